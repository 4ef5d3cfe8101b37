"""What the operators of this subpackage share: scratch tables, fixed-seed word hashing, table loading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from maskwright.shipping import ship

#: What counts as white space between words.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STRETCH = 1 << 19
BATCH_ROWS = 2000


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a folder of our own on a local master, and an error on any other."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        root = _own[app]
    return f"{root.rstrip('/')}/maskwright-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: cuts lineage and outlives any executor. dropped() deletes it."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in slices of BATCH_ROWS rows, after making sure that Python workers can import this package."""
    ship(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(sliced, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, STRETCH), base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def _stretches(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that cut no word: whole rows together, or parts of a long row."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = int(offsets[np.searchsorted(offsets, lo + STRETCH, side="right") - 1])
        if hi <= lo:  # a row longer than a stretch
            stop = int(offsets[np.searchsorted(offsets, lo, side="right")])
            hi = min(lo + STRETCH, stop)
            while hi < stop and is_word[data[hi - 1]] and is_word[data[hi]]:
                part = np.flatnonzero(~is_word[data[hi : hi + STRETCH]])
                hi = min(stop, hi + (int(part[0]) if len(part) else STRETCH))
        yield lo, hi
        lo = hi


def word_table(separators: str) -> np.ndarray:
    """Which UTF-8 bytes belong to words, given the ASCII characters that don't."""
    t = np.ones(256, bool)
    t[list(separators.encode("ascii"))] = False
    return t


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column's texts in lower case, and where each text starts and the last ends; a null has none."""
    col = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    _, off, raw = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


class Spelt:
    """A stretch of a column's bytes and the words in it. A word is a longest run of word bytes; rows end words, and no word is cut.

    The hash of any bytes is the difference of two running sums over the stretch, shifted to their start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lo: int, hi: int) -> None:
        self.d, self.offsets, self.lo = data[lo:hi], offsets, lo
        w = is_word[self.d]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        inner = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi, side="left")] - lo
        first[inner], last[inner - 1] = w[inner], w[inner - 1]
        self.s, self.e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, self.inverse = _power(len(self.d) + 1)
        self.sums = np.zeros(len(self.d) + 1, np.uint64)
        np.cumsum((self.d.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    @classmethod
    def stretches(cls, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Iterator["Spelt"]:
        return (cls(data, offsets, is_word, lo, hi) for lo, hi in _stretches(offsets, data, is_word))

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((self.sums[e] - self.sums[s]) * self.inverse[s])

    def counts(self, s: np.ndarray) -> np.ndarray:
        """Words of each text, given where they start."""
        return np.bincount(np.searchsorted(self.offsets, s + self.lo, side="right") - 1, minlength=len(self.offsets) - 1)

    def trimmed(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words without marks at either end, those of marks alone left out."""
        at = np.arange(len(self.d))
        keep = ~marks[self.d]
        after = np.minimum.accumulate(np.where(keep, at, len(at))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(keep, at, -1)) + 1
        s, e = after[self.s], before[self.e - 1]
        return s[s < e], e[s < e]


def hashed_words(texts: pa.Array, is_word: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the words of each text in order, in lower case; a null has none."""
    data, offsets = column_bytes(texts)
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for part in Spelt.stretches(data, offsets, is_word):
        out.append(part.hashes(part.s, part.e))
        counts += part.counts(part.s)
    return np.split(np.concatenate(out), np.cumsum(counts)[:-1]) if len(texts) else []


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours; of the whole where there are fewer than k."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + len(out)]
    return mix64(out)


def occurrence_labels(h: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of each value from the left, 1 for the second, and so on."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    starts = np.flatnonzero(new)
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty(len(s), np.int64)
    out[order] = rank
    return out
