"""Benchmark decontamination by latent semantic retrieval.

1. Every document becomes its words' 16-bit hashes, written once. Words are runs of letters, digits and bytes beyond ASCII,
   in lower case. Items of fewer than LEAST words are too short for a passage's meaning: they leak where a text holds
   all their words in a row, by 64-bit hashes of word runs. A bitmap of fixed size picks the runs that may be an
   item's, and a join on the whole hash decides.
2. Statistics: over all passages of PASSAGE words, the benchmark's among them, document frequencies of FEATURES hashed
   terms; then one pass of a randomised SVD of their TF-IDF matrix A: the partitions' shares of A'(A R), R random, are
   summed, and the Nystroem form of that sketch gives the right singular vectors V and values s of the best RANK.
3. Search: windows of each size class slide over every document, each by a third of its length; windows and benchmark
   items meet in the whitened latent space (rows of V scaled by 1/s), tile by tile, and pairs with a cosine of COSINE or
   more are candidates. An item is sought by windows of the largest class that isn't longer than it (the smallest class
   for shorter items).
   A candidate goes if the stretch that step 4 reads around it holds under PARA of the item's words: it can't leak.
4. Check: the longest common subsequence of the item and the document around the window, over the item's length. A
   candidate leaks if that is FULL or more, or if it is PARA or more and the answer, the item's last words (a fifth,
   three at least), is found too: ANSWER of them in order.

Items are sought in blocks of BLOCK, one after the other, each of which is broadcast and then given up: a bound on what
executors hold, whatever the size of the benchmark. Documents are searched in pieces of AT_ONCE words that overlap by
more than any stretch. What reaches the driver: FEATURES counts, a FEATURES x RANK matrix and a block of items.

Null and empty texts are clean. Repeated rows and null ids give a row each; items with equal texts are found alike,
items without words never. An empty benchmark finds nothing; an empty table of documents gives an empty result. Columns
other than doc_id, text and item_id are ignored by leaks(), carried along by without_leaks().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import hashed_words, mapped, rolled, staged, table, word_table

FEATURES = 1 << 12
RANK = 64
EXTRA = 8
STEP = 4
PASSAGE = 48
CLASSES = (8, 12, 16, 24, 32, 48, 64)
COSINE = 0.25
FULL, PARA, ANSWER = 0.8, 0.6, 0.6
LEAST = 6
BLOCK = 20_000
AT_ONCE = 1 << 17
BITMAP_BITS = 24
_SEED = 10
_COARSE, _LARGE, _MOST_CELLS = 8, 64, 1 << 26
_TILE_WINDOWS, _TILE_ITEMS = 8192, 128


_IS_WORD = word_table("".join(chr(i) for i in range(128) if not chr(i).isalnum()))


def short_ids(words: list[np.ndarray]) -> list[np.ndarray]:
    """16-bit hashes, from 1 on, of the words of each text."""
    return [np.maximum(h >> np.uint64(48), 1).astype(np.uint16) for h in words]


def column_ids(texts: pa.Array) -> list[np.ndarray]:
    return short_ids(hashed_words(texts, _IS_WORD))


def word_ids(text: str | None) -> np.ndarray:
    return column_ids(pa.array([text], pa.string()))[0]


def run_codes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of a text."""
    return rolled(h, n) + np.uint64(n) if len(h) >= n else h[:0]


class Bitmap:
    """Which runs may be those of short items: their number of words, and a bit for the low bits of each hash."""

    def __init__(self, codes: Iterator[tuple[int, int]]) -> None:
        self.bits, self.lengths = np.zeros(1 << (BITMAP_BITS - 3), np.uint8), set()
        for n, code in codes:
            self.lengths.add(n)
            low = code & ((1 << BITMAP_BITS) - 1)
            self.bits[low >> 3] |= 1 << (low & 7)

    def found(self, h: np.ndarray) -> np.ndarray:
        codes = np.unique(np.concatenate([h[:0], *(run_codes(h, n) for n in self.lengths)]))
        low = codes & np.uint64((1 << BITMAP_BITS) - 1)
        return codes[(self.bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0]


def encoded(rows: DataFrame, key: str, bitmap: Bitmap | None = None) -> DataFrame:
    """row (a number), k, w (word ids as bytes), n (words), runs: with a bitmap, the hashes of the runs it finds; without one, the hash of a whole text of under LEAST words."""

    def runs(h: np.ndarray) -> np.ndarray:
        if bitmap is not None:
            return bitmap.found(h) if bitmap.lengths else h[:0]
        return run_codes(h, len(h)) if 0 < len(h) < LEAST else h[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = hashed_words(b.column("text"), _IS_WORD)
            yield pa.record_batch([b.column("row"), b.column("k"), pa.array([w.tobytes() for w in short_ids(words)], pa.binary()), pa.array([len(w) for w in words], pa.int64()), pa.array([runs(w).view(np.int64) for w in words], pa.list_(pa.int64()))], names=["row", "k", "w", "n", "runs"])

    return mapped(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("k"), "text"), run, "row long, k long, w binary, n long, runs array<long>")


def _joined(batches: Iterator[pa.RecordBatch], overlap: int = 0) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Word ids of many rows in one array, each row filled up with 0 to a multiple of STEP; rows' numbers, and where each
    starts. A row of more than AT_ONCE words comes in pieces, each under the row's number and overlapping the next."""
    rows, parts, starts, n = [], [], [], 0
    size = max(AT_ONCE, 4 * overlap) // PASSAGE * PASSAGE
    step = (size - overlap) // PASSAGE * PASSAGE
    for b in batches:
        keys, words = b.column("row"), b.column("w")
        for i in range(b.num_rows):
            whole = np.frombuffer(words[i].as_py(), np.uint16)
            for at in range(0, max(1, len(whole) - overlap), step):
                w = whole[at : at + size]
                fill = -len(w) % STEP
                rows.append(keys[i].as_py())
                starts.append(n)
                parts += [w, np.zeros(fill, np.uint16)]
                n += len(w) + fill
                if n >= size:
                    yield rows, np.concatenate(parts), np.array(starts)
                    rows, parts, starts, n = [], [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.array(starts)


def _feature(w: np.ndarray) -> np.ndarray:
    """Term of each word; the last one stands for no word."""
    return np.where(w > 0, w % np.uint16(FEATURES), FEATURES).astype(np.int32)


def _block_sums(rows: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sum of the rows of each STEP terms."""
    out = np.empty((len(f) // STEP, rows.shape[1]), rows.dtype)
    for lo in range(0, len(out), 1024):
        part = f[lo * STEP : (lo + 1024) * STEP]
        np.take(rows, part[::STEP], axis=0, out=(o := out[lo : lo + 1024]))
        for i in range(1, STEP):
            o += rows[part[i::STEP]]
    return out


def _passages(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of each word's passage: PASSAGE words from its document's start on."""
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
    within = np.arange(len(f)) - starts[doc]
    new = within % PASSAGE == 0
    return np.cumsum(new) - 1


def frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and passages in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for _, w, starts in _joined(batches):
            if not len(w):
                continue
            f = _feature(w)
            p = _passages(f, starts)
            pairs = np.sort((p * (FEATURES + 1) + f).astype(np.int32))
            once = pairs[np.append(True, pairs[1:] != pairs[:-1])] % (FEATURES + 1)
            df += np.bincount(once, minlength=FEATURES + 1)
            n += int(p[-1]) + 1
        df[FEATURES] = n  # in the place of no term
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], names=["f", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in mapped(words, run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # a row for each term
        out[r["f"]] = r["n"]
    return out[:FEATURES], int(out[FEATURES])


def latent_space(words: DataFrame, rank: int = RANK) -> np.ndarray:
    """FEATURES + 1 rows: each term's idf times its place in the whitened latent space (zero for no term)."""
    df, n = frequencies(words)
    idf = np.append(np.where(df > 0, np.log((n + 1) / (df + 0.5)), 0.0).clip(0), 0.0).astype(np.float32)
    r = rank + EXTRA
    probe = np.random.default_rng(_SEED).normal(size=(FEATURES + 1, r)).astype(np.float32)
    probe[FEATURES] = 0
    weighted = idf[:, None] * probe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, r), np.float64)
        for _, w, starts in _joined(batches):
            if not len(w):
                continue
            f = _feature(w)
            p = _passages(f, starts)
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            sums = _block_sums(weighted, f)  # passages start where blocks do
            z = np.add.reduceat(sums, first // STEP, axis=0)  # A R, a row a passage
            z /= np.maximum(np.add.reduceat(idf[f] ** 2, first), 1e-6)[:, None]  # passages have unit length on either side
            order = np.argsort(f.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
            for lo in range(0, len(order), 8192):  # terms in order, a few at a time
                part = order[lo : lo + 8192]
                fs = f[part]
                at = np.flatnonzero(np.append(True, fs[1:] != fs[:-1]))
                total[fs[at]] += np.add.reduceat(z[p[part]], at, axis=0) * idf[fs[at]][:, None]
        rows = np.flatnonzero(np.abs(total[:FEATURES]).sum(1))
        yield pa.record_batch([pa.array(rows), *(pa.array(total[rows, j]) for j in range(r))], names=["f", *(f"x{j}" for j in range(r))])

    parts = mapped(words, run, "f long, " + ", ".join(f"x{j} double" for j in range(r)))
    y = np.zeros((FEATURES, r))
    for row in parts.groupBy("f").agg(*(F.sum(f"x{j}").alias(f"x{j}") for j in range(r))).collect():  # FEATURES rows at most
        y[row["f"]] = row[1:]
    return idf[:, None] * np.vstack([whitened(y, probe[:FEATURES].astype(np.float64), rank), np.zeros((1, rank))]).astype(np.float32)


def whitened(y: np.ndarray, probe: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors over singular values of A, from y = A'A probe, by the stabilised Nystroem form; directions without weight are zero."""
    shift = 1e-6 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * probe
    core = probe.T @ y
    vals, vecs = np.linalg.eigh((core + core.T) / 2)
    good = vals > max(vals.max(), 0) * 1e-10
    b = y @ (vecs[:, good] / np.sqrt(vals[good]))
    v, s, _ = np.linalg.svd(b, full_matrices=False)
    s2 = np.maximum(s**2 - shift, 0)[:rank]
    v = v[:, :rank]
    scale = np.where(s2 > s2.max(initial=0) * 1e-6, 1 / np.sqrt(np.maximum(s2, 1e-30)), 0)
    out = np.zeros((len(y), rank))
    out[:, : v.shape[1]] = v * scale
    return out


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def leak(item: np.ndarray, around: np.ndarray) -> float | None:
    """Share of the item that the text around a window holds in order; None if it is no leak."""
    m = len(item)
    share = lcs(item, around) / m
    if share < PARA:
        return None
    if share >= FULL:
        return share
    answer = item[-max(3, m // 5) :]
    return share if lcs(answer, around) >= ANSWER * len(answer) else None


class _Sought:
    """Where in an array of word ids a stretch may hold PARA of an item's words: first by large blocks, which tell for all items' words at once where each occurs, then by small ones."""

    def __init__(self, w: np.ndarray, number: np.ndarray, words: int) -> None:
        """number: of each of the items' words, -1 for other words."""
        self.columns = np.append(w, np.zeros(-len(w) % _COARSE, np.uint16)).reshape(-1, _COARSE).T.astype(np.intp, order="C")
        self.table = np.zeros(1 << 16, np.uint64)
        self.large = _LARGE
        while words * (len(w) // self.large + 1) > _MOST_CELLS:
            self.large *= 2
        self.held = {1: np.zeros((words, len(w) // self.large + 1), np.uint8)}
        at = np.flatnonzero(number[w] >= 0)
        self.held[1][number[w[at]], at // self.large] = 1

    def _together(self, n: int) -> np.ndarray:
        """Which words occur in n large blocks from each on."""
        if n not in self.held:
            less = self._together(n - 1)
            out = less.copy()
            out[:, : -(n - 1)] |= self.held[1][:, n - 1 :]
            self.held[n] = out
        return self.held[n]

    def may_leak(self, item: np.ndarray, numbers: np.ndarray, reach: int, at: np.ndarray) -> np.ndarray:
        """The places from which on stretches of `reach` words may hold enough of the item; repeated words count as held. numbers: of its different words."""
        least = PARA * len(item) - (len(item) - len(numbers))
        held = self._together(min(-(-reach // self.large) + 1, self.held[1].shape[1]))[numbers].sum(axis=0, dtype=np.int32)
        at = at[held[np.maximum(at, 0) // self.large] >= least]
        return at[self._closer(item, reach, at) >= least] if len(at) else at

    def _closer(self, item: np.ndarray, reach: int, at: np.ndarray) -> np.ndarray:
        """How many of the item's different words occur in the small blocks around each stretch. A bit stands for a word."""
        words = np.unique(item)
        size = -(-reach // _COARSE) + 1
        power = size.bit_length() - 1
        held = np.zeros(len(at), np.int64)
        lo = np.maximum(at, 0) // _COARSE
        for i in range(0, len(words), 64):
            part = words[i : i + 64]
            self.table[part] = np.uint64(1) << np.arange(len(part), dtype=np.uint64)
            bits = np.append(np.bitwise_or.reduce(self.table[self.columns], axis=0), np.zeros(size, np.uint64))
            self.table[part] = 0
            for p in range(power):
                bits[: len(bits) - (1 << p)] |= bits[1 << p :]
            held += np.bitwise_count(bits[lo] | bits[lo + size - (1 << power)])
        return held


class _Items:
    """A block of the benchmark, ready to be sought: by class, unit vectors and numbers of items."""

    def __init__(self, rows: list[tuple[int | None, np.ndarray]], space: np.ndarray) -> None:
        self.rows, self.space, self.by = rows, space, {}
        self.longest = max((len(w) for _, w in rows), default=0)
        words = np.unique(np.concatenate([np.zeros(0, np.uint16), *(w for _, w in rows)]))
        self.number = np.full(1 << 16, -1, np.int32)
        self.number[words] = np.arange(len(words))
        self.words = len(words)
        self.numbers = [self.number[np.unique(w)] for _, w in rows]
        size = np.array([max([c for c in CLASSES if c <= len(w)], default=CLASSES[0]) for _, w in rows])
        for c in CLASSES:
            if len(at := np.flatnonzero(size == c)):
                v = np.stack([space[_feature(rows[i][1])].sum(0) for i in at])
                self.by[c] = ((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32), at)

    def _near(self, before: np.ndarray, c: int, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """before: sums of all blocks before each. For each item of a class: its number there and the first blocks of the windows whose cosine reaches COSINE. A tile of windows and items is compared at a time."""
        k, n = c // STEP, len(before) - 1
        hop = max(1, k // 3)
        for lo in range(0, len(vectors), _TILE_ITEMS):
            some, wins, nums = vectors[lo : lo + _TILE_ITEMS], [], []
            for at in range(0, n, hop * _TILE_WINDOWS):
                ends = before[np.minimum(np.arange(at, min(n, at + hop * _TILE_WINDOWS), hop) + k, n)]
                sums = ends - before[at : min(n, at + hop * _TILE_WINDOWS) : hop]
                near = some @ sums.T >= COSINE * np.sqrt(np.einsum("ij,ij->i", sums, sums))
                i, x = np.divmod(np.flatnonzero(near).astype(np.int32), len(sums))
                nums.append(i)
                wins.append(x * hop + at)
            i, x = np.concatenate(nums), np.concatenate(wins)
            order = np.argsort(i, kind="stable") if len(nums) > 1 else np.arange(len(i))
            cut = np.searchsorted(i[order], np.arange(len(some) + 1))
            for j in range(len(some)):
                if cut[j] < cut[j + 1]:
                    yield lo + j, x[order[cut[j] : cut[j + 1]]]

    def found(self, w: np.ndarray, starts: np.ndarray) -> dict[int, dict[int, float]]:
        """Of the rows in the array: row's place -> item -> share."""
        out: dict[int, dict[int, float]] = {}
        if not len(w):
            return out
        blocks = _block_sums(self.space, _feature(w))
        before = np.concatenate([np.zeros((1, blocks.shape[1]), np.float32), np.cumsum(blocks, axis=0)])
        sought, ends = _Sought(w, self.number, self.words), np.append(starts[1:], len(w))
        for c, (vectors, members) in self.by.items():
            for j, first in self._near(before, c, vectors):
                i = int(members[j])
                item, m = self.rows[i][1], len(self.rows[i][1])
                at = sought.may_leak(item, self.numbers[i], c + 2 * m, first * STEP - m)
                if len(at):
                    self._check(i, item, c, at + m, w, starts, ends, out)
        return out

    def _check(self, i: int, item: np.ndarray, c: int, b: np.ndarray, w: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: dict) -> None:
        """Read the stretches around windows of c words from each place of b on, in each row they reach into."""
        words, times = np.unique(item, return_counts=True)
        m = len(item)
        place = np.full(1 << 16, -1, np.int32)
        place[words] = np.arange(len(words))
        low = np.searchsorted(starts, b, side="right") - 1
        high = np.searchsorted(starts, np.minimum(b + c, len(w)) - 1, side="right") - 1
        for x, d0, d1 in zip(b.tolist(), low.tolist(), high.tolist(), strict=True):
            for d in range(d0, d1 + 1):
                had = out.get(d, {}).get(i, 0.0)
                lo, hi = max(starts[d], x - m), min(ends[d], x + c + m)
                if had >= 1 or lo >= hi:
                    continue
                part = place[w[lo:hi]]
                part = part[part >= 0]
                if np.minimum(np.bincount(part, minlength=len(words)), times).sum() < PARA * m:
                    continue  # leak() wants as many in order
                share = leak(item, words[part])
                if share is not None:
                    out.setdefault(d, {})[i] = max(share, had)


def _sought_in(words: DataFrame, rows: list[tuple[int | None, np.ndarray]], space: np.ndarray) -> DataFrame:
    """row, item_ids, share of the rows in which items of a block are found; a long row may come more than once. Written."""
    held = words.sparkSession.sparkContext.broadcast(_Items(rows, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for numbers, w, starts in _joined(batches, 2 * (CLASSES[-1] + 2 * items.longest)):
            found = sorted(items.found(w, starts).items())
            ids = [sorted({items.rows[i][0] for i in x if items.rows[i][0] is not None}) for _, x in found]
            yield pa.record_batch([pa.array([numbers[d] for d, _ in found], pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array([max(x.values()) for _, x in found], pa.float64())], names=["row", "item_ids", "share"])

    out = staged(mapped(words.select("row", "w"), run, "row long, item_ids array<long>, share double"))
    held.destroy()
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """A row for each document: doc_id, contaminated, item_ids (ordered), share (the greatest found; 0 if clean)."""
    items = staged(encoded(benchmark, "item_id"))
    short = items.filter(F.size("runs") > 0).select("n", F.get("runs", F.lit(0)).alias("code"), F.col("k").alias("item"))
    words = staged(encoded(documents, "doc_id", Bitmap((r["n"], r["code"]) for r in short.toLocalIterator())))
    long = items.filter(F.col("n") >= LEAST)
    parts = -(-long.count() // BLOCK)
    space = latent_space(words.select("row", "w").union(items.select("row", "w")), rank) if parts else None
    dealt = long.select("k", "w", F.pmod(F.xxhash64("k", "w"), F.lit(max(1, parts))).alias("part"))
    finds = short.join(words.select("row", F.explode("runs").alias("code")), "code").select("row", F.array_compact(F.array("item")).alias("item_ids"), F.lit(1.0).alias("share"))
    for part in range(parts):
        block = [(r["k"], np.frombuffer(r["w"], np.uint16)) for r in dealt.filter(F.col("part") == part).collect()]  # about BLOCK items
        finds = finds.union(_sought_in(words, block, space))
    hits = finds.groupBy(F.col("row").alias("r")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("share").alias("share"))
    out = words.select("row", "k").join(hits, F.col("row") == F.col("r"), "left")
    return out.select(F.col("k").alias("doc_id"), F.col("share").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found, with all their columns. Rows are told apart by id and text together."""
    row_id = F.xxhash64(F.col("doc_id").cast("long"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    bad = leaks(documents.select(row_id.alias("doc_id"), "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    bad = staged(bad)
    rows = documents.select(F.struct("*").alias("row"), row_id.alias("id"))
    return rows.join(bad, F.col("id") == F.col("_bad"), "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
