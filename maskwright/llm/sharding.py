"""Sharding by histogram sort: splitters from exact counts of bytes, then one exchange.

A row's sort key is 32 bits of its text's hash, then 31 bits of its id's hash: copies of a text lie together, and a
large group of them can still be cut. Splitters divide the key space at equal steps of bytes, a few bins to each
shard. Each round counts the exact bytes below every candidate boundary over all partitions; a splitter whose best
candidate misses its target by more than the tolerance gets new candidates inside the gap around the target, until
all are met or no key lies inside the gap. Rows are then exchanged once, by bin, and numbered in key order.

The law is "bytes": shards differ by the tolerance, or by the largest set of rows with one key (rows equal in text
and id share a key; they are the only rows that can't be parted). A row's size is its UTF-8 bytes plus 1, so null
and empty texts count too. Null ids are hashed as a value of their own. Empty tables give empty results. shard()
ignores other columns; with_shards() carries them along, under any names but those it adds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import staged, table
from maskwright.shipping import ship

SHARDS = 8
TOLERANCE = 0.0005
BIN_ROWS = 100_000
LEAST_BINS = 8
CANDIDATES = 4096


def _key(text, doc_id):
    return F.shiftrightunsigned(F.xxhash64(text), 32).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(1 << 31) + F.xxhash64(doc_id, F.lit(7)).bitwiseAND(F.lit(0x7FFFFFFF))


def _below(keyed: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe: one small row for each partition and gap between probes."""

    def count(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for pdf in batches:
            at = np.searchsorted(probes, pdf["k"].to_numpy(), side="right")
            np.add.at(size, at, pdf["size"].to_numpy())
            np.add.at(rows, at, 1)
        full = np.flatnonzero(rows)
        yield pd.DataFrame({"at": full, "size": size[full], "n": rows[full]})

    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in keyed.select("k", "size").mapInPandas(count, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():  # a row for each gap at most
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _between(lo: int, hi: int, m: int) -> np.ndarray:
    """Up to m keys at even steps strictly between two keys, the middle among them."""
    return np.array(sorted({lo + (hi - lo) * i // (m + 1) for i in range(1, m + 1)} | {lo + (hi - lo) // 2}), np.int64)


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, bin_rows: int = BIN_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Boundaries of the bins (a row lies in the bin numbered by the boundaries at or below its key), rows below each, and bins in a shard."""
    ship(keyed.sparkSession)
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bins = max(LEAST_BINS, -(-rows // (bin_rows * shards)))
    n = bins * shards
    goal = np.arange(1, n) * (total / n)
    slack = np.where(np.arange(1, n) % bins == 0, tolerance * total / shards, 0.05 * total / n)
    lo, hi = np.zeros(n - 1, np.int64), np.full(n - 1, 2**63 - 1, np.int64)  # lo's bytes are below the goal, hi's at it or above
    lo_b, hi_b, lo_r, hi_r = np.zeros(n - 1, np.int64), np.full(n - 1, total, np.int64), np.zeros(n - 1, np.int64), np.full(n - 1, rows, np.int64)
    while True:
        gap = np.unique(np.stack([lo, hi], 1)[(np.minimum(goal - lo_b, hi_b - goal) > slack) & (hi - lo > 1)], axis=0)
        if not len(gap):
            break
        m = max(2, CANDIDATES // len(gap))
        probes = np.unique(np.concatenate([_between(int(x), int(y), m) for x, y in gap]))
        b, r = _below(keyed, probes)
        at = np.searchsorted(b, goal, side="left")  # the first probe with the goal's bytes below it
        for j in range(n - 1):
            if at[j] < len(probes) and lo[j] < probes[at[j]] < hi[j]:
                hi[j], hi_b[j], hi_r[j] = probes[at[j]], b[at[j]], r[at[j]]
            if at[j] > 0 and lo[j] < probes[at[j] - 1] < hi[j]:
                lo[j], lo_b[j], lo_r[j] = probes[at[j] - 1], b[at[j] - 1], r[at[j] - 1]
    low = goal - lo_b <= hi_b - goal
    return np.where(low, lo, hi), np.where(low, lo_r, hi_r), bins


def _placed(keyed: DataFrame, cut: np.ndarray, below: np.ndarray, bins: int) -> DataFrame:
    """Adds shard and slot to rows with k; one exchange, by bin."""
    ship(keyed.sparkSession)
    starts = np.concatenate([[0], below])
    first = starts[np.arange(len(starts)) // bins * bins]

    @F.pandas_udf("struct<bin:int,shard:int,base:long>")
    def place(k: pd.Series) -> pd.DataFrame:
        b = np.searchsorted(cut, k.to_numpy(), side="right")
        return pd.DataFrame({"bin": b.astype(np.int32), "shard": (b // bins).astype(np.int32), "base": starts[b] - first[b]})

    rn = F.row_number().over(W.partitionBy("p.bin").orderBy("k", "id"))
    return keyed.withColumn("p", place("k")).withColumn("slot", F.col("p.base") + rn - 1).withColumn("shard", F.col("p.shard")).drop("p", "k", "id")


def shard(documents: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    rows = documents.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"), _key(F.col("text"), F.col("doc_id")).alias("k"))
    keyed = staged(rows.withColumn("id", F.col("doc_id")))  # the rounds read keys and sizes, not texts
    return _placed(keyed, *splitters(keyed, shards, tolerance)).select("doc_id", "size", "text_crc32", "shard", "slot")


def with_shards(documents: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents with columns shard and slot (which replace any of these names): the form to write out, partitioned by shard."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")
    key = _key(F.col("text"), F.col("doc_id")).alias("k")
    cut = splitters(staged(documents.select(size, key)), shards, tolerance)
    rows = documents.drop("shard", "slot")
    keyed = rows.select(F.struct("*").alias("row"), key, F.col("doc_id").alias("id"))
    return _placed(keyed, *cut).select("row.*", "shard", "slot")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
