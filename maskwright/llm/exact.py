"""Exact deduplication by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of the last bytes has zero low bits, so that equal
stretches give equal chunks wherever they stand. Chunks are deduplicated into a dictionary of identifiers: a chunk is
looked up by a SHA-256 prefix and verified by a second hash and its length, so two chunks that agree in the prefix
alone get identifiers of their own. Only chunks that occur twice are in it, for a text with any other chunk has no
equal. Two texts are equal if their ordered lists of identifiers are: nothing else groups them, and text_sha256 is an
output. Long texts are read once where they lie; what moves is 28 bytes a chunk, then 8.

A null text counts as empty; empty texts equal each other (empty lists). Ties in length go to the smallest id, null
ids come last. Repeated rows are members like any other (the row that stays is unique by id; rows repeating that id
share its flag). Empty tables give empty results, columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import SPACE, mapped, staged, table

MASK_BITS = 11
MIN_CHUNK = 512
MAX_CHUNK = 16384
ID_BYTES = 16
PROOF_BYTES = 12
_DROP = dict.fromkeys(map(ord, SPACE))
_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 2**32, 256, dtype=np.uint32)


def normal(text: str | None) -> bytes:
    return (text or "").translate(_DROP).encode("utf-8", "surrogatepass")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: content-defined, at least MIN_CHUNK and at most MAX_CHUNK bytes long (but for the last)."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # after these, h holds the hash of the last 16 bytes
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at = [], 0
    for m in marks.tolist():
        while m - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
        if m - at >= MIN_CHUNK and m < n:
            out.append(m)
            at = m
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        out.append(at)
    return [*out, n]


def recipe(data: bytes) -> list[bytes]:
    """Identifiers of the chunks in order; each is ID_BYTES of SHA-256, then 8 bytes of a second hash, then the length."""
    out, at = [], 0
    for end in cuts(data):
        c = data[at:end]
        out.append(hashlib.sha256(c).digest()[:ID_BYTES] + xxhash.xxh64_digest(c) + len(c).to_bytes(4, "big"))
        at = end
    return out


_RECIPES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("text_sha256", pa.string()), ("chunks", pa.list_(pa.binary()))])


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column("text"):
            s = text.as_py()
            data = normal(s)
            rows.append((len(s or ""), hashlib.sha256(data).hexdigest(), recipe(data)))
        n, sha, chunks = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(chunks, pa.list_(pa.binary()))], schema=_RECIPES)


def recipes(documents: DataFrame) -> DataFrame:
    """doc_id, n (code points of the original text), text_sha256, chunks (ordered identifiers)."""
    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _recipes, "doc_id long, n long, text_sha256 string, chunks array<binary>")


def chunk_dictionary(occurrences: DataFrame) -> DataFrame:
    """occurrences: chunk (SHA-256 prefix), proof (second hash and length). An identifier for each pair of them that occurs more than once: chunk, proof, id."""
    repeated = occurrences.groupBy("chunk", "proof").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return staged(repeated.select("chunk", "proof", F.monotonically_increasing_id().alias("id")))


def identified(rows: DataFrame) -> DataFrame:
    """rows: row, doc_id, n, chunks. The rows all of whose chunks have an identifier, with their ordered list; rows without chunks have an empty one."""
    places = rows.select("row", "doc_id", "n", F.size("chunks").alias("size"), F.posexplode("chunks").alias("at", "c"))
    places = places.select("row", "doc_id", "n", "size", "at", F.substring("c", 1, ID_BYTES).alias("chunk"), F.substring("c", ID_BYTES + 1, PROOF_BYTES).alias("proof"))
    # a row's own chunks come from one row, so only they meet in a group; a chunk that many rows share is a join key, which Spark splits
    found = places.join(chunk_dictionary(places), ["chunk", "proof"])
    lists = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "id"))).alias("ids"))
    whole = lists.filter(F.size("ids") == F.col("size")).select("row", "doc_id", "n", F.col("ids.id").alias("list"))
    return whole.union(rows.filter(F.size("chunks") == 0).select("row", "doc_id", "n", F.array().cast("array<long>")))


def classes(rows: DataFrame) -> DataFrame:
    """rows: written recipes with a row number. row, keep_id, group_size and most (code points of the text that stays) of each row whose list occurs more than once."""
    listed = staged(identified(rows))
    best = F.struct(F.col("n").alias("n"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg"))
    groups = listed.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.max(best).alias("best")).filter("size > 1")
    # written, so that the join below deals out both its sides itself, and a large group's rows can be split
    groups = staged(groups.select(F.col("list").alias("l"), "size", F.col("best.n").alias("most"), (-F.col("best.neg")).alias("best_id")))
    return listed.join(groups, F.col("list") == F.col("l")).select(F.col("row").alias("r"), "size", "most", "best_id")


def deduplicate_recipes(rows: DataFrame) -> DataFrame:
    """rows: written recipes with a row number. doc_id, keep_id, group_size, kept, text_sha256."""
    joined = rows.join(classes(rows), F.col("row") == F.col("r"), "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    kept = F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n") == F.col("most")))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256. Groups: equal ordered lists of verified chunk identifiers."""
    return deduplicate_recipes(staged(recipes(documents).withColumn("row", F.monotonically_increasing_id())))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT *, first(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
