"""Mix sources to target weights: weighted sampling without replacement by exponential keys, in DataFrame operations only.

Every document draws a key -ln(u) / w, where u is a hash of the row and w its quality weight; a source is read in
the order of these keys. The weight is lower for short texts, for texts of digits and marks, and for texts that repeat their words. A source whose target is e times its size and a rest gives e complete epochs first; the
rest is the fractional selection, the documents at the front of that order up to the rest of the budget.

The order inside a source is never sorted in one task. A histogram of words by (source, key range) gives the words
before each range; only rows of one range are sorted together. Ranges of one source lie in different tasks, so a
source that holds most rows is dealt out like the others; there is a range for every RANGE_ROWS rows, LEAST_RANGES at least.

Null texts have size 0; a null source is a source of its own, last in rank; null and repeated ids are rows like any
other (rows equal in id and size draw equal keys and are interchangeable). Empty tables give empty results. Columns
other than those named are ignored by mix(), and carried along by resample() under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import staged, table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
RANGE_ROWS = 50_000
LEAST_RANGES = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A weight from 0.01 to 1: texts of under 50 words, of digits and marks, or of repeated words are drawn later."""
    marks = F.regexp_count(text, F.lit(r"[!-@\[-`{-~]")) / F.length(text)

    def weight(words: Column) -> Column:
        size = F.size(words)
        long = F.least(F.lit(1.0), (size + 1) / F.lit(50.0))
        varied = F.least(F.lit(1.0), F.size(F.array_distinct(words)) * 4.0 / size)
        return F.when(size > 0, F.greatest(F.lit(0.01), long * varied * (F.lit(1.0) - marks))).otherwise(F.lit(0.01))

    # bound to a variable, so that the words are taken out once
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.get(F.transform(F.array(words), weight), F.lit(0))


def _ranges(rows: int) -> int:
    return max(LEAST_RANGES, rows // RANGE_ROWS)


def _drawn(docs: DataFrame, weights: tuple, cap: int, seed: str, ranges: int) -> DataFrame:
    """docs: doc_id, source, size, quality and what else there is. Adds target, epochs, rest (words of the fractional selection) and before (words of its source ahead of it)."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    docs = docs.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).withColumn("key", -F.log(u) / F.col("quality"))
    docs = docs.withColumn("rng", F.floor(F.col("key") / (F.col("key") + 1) * ranges).cast("int"))
    hist = docs.groupBy("skey", "rng").agg(F.sum("size").alias("words"))
    sources = hist.groupBy("skey").agg(F.sum("words").alias("s"))
    everything = W.partitionBy()
    cycle = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(everything.orderBy(F.col("skey") == "", "skey")) - 1) % len(weights) + 1)
    ranked = sources.withColumn("w", cycle).withColumn("cap", F.col("s") * F.lit(float(cap))).withColumn("c", F.col("cap") / F.col("w"))
    ahead = everything.orderBy("c", "skey").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("s").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    # the first source in the order of cap / weight that the level doesn't fill sets the level of all that aren't full
    at = F.min(F.when(F.col("level") <= F.col("c"), F.struct("c", "skey", "level"))).over(everything)["level"]
    targets = levels.withColumn("target", F.least(F.col("cap"), F.coalesce(at * F.col("w"), F.col("cap")))).select("skey", "s", "target")
    targets = targets.withColumn("epochs", F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("s")).cast("long"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = hist.withColumn("start", before).join(targets, "skey").select("skey", "rng", "start", "s", "target", "epochs", "rest")
    own = W.partitionBy("skey", "rng").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return docs.join(starts, ["skey", "rng"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(own), F.lit(0)))


def mix(documents: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED, quality=text_quality) -> DataFrame:
    """Words to take of each document. The document in which the rest of the budget ends gives its first words only, so a source's words equal its rounded target."""
    docs = staged(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality(F.col("text")).alias("quality")))  # texts are read once
    drawn = _drawn(docs, weights, cap, seed, _ranges(docs.count()))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return drawn.select("doc_id", "size", F.col("s").alias("source_size"), "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "source", F.col("epochs"), F.col("key").alias("draw_key"))


def resample(documents: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED, quality=text_quality) -> DataFrame:
    """The mixed corpus itself: whole documents, as often as the mix takes them. The document in which the rest of the budget ends is taken if over half of it fits."""
    # taken out of an array of one element, so that the optimiser doesn't copy the counts into all that uses them
    counts = F.array(F.struct(word_count(F.col("text")).alias("size"), quality(F.col("text")).alias("quality")))
    docs = documents.select(F.struct("*").alias("row"), "doc_id", "source", F.inline(counts))
    drawn = _drawn(docs, weights, cap, seed, _ranges(documents.count()))
    copies = F.col("epochs") + F.when(F.col("before") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    return drawn.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), q AS (
  SELECT doc_id, source, len(words)::BIGINT AS size, CASE WHEN len(words) > 0 THEN greatest(0.01::DOUBLE,
    least(1.0::DOUBLE, (len(words) + 1) / 50.0::DOUBLE) * least(1.0::DOUBLE, len(list_distinct(words)) * 4.0::DOUBLE / len(words))
    * (1.0::DOUBLE - len(regexp_extract_all(text, '[!-@\[-`{{-~]')) / length(text)::DOUBLE)) ELSE 0.01::DOUBLE END AS quality FROM d
), k AS (
  SELECT *, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / quality AS key FROM q
), s AS (SELECT source, sum(size)::DOUBLE AS s FROM q GROUP BY source
), r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3 * s AS cap FROM s
), l AS (
  SELECT *, cap / w AS c, (sum(s) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS lvl FROM r
  WINDOW p AS (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, s, least(cap, coalesce((SELECT lvl FROM l WHERE lvl <= c ORDER BY c, source NULLS FIRST LIMIT 1) * w, cap)) AS target FROM l
), e AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs FROM t
), b AS (
  SELECT k.*, e.s, e.target, e.epochs, round(e.target - e.epochs * e.s) AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, s::BIGINT AS source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM b
"""
