"""Checks over a source and its redacted form. Each returns the rows that offend; report() sums them up.

Texts are units (k, text) before and after; maps are the mapping (ptype, original, fake); parts are (path, part, xml)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright import vocabulary as v
from maskwright.operators.rewrite import word_runs


def part_parity(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, part, state: parts that the result lacks (missing) or has beside those of the source (added)."""
    a, b = (x.select("path", "part").distinct() for x in (before, after))
    return a.exceptAll(b).withColumn("state", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("state", F.lit("added")))


def structure(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, part, tag, before, after: elements whose number changed, of parts that both have."""
    counts = lambda xml: F.array(*[F.struct(F.lit(t).alias("tag"), F.regexp_count(xml, F.lit(rf"<w:{t}(?=[\s/>])")).alias("n")) for t in v.STRUCTURE_TAGS])
    tags = lambda df, n: df.select("path", "part", F.inline(counts(F.col("xml")))).withColumnRenamed("n", n)
    return tags(before, "before").join(tags(after, "after"), ["path", "part", "tag"]).filter("before <> after")


def _tolerant(value: Column) -> Column:
    """A pattern of the value's words with any white space and commas, or none, between them."""
    words = F.filter(F.split(value, r"[\s\u00a0,]+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.array_join(quoted, r"[\s\u00a0,]*")


def residual(after: DataFrame, maps: DataFrame) -> DataFrame:
    """k, ptype, original, state: originals of four letters and digits or more that a text still holds, in any case and however spaced.

    state is "prose" where a preposition leads up to the first occurrence and no number does, else "leak". Runs of as many
    words as the originals have meet them in a join, and only texts that share one are searched."""
    runs_of = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z]+"), F.lit(0))
    values = maps.select("ptype", "original").distinct().filter(F.length(F.regexp_replace("original", "[^0-9A-Za-z]", "")) >= 4)
    values = values.withColumn("run", F.array_join(runs_of("original"), " "))
    sizes = sorted(r[0] for r in values.select(F.size(F.split("run", " "))).distinct().collect())  # word numbers, a few
    runs = after.select("k", F.explode(F.array_distinct(F.transform(word_runs(F.col("text"), sizes), lambda r: r["run"]))).alias("run"))
    met = runs.join(values, "run").join(after.select("k", F.col("text").alias("_text")), "k")
    before = F.call_function("regexp_extract", F.col("_text"), F.concat(F.lit("(?is)^(.*?)(?:"), _tolerant(F.col("original")), F.lit(")")), F.lit(1))
    held = met.filter(F.regexp_like("_text", F.concat(F.lit("(?is)"), _tolerant(F.col("original")))))
    held = held.withColumn("_before", F.substring(before, -60, 60))
    number = F.col("_before").rlike(r"\d{3}\s?\d{3}\s*[-,]?\s*$") | F.col("_before").rlike(r"\d{1,4}\s*[-,]\s*$")
    prose = ~number & F.regexp_replace("_before", r"\(+$", "").rlike(v.PROSE_BEFORE)
    return held.select("k", "ptype", "original", F.when(prose, "prose").otherwise("leak").alias("state"))


def foreign_domains(after: DataFrame, show: int = 3) -> DataFrame:
    """domain, n: the most frequent domains of e-mail addresses that are no reserved ones."""
    found = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]*+(?:\.[A-Za-z0-9\-]++)++"), F.lit(0))
    domains = after.select(F.explode(found).alias("m")).select(F.lower(F.split_part("m", F.lit("@"), F.lit(-1))).alias("domain"))
    return domains.filter(~F.col("domain").isin(*v.RESERVED_DOMAINS)).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(show)


def shape(maps: DataFrame) -> DataFrame:
    """ptype, original, fake: substitutes that can't stand in their original's place. One of several spellings is held to the widest of them in words, an address to the shortest."""
    one = W.partitionBy("ptype", F.regexp_replace(F.lower("original"), "[^0-9a-z]", ""))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    local = lambda c: F.length(F.split_part(c, F.lit("@"), F.lit(1)))
    out = maps.select("ptype", "original", "fake").withColumn("_widest", F.max(words("original")).over(one)).withColumn("_shortest", F.min(F.length("original")).over(one))
    bad = F.when(F.col("ptype").isin("PHONE", "DIN"), digits("fake") != digits("original"))
    bad = bad.when(F.col("ptype") == "EMAIL", (F.regexp_count("fake", F.lit("@")) != 1) | (local("fake") > local("original")))
    bad = bad.when(F.col("ptype").isin("PERSON_NAME", "COMPANY"), words("fake") > F.col("_widest"))
    bad = bad.when(F.col("ptype") == "ADDRESS", F.length("fake") > F.col("_shortest")).otherwise(False)
    return out.filter(bad).drop("_widest", "_shortest")


def two_fakes(maps: DataFrame) -> DataFrame:
    """original, fakes: originals with more than one substitute."""
    return maps.groupBy("original").agg(F.countDistinct("fake").alias("fakes")).filter("fakes > 1")


def shared_fakes(maps: DataFrame) -> DataFrame:
    """ptype, fake, originals: substitutes that several originals share (reported, not wrong)."""
    return maps.groupBy("ptype", "fake").agg(F.countDistinct("original").alias("originals")).filter("originals > 1")


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: part, idx, text. part, idx, old, new of parts with as many units on either side; others can't be paired."""
    sizes = lambda df, n: df.groupBy(F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias(n))
    even = sizes(before, "a").join(sizes(after, "b"), "_part").filter("a = b").select("_part")
    rows = before.select("part", "idx", F.col("text").alias("old")).join(after.select("part", "idx", F.col("text").alias("new")), ["part", "idx"])
    return rows.join(even, F.col("part").eqNullSafe(F.col("_part")), "left_semi")


def doubled_blanks(pairs: DataFrame) -> DataFrame:
    """pairs: with old and new. Those with more runs of blanks than before, and how many more (added)."""
    n = lambda c: F.regexp_count(c, F.lit(r"[ \u00a0]{2,}"))
    return pairs.withColumn("added", n("new") - n("old")).filter("added > 0").drop("old", "new")


def grown(pairs: DataFrame, most: int = 8) -> DataFrame:
    """pairs: with old and new. Those that grew by more than `most` characters (growth)."""
    return pairs.withColumn("growth", F.length("new") - F.length("old")).filter(F.col("growth") > most).drop("old", "new")


def differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of either of two runs that the other lacks, with side. Texts are compared by digest."""
    digest = lambda df: df.select("k", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"))
    a, b = digest(one), digest(two)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def wrong_sources(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files: path, content; expected: path, sha256. Files whose content isn't the expected one, with its digest."""
    real = files.select("path", F.sha2("content", 256).alias("found"))
    return real.join(expected, "path").filter(F.col("found") != F.lower("sha256")).select("path", "found")


def report(checks: dict[str, DataFrame], show: int = 3) -> DataFrame:
    """name, ok, offenders, examples: a row for each check, from the rows that offend; the first few of them are shown."""
    out = None
    for name, bad in checks.items():
        text = F.to_json(F.struct("*")).alias("e")
        rows = bad.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).cast("string").alias("e"))
        rows = rows.union(bad.select(text).orderBy("e").limit(show).select(F.lit(0).cast("long"), "e"))
        row = rows.agg(F.sum("n").alias("offenders"), F.array_sort(F.collect_list("e")).alias("examples")).select(F.lit(name).alias("name"), (F.col("offenders") == 0).alias("ok"), "offenders", F.array_join("examples", " ").alias("examples"))
        out = row if out is None else out.union(row)
    return out
