"""Mapping and rewriting: one substitute for each distinct entity, spliced into the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.fakes import Fakes, match_case
from maskwright.functions.text import canonical, normalised
from maskwright.shipping import ship

KEYED = ("EMAIL", "URL", "PHONE", "COMPANY", "PERSON_NAME", "ADDRESS", "DIN", "SSN", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH")


def _entity(spans: DataFrame) -> Column:
    """What a span names: of a piece, the whole name."""
    return F.coalesce(F.col("whole.entity"), F.col("value")) if "whole" in spans.columns else F.col("value")


def with_keys(spans: DataFrame) -> DataFrame:
    """spans with key; spellings that mean one entity share it."""
    entity = normalised(_entity(spans))
    key = reduce(lambda rest, t: F.when(F.col("ptype") == t, canonical(t, F.col("_entity"))).otherwise(rest), ("PHONE", "CREDIT_CARD", "DATE_OF_BIRTH", "URL", "PERSON_NAME", "COMPANY"), canonical("EMAIL", F.col("_entity")))
    return spans.withColumn("_entity", entity).withColumn("key", key).drop("_entity")


def mapping(spans: DataFrame, fakes: Fakes | None = None) -> DataFrame:
    """ptype, key, original (the first spelling by unit and place), fake. Keyed on type and key, so equal keys of two types differ."""
    f = fakes or Fakes()
    ship(spans.sparkSession)
    first = with_keys(spans).groupBy("ptype", "key").agg(F.min_by(_entity(spans), F.struct("k", "start")).alias("original"))
    made = {"EMAIL": match_case(f.email(F.col("key")), F.col("original")), "URL": match_case(f.url(F.col("original")), F.col("original")), "PHONE": f.phone(f.subscriber(F.col("original")), F.col("original")), "COMPANY": F.col("company"), "PERSON_NAME": f.person(F.col("key"), F.col("original")), "ADDRESS": f.address(F.col("key"), F.col("original")), "DIN": f.din(F.col("key")), "SSN": f.ssn(F.col("key")), "CREDIT_CARD": f.card(F.col("key")), "IP_ADDRESS": f.ip(F.col("key")), "DATE_OF_BIRTH": f.birth_date(F.col("key"))}
    fake = reduce(lambda rest, t: F.when(F.col("ptype") == t, made[t]).otherwise(rest), KEYED, F.lit("[REDACTED]"))
    company = f.company(F.when(F.col("ptype") == "COMPANY", F.col("key")), F.col("original"))
    return first.withColumn("company", company).withColumn("fake", fake).drop("company")


def printed(fakes: Fakes, ptype: Column, value: Column, original: Column, fake: Column) -> Column:
    """A substitute as one occurrence shows it: phones in its layout, e-mails and web addresses in its capitals."""
    cased = match_case(F.lower(fake), value)
    return F.when(value == original, fake).when(ptype == "PHONE", fakes.phone(fakes.subscriber(original), value)).when(ptype.isin("EMAIL", "URL"), cased).otherwise(fake)


def spread(fake: Column, lengths: Column, piece: Column) -> Column:
    """The piece's share of a substitute, in proportion to the pieces' lengths; each gets a character at least, and the first all of one that is shorter than their number. The shares of all pieces make up the substitute."""
    n, size = F.size(lengths), F.length(fake)
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    ahead = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x)
    # a piece ends at its rounded share of the whole, as long as it leaves a character to each on either side
    cut = lambda i: F.greatest(i, F.least(size - (n - i), F.round(size * ahead(i) / total).cast("int")))
    share = F.substring(fake, cut(piece) + 1, cut(piece + 1) - cut(piece))
    return F.when(size >= n, share).when(piece == 0, fake).otherwise("")


def edits_of(spans: DataFrame, maps: DataFrame, fakes: Fakes | None = None) -> DataFrame:
    """k, start, end, fake: what to write in place of every span."""
    both = with_keys(spans).join(maps.select("ptype", "key", "original", "fake"), ["ptype", "key"])
    whole = printed(fakes or Fakes(), F.col("ptype"), _entity(spans), F.col("original"), F.col("fake"))
    if "whole" in spans.columns:
        whole = F.when(F.col("whole").isNull(), whole).otherwise(spread(F.col("fake"), F.col("whole.lengths"), F.col("whole.piece")))
    return both.select("k", "start", "end", whole.alias("fake"))


def redact(units: DataFrame, spans: DataFrame, maps: DataFrame, fakes: Fakes | None = None) -> DataFrame:
    """k, text with every span replaced; spans must not overlap. Units without spans pass unchanged."""
    edits = edits_of(spans, maps, fakes)
    by_unit = edits.groupBy("k").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", "fake")))).alias("edits"))
    out = units.join(by_unit, "k", "left")
    splice = F.aggregate("edits", F.col("text"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["fake"], F.substring(t, e["end"] + 1, F.length(t))))
    return out.select("k", F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice).alias("text"))


def word_runs(text: Column, sizes: list[int]) -> Column:
    """array<struct<run,at,words>> of all runs of so many words: words are letters and digits in lower case, at counts them, and a run is joined by blanks."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[0-9a-z]+"), F.lit(0))
    run = lambda n: lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(n)), " ").alias("run"), (i - 1).alias("at"), F.lit(n).alias("words"))
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), run(n)) for n in sizes]
    return F.filter(F.concat(*runs), lambda r: F.size(F.split(r["run"], " ")) == r["words"]) if runs else F.array().cast("array<struct<run:string,at:int,words:int>>")


def standing(units: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """values that stand in a text as whole words in any case: all their columns and k. Runs of as many words as the values have meet them in a join; the text is then searched for the value itself, so punctuation counts."""
    ship(units.sparkSession)
    run = F.array_join(F.regexp_extract_all(F.lower(column), F.lit("[0-9a-z]+"), F.lit(0)), " ")
    keyed = values.withColumn("_run", run).filter("_run <> ''").withColumn("_id", F.monotonically_increasing_id())
    sizes = sorted(r[0] for r in keyed.select(F.size(F.split("_run", " ")).alias("n")).distinct().collect())  # word numbers, a few
    runs = units.select("k", F.explode(F.array_distinct(F.transform(word_runs(F.col("text"), sizes), lambda r: r["run"]))).alias("_run"))
    met = runs.join(keyed, "_run").drop("_run", "_id")
    literal = F.concat(F.lit("(?i)(?<![0-9a-z])\\Q"), F.replace(F.col(column), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![0-9a-z])"))
    return met.join(units.select("k", F.col("text").alias("_text")), "k").filter(F.regexp_like("_text", literal)).drop("_text")


def collisions(units: DataFrame, maps: DataFrame) -> DataFrame:
    """The entries whose substitute, of four characters or more, already stands as whole words in a text."""
    found = standing(units, maps.filter(F.length("fake") >= 4), "fake")
    return found.drop("k").distinct()
