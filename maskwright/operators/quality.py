"""Scoring and verification: similarity, metrics, coverage, controls, structure, growth."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.shipping import ship


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one holds the other, else twice the common characters over all characters."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    common = F.aggregate(F.array_distinct(chars(a)), F.lit(0), lambda acc, c: acc + F.least(count(a, c), count(b, c)))
    ratio = F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(2.0 * common / (F.length(a) + F.length(b)))
    return F.when(a == b, F.lit(1.0)).when(a.contains(b) | b.contains(a), F.lit(0.9)).otherwise(ratio)


def metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision (1 if nothing is reported), recall (1 without gold), F1 (0 without hits), accuracy (1 if empty)."""
    ratio = lambda x, y, other: F.when(y > 0, x / y).otherwise(F.lit(other))
    return {"precision": ratio(tp, tp + fp, 1.0), "recall": ratio(tp, tp + fn, 1.0), "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0), "accuracy": ratio(tp + tn, tp + tn + fp + fn, 1.0)}


def likeness(a: str, b: str) -> float:
    """similarity() of two strings."""
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    return 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def _taken(want: list[tuple], have: list[tuple], least: float) -> tuple[list[tuple[int | None, float | None]], set[int]]:
    """want, have: n and text, in the order of n. Of each wanted one, the place in have of the one it takes and their likeness (None: none), and the places taken."""
    out, taken = [], set()
    for _, text in want:
        best, at = -1.0, None
        for i, (_, hit) in enumerate(have):
            if i in taken or text is None or hit is None:
                continue
            like = likeness(text, hit)
            if like > best:
                best, at = like, i
            if like == 1.0:
                break
        if at is None or best < least:
            out.append((None, None))
        else:
            taken.add(at)
            out.append((at, best))
    return out, taken


def _by_group(gold: DataFrame, found: DataFrame, of, schema: str) -> DataFrame:
    """of(type, part, want, have): the result's rows of a group, the spans of one type in one part, whose (n, text) come in
    the order of n. Either side is shuffled once and sorted, and groups are read off the sorted rows, a batch of many
    groups at a time; a group is held whole, and one document bounds it. schema: part is set to gold's type."""
    ship(gold.sparkSession)
    side = lambda df, i: df.select("type", "part", F.lit(i).alias("side"), F.col("n").cast("long").alias("n"), "text")
    rows = side(gold, 0).union(side(found, 1)).repartition("type", "part").sortWithinPartitions("type", "part", "side", "n")
    names = [x.split()[0] for x in schema.format(part="").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, kinds = None, ([], []), None
        for b in batches:
            kinds = {"part": b.schema.field("part").type, "n": pa.int64(), "found_n": pa.int64(), "similarity": pa.float64()}
            out: list[tuple] = []
            for kind, part, i, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (kind, part):
                    if key is not None:
                        out += of(*key, *sides)
                    key, sides = (kind, part), ([], [])
                sides[i].append((n, text))
            yield made(out, kinds)
        if key is not None:
            yield made(of(*key, *sides), kinds)

    def made(out: list[tuple], kinds: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in out], kinds.get(c, pa.string())) for i, c in enumerate(names)], names=names)

    part = rows.schema["part"].dataType.simpleString()
    out = rows.mapInArrow(run, schema.format(part=part))
    return out.withColumn("part", F.col("part").cast(gold.schema["part"].dataType))


def match(gold: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """gold, found: type, part, n, text. One to one, in the order of n: each gold span takes the most similar span of its
    type and part that is still free, the first of equal ones. Columns type, part, n, found_n (null: none), similarity.

    A group is the spans of one type in one part of one document, so its size is bounded by a document. Null texts match
    nothing."""

    def of(kind: str, part: object, want: list[tuple], have: list[tuple]) -> list[tuple]:
        hits, _ = _taken(want, have, least)
        return [(kind, part, n, None if at is None else have[at][0], like) for (n, _), (at, like) in zip(want, hits, strict=True)]

    return _by_group(gold, found, of, "type string, part {part}, n long, found_n long, similarity double")


def score(gold: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """gold, found: type, part, n (unique in a type and part), text, k (the unit), start, end. A row for each type that gold has and one for ALL, from the one-to-one matches; exact ones agree in unit, place and text too."""
    place = ("k", "start", "end", "text")
    pairs = match(gold, found, least)
    side = lambda df, n, x: df.select(F.col("type").alias(f"{x}t"), F.col("part").alias(f"{x}p"), F.col("n").alias(f"{x}n"), F.struct(*place).alias(x))
    g, f = side(gold, "n", "g"), side(found, "n", "f")
    both = pairs.join(g, (F.col("type") == F.col("gt")) & F.col("part").eqNullSafe(F.col("gp")) & (F.col("n") == F.col("gn")))
    both = both.join(f, (F.col("type") == F.col("ft")) & F.col("part").eqNullSafe(F.col("fp")) & (F.col("found_n") == F.col("fn")), "left")
    one = lambda c: c.cast("int")
    rows = both.select("type", F.lit(1).alias("g"), F.lit(0).alias("f"), one(F.col("found_n").isNotNull()).alias("hit"), one(F.coalesce(F.col("g") == F.col("f"), F.lit(False))).alias("same"))
    types = gold.select(F.col("type").alias("t")).distinct()
    rows = rows.union(found.join(types, F.col("type") == F.col("t"), "left_semi").select("type", F.lit(0), F.lit(1), F.lit(0), F.lit(0)))
    out = rows.rollup("type").agg(F.sum("g").alias("gold"), F.sum("f").alias("found"), F.sum("hit").alias("tp"), F.sum("same").alias("exact"))
    out = out.withColumn("type", F.coalesce("type", F.lit("ALL"))).withColumn("fp", F.col("found") - F.col("tp")).withColumn("fn", F.col("gold") - F.col("tp"))
    m = metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0))
    return out.select("type", "gold", "found", "tp", "fp", "fn", "exact", *[F.round(m[c], 6).alias(c) for c in ("precision", "recall", "f1")])


def accuracy(scores: DataFrame, negatives: DataFrame) -> DataFrame:
    """scores: of score(); negatives: of negative_controls(). tp, fp, fn, tn and accuracy over all types."""
    tn = negatives.agg(F.count(F.when(~F.col("touched"), 1)).alias("tn"))
    counts = scores.filter("type = 'ALL'").select("tp", "fp", "fn", F.lit(0).cast("long").alias("tn")).union(tn.select(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "tn"))
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return total.withColumn("accuracy", F.round(metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))["accuracy"], 6))


def coverage(gold: DataFrame, found: DataFrame, least: float = 0.9) -> DataFrame:
    """type, gold, covered, recall, and a row for ALL: gold spans that some reported span of their type and part contains or reads like. A join by type and part, whose spans one document bounds."""
    g = gold.select("type", "part", "n", F.col("text").alias("want"))
    f = found.select(F.col("type").alias("t"), F.col("part").alias("p"), F.col("text").alias("hit")).distinct()
    both = g.join(f, (F.col("type") == F.col("t")) & F.col("part").eqNullSafe(F.col("p")), "left")
    ok = F.coalesce(F.col("hit").contains(F.col("want")) | (similarity(F.col("want"), F.col("hit")) >= least), F.lit(False))
    each = both.groupBy("type", "part", "n").agg(F.max(ok).alias("ok"))
    out = each.rollup("type").agg(F.count(F.lit(1)).alias("gold"), F.count(F.when(F.col("ok"), 1)).alias("covered"))
    return out.select(F.coalesce("type", F.lit("ALL")).alias("type"), "gold", "covered", F.round(metrics(F.col("covered"), F.lit(0), F.col("gold") - F.col("covered"), F.lit(0))["recall"], 6).alias("recall"))


def negative_controls(units: DataFrame, spans: DataFrame, values: list[str]) -> DataFrame:
    """value, touched: of the control strings (a short list of the configuration) that occur in the units, whether a span overlaps one of their occurrences."""
    ship(units.sparkSession)
    controls = [v for v in dict.fromkeys(values) if v]

    @F.pandas_udf("array<struct<value:string,touched:boolean>>")
    def seen(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, places):
            row = []
            for value in controls:
                at, touched, held = (text or "").find(value), False, False
                while at >= 0:
                    held = True
                    touched |= own is not None and any(p["start"] < at + len(value) and at < p["end"] for p in own)
                    at = text.find(value, at + 1)
                if held:
                    row.append({"value": value, "touched": bool(touched)})
            out.append(row)
        return pd.Series(out, dtype=object)

    places = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    rows = units.join(places, "k", "left").select(F.explode(seen(F.col("text"), F.col("places"))).alias("x"))
    return rows.groupBy(F.col("x.value").alias("value")).agg(F.max("x.touched").alias("touched"))


def disagreements(gold: DataFrame, found: DataFrame, show: int = 12) -> DataFrame:
    """type, kind (missed or extra), part, n, text: gold spans without a match and reported ones that match none, the first `show`."""

    def of(kind: str | None, part: object, want: list[tuple], have: list[tuple]) -> list[tuple]:
        hits, taken = _taken(want, have, 0.5)
        missed = [(kind, "missed", part, *x) for x, (at, _) in zip(want, hits, strict=True) if at is None]
        return missed + [(kind, "extra", part, *x) for i, x in enumerate(have) if i not in taken]

    types = gold.select(F.col("type").alias("t")).distinct()
    own = found.join(types, F.col("type") == F.col("t"), "left_semi")
    out = _by_group(gold.filter("type IS NOT NULL"), own, of, "type string, kind string, part {part}, n long, text string")
    return out.orderBy("type", F.desc("kind"), "part", "n").limit(show)
