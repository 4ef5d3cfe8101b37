"""Overlaps: of spans that clash in a unit the one of higher priority stays, then the longer, then the earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import vocabulary as v

#: Of a piece of a name that is broken over units: the whole name, the piece's number and the lengths of all its pieces.
WHOLE = "struct<entity:string,piece:int,lengths:array<int>>"


def ranked(x: Column) -> Column:
    """A span struct (start, end, ptype, value, source, whole, det_ord) in the order of acceptance."""
    priority = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in v.PRIORITY.items() for y in kv]), x["ptype"]), F.lit(0))
    return F.struct((-priority).alias("p"), (x["start"] - x["end"]).alias("l"), *[x[c].alias(c) for c in ("start", "det_ord", "end", "ptype", "value", "source", "whole")])


def accepted(spans: Column) -> Column:
    """The accepted ones of an array of span structs of one unit."""
    rows = F.array_sort(F.transform(spans, ranked))
    clash = lambda acc, x: F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"]))
    return F.aggregate(rows, F.filter(rows, lambda x: F.lit(False)), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def resolve(spans: DataFrame) -> DataFrame:
    """spans: k, start, end, ptype, value, source, det_ord and perhaps whole. The accepted ones; one shuffle, by unit, and no step beyond a unit."""
    if "whole" not in spans.columns:
        spans = spans.withColumn("whole", F.lit(None).cast(WHOLE))
    groups = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end", "ptype", "value", "source", "whole", "det_ord")).alias("s"))
    return groups.select("k", F.inline(accepted(F.col("s")))).select("k", "start", "end", "ptype", "value", "source", "whole")
