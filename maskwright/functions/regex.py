"""Regular expression matches with their places, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
CHUNK = 512  # even, so that each chunk starts outside a match


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches (code points, end exclusive). The pattern must not match the empty string.

    Matches are fenced by two control characters, for which another stands in the text and in the values, and the text is split at them: every second piece is a match."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.when(whole.contains(OPEN) | whole.contains(CLOSE), F.translate(whole, OPEN + CLOSE, OTHER + OTHER)).otherwise(whole)
    pieces = F.split(F.regexp_replace(plain, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        hit = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

    def listed(p: Column) -> Column:
        """A list grows by copying, so the matches of CHUNK pieces at a time are listed, and the lists joined at the end."""

        def part(acc: Column, i: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.lit(False).alias("inside"), none.alias("out"))
            return F.aggregate(F.slice(p, i * CHUNK + 1, F.lit(CHUNK)), start, step, lambda own: F.struct(own["at"].alias("at"), F.concat(acc["lists"], F.array(own["out"])).alias("lists")))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("lists"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), zero, part, lambda acc: F.flatten(acc["lists"]))

    # bound to a variable, so that the text is taken apart once
    return F.when(plain.rlike(pattern), F.get(F.transform(F.array(pieces), listed), F.lit(0))).otherwise(none)
