"""Gold spans by rules of their own, which share nothing with the detectors but the lists of names.

units: k, part, idx and text. A unit's rules run in stages, and a later stage takes no place that an earlier one holds:
listed persons, listed companies, legal forms, e-mail, web addresses, phones, director numbers, listed addresses. The
last-but-one looks back: a unit of eight digits counts if one of the 40 units before it in its part, or itself, names the
number. Null and empty texts give no span."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright import vocabulary as v
from maskwright.operators.walkers import Names, Taken
from maskwright.shipping import ship

SPANS = "array<struct<start:int,end:int,type:string,text:string,rule:string>>"
LOOK_BACK = 40


def literal(phrase: str) -> str:
    """A pattern of the phrase's words, any white space between them, that no letter or digit touches."""
    return r"(?i)(?<![A-Za-z0-9])" + r"\s+".join(re.sub(r"([^0-9A-Za-z])", r"\\\1", w) for w in phrase.split()) + r"(?![A-Za-z0-9])"


def kept_host(value: str | Column) -> bool | Column:
    """Whether a web address, white space left out, names a host that stays."""
    if isinstance(value, str):
        flat = re.sub(r"\s+", "", value).lower()
        return any(h in flat for h in v.GOLD_KEEP_HOSTS)
    flat = F.lower(F.regexp_replace(value, r"\s+", ""))
    return F.exists(F.array(*[F.lit(h) for h in v.GOLD_KEEP_HOSTS]), lambda h: flat.contains(h))


class _Listed(Names):
    """A list whose names stand alone among letters and digits, in any case, with white space between their words."""

    _START = re.compile(r"(?<![A-Za-z0-9])\S")
    _HEAD = re.compile(r"(?:\s*\S){1,3}")

    def __init__(self, names: Iterable[str]) -> None:
        super().__init__(names, any_case=True, behind="[A-Za-z0-9]", gap=r"\s+")


def _stages(text: str, headed: bool, people: _Listed, organisations: _Listed, addresses: _Listed) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """Type, rule and places of each stage, in order."""
    found = lambda p: [m.span() for m in re.finditer(p, text)]
    mails, sites = found(v.GOLD_EMAIL), found(v.GOLD_WEB)
    # a company's name inside an e-mail or web address is a domain
    outside = lambda places: [(a, b) for a, b in places if not any(x <= a and b <= y for x, y in mails + sites)]
    yield "PERSON_NAME", "listed", sorted(((a, b) for _, _, a, b in people.hits(text)), key=lambda x: (x[0], x[0] - x[1]))
    yield "COMPANY", "listed", outside([(a, b) for _, _, a, b in organisations.hits(text)])
    yield "COMPANY", "legal form", outside(found(v.GOLD_LEGAL))
    yield "EMAIL", "pattern", mails
    yield "URL", "pattern", [(a, b) for a, b in sites if not kept_host(text[a:b])]
    yield "PHONE", "pattern", found(v.GOLD_PHONE)
    yield "DIN", "eight digits under a heading", found(r"\b\d{8}\b") if headed and re.fullmatch(r"\d{8}", text.strip()) else []
    yield "ADDRESS", "listed", [(a, b) for _, _, a, b in addresses.hits(text)]


def headed(units: DataFrame) -> Column:
    """Whether the unit or one of the 40 before it in its part names the director number."""
    w = W.partitionBy("part").orderBy("idx").rowsBetween(-LOOK_BACK, 0)
    return F.coalesce(F.max(F.col("text").rlike(v.GOLD_DIN_LABEL)).over(w), F.lit(False))


def annotate(units: DataFrame, people: Iterable[str] = (), organisations: Iterable[str] = (), addresses: Iterable[str] = ()) -> DataFrame:
    """k, part, idx, start, end, type, text, rule of the gold spans; one window by part."""
    ship(units.sparkSession)
    lists = tuple(_Listed(x) for x in (people, organisations, addresses))

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for text, head in zip(texts, heads):
            taken, rows = Taken(), []
            for kind, rule, places in _stages(text, bool(head), *lists) if text else ():
                rows += [{"start": a, "end": b, "type": kind, "text": text[a:b], "rule": rule} for a, b in places if taken.add(a, b)]
            out.append(rows)
        return pd.Series(out, dtype=object)

    rows = units.withColumn("_headed", headed(units))
    return rows.select("k", "part", "idx", F.inline(spans(F.col("text"), F.col("_headed"))))


def present_controls(units: DataFrame, addresses: Iterable[str] = (), values: Iterable[str] = v.NEGATIVE_CONTROLS) -> list[str]:
    """The control strings that a text holds, in the order of the list. One that is part of a listed address raises an error: it is redacted by design."""
    values = list(values)
    clash = [x for x in values if any(x in a for a in addresses)]
    if clash:
        raise ValueError(f"controls inside listed addresses: {clash}")
    row = units.agg(*[F.coalesce(F.max(F.col("text").contains(x)), F.lit(False)).alias(f"c{i}") for i, x in enumerate(values)]).first()
    return [x for i, x in enumerate(values) if row[i]]
