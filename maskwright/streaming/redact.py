"""Redaction of a stream of texts: each row alone, without state, so it runs unchanged on a batch.

A substitute depends on the value's key and its own spelling only; a batch run, which takes the shape of the first
spelling of the whole corpus, may print another layout for names and addresses. Types whose substitutes need Python
(companies) and learned or neighbouring context are left to the batch engine; companies become [REDACTED]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.fakes import Fakes, match_case
from maskwright.functions.text import canonical
from maskwright.operators.detect import PATTERN_DETECTORS, Detector, _candidates
from maskwright.operators.resolve import accepted


def substitute(f: Fakes, ptype: Column, value: Column) -> Column:
    made = {
        "EMAIL": match_case(f.email(canonical("EMAIL", value)), value),
        "URL": match_case(f.url(value), value),
        "PHONE": f.phone(f.subscriber(value), value),
        "PERSON_NAME": f.person(canonical("PERSON_NAME", value), value),
        "DIN": f.din(canonical("DIN", value)),
        "SSN": f.ssn(canonical("SSN", value)),
        "CREDIT_CARD": f.card(canonical("CREDIT_CARD", value)),
        "IP_ADDRESS": f.ip(canonical("IP_ADDRESS", value)),
        "DATE_OF_BIRTH": f.birth_date(canonical("DATE_OF_BIRTH", value)),
    }
    return reduce(lambda rest, t: F.when(ptype == t, made[t]).otherwise(rest), made, F.lit("[REDACTED]"))


def redact_rows(units: DataFrame, detectors: tuple[Detector, ...] = PATTERN_DETECTORS, fakes: Fakes | None = None) -> DataFrame:
    """units, batch or stream, with text rewritten; other columns pass. A null text stays null."""
    f = fakes or Fakes()
    edits = F.transform(accepted(_candidates(detectors)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), substitute(f, x["ptype"], x["value"]).alias("fake")))
    last_first = F.reverse(F.array_sort(edits))
    text = F.aggregate(last_first, F.col("text"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["fake"], F.substring(t, e["end"] + 1, F.length(t))))
    return units.withColumn("text", text)
