"""Predicates and scalars over names, hosts and keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocabulary as v


def norm_key(text: Column) -> Column:
    """White space collapsed, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " ")))


def url_host(url: Column) -> Column:
    """Host without scheme, path, blanks and a leading www."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(url, " ", "")), r"^https?://", "")
    return F.regexp_replace(F.element_at(F.split(bare, "/"), 1), r"^www\.", "")


def looks_like_organisation(text: Column) -> Column:
    return text.rlike(v.ORGANISATION_HINT)


def looks_like_name(text: Column) -> Column:
    """Two to four words, none a stop word or a lone letter without its dot, and no organisation."""
    words = F.split(F.trim(text), r"[\s\u00a0]+")
    stop = F.array(*[F.lit(w) for w in v.NAME_STOPWORDS])
    return F.size(words).between(2, 4) & ~F.exists(words, lambda w: (F.length(w) == 1) & (w != ".")) & ~F.arrays_overlap(F.transform(words, F.lower), stop) & ~looks_like_organisation(text)


def normalised(text: Column) -> Column:
    """NFKC form; only texts beyond ASCII cross to Python."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)

    ascii = text.rlike(r"^[\x00-\x7f]*\z")
    return F.when(ascii, text).otherwise(nfkc(F.when(ascii, F.lit(None).cast("string")).otherwise(text)))


def canonical(ptype: str, value: Column) -> Column:
    """The key under which spellings of one value meet, for a value that is normalised()."""
    flat = F.trim(F.regexp_replace(value, r"[\s\u00a0]+", " "))
    if ptype in ("PHONE", "CREDIT_CARD", "DATE_OF_BIRTH"):
        return F.regexp_replace(flat, "[^0-9]", "")
    if ptype == "URL":
        return F.regexp_replace(F.lower(flat), r"\s", "")
    if ptype in ("PERSON_NAME", "COMPANY"):
        return F.regexp_replace(F.lower(flat), "[^0-9a-z]", "")
    return F.lower(flat)
