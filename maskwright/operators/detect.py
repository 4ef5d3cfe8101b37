"""Detectors: from units (k, text) to spans (k, start, end, ptype, value, source).

Each is an array of span structs in built-in expressions over one unit, so that all of them make one pass over the texts,
without a shuffle; those that look at neighbours are windows over the unit sequence. Offsets are code points, half-open."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright import vocabulary as v
from maskwright.functions.regex import find_all
from maskwright.functions.text import looks_like_name, looks_like_organisation, url_host
from maskwright.operators import walkers
from maskwright.operators.resolve import accepted
from maskwright.shipping import ship

SPAN = ("start", "end", "ptype", "value", "source", "whole")


def span(start: Column, end: Column, ptype: str, value: Column, source: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(ptype).alias("ptype"), value.alias("value"), F.lit(source).alias("source"), F.lit(None).cast(walkers.WHOLE).alias("whole"))


def spans(hits: Column, ptype: str, source: str = "regex") -> Column:
    return F.transform(hits, lambda h: span(h["start"], h["end"], ptype, h["value"], source))


def only(condition: Column, hits: Column) -> Column:
    """The hits of texts that meet a condition."""
    return F.when(condition, hits).otherwise(F.array().cast(walkers.SPANS))


class Detector:
    """hits: from a text column to an array of span structs. Called on units it gives their spans as rows."""

    def __init__(self, hits: Callable[[Column], Column]) -> None:
        self.hits, self.__doc__, self.__name__ = hits, hits.__doc__, hits.__name__

    def __call__(self, units: DataFrame) -> DataFrame:
        return units.select("k", F.inline(self.hits(F.col("text"))))


@Detector
def emails(text: Column) -> Column:
    return only(text.contains("@"), spans(find_all(text, v.EMAIL), "EMAIL"))


@Detector
def urls(text: Column) -> Column:
    """Web addresses with a scheme or www, but for hosts of public registers."""
    found = F.filter(find_all(text, f"(?:{v.URL}|{v.NO_URL})"), lambda h: h["value"].rlike("^" + v.URL))
    return F.filter(spans(found, "URL"), lambda h: ~url_host(h["value"]).isin(*v.KEEP_URL_HOSTS))


@Detector
def ssns(text: Column) -> Column:
    return spans(find_all(text, v.SSN), "SSN")


def _luhn(hits: Column) -> Column:
    return F.filter(spans(hits, "CREDIT_CARD"), lambda h: F.call_function("luhn_check", F.regexp_replace(h["value"], "[^0-9]", "")))


def _large(hits: Column) -> Column:
    return F.filter(spans(hits, "IP_ADDRESS"), lambda h: F.exists(F.split(h["value"], r"\."), lambda x: x.cast("int") >= 10))


@Detector
def cards(text: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    return _luhn(find_all(text, v.CARD))


@Detector
def ip_addresses(text: Column) -> Column:
    """Four octets, not all of them under ten (section numbers)."""
    return _large(find_all(text, v.IPV4))


def _inside(hits: Column, ends: str) -> Column:
    """Matches without the character that they take at either side, which is none of those that a value starts and ends with."""

    def own(h: Column) -> Column:
        lead = h["value"].rlike(f"^[^{ends}]").cast("int")
        size = F.length(h["value"]) - lead - h["value"].rlike(f"[^{ends}]\\z").cast("int")
        return F.struct((h["start"] + lead).alias("start"), (h["start"] + lead + size).alias("end"), F.substring(h["value"], lead + 1, size).alias("value"))

    return F.transform(hits, own)


@Detector
def emails_taking(text: Column) -> Column:
    """E-mails whose match takes its neighbours, as the queries' SQL has them; emails() finds the others too."""
    return only(text.contains("@"), spans(_inside(find_all(text, v.EMAIL_TAKING), "A-Za-z0-9"), "EMAIL"))


@Detector
def ip_addresses_taking(text: Column) -> Column:
    """Addresses whose match takes its neighbours, as the queries' SQL has them; ip_addresses() finds the others too."""
    return _large(_inside(find_all(text, v.IPV4_TAKING), "0-9"))


@Detector
def cards_bounded(text: Column) -> Column:
    """Cards between word boundaries, as the queries' SQL has them: behind a decimal point too, beside a letter not."""
    return _luhn(find_all(text, v.CARD_BOUNDED))


@Detector
def phones_std(text: Column) -> Column:
    return spans(find_all(text, v.PHONE_STD), "PHONE")


@Detector
def phones_international(text: Column) -> Column:
    """+91 and ten digits or more; of more than ten digits the last ten make the span."""

    def number(h: Column) -> Column:
        plus = F.length(F.regexp_extract(h["value"], r"^\+\s*91[\s\-.]*", 0))
        tail = F.regexp_extract(h["value"], r"(?:[0-9][^0-9]*){9}[0-9](?=[^0-9]*$)", 0)
        behind = F.length(F.regexp_extract(h["value"], r"[^0-9]*$", 0))
        digits = F.length(F.regexp_replace(F.substring(h["value"], plus + 1, F.length(h["value"])), "[^0-9]", ""))
        last = F.length(h["value"]) - behind
        first = F.when(digits > 10, last - F.length(tail)).otherwise(0)
        return F.when(digits >= 10, span(h["start"] + first, h["start"] + last, "PHONE", F.substring(h["value"], first + 1, last - first), "regex"))

    return only(text.contains("+"), F.filter(F.transform(find_all(text, v.PHONE_INTERNATIONAL), number), lambda h: h.isNotNull()))


def _behind(text: Column, label: str, reach: int, pattern: str) -> Column:
    """Matches of a pattern in the characters behind each match of a label, placed in the text."""

    # the stretches come from one pass of the pattern, for to cut each out of the text would start at its beginning
    stretches = F.regexp_extract_all(text, F.lit(f"(?s)(?:{label})(?=(.{{0,{reach}}}))"), F.lit(1))

    def after(label: Column, stretch: Column) -> Column:
        hits = find_all(stretch, pattern)
        return F.transform(hits, lambda h: F.struct((h["start"] + label["end"]).alias("start"), (h["end"] + label["end"]).alias("end"), h["value"].alias("value")))

    return F.flatten(F.zip_with(find_all(text, label), stretches, after))


@Detector
def birth_dates(text: Column) -> Column:
    """Dates in the 40 characters behind a keyword; a date that two keywords reach comes once."""
    return only(text.rlike(v.DOB_KEYWORD), F.array_distinct(spans(_behind(text, v.DOB_KEYWORD, 40, v.DATE), "DATE_OF_BIRTH")))


@Detector
def dins(text: Column) -> Column:
    """A unit of eight digits alone, or any run of eight digits in a unit that names the number."""
    bare = F.trim(text).rlike(r"^\d{8}$")
    named = text.rlike(r"(?i)\bDIN\b") & ~bare
    return F.concat(only(bare, spans(find_all(text, r"\d{8}"), "DIN", "bare-8-digit")), only(named, spans(find_all(text, r"(?<!\d)\d{8}(?!\d)"), "DIN")))


@Detector
def label_pairs(text: Column) -> Column:
    """The left side of "Name Name: Name Name", unless its last word is a label's."""
    left = spans(find_all(text, v.NAME_RUN + r"(?=\s*:\s*(?:[A-Z]\.|[A-Z][a-z]+)(?:[ \u00a0]*(?:[A-Z]\.|[A-Z][a-z]+)){1,3})"), "PERSON_NAME", "label-pair")
    words = lambda h: F.split(h["value"], r"[\s\u00a0]+")
    return only(text.contains(":"), F.filter(left, lambda h: F.size(words(h)).between(2, 4) & ~F.lower(F.element_at(words(h), -1)).isin(*v.LABEL_TAIL)))


@Detector
def role_anchors(text: Column) -> Column:
    """Names behind "being", "namely", "is our", or before "is our" and a role."""
    token = r"[A-Z][A-Za-z.'’-]*"
    name = token + r"(?:[ \u00a0]*" + token + r"){1,3}"
    role = r"(?i:company\s+secretary|chairman|managing director|executive director|promoter)"
    behind = find_all(text, r"(?<=\b(?i:being|namely|namely,|is our|are our)\s{1,4})" + name)
    before = find_all(text, r"\b" + name + r"(?=\s+(?i:is|are)\s+our\s+" + role + ")")
    cue = text.rlike(r"(?i)\b(?:being|namely|(?:is|are)\s+our)\b")
    return only(cue, F.filter(spans(F.concat(behind, before), "PERSON_NAME", "role-anchor"), lambda h: looks_like_name(h["value"])))


@Detector
def all_caps_names(text: Column) -> Column:
    """Runs of two to four capitalised words in the 400 characters behind a list label."""
    label = r"(?i)\b(?:our\s+)?(?:promoters?|promoter\s+selling\s+shareholders?|directors?|individual\s+promoters?)\s*:\s*"
    value = lambda h: F.regexp_replace(h["value"], r"(?:\s+(?:AND|OR|&))+$", "")
    hits = _behind(text, label, 400, r"[A-Z]+(?:[ \u00a0]+[A-Z]+){1,3}")
    cut = F.transform(hits, lambda h: span(h["start"], h["start"] + F.length(value(h)), "PERSON_NAME", value(h), "all-caps-list"))
    words = lambda h: F.split(h["value"], r"[ \u00a0]+")
    plausible = lambda h: F.size(words(h)).between(2, 4) & F.forall(words(h), lambda w: (F.length(w) <= 14) & ~w.isin(*v.ALL_CAPS_DENY))
    return only(text.contains(":"), F.filter(cut, lambda h: ~looks_like_organisation(h["value"]) & plausible(h)))


@Detector
def family_trusts(text: Column) -> Column:
    return spans(find_all(text, v.FAMILY_TRUST), "COMPANY", "family-trust")


def _designated(within: str) -> Column:
    """The unit as a name, if one of the next two units in the sequence starts with a designation."""
    w = W.partitionBy(within).orderBy("k")
    titles = "(?i)^(?:" + "|".join(t.replace("-", r"\-") for t in v.DESIGNATIONS) + ")"
    near = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.lead("text", i).over(w)).rlike(titles), F.lit(False)) for i in (1, 2)])
    flat = F.trim("text")
    named = near & (F.length(flat) <= 60) & flat.rlike("^(?:" + v.NAME_RUN + ")$") & looks_like_name(flat)
    start = F.length("text") - F.length(F.ltrim("text"))
    return only(named, F.array(span(start, start + F.length(flat), "PERSON_NAME", flat, "designation-table")))


def designation_table(units: DataFrame, within: str) -> DataFrame:
    """Units that are a name, one of whose next two units in the sequence starts with a designation. units: k, text and the column of the sequence."""
    return units.withColumn("_named", _designated(within)).select("k", F.inline("_named"))


#: In the order that breaks ties between equal spans.
PATTERN_DETECTORS = (emails, urls, phones_international, phones_std, dins, ssns, cards, ip_addresses, birth_dates, label_pairs, role_anchors, all_caps_names, family_trusts)


def _ordered(hits: Column, order: int) -> Column:
    return F.transform(hits, lambda h: F.struct(*[h[c].alias(c) for c in SPAN], F.lit(order).alias("det_ord")))


def _candidates(detectors: tuple[Detector, ...]) -> Column:
    return F.concat(*[_ordered(d.hits(F.col("text")), i) for i, d in enumerate(detectors)])


def detect(units: DataFrame, detectors: tuple[Detector, ...] = PATTERN_DETECTORS) -> DataFrame:
    """All candidates of all detectors, with det_ord, the place of theirs; one pass over the texts."""
    return units.select("k", F.inline(_candidates(detectors)))


def scan(units: DataFrame, people: list[str] = (), organisations: list[str] = (), within: str | None = None) -> DataFrame:
    """The accepted spans of all detectors: candidates are resolved, addresses are sought with the accepted ones as their
    bounds, and candidates and addresses are resolved again.

    All of it happens in the row of the unit, in one pass that crosses to Python once, so nothing is shuffled; within, the column of the sequence the units stand
    in, adds what looks at neighbours (names over several units too, by the column cell where there is one), at the price
    of one shuffle by it; listed people add the joins of learned pairs."""
    ship(units.sparkSession)
    sequence = [within] if within is not None else []
    out = units.select("k", "text", *sequence, *(["cell"] if within is not None and "cell" in units.columns else []))
    if people:
        out = walkers.with_pairs(out, people)
    found = _candidates(PATTERN_DETECTORS)
    if within is not None:
        if "cell" not in out.columns:
            out = out.withColumn("cell", F.lit(-1))
        out = walkers.split_lines(out, within, people, organisations).withColumn("_named", _designated(within))
        found = F.concat(found, _ordered(F.col("_named"), 98), _ordered(F.col("_split"), 99))
    out = out.withColumn("_found", found)
    out = out.withColumn("_own", walkers.walked(F.transform("_found", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["ptype"].alias("ptype"))), people, organisations, F.col("_pairs") if people else None))
    more = F.col("_own")
    if within is not None:
        out = walkers.linked_lines(out, F.col("_own"), within)
        more = F.concat("_own", "_more")
    more = F.transform(more, lambda h, i: F.struct(*[h[c].alias(c) for c in SPAN], (i + 100).alias("det_ord")))
    out = out.withColumn("_all", accepted(F.concat("_found", more)))
    return out.select("k", F.inline("_all")).select("k", *SPAN)
