"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind is scanned from the left without overlaps; a proposal that fails its check is dropped and not retried. Base
kinds: e-mail, IPv4, card (14 to 19 digits, Luhn), phone (10 to 15 digits after a plus). The
method adds IBANs (as long as their country's are, mod 97) and national phone numbers, card numbers of 13 digits (Luhn), the last two only where a
word nearby speaks for them. A span's score starts from its kind and check, and rises or falls with context words
in the CONTEXT characters before it and AFTER behind it; it is clipped to 0..1. Base spans are reported at any score.

The patterns start only where a run of their characters starts, so a long run costs time in proportion to its
length. Whole texts are read. Null counts as empty and gives no spans; repeated rows and null ids give a row each;
empty tables give empty results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm.common import table
from maskwright.llm.spans import digests, overlaps, scanned

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "card13", "national")
CONTEXT, AFTER = 48, 16
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.85, "card13": 0.35, "national": 0.35}
REPORT = 0.5
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
#: Characters of an IBAN by country, as registered under ISO 13616.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24,
    FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32,
    LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22,
    SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
IBAN_BODY = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")
FOR = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write to|reach|correo|courriel|kontakt)"),
    "ip": re.compile(r"(?i)\b(ip|address|server|host|client|login|logged|adresse)\b"),
    "card": re.compile(r"(?i)\b(card|visa|master ?card|amex|credit|debit|payment|karte|carte|tarjeta)"),
    "phone": re.compile(r"(?i)\b(phone|call|tel|mobile|cell|fax|whats ?app|telefon|tél|teléfono|appel)"),
    "iban": re.compile(r"(?i)\b(iban|account|bank|konto|compte|cuenta)"),
}
FOR |= {"card13": FOR["card"], "national": FOR["phone"]}
AGAINST = re.compile(r"(?i)\b(example|sample|test|dummy|version|order|invoice|ticket|serial|isbn|build|release)\b")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ backwards."""
    end, at = 0, text.find("@")
    floor = 0  # a local part can't reach behind the last match or the last @
    while at >= 0:
        part = text[floor:at]
        local = len(part) - len(part.rstrip(LOCAL))
        floor = at + 1
        if local and (m := DOMAIN.match(text, at + 1)):
            yield at - local, (end := m.end())
            floor = end
        at = text.find("@", floor)


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A country's code, two digits and as many more characters as its IBANs have, a blank before any of them, that hold mod 97."""
    end = 0
    for head in IBAN_HEAD.finditer(text):
        n = IBAN_LENGTHS.get(head[1])
        if n and head.start() >= end and (body := IBAN_BODY[n].match(text, head.end())) and mod97(head[0] + body[0]):
            yield head.start(), (end := body.end())


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for s, e in _emails(text):
        yield "email", s, e
    for m in IP.finditer(text):
        if _octets(m[0]):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            yield "card" if len(d) >= 14 else "card13", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for s, e in _ibans(text):
        yield "iban", s, e
    for m in NATIONAL.finditer(text):
        yield "national", *m.span()


def scan(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text with their scores: base spans, and others that reach REPORT and overlap none of them."""
    found = []
    for kind, s, e in _proposals(text):
        near = f"{text[max(0, s - CONTEXT) : s]} {text[e : e + AFTER]}"
        score = PRIOR[kind] + 0.25 * bool(FOR[kind].search(near)) - 0.2 * bool(AGAINST.search(near))
        found.append((kind, s, e, round(min(1.0, max(0.0, score)), 3), kind in BASE))
    base = [x for x in found if x[4]]
    taken = overlaps(base)
    return base + [x for x in found if not x[4] and x[3] >= REPORT and not taken(x[1], x[2])]


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score, base)."""
    return scanned(documents, scan)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_pii(table(spark, sf_dir, "documents")), BASE, KINDS)
