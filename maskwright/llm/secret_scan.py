"""Secrets: base patterns, and novelty by dictionary-primed zstandard.

Base kinds: assignments to a password-like name (ASCII letters in either case), access key ids, long runs of lower-case
hex. Beyond these, each token of TOKEN's shape (16 characters or more, with a digit or with capitals inside) that has a
sensitive word in the CONTEXT characters before it is measured: its marginal bytes are the compressed size of the
surrounding code with the token, less that without it, by a zstandard compressor primed with a dictionary. The
dictionary is IDENTIFIERS and, before them, the TOP most frequent identifiers of all documents, the most frequent
last: names in lower case joined by underscores, which no random string is. Ordinary names cost few bytes there; a
token that costs BITS bits a character or more is incompressible, and reported as kind novel with that figure (over 6,
at most 1) as its score.

Each kind is scanned from the left without overlaps; a proposal that fails its length check is dropped and not
retried. Whole texts are read. Null counts as empty and gives no spans; repeated rows and null ids give a row each;
empty tables give empty results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import table
from maskwright.llm.spans import digests, overlaps, scanned

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
CONTEXT, BITS = 64, 4.0
TOP = 2000
NAME = "(?<![A-Za-z0-9_])[a-z]{3,14}(?:_[a-z]{3,14}){1,5}(?![A-Za-z0-9_])"
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9]|[A-Za-z+/_=-]*?[a-z][A-Z])[A-Za-z0-9+/_=-]{16,}+")
SENSITIVE = re.compile(r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer|signature)")
#: What surrounds secrets in code: primes the compressor, so that only the token itself is new to it.
IDENTIFIERS = b"""
import os sys json logging config settings environ getenv client session request response headers Authorization Bearer Basic
def init self return None True False class function const let var public private static final string String int bool
password passwd pwd secret token api_key apikey api-key access_key access_key_id secret_access_key private_key client_id client_secret
aws_access_key_id aws_secret_access_key auth_token refresh_token bearer_token session_token credential credentials signature
username user_name user email host hostname port database db_url connection_string endpoint https://www.example.com/api/v1/
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ test example sample default development production staging
request_id user_id session_id transaction_id created_at updated_at timestamp version content_type application/json charset utf-8
"""


class Novelty:
    """names: identifiers of the corpus, the most frequent last. The compressor is made where it is used first."""

    def __init__(self, names: tuple[str, ...] = ()) -> None:
        self.names, self.z = names, None

    def __getstate__(self) -> dict:
        return {"names": self.names, "z": None}

    def bits(self, around: str, token: str) -> float:
        """Marginal compressed bits for each character of the token, given the text around it."""
        if self.z is None:
            known = "\n".join(self.names).encode() + IDENTIFIERS
            self.z = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        plain = around.encode("utf-8", "replace")
        more = len(self.z.compress(plain + b" " + token.encode())) - len(self.z.compress(plain))
        return max(0, more - 1) * 8 / len(token)  # a byte for the space


PLAIN = Novelty()


def identifiers(documents: DataFrame, top: int = TOP) -> tuple[str, ...]:
    """The `top` identifiers found most often in all documents, the most frequent last."""
    found = documents.select(F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return tuple(r["name"] for r in reversed(found.orderBy(F.desc("n"), "name").limit(top).collect()))


def scan(text: str, novelty: Novelty = PLAIN) -> list[tuple[str, int, int, float, bool]]:
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 8:
            found.append(("assign", *m.span(), 0.9, True))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            found.append(("access", *m.span(), 0.95, True))
    for m in HEX.finditer(text):
        found.append(("hex", *m.span(), 0.6, True))
    taken, more = overlaps(found), []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        near = text[max(0, s - CONTEXT) : s]
        if SENSITIVE.search(near) and not taken(s, e) and (bits := novelty.bits(near + " " + text[e : e + CONTEXT], m[0])) >= BITS:
            more.append(("novel", s, e, round(min(1.0, bits / 6), 3), False))
    return found + more


def find_secrets(documents: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id and spans (kind, start, end, score, base)."""
    novelty = Novelty(identifiers(documents, top))
    return scanned(documents, lambda text: scan(text, novelty))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_secrets(table(spark, sf_dir, "documents")), BASE, KINDS)
