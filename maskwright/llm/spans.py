"""What the span scanners share: the frame around a scanner of one text, and the digest columns."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import mapped

#: kind, start, end (code points, end exclusive), score, base (found by a base pattern)
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])))])


def joined(spans: list[tuple], order: dict[str, int]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def overlaps(spans: list[tuple]) -> Callable[[int, int], bool]:
    """Whether a stretch meets any of the spans (kind, start, end, ...): those that start before its end, and the furthest of their ends."""
    ordered = sorted((x[1], x[2]) for x in spans)
    starts, reach = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
    return lambda s, e: (n := bisect.bisect_left(starts, e)) > 0 and reach[n - 1] > s


def scanned(documents: DataFrame, scan: Callable[[str], list[tuple]]) -> DataFrame:
    """doc_id and the spans of each text; scan gets a whole text and returns (kind, start, end, score, base) tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in scan(t.as_py() or "")] for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(spans, _ARROW.field("spans").type)], schema=_ARROW)

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, spans {SPAN_TYPE}")


def digests(spans: DataFrame, base_kinds: tuple[str, ...], all_kinds: tuple[str, ...]) -> DataFrame:
    """n_<kind> for each base kind, base_sha256 and spans, from the spans column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(all_kinds)}
        for b in batches:
            counts: list[list[int]] = [[] for _ in base_kinds]
            shas, texts = [], []
            for row in b.column("spans"):
                spans = [(x["kind"], x["start"], x["end"], x["base"]) for x in row.as_py()]
                base = [x for x in spans if x[3]]
                for k, out in zip(base_kinds, counts, strict=True):
                    out.append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(joined(base, order).encode()).hexdigest())
                texts.append(joined(spans, order))
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["doc_id", *(f"n_{k}" for k in base_kinds), "base_sha256", "spans"])

    return mapped(spans.select("doc_id", "spans"), run, "doc_id long, " + ", ".join(f"n_{k} long" for k in base_kinds) + ", base_sha256 string, spans string")
