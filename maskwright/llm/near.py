"""Near-duplicate documents by MinHash over k-mers, verified by banded alignment.

Words are lower-cased and split at white space; a k-mer is five words (the whole text where there are fewer), for the
tables labelled with its occurrence. Each of TABLES tables orders the labelled k-mers by its own hash and takes the
SAMPLE smallest: their hash is the text's key in that table, so texts meet if they share the minima. The minima's order
in the text is no part of the key: an edit renumbers the later occurrences of a repeated k-mer and so moves its labels,
and order is the alignment's to judge. Texts of up to SMALL k-mers also have a key for each k-mer of their prefix under
one hash order, where no pair at the threshold can be missed.

Similarity of two texts: k-mers matched by an alignment (in the same order in both), over the k-mers of either. It is
the longest common subsequence of the plain k-mers; labels only bound it, from above by those that both texts hold and
from below by the longest increasing run of their places, and where the bounds are equal they are it. An alignment at
the threshold leaves few k-mers unmatched on either side, so matches further off the diagonal lie outside the band and
are left out. The threshold is 0.8; an alignment is no larger than the labelled k-mers in common, so at it a pair misses
all tables about 5 times in a million, with repeated k-mers or without.

Equal texts are collapsed first, with their count. A key's texts are compared with the one among them that shares
most keys with others, which stands in the middle of a group of copies; components of the links found so far give
labels. Where a key still holds texts under different labels, the texts outside its most frequent label are compared
with all others across labels if sketches of their k-mers, the least of each of SKETCH bins, put their similarity no more
than ERRORS standard errors below the threshold (a pair at the threshold fails about once in a hundred million; texts
of few k-mers have few to a bin and are estimated all the better). Pairs within a label are not needed:
classes are the connected components of the verified links. So a large group of copies costs comparisons in proportion to
it, with a few strange texts under its keys too. Large keys are joined by joins whose partitions Spark splits, and
searched for pairs in blocks of BLOCK texts against BLOCK, each a task's group of its own: a text outside the most
frequent label is copied once for each block of all texts, one of that label once for each block of those outside.

Null and empty texts have no k-mers and link to nothing but texts equal to them (null counts as empty). A class's id
is the smallest id of its documents, null if all are null. Repeated rows are members like any other. Empty tables give
empty results; columns other than doc_id and text are ignored by classes(), carried along by one_of_each().
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import SPACE, dropped, hashed_words, mapped, mix64, occurrence_labels, rolled, staged, table, word_table
from maskwright.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TABLES = 40
SAMPLE = 6
SMALL = 30
SKETCH = 1024
ERRORS = 6
BLOCK = 1024
#: Ids of texts are broadcast up to this number (16 bytes each), and joined by merging beyond it.
FEW_IDS = 1 << 20
_CHUNK = 8192
_SALTS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, (2, TABLES), dtype=np.uint64) | np.uint64(1)


_IS_WORD = word_table(SPACE)


def with_occurrences(plain: np.ndarray) -> np.ndarray:
    occ = occurrence_labels(plain)
    labelled = plain.copy()
    again = occ > 0
    if again.any():
        labelled[again] = mix64(plain[again] + occ[again].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return labelled


def column_kmers(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its k-mers in text order, plain and labelled with their occurrence."""
    for words in hashed_words(texts, _IS_WORD):
        plain = rolled(words, WORDS)
        yield plain, with_occurrences(plain)


def kmers(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return next(column_kmers(pa.array([text], pa.string())))


def keys(plain: np.ndarray, labelled: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The text's keys: one a table in the tables' order, then those of a small text's prefix."""
    n = len(plain)
    if not n:
        return np.zeros(0, np.int64)
    best_h = best_at = None
    for lo in range(0, n, _CHUNK):  # whole text, in stretches
        h = (labelled[None, lo : lo + _CHUNK] ^ _SALTS[0][:, None]) * _SALTS[1][:, None]
        h ^= h >> np.uint64(29)
        at = np.broadcast_to(np.arange(lo, lo + h.shape[1]), h.shape)
        if best_h is not None:
            h, at = np.concatenate([best_h, h], 1), np.concatenate([best_at, at], 1)
        if h.shape[1] > SAMPLE:
            top = np.argpartition(h, SAMPLE - 1, axis=1)[:, :SAMPLE]
            h, at = np.take_along_axis(h, top, 1), np.take_along_axis(at, top, 1)
        best_h, best_at = h, at
    minima = np.sort(labelled[best_at], axis=1)
    out = np.arange(1, TABLES + 1, dtype=np.uint64)
    for j in range(minima.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + minima[:, j])
    if n <= SMALL:
        prefix = np.sort(mix64(labelled.copy()))[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
        out = np.concatenate([out, prefix])
    return out.view(np.int64)


def sketch(labelled: np.ndarray) -> np.ndarray:
    """8 bits, from 1 on, of the least k-mer in each of SKETCH bins that a hash deals them to; 0 for an empty bin."""
    h = np.sort(mix64(labelled + np.uint64(6)))
    at = (h // np.uint64(2**64 // SKETCH)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(h) else []
    out = np.zeros(SKETCH, np.uint8)
    out[at[first]] = 1 + mix64(h[first]) % np.uint64(255)
    return out


def agreement(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bins with equal minima over bins that either fills, of one sketch and each of others: an estimate of their k-mers' Jaccard similarity."""
    return ((others == one) & (one > 0)).sum(1) / np.maximum(1, ((others | one) > 0).sum(1))


def least_agreement(threshold: float) -> float:
    """Share of equal minima below which two texts are taken not to reach the threshold."""
    return threshold - ERRORS * (threshold * (1 - threshold) / SKETCH) ** 0.5


def banded_lcs(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Length of the longest common subsequence if it is `need` or more, else a number below that. Bit-parallel over a, a
    stretch of b at a time; only the places of a that an alignment of that length can match are held, a bit each."""
    n, m = len(a), len(b)
    if need > min(n, m):
        return 0
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    a, b = a[head:], b[head:]
    k -= head
    differ = np.flatnonzero(a[len(a) - k :] != b[len(b) - k :])
    tail = k - 1 - int(differ[-1]) if len(differ) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m, least = len(a), len(b), max(0, need - head - tail)
    left, right = m - least, n - least  # a match of place j has its place in a from j - left to j + right
    if left < 0 or right < 0:
        return 0
    step = max(256, (left + right) // 2)
    lo = hi = v = passed = 0  # v: a[lo:hi], a 0 where the length grows
    for at in range(0, m, step):
        part = b[at : at + step]
        new_lo, new_hi = min(n, max(lo, at - left)), min(n, at + len(part) + right)
        gone = min(new_lo, hi) - lo
        passed += gone - (v & ((1 << gone) - 1)).bit_count()
        v >>= gone
        if new_hi > hi:
            v |= ((1 << (new_hi - hi)) - 1) << (hi - lo - gone)
        lo, hi = new_lo, max(hi, new_hi)
        full = (1 << (hi - lo)) - 1
        masks: dict[int, int] = dict.fromkeys(part.tolist(), 0)
        for i in np.flatnonzero(np.isin(a[lo:hi], part)).tolist():
            masks[int(a[lo + i])] |= 1 << i
        for x in part.tolist():
            if hit := masks[x]:
                u = v & hit
                v = ((v + u) | (v - u)) & full
        if passed + (hi - lo) - v.bit_count() + m - at - len(part) < least:
            return 0
    return head + tail + passed + (hi - lo) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, labelled: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Aligned k-mers over all k-mers of two texts, from their plain k-mers (and the labelled ones, if at hand); 0 below the threshold."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    _, i, j = np.intersect1d(*(labelled or (with_occurrences(a), with_occurrences(b))), assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        best = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(tails, x)
            tails[at : at + 1] = [x]
        best = len(tails)
        if best < len(j) and len(np.unique(a)) + len(np.unique(b)) < n + m:  # without repeats the run is the alignment
            best = banded_lcs(a, b, need)
    return best / (n + m - best) if best >= need else 0.0


def text_id(text: Column) -> Column:
    """16 bytes of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)), 1, 16)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, rid (of the text), n (k-mers), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for plain, labelled in column_kmers(b.column("text")):
                n.append(len(plain))
                out.append(keys(plain, labelled))
            yield pa.record_batch([b.column("doc_id"), b.column("rid"), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "rid", "n", "keys"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("rid"), "text")
    return mapped(rows, run, "doc_id long, rid binary, n long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def of(rid: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if rid not in held:
                if len(held) >= 64:
                    held.clear()
                held[rid] = kmers(text)
            return held[rid]

        def reached(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
            return similarity(x[0], y[0], threshold, (x[1], y[1])) >= threshold - 1e-9

        for batch in batches:
            ok = [reached(of(a.as_py(), s.as_py()), of(b.as_py(), t.as_py())) for a, b, s, t in zip(*(batch.column(c) for c in ("a", "b", "ta", "tb")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
    return mapped(full.select("a", "b", "ta", "tb"), run, "a binary, b binary")


def links(documents: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a, b) between different texts, enough of them that components equal those of all links found.

    rows: written signatures()."""
    # sets of ids grow with the data, so they are joined by merging and never broadcast
    distinct = staged(rows.groupBy("rid").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
    dealt = distinct.select("rid", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = staged(dealt.join(shared.hint("merge"), "key").select("key", "rid", "c"))
    score = staged(met.groupBy("rid").agg(F.sum("c").alias("score")))
    rids = score.select("rid")
    rids = F.broadcast(rids) if rids.count() <= FEW_IDS else rids.hint("merge")
    texts = documents.select(text_id(F.col("text")).alias("rid"), F.coalesce("text", F.lit("")).alias("text")).join(rids, "rid", "left_semi")
    texts = staged(texts.groupBy("rid").agg(F.first("text").alias("text")))
    middle = staged(met.join(score, "rid").groupBy("key").agg(F.max_by("rid", F.struct("score", "rid")).alias("b")))
    star = met.select("key", F.col("rid").alias("a")).join(middle, "key").filter("a <> b").select("a", "b").distinct()
    found = staged(_verified(star, texts, threshold))
    label = components(found).select(F.col("node").alias("rid"), "label")
    labelled = staged(met.join(label, "rid", "left").select("key", "rid", F.coalesce("label", "rid").alias("label")))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all"))
    mixed = staged(sizes.filter("most < all").select("key", "major", "most", (F.col("all") - F.col("most")).alias("others")))
    open_ = labelled.join(mixed, "key")
    sketches = _sketches(texts.join(open_.select("rid").distinct(), "rid", "left_semi"))
    open_ = staged(open_.join(distinct.hint("merge"), "rid").join(sketches.hint("merge"), "rid"))
    rest = staged(_across(open_, threshold).distinct())
    more = staged(_verified(rest, texts, threshold))
    dropped(distinct, met, score, texts, middle, labelled, mixed, open_, rest)
    return found.union(more)


def _sketches(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("rid"), pa.array([sketch(x).tobytes() for _, x in column_kmers(b.column("text"))], pa.binary())], names=["rid", "sketch"])

    return mapped(texts.select("rid", "text"), run, "rid binary, sketch binary")


def _across(open_: DataFrame, threshold: float) -> DataFrame:
    """open_: key, rid, label, n, keys, sketch, and of the key: major (its most frequent label), most (texts under that) and others. Pairs (a, b) under different labels whose sketches come near the threshold; each pair that shares a table once, under the first they share."""
    least = least_agreement(threshold)

    def of(g: pa.Table) -> list[tuple[bytes, bytes]]:
        key, same = g.column("key")[0].as_py(), g.column("same")[0].as_py()
        side, n, rid = g.column("side").to_numpy(), g.column("n").to_numpy(), g.column("rid").to_pylist()
        tables = np.array([k[:TABLES] for k in g.column("keys").to_pylist()], np.int64)
        minima = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        _, label = np.unique(np.array([x.hex() for x in g.column("label").to_pylist()]), return_inverse=True)
        here = tables == key
        at = int(here.any(0).argmax()) if here.any() else TABLES  # the table of this key; beyond them: a small text's
        out: list[tuple[bytes, bytes]] = []
        for x in range(len(rid)):
            if same:
                y = np.flatnonzero((label != label[x]) & (np.arange(len(rid)) > x))
            elif side[x]:
                continue
            else:
                y = np.flatnonzero((label != label[x]) & (side == 1))
            y = y[(n[y] >= threshold * n[x]) & (n[x] >= threshold * n[y])]
            if at < TABLES and len(y):
                y = y[(tables[y] == tables[x]).argmax(1) == at]
            if len(y):
                y = y[agreement(minima[x], minima[y]) >= least]
            out += [(rid[x], rid[z]) for z in y.tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        held: pa.Table | None = None
        names = ("key", "kind", "i", "j")

        def groups(t: pa.Table) -> np.ndarray:
            c = [t.column(x).to_numpy() for x in names]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in c], axis=0)
            return np.flatnonzero(new)

        def found(t: pa.Table, starts: np.ndarray, stop: int) -> pa.RecordBatch:
            out = [p for lo, hi in zip(starts, [*starts[1:], stop], strict=True) if hi - lo > 1 for p in of(t.slice(lo, hi - lo))]
            return pa.record_batch([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            starts = groups(held)
            if len(starts) > 1:
                yield found(held, starts[:-1], int(starts[-1]))
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield found(held, groups(held), held.num_rows)

    # kind 0: a block i of texts outside the most frequent label (side 0) against a block j of those under it; kind 1: two blocks of the former
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    one = lambda kind, i, j, side, same: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"), same.alias("same"))
    outside, own = F.col("label") != F.col("major"), F.col("own")
    every = lambda c: F.sequence(F.lit(0), count(c) - 1)
    no = F.lit(False)
    to_major = F.transform(every("most"), lambda j: one(0, own, j, 0, no))
    to_others = F.transform(every("others"), lambda o: one(1, F.least(own, o), F.greatest(own, o), own > o, own == o))
    from_major = F.transform(every("others"), lambda i: one(0, i, own, 1, no))
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("rid"), F.when(outside, count("others")).otherwise(count("most"))).cast("int"))
    dealt = dealt.select("key", "rid", "label", "n", "keys", "sketch", F.inline(F.when(outside, F.concat(to_major, to_others)).otherwise(from_major)))
    pairs = mapped(dealt.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j"), run, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, rid, class_id, class_size, distinct_texts, kept (true for the rows of the text that stands for its class under the class's id)."""
    rows = staged(signatures(documents))
    texts = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    label = components(links(documents, rows, threshold)).select(F.col("node").alias("rid"), "label")
    texts = staged(texts.join(label, "rid", "left").select("rid", "copies", "least", F.coalesce("label", "rid").alias("label")))
    whole = texts.groupBy("label").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("distinct_texts"), F.min(F.struct(F.col("least").isNull().alias("no"), F.col("least").alias("id"), F.col("rid").alias("rid"))).alias("best"))
    named = texts.select("rid", "label").join(whole, "label").select("rid", F.col("best.id").alias("class_id"), F.col("best.rid").alias("best_rid"), "class_size", "distinct_texts")
    out = rows.select("doc_id", "rid").join(named, "rid")
    kept = (F.col("rid") == F.col("best_rid")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", "rid", "class_id", "class_size", "distinct_texts", kept.alias("kept"))


def near_classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, class_id, class_size, distinct_texts, kept."""
    return classes(documents, threshold).drop("rid")


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row of each class: the smallest id's."""
    kept = classes(documents, threshold).filter("kept").select("rid", F.col("doc_id").alias("id")).distinct()
    rows = documents.select(F.struct("*").alias("row"), text_id(F.col("text")).alias("rid"), F.col("doc_id").cast("long").alias("id"))
    held = rows.join(kept.select(F.col("rid").alias("r"), F.col("id").alias("i")), (F.col("rid") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    return held.dropDuplicates(["rid"]).select("row.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
