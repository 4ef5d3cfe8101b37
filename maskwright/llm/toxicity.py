"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (lower case, without marks at their ends) get the sum of hashed embeddings, of the word itself and of its PREFIXES
and SUFFIX in bytes, so that forms not seen before share what their stems have; there are BUCKETS embeddings of DIMS numbers.
FILTERS filters of each width slide over the words of a whole text, the greatest response of each is kept, and a logistic
layer joins them. All of it works on whole columns: hashes of words and their ends are differences of running sums over
the bytes, and filters run over a stretch of many texts' words at a time.

Training: at most ROWS labelled rows of each label and at most TRAIN_BYTES of their texts, drawn by hash of the id from
those outside the held-out remainder (both bounds are parameters); embeddings start at a word's smoothed log odds in the
first coordinate, and all layers are trained by gradient steps through the maxima.

Thresholds are calibrated by language: a text's language is guessed from its function words, and each language's
threshold is the cut of best F1 among validation rows that training didn't see (languages with few positive rows use
the common cut). A score is the logistic of the response less its language's threshold, set so that the threshold
stands at CUT. Labels, lang, source and doc_id take no part in a score.

Null texts count as empty; empty texts have the bias's score, below the cut. Rows with a null label or id teach
nothing; labels that contradict each other count each. Without labelled rows of both kinds every score is 0.05.
Repeated rows and null ids give a row each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import BATCH_ROWS, SPACE, Spelt, column_bytes, mapped, mix64, table, word_table
from maskwright.shipping import ship

BUCKETS = 1 << 15
DIMS = 12
PREFIXES = (3, 4, 5, 6)
SUFFIX = 4
WIDTHS = (1, 2, 3)
FILTERS = 6
ROWS = 3000
TRAIN_BYTES = 64 << 20
EPOCHS = 4
RATE = 0.08
CUT = 0.3
MARKS = ".,;:!?\"'()[]{}<>*%$&#|/\\-_=+~`@^0123456789"
STRETCH = 1 << 15
#: Frequent function words by language.
FUNCTION_WORDS = {"en": "the of and to in that is for with as on by are be this was", "de": "der die und den das von mit ist im dem nicht ein eine zu auf", "fr": "le la les des et du une que pour dans qui sur au est par", "es": "el los las una que del con por para es se y en lo como"}
LANGUAGES = ("other", *FUNCTION_WORDS)


FEATURES = 2 + len(PREFIXES)
_IS_WORD, _IS_MARK = word_table(SPACE), ~word_table(MARKS)


def _buckets(h: np.ndarray, kind: int) -> np.ndarray:
    return (1 + mix64(h + np.uint64(kind)) % np.uint64(BUCKETS - 1)).astype(np.uint16)


def column_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column's words in order: which of the different words each is, where each text's words end, and of the different words the buckets (of the word, its prefixes and its suffix; 0 for one it is too short to have) and the number of the language whose function word it is, or 0."""
    data, offsets = column_bytes(texts)
    hashes, feats, order, counts, n = [np.zeros(0, np.uint64)], [np.zeros((0, FEATURES), np.uint16)], [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), 0
    for part in Spelt.stretches(data, offsets, _IS_WORD):
        s, e = part.trimmed(_IS_MARK)
        counts += part.counts(s)
        h, first, which = np.unique(part.hashes(s, e), return_index=True, return_inverse=True)
        s, e = s[first], e[first]  # of a word that a stretch repeats, the ends are hashed once
        size = e - s
        ends = [_buckets(h.copy(), 0)]
        for k, least in enumerate(PREFIXES, 1):
            ends.append(np.where(size >= least, _buckets(part.hashes(s, np.minimum(s + least, e)), k), 0).astype(np.uint16))
        ends.append(np.where(size > SUFFIX, _buckets(part.hashes(np.maximum(s, e - SUFFIX), e), len(PREFIXES) + 1), 0).astype(np.uint16))
        hashes.append(h)
        feats.append(np.stack(ends, 1))
        order.append((which + n).astype(np.int32))
        n += len(h)
    known, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    at = np.searchsorted(_FUNCTION[0], known).clip(0, len(_FUNCTION[0]) - 1)
    kinds = np.where(_FUNCTION[0][at] == known, _FUNCTION[1][at], 0)
    which = which.astype(np.int32)
    return np.concatenate([which[x] for x in order]), np.cumsum(counts), np.concatenate(feats)[first], kinds


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words and the numbers of their languages; of a word in several, the last."""
    number = {w: k for k, words in enumerate(FUNCTION_WORDS.values(), 1) for w in words.split()}
    data, offsets = column_bytes(pa.array(list(number)))
    (part,) = Spelt.stretches(data, offsets, _IS_WORD)
    h = part.hashes(*part.trimmed(_IS_MARK))
    order = np.argsort(h)
    return h[order], np.array(list(number.values()))[order]


_FUNCTION = _function_words()


def languages(which: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """For each text the number in LANGUAGES of the language most of whose function words occur."""
    at = np.flatnonzero((kinds > 0)[which])
    n = np.bincount(np.searchsorted(ends, at, side="right") * len(LANGUAGES) + kinds[which[at]], minlength=len(ends) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))[:, 1:]
    return np.where(n.any(1), n.argmax(1) + 1, 0)


@dataclass
class Model:
    """emb: bucket x dim; conv: width -> filter x place x dim, and bias; out: weights and bias; cuts by language."""

    emb: np.ndarray
    conv: dict[int, tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    bias: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def responses(self, which: np.ndarray, ends: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """Of each text of a column: the joined filters' response."""
        flat = np.concatenate([self.conv[k][0].reshape(FILTERS * k, DIMS) for k in WIDTHS])
        table = (self.emb @ flat.T).astype(np.float32)  # bucket x (width, filter, place)
        rows = np.concatenate([table[feats[lo : lo + 8192]].sum(1) for lo in range(0, max(1, len(feats)), 8192)])
        starts = np.append(0, ends[:-1])
        best = [np.full((len(ends), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        for lo in range(0, len(which), STRETCH):  # all words, in stretches; a filter reaches into the next
            hi = min(lo + STRETCH, len(which))
            part = rows[which[lo : min(hi + WIDTHS[-1] - 1, len(which))]]
            text = np.searchsorted(ends, np.arange(lo, hi), side="right")
            left = ends[text] - np.arange(lo, hi)  # words of its text from each place on
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            col = 0
            for q, k in enumerate(WIDTHS):
                n = min(hi - lo, len(part) - k + 1)
                if n > 0:
                    filters = part[:, col : col + FILTERS * k].reshape(-1, FILTERS, k)
                    r = filters[:n, :, 0].copy()
                    for p in range(1, k):
                        r += filters[p : n + p, :, p]
                    r[left[:n] < k] = -np.inf
                    some = first[first < n]
                    np.maximum.at(best[q], text[some], np.maximum.reduceat(r, some, axis=0))
                col += FILTERS * k
        hidden = [np.maximum(0, np.where(np.isfinite(x), x + self.conv[k][1], 0)) for k, x in zip(WIDTHS, best, strict=True)]
        return np.concatenate(hidden, 1) @ self.out + self.bias

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a column's texts, and the numbers of the guessed languages."""
        which, ends, feats, kinds = column_words(texts)
        lang = languages(which, ends, kinds)
        x = self.responses(which, ends, feats) - self.cuts[lang] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30))), lang


def _start(docs: Iterable[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Model:
    n = np.zeros((2, BUCKETS))
    for words, label in zip(docs, y, strict=True):
        n[int(label), np.unique(words)] += 1
    size = np.bincount(y.astype(int), minlength=2)
    odds = np.log((n[1] + 0.5) / (size[1] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1))
    odds *= (n.sum(0) / (n.sum(0) + 3)).clip(0, 1)  # what is seen once or twice says little
    emb = rng.normal(0, 0.05, (BUCKETS, DIMS))
    emb[:, 0] = np.clip(odds, -2, 4) / FEATURES
    emb[0] = 0
    conv = {}
    for k in WIDTHS:
        w = rng.normal(0, 0.05, (FILTERS, k, DIMS))
        w[:, :, 0] += np.linspace(0.5, 1.0, FILTERS)[:, None] / k
        conv[k] = (w, np.full(FILTERS, -0.3))
    return Model(emb, conv, np.full(FILTERS * len(WIDTHS), 2.0 / (FILTERS * len(WIDTHS))), -1.0)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 2) -> Model | None:
    """Fit on texts and 0/1 labels; every fifth row is held back to calibrate. None without both labels."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    which, ends, feats, kinds = column_words(pa.array(texts, pa.large_string()))  # of the training rows, which are bounded
    starts = np.append(0, ends[:-1])
    buckets = lambda i: feats[which[starts[i] : ends[i]]].astype(np.int32)  # noqa: E731  of one text at a time, for all are many times the texts
    back = np.arange(len(y)) % 5 == 4 if min((y == 0).sum(), (y == 1).sum()) >= 10 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~back)
    m = _start((buckets(i) for i in fit), y[fit], rng)
    share = np.clip(y[fit].mean(), 0.01, 0.99)
    weight = {1.0: 0.5 / share, 0.0: 0.5 / (1 - share)}
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(fit):
            words = buckets(i)
            hidden, at = [], []
            e = m.emb[words].sum(1)
            for k in WIDTHS:
                w, b = m.conv[k]
                if len(words) < k:
                    hidden.append(np.zeros(FILTERS))
                    at.append(None)
                    continue
                r = sum(e[p : len(words) - k + 1 + p] @ w[:, p].T for p in range(k))
                j = r.argmax(0)
                hidden.append(np.maximum(0, r[j, np.arange(FILTERS)] + b))
                at.append(j)
            h = np.concatenate(hidden)
            z = h @ m.out + m.bias
            g = weight[y[i]] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
            if abs(g) < 1e-3:
                continue
            dh = g * m.out
            m.out -= step * g * h
            m.bias -= step * g
            for q, k in enumerate(WIDTHS):
                if at[q] is None:
                    continue
                d = np.where(hidden[q] > 0, dh[q * FILTERS : (q + 1) * FILTERS], 0)
                places = words[at[q][:, None] + np.arange(k)]  # filter x place x feature
                w, b = m.conv[k]
                ew = m.emb[places].sum(2)
                np.subtract.at(m.emb, places, (step * d[:, None, None] * w)[:, :, None, :])
                w -= step * d[:, None, None] * ew
                b -= step * d
            m.emb[0] = 0
    check = np.flatnonzero(back) if back.any() else fit
    z, lang = m.responses(which, ends, feats)[check], languages(which, ends, kinds)[check]
    common = _cut(z, y[check])
    for k in range(len(LANGUAGES)):
        own = lang == k
        m.cuts[k] = _cut(z[own], y[check][own]) if (y[check][own] == 1).sum() >= 20 else common
    return m


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F1, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    tp = np.cumsum(y)
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    i = int(np.argmax(f1))
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, rows: int = ROWS, most_bytes: int = TRAIN_BYTES) -> Model | None:
    """Train on at most `rows` labelled rows of each label and half of `most_bytes` of their texts for each, none of them held out; these texts come to the driver."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    draw = lambda k: usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = draw(0).union(draw(1))  # at most 2 * rows rows of two numbers
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    drawn = texts.select("doc_id", "toxic", "text", F.row_number().over(order).alias("n"), F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("bytes"))
    got = drawn.filter((F.col("n") <= rows) & (F.col("bytes") <= most_bytes // 2)).collect()  # repeated ids can't pass the bounds
    got.sort(key=lambda r: (r["n"], r["toxic"]))
    model = train([r["text"] for r in got], np.array([r["toxic"] for r in got]))
    pa.default_memory_pool().release_unused()  # else the driver keeps what the texts' columns took
    return model


def _scorer(documents: DataFrame, model: Model | None):
    """A function from a column of texts to scores and numbers of languages for use on executors; the model is sent once to each."""
    ship(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if held.value is None:
            return np.full(len(texts), 0.05), np.zeros(len(texts), int)
        return held.value.scores(texts)

    return score


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, language (guessed from the text)."""
    score = _scorer(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, lang = score(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(x, pa.float64()), pa.array([LANGUAGES[i] for i in lang], pa.string())], names=["doc_id", "score", "language"])

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, language string")


def without_toxic(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents whose score is below the cut, with all their columns."""
    score = _scorer(documents, fit(documents, labels))

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *(score(pa.array(text[i : i + BATCH_ROWS], pa.large_string(), from_pandas=True))[0] for i in range(0, len(text), BATCH_ROWS))]))

    return documents.filter(of(F.col("text")) < cut)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "language")
