"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds cut its score into grades:
``P(grade <= k) = logistic(threshold_k - score)``. That gives each document an expected grade and the probability of at
least a given grade, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm._text import Block, blocks, span_hashes, word_spans
from sylva.llm.toxicity import held_out, labelled
from sylva.runtime import discard, materialize, ship_package

#: Hashed features: words, and shapes of words (letters, capitals, digits and signs with runs made one); one more for repeats.
WORDS, SHAPES = 1 << 14, 1 << 12
SIZE = WORDS + SHAPES + 1
#: Labelled documents that the regression is fitted on, about, and the features that these have together, at most.
FIT_ROWS, FIT_FEATURES = 12_000, 16_000_000
_STEPS, _RATE, _RIDGE, _SCALE = 150, 0.3, 1e-4, 10.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def feature_tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of a block's documents as tokens: each token's feature, its weight, and where each document's begin.

    A document's weights of words, of shapes and of repeats are parts of its number of words.
    """
    s, e, first = word_spans(b.data, b.offsets)
    h = span_hashes(b.data, s, e, lower=True)
    n = np.diff(first)
    of = np.repeat(np.arange(b.n), n)
    shape = _SHAPE[b.data]
    stay = np.ones(len(shape), bool)
    stay[1:] = shape[1:] != shape[:-1]
    stay[b.offsets[:-1][b.offsets[:-1] < len(shape)]] = True
    at = np.concatenate([[0], np.cumsum(stay)])[b.offsets]
    shape = shape[stay]
    s2, e2, first2 = word_spans(shape, at)
    h2 = span_hashes(shape, s2, e2)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    doc = np.concatenate([of, np.repeat(np.arange(b.n), np.diff(first2)), of[again]])
    feature = np.concatenate([(h >> np.uint64(50)).astype(np.int64), (h2 >> np.uint64(52)).astype(np.int64) + WORDS, np.full(again.sum(), SIZE - 1)])
    order = np.argsort(doc, kind="stable")
    doc, feature = doc[order], feature[order]
    return feature, (_SCALE / np.maximum(n, 1))[doc], np.searchsorted(doc, np.arange(b.n + 1))


@dataclass
class OrdinalModel:
    """grades in order, the shared weights, and the thresholds between grades in order."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) of each document for each grade but the first."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(score) @ np.diff(self.grades)


def fit_ordinal(grade: np.ndarray, feature: np.ndarray, value: np.ndarray, first: np.ndarray) -> OrdinalModel:
    """Maximum likelihood with a small ridge by full-batch Adam; thresholds are a first one and positive steps.

    No document or one grade: no thresholds, so that the expected grade is that grade (0 without any)."""
    grades = np.unique(grade).astype(np.float64)
    k = len(grades) - 1
    if k < 1:
        return OrdinalModel(grades if len(grades) else np.zeros(1), np.zeros(SIZE), np.zeros(0))
    y = np.searchsorted(grades, grade)
    doc = np.repeat(np.arange(len(grade)), np.diff(first))
    share = np.array([np.mean(y <= j) for j in range(k)]).clip(1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(SIZE), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    rows = np.arange(len(y))
    for step in range(1, _STEPS + 1):
        w, steps = p[:SIZE], np.exp(p[SIZE + 1 :])
        t = p[SIZE] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(doc, w[feature] * value, len(y))
        below = np.concatenate([np.zeros((len(y), 1)), logistic(t[None, :] - score[:, None]), np.ones((len(y), 1))], 1)
        slope = below * (1 - below)
        hi, lo = below[rows, y + 1], below[rows, y]
        each = np.maximum(hi - lo, 1e-12) * len(y)
        d_hi, d_lo = -slope[rows, y + 1] / each, slope[rows, y] / each
        g_score = -(d_hi + d_lo)
        g_t = np.bincount(y, d_hi, k + 1)[:k] + np.bincount(y, d_lo, k + 1)[1:]
        g = np.empty_like(p)
        g[:SIZE] = np.bincount(feature, g_score[doc] * value, SIZE) + _RIDGE * w
        g[SIZE] = g_t.sum()
        g[SIZE + 1 :] = g_t[::-1].cumsum()[::-1][1:] * steps
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(grades, p[:SIZE].astype(np.float32), p[SIZE] + np.concatenate([[0.0], np.cumsum(np.exp(p[SIZE + 1 :]))]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """The regression fitted on labelled documents that aren't held out: all of them, or a hash range of about ``rows``.

    Where rows share a labelled doc_id, or texts are so long that all have more than ``FIT_FEATURES`` features, a hash range of
    the texts is taken, so that what comes to the driver is bounded whatever the tables hold.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = labels.count()
    chosen = labels if n <= rows else labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < F.lit(int(1_000_000 * rows / n)))
    some = labelled(docs, chosen, label, doc_id, text).select(F.col("text").cast("binary").alias("text"), F.col("label").cast("double").alias("grade"), F.xxhash64("text", F.lit("fit")).alias("key"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = batch.column("grade").to_numpy(zero_copy_only=False)
            for b in blocks(batch.column("text")):
                feature, value, first = feature_tokens(b)
                of = np.repeat(np.arange(b.n), np.diff(first))
                key, at = np.unique(of * SIZE + feature, return_inverse=True)
                own = batch.column("key").slice(b.first, b.n)
                bounds = pa.array(np.searchsorted(key // SIZE, np.arange(b.n + 1)).astype(np.int32))
                f = pa.ListArray.from_arrays(bounds, pa.array((key % SIZE).astype(np.int32)))
                x = pa.ListArray.from_arrays(bounds, pa.array(np.bincount(at, value, len(key)).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(grade[b.first : b.first + b.n]), f, x, own], ["grade", "feature", "value", "key"])

    measured = materialize(some.mapInArrow(measure, "grade double, feature array<int>, value array<float>, key long"), "quality-features")
    here, features = measured.agg(F.count("*"), F.coalesce(F.sum(F.size("feature")), F.lit(0))).first()
    share = min(1.0, rows / here if here > 1.1 * rows else 1.0, FIT_FEATURES / max(features, 1))
    used = measured if share == 1.0 else measured.filter(F.pmod("key", F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))
    t = used.select("grade", "feature", "value").toArrow()
    discard(measured)
    if not t.num_rows:
        return fit_ordinal(np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64))
    f, x = t.column("feature").combine_chunks(), t.column("value").combine_chunks()
    first = np.concatenate([[0], np.cumsum(f.value_lengths().to_numpy())])
    return fit_ordinal(t.column("grade").to_numpy(), f.flatten().to_numpy(), x.flatten().to_numpy(), first)


def quality_udf(spark, model: OrdinalModel, least_grade: float | None = None):
    """An Arrow UDF from text (as binary) to expected grade and P(grade >= ``least_grade``); by default the second lowest."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # SIZE weights
    least = least_grade if least_grade is not None else model.grades[min(1, len(model.grades) - 1)]
    level = int(np.searchsorted(model.grades, least))

    @F.arrow_udf("struct<expected_grade: double, tail_prob: double>")
    def quality(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in column:
            expected, tail = np.zeros(len(batch)), np.zeros(len(batch))
            for b in blocks(batch):
                feature, value, first = feature_tokens(b)
                score = np.diff(np.concatenate([[0.0], np.cumsum(m.weights[feature] * value)])[first])
                here = slice(b.first, b.first + b.n)
                expected[here] = m.expected(score)
                tail[here] = 1.0 if level == 0 else 0.0 if level > len(m.thresholds) else m.tails(score)[:, level - 1]
            yield pa.StructArray.from_arrays([pa.array(expected), pa.array(tail)], ["expected_grade", "tail_prob"])

    return quality.asNondeterministic()  # else a plan that uses the result twice may compute it twice


def score_quality(docs: DataFrame, labels: DataFrame, least_grade: float | None = None, least_prob: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob, selected of each row, from its whole text alone.

    A document is selected if the probability of at least ``least_grade`` (the second lowest grade there is) reaches
    ``least_prob``. Null and empty texts have no features: the thresholds alone decide. Null grades aren't used; repeated
    labels of a document count as the largest. No labels or one grade: every document is selected. Rows may repeat.
    """
    quality = quality_udf(docs.sparkSession, fit_quality(docs, labels, doc_id=doc_id, text=text), least_grade)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), quality(F.col(text).cast("binary")).alias("q"))
    return out.select("doc_id", "held_out", "q.expected_grade", "q.tail_prob", (F.col("q.tail_prob") >= least_prob).alias("selected"))
