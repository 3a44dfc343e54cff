"""Toxicity by class-conditional Kneser-Ney models of words and word pairs with a shared backoff.

The class is the outermost context, and the orders below count contexts instead of occurrences, so that copies of one
document weigh no more than the document:

- ``p(w | class)`` discounts the number of different words before ``w`` in the class and gives the rest to an order that
  both classes share, the number of different words before ``w`` in either;
- ``p(w | v, class)`` discounts the number of different words before the pair ``v w`` in the class and gives the rest of
  what follows ``v`` to ``p(w | class)``.

Both classes keep the same words and pairs above the shared order: those that the toxic class has in more contexts than the
discount takes. All else is a rare expression and is smoothed by the shared counts alone, by which both classes give it the
same odds. Spark counts over all labelled documents; workers get the log-ratios as sorted hash arrays, or, of a model too
large for that, each document's part by a join. A document's evidence is the log-likelihood under the toxic model less
that under the ordinary one, what each word has of it beyond a margin, over the root of its number of words; a logistic
link of this one feature gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm._text import Block, blocks, mix, span_hashes, word_spans
from sylva.llm.lookup import entries_of, with_entries
from sylva.runtime import materialize, ship_package

#: Contexts that the discount takes from a word and from a pair.
WORD_DISCOUNT, PAIR_DISCOUNT = 2.0, 4.0
#: Log-ratio (natural) of a word up to which it is no evidence, and what one word can tell at most.
MARGIN, MOST = 0.5, 8.0
#: Labelled documents on which the link is fitted, at most; the counts cover all of them.
LINK_ROWS = 20_000
#: Up to so many labels (20 bytes each) are broadcast to the documents; beyond, the two are joined by a shuffle.
BROADCAST_LABELS = 4_000_000
#: A model of up to so many words and pairs (24 bytes each) is broadcast; beyond, documents are joined to it.
BROADCAST_ENTRIES = 4_000_000
#: Words that a task holds before it sends their contexts on.
HELD_WORDS = 1 << 18

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, label of the labelled documents that aren't held out."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col(label).alias("label"))
    own = own.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    own = F.broadcast(own) if labels.count() <= BROADCAST_LABELS else own
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.join(own, d.doc_id == F.col("label_id")).select("doc_id", "text", "label")


@dataclass
class Words:
    """The words of a block: hashes, the words before them (1 at a text's first), pairs of both, and where texts begin."""

    w: np.ndarray
    v: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    first: np.ndarray
    follows: np.ndarray

    @staticmethod
    def of(b: Block) -> Words:
        s, e, first = word_spans(b.data, b.offsets, _SEPARATOR)
        w = span_hashes(b.data, s, e, lower=True)
        place = np.arange(len(w)) - np.repeat(first[:-1], np.diff(first))
        v, before = np.ones_like(w), np.ones_like(w)
        v[1:], before[2:] = w[:-1], w[:-2]
        v[place == 0] = 1
        before[place < 2] = 1
        return Words(w, v, mix(v * _PAIR + w), before, first, place > 0)


def _low(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32).view(np.int32)


def word_contexts(rows: DataFrame) -> DataFrame:
    """key, n0, n1, c0, c1, c of each word of ``rows`` (text, toxic): occurrences in toxic and in ordinary rows, and the
    number of different words before it in toxic rows, in ordinary ones and in all. A text's first word follows the start."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            w, v, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            _, at, back = np.unique(mix(v * _PAIR + w), return_index=True, return_inverse=True)
            n = [np.bincount(back[m], minlength=len(at)) for m in (toxic, ~toxic)]
            order = np.argsort(w[at])  # rows of one word together: their keys are packed better on their way
            at, n = at[order], [x[order] for x in n]
            return pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), pa.array(_low(v[at])), *(pa.array(x.astype(np.int32)) for x in n)], ["key", "before", "n0", "n1"])

        for batch in batches:
            toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), bool)
            for b in blocks(batch.column("text")):
                x = Words.of(b)
                held.append((x.w, x.v, np.repeat(toxic[b.first : b.first + b.n], np.diff(x.first))))
                if sum(len(h[0]) for h in held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    pairs = rows.mapInArrow(count, "key long, before int, n0 int, n1 int").groupBy("key", "before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return pairs.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(F.col("n0") > 0).alias("c0"), F.count_if(F.col("n1") > 0).alias("c1"), F.count("*").alias("c"))


def pair_contexts(rows: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """pair, key, before, c of each pair of words of ``rows`` (text), only of those ``known`` if given: its second and first
    word, and the number of different words before it."""
    shared = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            pair, w, v, before = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at = np.unique(mix(before * _PAIR + pair), return_index=True)[1]
            at = at[np.argsort(pair[at])]
            return pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (pair, w, v)), pa.array(_low(before[at]))], ["pair", "key", "before", "context"])

        for batch in batches:
            for b in blocks(batch.column("text")):
                x = Words.of(b)
                m = x.follows
                if shared is not None:
                    m = m & _has(shared.value, x.pair)
                held.append((x.pair[m], x.w[m], x.v[m], x.before[m]))
                if sum(len(h[0]) for h in held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    found = rows.select("text").mapInArrow(count, "pair long, key long, before long, context int").distinct()
    return found.groupBy("pair", "key", "before").agg(F.count("*").alias("c"))


def _has(keys: np.ndarray, q: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, q), len(keys) - 1)] == q if len(keys) else np.zeros(len(q), bool)


def _value(keys: np.ndarray, values: np.ndarray, q: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(q), other)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return np.where(keys[at] == q, values[at], other)


@dataclass
class Ratios:
    """Sorted hashes of words with the log-ratio of each (``u``) and what it adds as the word before (``g``); sorted hashes
    of pairs with the log-ratio of their second word (``d``); ``rare``: the log-ratio of all other words."""

    words: np.ndarray
    u: np.ndarray
    g: np.ndarray
    pairs: np.ndarray
    d: np.ndarray
    rare: float

    @staticmethod
    def of(key: np.ndarray, kind: np.ndarray, a: np.ndarray, g: np.ndarray, rare: float) -> Ratios:
        """From rows of words (kind 0) and pairs (kind 1)."""
        key = key.view(np.uint64)
        order = np.lexsort((key, kind))
        n = int((kind == 0).sum())
        w, p = order[:n], order[n:]
        return Ratios(key[w], a[w], g[w], key[p], a[p], rare)

    def evidence(self, x: Words) -> np.ndarray:
        """log p(w | toxic) - log p(w | ordinary) of each word of a block."""
        alone = _value(self.words, self.u, x.w, self.rare) + np.where(x.follows, _value(self.words, self.g, x.v, 0.0), 0.0)
        if not len(self.pairs):
            return alone
        at = np.minimum(np.searchsorted(self.pairs, x.pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == x.pair) & x.follows, self.d[at], alone)

    def feature(self, x: Words) -> np.ndarray:
        """Of each text: its words' evidence beyond the margin, over the root of their number; 0 without words."""
        c = np.concatenate([[0.0], np.cumsum(np.maximum(np.minimum(self.evidence(x), MOST) - MARGIN, 0.0))])
        return (c[x.first[1:]] - c[x.first[:-1]]) / np.sqrt(np.maximum(np.diff(x.first), 1))


@dataclass
class ToxicModel:
    """table: key, kind (0: word, 1: pair), a, g of all entries; rare: the log-ratio of other words; link: bias and weight."""

    table: DataFrame
    entries: int
    rare: float
    link: np.ndarray

    @property
    def local(self) -> bool:
        return self.entries <= BROADCAST_ENTRIES

    def ratios(self) -> Ratios:
        t = self.table.toArrow()
        return Ratios.of(*(t.column(c).to_numpy() for c in ("key", "kind", "a", "g")), self.rare)

    def score(self, feature: np.ndarray) -> np.ndarray:
        return logistic(self.link, feature)


def logistic(link: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(link[0] + link[1] * x, -40, 40)))


def fit_link(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Bias and weight of a logistic link by Newton's method with a small ridge. One class only: a constant score."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([8.0 if len(y) and y[0] else -8.0, 0.0])
    a = np.stack([np.ones(len(x)), x], 1)
    w, ridge = np.zeros(2), 0.1 * np.eye(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def class_models(rows: DataFrame) -> tuple[DataFrame, float]:
    """The entries (key, kind, a, g) and the log-ratio of other words from ``rows`` (text: binary, toxic: boolean)."""
    words = materialize(word_contexts(rows), "toxic-words")
    kept = [F.when(F.col("c0") > WORD_DISCOUNT, F.greatest(F.col(f"c{k}") - WORD_DISCOUNT, F.lit(0.0))).otherwise(0.0) for k in (0, 1)]
    s = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("c0", "c1", "c")], *[F.coalesce(F.sum(k), F.lit(0.0)).alias(f"k{i}") for i, k in enumerate(kept)]).first()
    total = [max(s.c0, 1.0), max(s.c1, 1.0)]
    gamma = [(n - k) / n if n else 1.0 for n, k in ((s.c0, s.k0), (s.c1, s.k1))]
    rare = float(np.log(gamma[0] / gamma[1]))
    prob = [k / F.lit(total[i]) + F.lit(gamma[i]) * F.col("c") / F.lit(max(s.c, 1.0)) for i, k in enumerate(kept)]
    known = words.filter(F.col("c0") > WORD_DISCOUNT).select("key", "n0", "n1", prob[0].alias("p0"), prob[1].alias("p1"))

    toxic = pair_contexts(rows.filter("toxic"))
    toxic = materialize(toxic.filter(F.col("c") > PAIR_DISCOUNT), "toxic-pairs")
    small = toxic.count() <= BROADCAST_ENTRIES
    listed = np.sort(toxic.select("pair").toArrow().column("pair").to_numpy().view(np.uint64)) if small else None
    usual = pair_contexts(rows.filter("not toxic"), listed).select("pair", F.col("c").alias("c1"))
    pairs = toxic.select("pair", "key", "before", F.col("c").alias("c0")).join(usual, "pair", "left").withColumn("c1", F.coalesce("c1", F.lit(0)))
    pairs = materialize(pairs.select("pair", "key", "before", *[F.greatest(F.col(f"c{k}") - PAIR_DISCOUNT, F.lit(0.0)).alias(f"k{k}") for k in (0, 1)]), "toxic-pair-counts")

    # what follows a word in the pairs, and what is left of its occurrences
    after = pairs.groupBy("before").agg(F.sum("k0").alias("s0"), F.sum("k1").alias("s1"))
    left = [F.when(F.col(f"n{k}") > 0, F.coalesce((F.col(f"n{k}") - F.col(f"s{k}")) / F.col(f"n{k}"), F.lit(1.0))).otherwise(1.0) for k in (0, 1)]
    known = materialize(known.join(after.withColumnRenamed("before", "key"), "key", "left").select("key", "n0", "n1", "p0", "p1", left[0].alias("g0"), left[1].alias("g1")), "toxic-known")
    second, first = known.select("key", "p0", "p1"), known.select(F.col("key").alias("before"), "n0", "n1", "g0", "g1")
    both = pairs.join(second, "key").join(first, "before")
    high = [F.when(F.col(f"n{k}") > 0, F.col(f"k{k}") / F.col(f"n{k}")).otherwise(0.0) + F.col(f"g{k}") * F.col(f"p{k}") for k in (0, 1)]
    table = known.select("key", F.lit(0).cast("long").alias("kind"), F.log(F.col("p0") / F.col("p1")).alias("a"), F.log(F.col("g0") / F.col("g1")).alias("g"))
    table = table.unionByName(both.select(F.col("pair").alias("key"), F.lit(1).cast("long").alias("kind"), F.log(high[0] / high[1]).alias("a"), F.lit(0.0).alias("g")))
    return materialize(table, "toxic-model"), rare


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicModel:
    """Counts over all labelled documents that aren't held out; the link on about LINK_ROWS of them."""
    ship_package(docs.sparkSession)
    rows = labelled(docs, labels, label, doc_id, text)
    table, rare = class_models(rows.select(F.col("text").cast("binary").alias("text"), (F.col("label") > 0).alias("toxic")))
    model = ToxicModel(table, table.count(), rare, np.zeros(2))
    n = labels.count()
    if n > LINK_ROWS:  # a hash range that holds about so many
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("link")), F.lit(1_000_000)) < F.lit(int(1_000_000 * LINK_ROWS / n)))
    some = rows.select((F.col("label") > 0).cast("double").alias("y"), F.col("text").cast("binary").alias("text"))
    t = _with_feature(some, model, "text", "x").select("y", "x").toArrow()
    model.link = fit_link(t.column("x").to_numpy(), t.column("y").to_numpy())
    return model


def _with_feature(docs: DataFrame, model: ToxicModel, text: str, name: str) -> DataFrame:
    """``docs`` with the feature of each text: from the model in every worker, or from each text's own part of it by a join."""
    if model.local:
        shared = docs.sparkSession.sparkContext.broadcast(model.ratios())  # BROADCAST_ENTRIES bounds it

        @F.arrow_udf("double")
        def feature(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            m = shared.value
            for batch in column:
                yield pa.array(np.concatenate([np.zeros(0), *(m.feature(Words.of(b)) for b in blocks(batch))]))

        # without the mark a plan that uses the result twice may compute it twice
        return docs.withColumn(name, feature.asNondeterministic()(F.col(text).cast("binary")))

    def keys(b: Block) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x = Words.of(b)
        of = np.repeat(np.arange(b.n), np.diff(x.first))
        key, kind, of = np.concatenate([x.w, x.pair[x.follows]]), np.repeat([0, 1], [len(x.w), int(x.follows.sum())]), np.concatenate([of, of[x.follows]])
        at = np.unique(mix(mix(key + kind.astype(np.uint64)) ^ of.astype(np.uint64)), return_index=True)[1]
        return of[at], {"key": key[at].view(np.int64), "kind": kind[at]}

    rare = model.rare
    rows, row, found = with_entries(docs, text, model.table, ["key", "kind"], keys)

    @F.arrow_udf("double")
    def joined(text: pa.Array, entries: pa.Array) -> pa.Array:
        parts = (Ratios.of(*entries_of(entries, i, ["key", "kind", "a", "g"]), rare) for i in range(len(text)))
        return pa.array([float(m.feature(Words.of(next(blocks(text.slice(i, 1)))))[0]) for i, m in enumerate(parts)], pa.float64())

    return rows.withColumn(name, joined.asNondeterministic()(F.col(text).cast("binary"), F.col(found))).drop(row, found)


def with_score(docs: DataFrame, model: ToxicModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1) of each text as column ``name``."""
    bias, weight = (F.lit(float(x)) for x in model.link)
    z = F.least(F.greatest(bias + weight * F.col(name), F.lit(-40.0)), F.lit(40.0))
    return _with_feature(docs, model, text, name).withColumn(name, 1 / (1 + F.exp(-z)))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row, from its whole text alone.

    Null and empty texts have no words and get the link's score for no evidence. Null ids are not held out. Repeated labels
    of a document count as the largest; labels of unknown documents and null labels are not used. No label, or labels of
    one class: a constant score. Rows may repeat. Other columns of the input are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    out = with_score(rows, fit_toxicity(docs, labels, doc_id=doc_id, text=text), name="score").drop("text")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
