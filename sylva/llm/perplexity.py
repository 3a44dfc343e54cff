"""Quality rules with n-gram perplexity: a modified Kneser-Ney model of five characters, counted in Spark.

Spark counts each run of five characters (code points; case and digits folded) of all documents exactly, packed into two
numbers, and derives the lower orders from them: continuation counts, modified discounts, backoff weights of contexts and
interpolated probabilities are all joins and aggregations. Workers get the model as sorted arrays of 64-bit hashes, or, of
a model too large for that, each document's part by a join. The model is one for all languages, so that a passage in
another language isn't taken for noise; an n-gram that no other text has is judged without its own count, so that noise
doesn't vouch for itself. A document is rejected if its mean log-perplexity is below or above the band of its language,
which the spread of the language's own documents sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm._text import WHITESPACE, Block, blocks, mix, span_hashes, windows, word_spans
from sylva.llm.lookup import entries_of, with_entries
from sylva.runtime import discard, materialize, ship_package

ORDER, BITS = 5, 21
_ONE, _TWO, _THREE = ((1 << BITS * k) - 1 for k in (1, 2, 3))
#: A band reaches so many interquartile ranges below and above the quartiles of its language, and at least so far (natural logarithm).
BAND, LEAST_BAND = (2.0, 2.0), 0.02
#: Documents of fewer characters are too short for a verdict of the model.
MIN_CHARS = 40
#: A model of up to so many n-grams and contexts (24 bytes each) is broadcast; beyond, documents are joined to it.
BROADCAST_ENTRIES = 4_000_000
#: Up to so many languages' bands (about 100 bytes each) are broadcast; beyond, documents are joined to them.
BROADCAST_LANGUAGES = 100_000
#: Characters of a text that are made into n-grams at once, and different n-grams that a task holds before it sends their counts on.
PIECE, HELD = 1 << 20, 1 << 20
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WORDS = 20, 30, 8
MARKS = b"#*$%&|<>"

#: What the first byte of a character gives to its code point, folded.
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[WHITESPACE] = 32
_FOLD[0x80:] &= np.where(_FOLD[0x80:] < 0xE0, 0x1F, np.where(_FOLD[0x80:] < 0xF0, 0x0F, 0x07))
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(MARKS)] = True


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of UTF-8 texts, and where each text's begin."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(at, offsets)
    lead = data[at]
    out = _FOLD[lead]
    more = np.flatnonzero(lead >= 0xC0)
    size = np.diff(at, append=len(data))[more]
    for k in (1, 2, 3):
        m = more[size > k]
        out[m] = out[m] << 6 | data[at[m] + k] & 0x3F
    return out & _ONE, first


def packed(c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each character with the four before it, the last three in the second number. White space precedes a text."""
    place = np.arange(len(c)) - np.repeat(first[:-1], np.diff(first))
    back = [c]
    for k in range(1, ORDER):
        x = np.full_like(c, 32)
        x[k:] = c[:-k]
        x[place < k] = 32
        back.append(x)
    return back[4] << BITS | back[3], back[2] << 2 * BITS | back[1] << BITS | back[0]


def suffix(hi, lo, k: int):
    """The last ``k`` of five packed characters; of numpy arrays or of columns."""
    return (hi, lo) if k == 5 else (_and(hi, _ONE), lo) if k == 4 else (hi * 0, _and(lo, (_ONE, _TWO, _THREE)[k - 1]))


def context(hi, lo):
    """Packed characters without the last one."""
    if isinstance(hi, Column):
        return F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(_and(hi, _ONE), 2 * BITS))
    return hi >> BITS, lo >> BITS | (hi & _ONE) << 2 * BITS


def _and(x, mask: int):
    return x.bitwiseAND(F.lit(mask)) if isinstance(x, Column) else x & mask


def _hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(hi.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ lo.astype(np.uint64))


def _summed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams with the sums of their counts."""
    key, back = np.unique(_hash(hi, lo), return_inverse=True)
    at = np.empty(len(key), np.int64)
    at[back] = np.arange(len(back))
    return hi[at], lo[at], np.bincount(back, n, len(key)).astype(np.int64)


def _pieces(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of a block with the count and the number of the text of each; of a very long text, which is cut in pieces,
    each n-gram once."""
    c, first = characters(b.data, b.offsets)
    if b.n > 1 or len(c) <= PIECE:
        hi, lo = packed(c, first)
        yield hi, lo, np.ones(len(c), np.int64), np.repeat(np.arange(b.n), np.diff(first))
        return
    sums = (np.zeros(0, np.int64),) * 3
    for a in range(0, len(c), PIECE):
        lead = max(0, a - ORDER + 1)
        part = c[lead : a + PIECE]
        hi, lo = packed(part, np.array([0, len(part)]))
        sums = _summed(*(np.concatenate(x) for x in zip(sums, (hi[a - lead :], lo[a - lead :], np.ones(len(part) - a + lead, np.int64)), strict=True)))
    yield *sums, np.zeros(len(sums[0]), np.int64)


def count_ngrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """hi, lo, n of each run of five characters of all texts. Counts are summed in tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            sums = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["hi", "lo", "n"])

        for batch in batches:
            for b in blocks(batch.column("text")):
                held += [_summed(*p[:3]) for p in _pieces(b) if len(p[0])]
                if sum(len(h[0]) for h in held) >= 2 * HELD:
                    held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) >= HELD:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams that occur once to four times; 1/2 where there are none to tell."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y, n = n1 / (n1 + 2 * n2), (n1, n2, n3, n4)
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return [min(max(x, 0.1), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """From the counts of five characters: kind, hi, lo, a, raw of each n-gram (kind is its order, a its log-probability,
    interpolated, raw its occurrences) and of each context (kind is 10 and the order, a the logarithm of its backoff weight);
    and the log-probability of an unknown character. Orders below five count continuations."""
    level = materialize(counts.select(F.lit(5).cast("long").alias("kind"), "hi", "lo", F.col("n").alias("raw"), "n"), "ngrams-5")
    levels = [level]
    for k in range(ORDER - 1, 0, -1):
        hi, lo = suffix(F.col("hi"), F.col("lo"), k)
        level = levels[0].groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.sum("raw").alias("raw"), F.count("*").alias("n"))
        levels.insert(0, materialize(level.select(F.lit(k).cast("long").alias("kind"), "hi", "lo", "raw", "n"), f"ngrams-{k}"))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    told = {r.kind: r for r in every.groupBy("kind").agg(F.count("*").alias("types"), F.sum("n").alias("total"), *[F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).collect()}
    one = told.get(1)
    floor = float(np.log(0.5 / (one.total + 0.5 * (one.types + 1)))) if one else 0.0
    done = [levels[0].select("kind", "hi", "lo", ((F.col("n") + 0.5) / F.lit(one.total + 0.5 * (one.types + 1) if one else 1.0)).alias("p"), "raw")]
    contexts = []
    for k in range(2, ORDER + 1):
        d = discounts(*(told[k][f"n{j}"] for j in (1, 2, 3, 4))) if k in told else [0.5] * 3
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        (chi, clo), (shi, slo) = context(F.col("hi"), F.col("lo")), suffix(F.col("hi"), F.col("lo"), k - 1)
        x = levels[k - 1].select("*", off.alias("off"), chi.alias("chi"), clo.alias("clo"), shi.alias("shi"), slo.alias("slo"))
        ctx = materialize(x.groupBy("chi", "clo").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("gamma")), f"contexts-{k}")
        below = done[-1].select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("below"))
        p = x.join(ctx, ["chi", "clo"]).join(below, ["shi", "slo"]).select("kind", "hi", "lo", ((F.col("n") - F.col("off")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p"), "raw")
        done.append(materialize(p, f"probabilities-{k}"))
        contexts.append(ctx.select(F.lit(10 + k).cast("long").alias("kind"), F.col("chi").alias("hi"), F.col("clo").alias("lo"), F.log("gamma").alias("a"), F.lit(0).cast("long").alias("raw")))
    out = contexts[0]
    for x in contexts[1:]:
        out = out.unionByName(x)
    for x in done:
        out = out.unionByName(x.select("kind", "hi", "lo", F.log("p").alias("a"), "raw"))
    out = materialize(out, "kneser-ney")
    discard(*levels)
    return out, floor


@dataclass
class KneserNey:
    """Sorted hashes of n-grams, by order, with log-probabilities and occurrences; of contexts with logarithms of backoff weights."""

    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: float

    @staticmethod
    def of(kind: np.ndarray, hi: np.ndarray, lo: np.ndarray, a: np.ndarray, raw: np.ndarray, floor: float) -> KneserNey:
        grams, contexts = {}, {}
        for k in range(1, ORDER + 1):
            for c in (k, 10 + k):
                at = np.flatnonzero(kind == c)
                key = _hash(hi[at], lo[at])
                order = np.argsort(key)
                if c == k:
                    grams[k] = key[order], a[at][order], raw[at][order]
                else:
                    contexts[k] = key[order], a[at][order]
        return KneserNey(grams, contexts, floor)

    def log_prob(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, n: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log-probability of the last character of n-grams that texts ``doc`` have ``n`` times: of the longest known one,
        backed off. An n-gram all of whose occurrences are in one text counts as unknown there.

        An n-gram is in one text alone only if all longer ones that end with it are, so that the occurrences among what
        longer orders don't know are all that a text has of it.
        """
        if not len(hi):
            return np.zeros(0)
        key, back = np.unique(_hash(hi, lo), return_inverse=True)
        keys, logs, raws = self.grams[k]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        raw = np.where(known, raws[at], 0) if len(keys) else np.zeros(len(key), np.int64)
        out = (np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(key)))[back]
        # no text has more of an n-gram than all of these together
        rare = np.flatnonzero((raw <= np.bincount(back, n, len(key)))[back])
        if len(rare):
            _, own = np.unique(mix(doc[rare].astype(np.uint64) + np.uint64(1)) ^ key[back[rare]], return_inverse=True)
            lost = rare[np.bincount(own, n[rare])[own] >= raw[back[rare]]]
            if k == 1:
                out[lost] = self.floor
            elif len(lost):
                ctx, gamma = self.contexts[k]
                c = _hash(*context(hi[lost], lo[lost]))
                at = np.minimum(np.searchsorted(ctx, c), max(len(ctx) - 1, 0))
                weight = np.where(ctx[at] == c, gamma[at], 0.0) if len(ctx) else np.zeros(len(c))
                out[lost] = weight + self.log_prob(*suffix(hi[lost], lo[lost], k - 1), doc[lost], n[lost], k - 1)
        return out

    def total(self, b: Block) -> np.ndarray:
        """The log-probability of each text of a block."""
        out = np.zeros(b.n)
        for hi, lo, n, doc in _pieces(b):
            out += np.bincount(doc, self.log_prob(hi, lo, doc, n) * n, b.n)
        return out


def language(lang: str) -> F.Column:
    return F.coalesce(F.lower(F.trim(F.col(lang).cast("string"))), F.lit(""))


_COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_chars_seen", pa.int64()), ("log_perplexity", pa.float64())]


def _between(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def measures(b: Block, model: KneserNey) -> list[np.ndarray]:
    """The columns of _COLUMNS for a block of documents."""
    s, e, first = word_spans(b.data, b.offsets)
    h = span_hashes(b.data, s, e)
    n_words = np.diff(first)
    of = np.repeat(np.arange(b.n), n_words)
    lead = (b.data & 0xC0) != 0x80
    word_chars = _between(lead & ~WHITESPACE[b.data], b.offsets)
    symbols = _between(_IS_MARK[b.data], b.offsets)
    # lines with a word, and how many different ones
    ls, le, lfirst = word_spans(b.data, b.offsets, _NEWLINE)
    ink = np.concatenate([[0], np.cumsum(~WHITESPACE[b.data])])
    with_word = ink[le] > ink[ls]
    lof = np.repeat(np.arange(b.n), np.diff(lfirst))
    lh = span_hashes(b.data, ls, le)[with_word] ^ mix(lof[with_word].astype(np.uint64))
    different = np.bincount(lof[with_word][np.unique(lh, return_index=True)[1]], minlength=b.n)
    dup_lines = np.bincount(lof[with_word], minlength=b.n) - different
    # words inside windows that occur twice in their document
    repeat = np.zeros(b.n, np.int64)
    w = windows(h, REPEAT_WORDS)
    at = np.flatnonzero(of[: len(w)] == of[REPEAT_WORDS - 1 :]) if len(w) else np.zeros(0, int)
    if len(at):
        _, back, times = np.unique(w[at] ^ mix(of[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        twice = at[times[back] > 1]
        edge = np.bincount(twice, minlength=len(h) + 1) - np.bincount(twice + REPEAT_WORDS, minlength=len(h) + 1)
        repeat = np.bincount(of[np.cumsum(edge)[: len(h)] > 0], minlength=b.n)
    n_chars = _between(lead, b.offsets)
    return [n_words, word_chars, symbols, dup_lines, repeat, n_chars, -model.total(b) / np.maximum(n_chars, 1)]


def _measured(parts: list[list[np.ndarray]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, (_, t) in enumerate(_COLUMNS)], [n for n, _ in _COLUMNS])


def score_documents(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, lang, and the measures of each row, by the model of all rows."""
    spark = docs.sparkSession
    ship_package(spark)
    table, floor = kneser_ney(count_ngrams(docs, text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), language(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    kind = "struct<" + ", ".join(f"{n}: {'double' if t == pa.float64() else 'bigint'}" for n, t in _COLUMNS) + ">"
    names = ["kind", "hi", "lo", "a", "raw"]
    if table.count() <= BROADCAST_ENTRIES:
        t = table.toArrow()
        shared = spark.sparkContext.broadcast(KneserNey.of(*(t.column(c).to_numpy() for c in names), floor))  # BROADCAST_ENTRIES bounds it

        @F.arrow_udf(kind)
        def measure(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in column:
                yield _measured([measures(b, shared.value) for b in blocks(batch)])

        out = rows.select("doc_id", "lang", measure.asNondeterministic()("text").alias("m"))
    else:

        def keys(b: Block) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            parts = []
            for hi, lo, _, doc in _pieces(b):
                for k in range(1, ORDER + 1):
                    s = suffix(hi, lo, k)
                    parts += [(doc, np.full(len(hi), k), *s)] + ([(doc, np.full(len(hi), 10 + k), *context(*s))] if k > 1 else [])
            of, kind, hi, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.unique(mix(_hash(hi, lo) + kind.astype(np.uint64)) ^ mix(of.astype(np.uint64)), return_index=True)[1]
            return of[at], {"kind": kind[at], "hi": hi[at], "lo": lo[at]}

        joined, _, found = with_entries(rows, "text", table, ["kind", "hi", "lo"], keys)

        @F.arrow_udf(kind)
        def measure_one(text: pa.Array, entries: pa.Array) -> pa.Array:
            models = (KneserNey.of(*entries_of(entries, i, names), floor) for i in range(len(text)))
            return _measured([measures(next(blocks(text.slice(i, 1))), m) for i, m in enumerate(models)])

        out = joined.select("doc_id", "lang", measure_one.asNondeterministic()("text", found).alias("m"))
    return out.select("doc_id", "lang", *[f"m.{n}" for n, _ in _COLUMNS])


def perplexity_rules(docs: DataFrame, band: tuple[float, float] = BAND, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log_perplexity, lower, upper.

    Bands come from the quartiles of the documents that pass the base rules, ``band`` interquartile ranges below and above.
    A mean over few characters scatters more: for documents shorter than their language's median the band is wider by the
    root of the ratio. Null text has no words and fails the base rules. A null language is language ''; a language in which no
    document passes has no band and rejects none by it. Rows may repeat; ids may be null. Very long texts are made into
    n-grams in pieces. Other columns of the input, of whatever names, are not looked at.
    """
    scored = score_documents(docs, doc_id, lang, text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = materialize(scored.withColumn("base_failed", failed), "perplexity")
    able = scored.filter(~F.col("base_failed") & (F.col("n_chars_seen") >= MIN_CHARS))
    bands = materialize(able.groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"), F.percentile_approx("n_chars_seen", 0.5, 10_000).alias("middle")), "bands")
    wider = F.greatest(F.lit(1.0), F.sqrt(F.col("middle") / F.greatest("n_chars_seen", F.lit(1))))
    down, up = (F.greatest(F.lit(LEAST_BAND), x * (F.col("q")[1] - F.col("q")[0])) * wider for x in band)
    judged = scored.join(F.broadcast(bands) if bands.count() <= BROADCAST_LANGUAGES else bands, "lang", "left").select(scored["*"], (F.col("q")[0] - down).alias("lower"), (F.col("q")[1] + up).alias("upper"))
    inside = F.col("lower").isNull() | (F.col("n_chars_seen") < MIN_CHARS) | F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "lower", "upper",
    )
