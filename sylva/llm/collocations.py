"""Frequent phrases and their strongest parts, by Rabin-Karp fingerprints.

Tasks hash runs of one to five words in numpy, from prefix sums of a polynomial over the words' hashes, and add up equal
fingerprints before they send them, each with a pointer to one occurrence (half the hash of its text, and the number of the word
in it). A run is only counted where both its parts of one word less are frequent already, one size after the other. Where a
fingerprint is frequent, the text at its pointer is read, and a last pass compares every occurrence with that text: those that
differ, which share the fingerprint by chance, are taken off and counted by their own text. So counts are exact whatever the
hashes do, and only frequent phrases ever become rows of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm._text import Block, blocks, mix, span_hashes, word_spans
from sylva.llm.mapped import mapped, write_mapped
from sylva.llm.shared_steps import join_unique
from sylva.runtime import materialize, ship_package

#: Words of the longest phrase.
LONGEST = 5
#: Different fingerprints that a task holds before it sends them; a text beyond PIECE_BYTES is cut between pieces.
HELD, PIECE_BYTES = 2_000_000, 4 << 20
#: Parts into which a language's candidates are dealt before its first ones are told.
SALTS = 64
_MULT, _INVERSE, _WORDS = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64), 1 << 16
# Fixed: what parts pieces, and what else parts words.
_PIECE, _SPACE = ".,;:!?\n\x0b\x0c\r", " \t"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    piece, word = np.zeros(256, bool), np.zeros(256, bool)
    piece[list(_PIECE.encode())] = True
    word[list((_PIECE + _SPACE).encode())] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return piece, word, lower


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULT, _INVERSE):
        p = np.full(_WORDS + LONGEST, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@cache
def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Words:
    """The words of a block: places, hashes, the piece that each is in, the row, its language, and its number in the row."""

    def __init__(self, b: Block, row: np.ndarray, langs: list[str], before: int):
        piece, separator, lower = _tables()
        self.data = lower[b.data]
        self.starts, self.ends, begin = word_spans(self.data, b.offsets, separator)
        n = len(self.starts)
        counts = np.diff(begin)
        self.of = np.repeat(np.arange(b.n), counts)
        self.row = row
        self.number = np.arange(n) - np.repeat(begin[:-1], counts) + before
        self.hash = span_hashes(self.data, self.starts, self.ends)
        new = np.zeros(n + 1, bool)
        new[begin] = True
        new[np.searchsorted(self.starts, np.flatnonzero(piece[self.data]))] = True
        self.piece = np.cumsum(new[:n])
        self.langs = langs
        self.lang = np.repeat(np.array([_lang_hash(x) for x in langs], np.uint64), counts)

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words begin that lie within a piece."""
        n = len(self) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def fingerprints(self, at: np.ndarray, size: int, bits: int) -> np.ndarray:
        """The fingerprints of the runs that begin at ``at`` (ascending), by differences of prefix polynomials: ``bits`` bits, then
        three for the size."""
        out = np.empty(len(at), np.uint64)
        power, inverse = _powers()
        for base in range(0, len(self), _WORDS):
            low, high = np.searchsorted(at, [base, base + _WORDS])
            if low == high:
                continue
            part = self.hash[base : base + _WORDS + LONGEST - 1]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=total[1:])
            i = at[low:high] - base
            out[low:high] = (total[i + size] - total[i]) * inverse[i]
        kept = (mix(mix(out) ^ self.lang[at]) >> np.uint64(64 - bits)) << np.uint64(3)
        return (kept | np.uint64(size)).view(np.int64)

    def text(self, i: int, size: int) -> str:
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(i, i + size)).decode()


def _words(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch (lang, text), block by block; a very long text in several blocks, cut where a piece ends."""
    langs = batch.column("lang").to_pylist()
    piece = _tables()[0]
    for b in blocks(batch.column("text")):
        rows, own = np.arange(b.first, b.first + b.n), langs[b.first : b.first + b.n]
        if b.n > 1 or len(b.data) <= PIECE_BYTES:
            yield Words(b, rows, own, 0)
            continue
        at, number = 0, 0
        while at < len(b.data):
            end = min(len(b.data), at + PIECE_BYTES)
            if end < len(b.data):
                inner = np.flatnonzero(piece[b.data[at:end]])
                later = np.flatnonzero(piece[b.data[end:]])[:1] if not len(inner) else inner
                end = at + int(inner[-1]) + 1 if len(inner) else end + int(later[0]) + 1 if len(later) else len(b.data)
            w = Words(Block(b.first, b.data[at:end], np.array([0, end - at])), rows, own, number)
            yield w
            number += len(w)
            at = end


def _distinct(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``fp`` that brings equal ones together, and where in it another one begins.

    Positions are sorted along in the low bits, several times as fast as sorting by index. Fingerprints that differ only in these
    bits may take turns, so that a run of one falls apart: it is added up later.
    """
    low = np.int64((1 << len(fp).bit_length()) - 1)
    order = np.sort(fp & ~low | np.arange(len(fp))) & low
    ordered = fp[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


class _Tally:
    """Counts of fingerprints with a pointer each, equal ones added up when many are held."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, fp: np.ndarray, at: np.ndarray) -> None:
        if len(fp):
            order, new = _distinct(fp)
            first = order[new]
            self.parts.append([fp[first], np.diff(new, append=len(fp)), at[first]])
            self.held += len(new)

    def emit(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """All that is held, once it is more than ``least`` even when equal ones are added up."""
        if self.held > least:
            fp, n, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order, new = _distinct(fp)
            first = order[new]
            self.parts, self.held = [[fp[first], np.add.reduceat(n[order], new), at[first]]], len(new)
        if self.parts and self.held > least * 3 // 4:
            fp, n, at = self.parts[0]
            for i in range(0, len(fp), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[s], pa.int64()) for x in (fp, n, at)], ["fp", "n", "at"])
            self.parts, self.held = [], 0


def _pointer(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Half of the hash of a text, and the number of a word in it."""
    return doc & ~np.int64(0xFFFFFFFF) | word


def _count(rows: DataFrame, size: int, known: tuple[str, ...] | None, bits: int) -> DataFrame:
    """fp, n, at: the runs of ``size`` words, or those of them whose parts of one word less are among ``known``, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, table = _Tally(), mapped(known, "fp") if known is not None else None
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for w in _words(batch):
                at = w.grams(size)
                if table is not None:
                    fits, part = np.zeros(len(w), bool), w.grams(size - 1)
                    fits[part] = table.find(w.fingerprints(part, size - 1, bits)) >= 0
                    at = at[fits[at] & fits[at + 1]]
                tally.add(w.fingerprints(at, size, bits), _pointer(docs[w.row[w.of[at]]], w.number[at]))
                if tally.held > HELD:
                    yield from tally.emit(HELD)
        yield from tally.emit()

    return rows.mapInArrow(run, "fp long, n long, at long").groupBy("fp").agg(F.sum("n").alias("n"), F.first("at").alias("at"))


def _totals(rows: DataFrame) -> DataFrame:
    """lang, total: the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for batch in batches:
            langs, separator = batch.column("lang").to_pylist(), _tables()[1]
            for b in blocks(batch.column("text")):
                for x, k in zip(langs[b.first : b.first + b.n], np.diff(word_spans(b.data, b.offsets, separator)[2]).tolist(), strict=True):
                    totals[x] = totals.get(x, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "n"])

    return rows.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("total"))


_PHRASE = ["fp", "n", "size", "lang", "text", "of", *(f"h{k}" for k in range(LONGEST))]


def _texts(rows: DataFrame, counted: DataFrame, bits: int) -> DataFrame:
    """fp, n, size, lang, text, of (the language's hash), h0 .. h4 (the words' hashes) of each fingerprint (fp, n, at), read where its pointer points."""
    pointers = counted.select("fp", "n", F.col("fp").bitwiseAND(7).alias("size"), F.shiftright("at", 32).alias("doc"), F.col("at").bitwiseAND(0x7FFFFFFF).alias("word"))
    paths = tuple(write_mapped(pointers, "doc", "phrase-pointers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = mapped(paths, "doc"), set()
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            found = table.find(docs >> 32)
            keep = [i for i in np.flatnonzero(found >= 0).tolist() if not (docs[i] in done or done.add(docs[i]))]
            if not keep:
                continue
            own, out = found[keep], []
            for w in _words(batch.take(pa.array(keep))):
                begin = np.searchsorted(w.of, np.arange(len(w.langs) + 1))
                for i, lang in enumerate(w.langs):
                    first, last = int(begin[i]), int(begin[i + 1])
                    if first == last:
                        continue
                    wanted = table.rows(int(own[w.row[i]]))
                    fps, ns, sizes, words = (wanted.column(c).to_numpy() for c in ("fp", "n", "size", "word"))
                    at = first + words - int(w.number[first])
                    for size in np.unique(sizes).tolist():
                        some = np.flatnonzero((sizes == size) & (at >= first) & (at + size <= last))
                        some = some[np.argsort(at[some], kind="stable")]
                        # half a hash may be another text's: what stands here must have the fingerprint
                        some = some[(w.piece[at[some]] == w.piece[at[some] + size - 1]) & (w.fingerprints(at[some], size, bits) == fps[some])]
                        for k, j in zip(some.tolist(), at[some].tolist(), strict=True):
                            h = w.hash[j : j + size].view(np.int64).tolist()
                            out.append((int(fps[k]), int(ns[k]), size, lang, w.text(j, size), int(w.lang[j : j + 1].view(np.int64)[0]), *h, *[0] * (LONGEST - size)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string() if k in (3, 4) else pa.int64()) for k in range(len(_PHRASE))], _PHRASE)

    schema = ", ".join(f"{c} {'string' if c in ('lang', 'text') else 'long'}" for c in _PHRASE)
    # a text that many documents are is found in several tasks
    one = rows.mapInArrow(run, schema).groupBy("fp").agg(F.min(F.struct(*_PHRASE[1:])).alias("x"))
    return one.select("fp", "x.*")


def _verify(rows: DataFrame, phrases: DataFrame, least: int, bits: int) -> DataFrame:
    """size, lang, text, n of the phrases that occur ``least`` times or more. Every occurrence of a fingerprint of ``phrases`` is
    compared with its text; those that differ are taken off its count, and counted under their own text.

    Words are compared byte by byte with the phrase of one word that has their fingerprint, longer runs word by word: all
    words of a frequent run are frequent, so that they are among ``phrases``.
    """
    paths = tuple(write_mapped(phrases, "fp", "phrases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, other = mapped(paths, "fp"), {}
        for batch in batches:
            for w in _words(batch):
                fits, true = None, np.zeros(len(w), bool)
                for size in range(1, LONGEST + 1):
                    at = w.grams(size)
                    fp = w.fingerprints(at, size, bits)
                    row = table.find(fp)
                    at, fp, row = at[row >= 0], fp[row >= 0], row[row >= 0]
                    shorter, fits = fits, np.zeros(len(w), bool)
                    fits[at] = True
                    if size > 1:  # as they were counted
                        counted = shorter[at] & shorter[at + 1]
                        at, fp, row = at[counted], fp[counted], row[counted]
                    one, of = np.unique(row, return_inverse=True)
                    if not len(one):
                        break
                    good = w.lang[at].view(np.int64) == table.column("of", one).to_numpy()[of]
                    for k in range(size):
                        good &= w.hash[at + k].view(np.int64) == table.column(f"h{k}", one).to_numpy()[of]
                    if size == 1:
                        good[good] = _equal(w, at[good], table.column("text", one), of[good])
                        true[at] = good
                    else:
                        for k in range(size):
                            good &= true[at + k]
                    for i, x in zip(at[~good].tolist(), fp[~good].tolist(), strict=True):
                        key = x, size, w.langs[w.of[i]], w.text(i, size)
                        other[key] = other.get(key, 0) + 1
        keys = list(other)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64() if i < 2 else pa.string()) for i in range(4)), pa.array(list(other.values()), pa.int64())], ["fp", "size", "lang", "text", "n"])

    differ = materialize(rows.mapInArrow(run, "fp long, size long, lang string, text string, n long").groupBy("fp", "size", "lang", "text").agg(F.sum("n").alias("off")), "phrase-collisions")
    # an occurrence may differ by a word's hash alone and still have the text
    both = differ.join(phrases.select("fp", "lang", "text"), ["fp", "lang", "text"], "left_semi")
    wrong = differ.join(both, ["fp", "size", "lang", "text"], "left_anti")
    right = phrases.join(wrong.groupBy("fp").agg(F.sum("off").alias("off")), "fp", "left").select("size", "lang", "text", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n"))
    own = wrong.groupBy("size", "lang", "text").agg(F.sum("off").alias("n"))
    return right.unionByName(own).filter(F.col("n") >= least)


def _equal(w: Words, at: np.ndarray, texts: pa.Array, of: np.ndarray) -> np.ndarray:
    """Whether the bytes of the words ``at`` are those of the texts numbered ``of``."""
    body = texts.cast(pa.large_binary())
    begin = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2], np.uint8) if body.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = w.ends[at] - w.starts[at]
    same = size == (begin[1:] - begin[:-1])[of]
    for low in range(0, len(at), _WORDS):  # bounds the memory for bytes
        s = slice(low, low + _WORDS)
        n = np.where(same[s], size[s], 0)
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        differ = w.data[np.repeat(w.starts[at[s]], n) + step] != data[np.repeat(begin[:-1][of[s]], n) + step]
        if differ.any():
            same[low + np.unique(np.repeat(np.arange(len(n)), n)[differ])] = False
    return same


def frequent_phrases(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang", bits: int = 61) -> tuple[DataFrame, DataFrame]:
    """The phrases of 1 to ``LONGEST`` words that occur ``least`` times or more in their language (size, lang, text, n), and the words
    of each language (lang, total); both written.

    Fingerprints have ``bits`` bits, 61 at most. Fewer make more collisions and more work, never other counts.
    """
    ship_package(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), body.cast("binary").alias("text"), F.xxhash64(body, F.coalesce(F.col(lang).cast("string"), F.lit("und"))).alias("doc"))
    totals = materialize(_totals(rows), "phrase-totals")
    found: list[DataFrame] = []
    for size in range(1, LONGEST + 1):
        paths = tuple(write_mapped(found[-1].select("fp"), "fp", "frequent")) if found else None
        found.append(materialize(_count(rows, size, paths, bits).filter(F.col("n") >= least), "fingerprints"))
        # the cleaner deletes the shuffle files of a size before the next one's are written
        docs.sparkSession.sparkContext._jvm.System.gc()
    phrases = materialize(_texts(rows, reduce(DataFrame.unionByName, found), bits), "phrase-texts")
    return materialize(_verify(rows, phrases, least, bits), "phrases"), totals


def score_phrases(phrases: DataFrame, totals: DataFrame, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases of two words or more.

    A phrase with a occurrences is cut where floor(1000 a n / (l r)) is smallest, l and r being the counts of its parts and n
    the words of the language; of equal cuts the one after the fewest words. Phrases within a longer one that is as
    frequent go. ``phrases`` (size, lang, text, n) has all parts of each phrase, as any part is as frequent at least.
    """
    words = F.split("text", " ", -1)
    # languages are few, but nothing says so: joined by key, heavy ones broadcast
    candidates = join_unique(phrases.filter("size > 1"), totals, ["lang"]).select("lang", "size", F.col("text").alias("phrase"), F.col("n").alias("a"), F.col("total").alias("n"), words.alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k"), "words", "size")
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size").cast("int") - F.col("k")), " ").alias("right"))
    cuts = materialize(cuts, "phrase-cuts")
    count = lambda part, name: phrases.select("lang", F.col("text").alias(part), F.col("n").alias(name))
    cuts = materialize(join_unique(cuts, count("left", "l"), ["lang", "left"]), "phrase-left")
    cuts = join_unique(cuts, count("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    longer = candidates.filter("size > 2").select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size").cast("int") - 1)).alias("m"))
    longer = longer.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - F.col("m") + 1)).alias("i"))
    inner = longer.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("within"))
    left = best.join(inner, ["lang", "phrase"], "left").filter("within is null or within < a").drop("within")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first ones of each part of a language, and of those the first ones
    part = left.withColumn("part", F.xxhash64("phrase") % SALTS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocations(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """The strongest phrases of each language: see ``frequent_phrases`` and ``score_phrases``.

    Null text is empty, a null language is ``und``; ids aren't looked at, and rows that repeat count as often as they stand
    there. Phrases are told lower-cased (A-Z), with one space between words, and don't go across punctuation or lines. No
    text or no frequent phrase: no rows. Other columns aren't looked at. A task holds a text and some twenty times a
    block of it; a text without punctuation is one block however long.
    """
    return score_phrases(*frequent_phrases(docs, least), first)
