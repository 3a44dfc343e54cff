"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items' words goes to every task. A document's words stream through it with the longest matching
length so far; where that length reaches the window, the last words are a window of some item. Only stretches whose
neighbouring words are neighbours in some item are streamed: elsewhere no match is longer than a word.

Items of more words than an automaton is to have are dealt to parts, an automaton each. Documents that have a window of any
item by its hash go through the automata one after the other, and what these find is put together: the result is the same.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm._text import blocks, span_hashes, windows, word_spans
from sylva.runtime import fresh_name, materialize, ship_package

#: Words of a window.
WINDOW = 10
#: Documents of which so large a part is hit are dropped; of the others the hit spans are cut out.
MAX_COVERAGE = 0.5
#: Words of the items of one automaton, about: it has up to twice as many states (some 300 bytes each), and each worker holds it.
PART_WORDS = 200_000
#: Hashes of windows (8 bytes each) that are broadcast at once to find the documents that have any.
WINDOW_HASHES = 8_000_000

_KEPT = {*range(48, 58), *range(97, 123), *range(128, 256)}
#: Bytes after lower-casing A-Z, with all that separates words as a space.
NORMAL = bytes(c if c in _KEPT else 32 for c in (b + 32 if 65 <= b <= 90 else b for b in range(256)))
_NORMAL = np.frombuffer(NORMAL, np.uint8)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class ItemAutomaton:
    """The generalised suffix automaton of items, each a (name, words) pair."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary = _Vocabulary()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, ids in known:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n = len(self.next)
        self.windows: dict[int, set[str]] = {}
        own: dict[int, list[tuple[str, int]]] = {}
        pairs, singles = set(), set()
        for name, ids in known:
            state = 0
            pairs.update(zip(ids, ids[1:]))
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.windows.setdefault(self._at_window(state), set()).add(name)
            if len(ids) < window:
                own.setdefault(state, []).append((name, len(ids)))
                if len(ids) == 1:
                    singles.add(ids[0])
        # whole short items that end where a state's words end, longer states first inheriting from their suffixes
        self.short: dict[int, list[tuple[str, int]]] = {}
        for s in sorted(range(1, n), key=self.length.__getitem__):
            if found := own.get(s, []) + self.short.get(self.link[s], []):
                self.short[s] = found
        self.least = min([window, *(k for found in own.values() for _, k in found)])
        self.pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), np.int64)
        self.singles = np.array(sorted(singles), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the shorter words that reach it from p."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _at_window(self, state: int) -> int:
        """The state that holds the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where at least ``least`` consecutive words could match: bounds of words."""
        n = len(ids)
        if n < self.least or not len(self.pairs) and not len(self.singles):
            return []
        ok = np.zeros(n + 1, bool)  # at i: words i-1 and i are neighbours in an item
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(self.pairs) and len(both):
            code = ids[both] * len(self.vocabulary) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            ok[both[self.pairs[at] == code] + 1] = True
        edge = np.diff(ok.astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
        out = [(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b - a >= self.least]
        if len(self.singles):
            out += [(i, i + 1) for i in np.flatnonzero(np.isin(ids, self.singles)).tolist()]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans of words (merged, in order), names of items with an occurring window, and the longest match."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        hits: list[tuple[int, int]] = []
        names: set[str] = set()
        longest = 0
        nxt, link, length, w = self.next, self.link, self.length, self.window
        for a, b in self.stretches(ids):
            state = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state, size = nxt[state][c], size + 1
                else:
                    state = size = 0
                longest = max(longest, size)
                if size >= w:
                    hits.append((i + 1 - w, i + 1))
                    names |= self.windows.get(self._at_window(state), set())
                for name, k in self.short.get(state, ()):
                    if k <= size:
                        hits.append((i + 1 - k, i + 1))
                        names.add(name)
        return joined(hits), names, longest

    def clean(self, text: bytes) -> bytes:
        """The text without its hit spans; again while cutting brings words together that are a window."""
        while True:
            spans, _, _ = self.scan(words_of(text))
            if not spans:
                return text
            text = without(text, spans)


def item_parts(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """part, name, words (bytes, single spaces between) of the items, and the number of parts, of about PART_WORDS words each.

    Long items are cut into stretches that overlap by a window less one word, which keeps their windows. Null texts have no
    words; a null id is the name ''.
    """
    ship_package(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = words_of(batch.column("text")[i].as_py() or b"")
                step = max(1, PART_WORDS // 4)
                own = [w[a : a + step + window - 1] for a in range(0, max(len(w) - window + 1, 1), step)] if w else []
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("name")[i].as_py()] * len(own), pa.string()), pa.array([b" ".join(x) for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())], ["name", "words", "n"])

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(text).cast("binary").alias("text"))
    rows = materialize(rows.mapInArrow(cut, "name string, words binary, n long").distinct(), "items")
    n_parts = max(1, math.ceil((rows.agg(F.sum("n")).first()[0] or 0) / PART_WORDS))
    return rows.select(F.pmod(F.xxhash64("name", "words"), F.lit(n_parts)).alias("part"), "name", "words"), n_parts


def automaton_of(items: DataFrame, part: int, window: int = WINDOW) -> ItemAutomaton:
    """The automaton of one part of ``item_parts``."""
    rows = items.filter(F.col("part") == part).select("name", "words").collect()  # about PART_WORDS words
    return ItemAutomaton([(r.name, bytes(r.words).split(b" ")) for r in sorted(rows, key=lambda r: (r.name, bytes(r.words)))], window)


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given spans of words."""
    at = [m.span() for m in _WORD.finditer(text.translate(NORMAL))]
    out, upto = [], 0
    for a, b in spans:
        out.append(text[upto : at[a][0]])
        upto = at[b - 1][1]
    return b"".join([*out, text[upto:]])


def _window_hashes(data: np.ndarray, offsets: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the hashes of the windows of normalised texts, and the number of the text of each."""
    s, e, first = word_spans(data, offsets)
    h = span_hashes(data, s, e)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out = []
    for k in sizes:
        w = windows(h, k)
        inside = of[: len(w)] == of[k - 1 :] if len(w) else np.zeros(0, bool)
        out.append((w[inside] + np.uint64(k), of[: len(w)][inside]))
    return out


def rows_with_windows(rows: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows (row, text: binary) that have a window of an item by its hash: all that have one, hardly any other."""

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("words")):
                size = np.array([min(window, b.raw(i).count(b" ") + 1) for i in range(b.n)])
                for k in set(size.tolist()):
                    ((h, of),) = _window_hashes(b.data, b.offsets, [k])
                    h = np.unique(h[size[of] == k])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), k))], ["hash", "k"])

    hashes = materialize(items.select("words").mapInArrow(sizes_of, "hash long, k long").distinct(), "item-windows")
    sizes = [r.k for r in hashes.select("k").distinct().collect()]  # 1 to the window
    turns = max(1, math.ceil(hashes.count() / WINDOW_HASHES))
    out = None
    for turn in range(turns):
        own = hashes.filter(F.pmod("hash", F.lit(turns)) == turn).select("hash").toArrow().column("hash").to_numpy().view(np.uint64)
        shared = rows.sparkSession.sparkContext.broadcast(np.sort(own))

        def pick(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys = shared.value
            for batch in batches:
                for b in blocks(batch.column("text")):
                    data = _NORMAL[b.data]
                    hit = np.zeros(b.n, bool)
                    for h, of in _window_hashes(data, b.offsets, sizes):
                        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                        hit[of[keys[at] == h] if len(keys) else of[:0]] = True
                    yield batch.slice(b.first, b.n).filter(pa.array(hit))

        found = rows.mapInArrow(pick, rows.schema)
        out = found if out is None else out.unionByName(found)
    out = materialize(out, "possible")
    return out if turns == 1 else materialize(out.dropDuplicates(["row"]), "possible")


def spans_by_parts(rows: DataFrame, items: DataFrame, n_parts: int, window: int) -> DataFrame:
    """row, spans (bounds after bounds), names of the rows (row, text: binary) that match, over all parts."""
    spark = rows.sparkSession
    rows = rows_with_windows(rows, items, window)
    out = None
    for part in range(n_parts):
        shared = spark.sparkContext.broadcast(automaton_of(items, part, window))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    spans, names, _ = shared.value.scan(words_of(batch.column("text")[i].as_py() or b""))
                    if spans:
                        yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), pa.array([[x for s in spans for x in s]], pa.list_(pa.int64())), pa.array([sorted(names)], pa.list_(pa.string()))], ["row", "spans", "names"])

        found = materialize(rows.mapInArrow(scan, "row long, spans array<bigint>, names array<string>"), "item-part")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))


_FOUND = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, longest: bigint>"


def _found(rows: list[tuple[int, list[tuple[int, int]], Iterable[str]]]) -> pa.StructArray:
    """The result from each text's number of words, merged spans, and names of items."""
    columns = [[n for n, *_ in rows], [sum(b - a for a, b in s) for _, s, _ in rows], [len(set(x)) for *_, x in rows], [hashlib.sha256(",".join(sorted(set(x))).encode()).hexdigest() for *_, x in rows], [max((b - a for a, b in s), default=0) for _, s, _ in rows]]
    return pa.StructArray.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(columns)], ["n_words", "n_hit", "n_items", "items_sha256", "longest"])


def _pairs(flat) -> list[tuple[int, int]]:
    return joined(zip(flat[::2], flat[1::2], strict=True)) if flat else []


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (run of hit words) of each document.

    Null text has no words. Repeated items count once by id. Rows may repeat. No items: nothing is hit. Any number of items is
    taken, with the same result however many automata they fill. Other columns of the input are not looked at.
    """
    spark = docs.sparkSession
    items, n_parts = item_parts(benchmark, window)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    if n_parts == 1:
        shared = spark.sparkContext.broadcast(automaton_of(items, 0, window))  # PART_WORDS bounds it

        @F.arrow_udf(_FOUND)
        def find(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in column:
                out = []
                for t in batch:
                    words = words_of(t.as_py() or b"")
                    out.append((len(words), *shared.value.scan(words)[:2]))
                yield _found(out)

        found = rows.select("doc_id", find.asNondeterministic()("text").alias("f"))
    else:
        base = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "texts")  # so that the numbers stay

        @F.arrow_udf(_FOUND)
        def put(text: pa.Array, spans: pa.Array, names: pa.Array) -> pa.Array:
            return _found([(len(words_of(t.as_py() or b"")), _pairs(s.as_py()), n.as_py() or ()) for t, s, n in zip(text, spans, names, strict=True)])

        spans = spans_by_parts(base.select("row", "text"), items, n_parts, window)
        found = base.join(spans, "row", "left").select("doc_id", put.asNondeterministic()("text", "spans", "names").alias("f"))
    return found.select("doc_id", "f.n_words", "f.n_hit", "f.n_items", "f.items_sha256", (F.col("f.n_hit") > 0).alias("contaminated"), "f.longest")


def remove_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the hit spans cut out of the texts, and without the documents of which more than ``max_coverage`` is hit.

    Cut again while cutting brings words together that are a window. Texts without hits stay as they are, to the byte; nulls
    and empty texts stay. Of a cut text the column ``n_chars``, where there is one, is counted anew. All other columns are
    kept, whatever their names. Rows may repeat. Any number of items is taken.
    """
    spark = docs.sparkSession
    items, n_parts = item_parts(benchmark, window)
    mark = fresh_name(docs, "cut")
    if n_parts == 1:
        shared = spark.sparkContext.broadcast(automaton_of(items, 0, window))  # PART_WORDS bounds it

        @F.arrow_udf("struct<text: string, state: int>")
        def cut(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = shared.value
            for batch in column:
                texts, states = [], []
                for t in batch:
                    raw = t.as_py() or b""
                    words = words_of(raw)
                    spans, _, _ = automaton.scan(words)
                    gone = bool(spans) and sum(b - a for a, b in spans) > max_coverage * len(words)
                    states.append(2 if gone else 1 if spans else 0)
                    texts.append(automaton.clean(raw).decode("utf-8", "replace") if spans and not gone else None)
                yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(states, pa.int32())], ["text", "state"])

        out = docs.withColumn(mark, cut.asNondeterministic()(F.col(text).cast("binary"))).filter(F.col(f"{mark}.state") < 2)
    else:
        row = fresh_name(docs, "row")
        base = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "texts")

        @F.arrow_udf("struct<text: binary, state: int>")
        def cut_spans(text: pa.Array, spans: pa.Array, most: pa.Array) -> pa.Array:
            out = []
            for t, s, m in zip(text, spans, most, strict=True):
                raw, s = t.as_py() or b"", _pairs(s.as_py())
                gone = sum(b - a for a, b in s) > m.as_py() * len(words_of(raw))
                out.append({"text": None if gone else without(raw, s), "state": 2 if gone else 1})
            return pa.array(out, pa.struct([("text", pa.binary()), ("state", pa.int32())]))

        now, steps = base.select(F.col(row).alias("row"), F.col(text).cast("binary").alias("text")), []
        while True:  # each turn cuts at least a window from each text that it keeps
            spans = spans_by_parts(now, items, n_parts, window).filter(F.size("spans") > 0).select("row", "spans")
            most = F.lit(float(max_coverage) if not steps else 1.0)
            found = materialize(now.join(spans, "row").select("row", cut_spans.asNondeterministic()("text", "spans", most).alias("cut"), F.lit(len(steps)).alias("turn")), "cut")
            steps.append(found)
            now = found.filter("cut.state = 1").select("row", F.col("cut.text").alias("text"))
            if not now.limit(1).count():
                break
        every = steps[0]
        for x in steps[1:]:
            every = every.unionByName(x)
        last = every.groupBy("row").agg(F.max_by("cut", "turn").alias("c")).select(F.col("row").alias(row), F.struct(F.col("c.text").cast("string").alias("text"), F.col("c.state").alias("state")).alias(mark))
        out = base.join(last, row, "left").filter(F.coalesce(F.col(f"{mark}.state"), F.lit(0)) < 2)
    changed = F.coalesce(F.col(f"{mark}.state"), F.lit(0)) == 1
    columns = {text: F.when(changed, F.col(f"{mark}.text")).otherwise(F.col(text))}
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        columns[n_chars] = F.when(changed, F.char_length(F.col(f"{mark}.text")).cast(kind)).otherwise(F.col(n_chars))
    return out.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
