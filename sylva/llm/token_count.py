"""Token counts of a byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens that a worker hasn't met are held together as one flat array of symbols with the sequences' bounds. In each
round every sequence finds the lowest rank among its adjacent pairs and joins all pairs of that rank at once; sequences
without a pair in the vocabulary leave with the number of symbols that survive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.runtime import ship_package

#: Split pattern of the byte-level vocabulary (fixed value of its published definition).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker remembers, and characters of text that it splits at once.
REMEMBERED, CHARS_AT_ONCE = 400_000, 4_000_000
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others take code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """The merge rules of one vocabulary file as sorted arrays."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        self.special = [t["content"] for t in model["added_tokens"]]
        ids = model["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left, right, made = (np.array([ids[x] for x in col], np.int64) for col in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        self.width = np.int64(max(ids.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # joining all pairs of a rank at once is the same as one by one unless what is made starts a pair of lower rank
        ranks = np.arange(len(merges))
        lowest = np.full(int(self.width), len(merges))
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        self.at_once = lowest[made] > ranks
        specials = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_re = regex.compile(specials) if specials else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each piece."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = size.copy()
        name = np.flatnonzero(size > 1)  # of each sequence that is still at work
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        sym = sym[np.repeat(size > 1, size)]
        size = size[name]
        ends = np.cumsum(size)
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        while len(name):
            starts = ends - size
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                out[name[done]] = size[done]
                keep = np.repeat(~done, size)
                sym, rank, name, size, best = sym[keep], rank[keep], name[~done], size[~done], best[~done]
                ends = np.cumsum(size)
                if not len(name):
                    break
                starts = ends - size
            of = np.repeat(np.arange(len(name)), size)
            hit = np.flatnonzero(rank == best[of])
            # of touching pairs (as in aaa) take every other one, from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - begin) % 2 == 0
            one = ~self.at_once[rank[hit]]
            if one.any():  # only the first pair of such a sequence
                first = np.ones(len(hit), bool)
                first[1:] = of[hit[1:]] != of[hit[:-1]]
                take &= ~one | first
            hit = hit[take]
            sym[hit] = self.made[rank[hit]]
            size = size - np.bincount(of[hit], minlength=len(size))
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, rank = sym[stay], rank[stay]
            ends = np.cumsum(size)
            hit = hit - np.arange(len(hit))
            last = np.zeros(len(sym), bool)
            last[ends - 1] = True
            # only the pairs on either side of what was made have changed
            near = np.union1d(hit, hit[hit > 0] - 1)
            near = near[near < len(sym)]
            inner = near[~last[near]]
            rank[near] = _NONE
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        return out

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the vocabulary's special strings inside a text are one token each."""
        split, known = self.split.findall, self.known
        parts: list[list[str]] = []
        extra = [0] * len(texts)
        for i, t in enumerate(texts):
            if self.special_re is not None and any(s in t for s in self.special):
                cut = self.special_re.split(t)
                extra[i] = len(cut) - 1
                parts.append([x for c in cut for x in split(c)])
            else:
                parts.append(split(t))
        new = list(set(chain.from_iterable(parts)).difference(known))
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set(chain.from_iterable(parts)))
            for at in range(0, len(new), 100_000):
                some = new[at : at + 100_000]
                known.update(zip(some, self.counts([x.encode() for x in some]).tolist(), strict=True))
        get = known.__getitem__
        return [e + sum(map(get, p)) for e, p in zip(extra, parts, strict=True)]


@lru_cache(maxsize=2)
def merger(vocabulary: str) -> RankMerger:
    return RankMerger(vocabulary)


def token_counter(spark, path: str):
    """An Arrow UDF from text to its number of tokens under the vocabulary file at ``path`` (read on the driver)."""
    ship_package(spark)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file, of fixed size

    @F.arrow_udf("long")
    def n_tokens(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = merger(shared.value)
        for batch in column:
            out: list[int] = []
            texts: list[str] = []
            held = 0
            for t in batch:
                texts.append(s := t.as_py() or "")
                held += len(s)
                if held > CHARS_AT_ONCE:
                    out += m.count_texts(texts)
                    texts, held = [], 0
            out += m.count_texts(texts)
            yield pa.array(out, pa.int64())

    return n_tokens


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of each row, whole texts.

    Null text counts as empty: 0 bytes, 0 tokens. Rows may repeat, ids may be null; each row is counted on its own. Other
    columns are not looked at. A very long text is held whole in its task, and nothing else of the table with it.
    """
    n_tokens = token_counter(docs.sparkSession, vocabulary_path)
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(text)).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
