"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import sylva.llm.collocations as module
from sylva.llm.collocations import collocations, frequent_phrases, score_phrases
from sylva.llm.mapped import Mapped, write_mapped

SCHEMA = "doc_id long, text string, lang string, n long, score string"


def brute_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang if lang is not None else "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang if lang is not None else "und", tuple(words[i : i + k])] += 1
    return counts, totals


def brute(rows, least, first):
    counts, totals = brute_counts(rows)
    cands = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cands.items():
        if any(l2 == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (l2, v), b in cands.items()):
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, n))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n, -s) for lang, v in out.items() for i, (s, a, p, x, y, n) in enumerate(sorted(v)[:first]))


def made(seed, docs=80):
    rng = random.Random(seed)
    v = ["a", "B", "ü", "the", "of", "x1", "日本", " ", "tree"]
    gap = lambda: rng.choice([" "] * 12 + ["  ", "\t", ", ", ". ", "\n", " \x0b", "!"])
    passage = "The Quick brown fox jumps over a lazy dog"
    rows = []
    for _ in range(docs):
        t = "".join(rng.choice(v) + gap() for _ in range(rng.randint(0, 60)))
        rows.append((t + (passage if rng.random() < 0.4 else "") + gap() + "of the tree", rng.choice(["en", "de", None, "", "en"])))
    return rows + [(None, "en"), ("", None), ("a a a a a a a", "en"), ("...", "en")]


@pytest.mark.parametrize("bits", [61, 5])
def test_against_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(module, "HELD", 50)
    rows = made(bits)
    df = spark.createDataFrame([(i, t, x, 5, "q") for i, (t, x) in enumerate(rows)], SCHEMA).repartition(4)
    phrases, totals = frequent_phrases(df, 10, bits=bits)
    counts, want_totals = brute_counts(rows)
    assert sorted((r.lang, r.text, r.n) for r in phrases.collect()) == sorted((x, " ".join(w), n) for (x, w), n in counts.items() if n >= 10)
    assert {r.lang: r.total for r in totals.collect() if r.total} == {k: n for k, n in want_totals.items() if n}
    got = sorted(tuple(r) for r in score_phrases(phrases, totals, 15).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, 10, 15)


def test_long_texts_and_copies(spark, monkeypatch):
    """A text that is cut between pieces, one without pieces, and a group of copies."""
    monkeypatch.setattr(module, "PIECE_BYTES", 300)
    rng = random.Random(9)
    say = lambda n, end: "".join(rng.choice(["alpha", "beta", "gamma"]) + (end if rng.random() < 0.1 else " ") for _ in range(n))
    rows = [(say(70_000, " "), "en"), (say(5000, ". "), "en"), (say(300, "; "), "fr")] + [("one two three four five six", "de")] * 300
    df = spark.createDataFrame([(i, t, x, 5, "q") for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)
    # workers import the module anew; what a task refers to goes with it
    got = sorted(tuple(r) for r in collocations(df, 100, 50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, 100, 50)


def test_pieces_of_a_long_row():
    import pyarrow as pa

    rng = random.Random(4)
    text = "".join(rng.choice(["aa", "b", "cc"]) + rng.choice([" ", " ", ". "]) for _ in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.encode()])], ["lang", "text"])
    old = module.PIECE_BYTES
    try:
        whole = list(module._words(batch))
        module.PIECE_BYTES = 100
        parts = list(module._words(batch))
    finally:
        module.PIECE_BYTES = old
    assert len(whole) == 1 and len(parts) > 50
    assert np.concatenate([w.number for w in parts]).tolist() == whole[0].number.tolist()
    for size in (1, 2, 5):
        once = whole[0].fingerprints(whole[0].grams(size), size, 61)
        assert np.concatenate([w.fingerprints(w.grams(size), size, 61) for w in parts]).tolist() == once.tolist()


def test_empty_tables(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, 1, ""), (2, "rare words", "en", 1, "")], SCHEMA)).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    big = 10**12
    phrases = spark.createDataFrame([(1, "en", "a", big), (1, "en", "b", big + 1), (2, "en", "a b", big - 7)], "size long, lang string, text string, n long")
    totals = spark.createDataFrame([("en", 10**14 + 3)], "lang string, total long")
    r = score_phrases(phrases, totals).first()
    assert r.score == 1000 * (big - 7) * (10**14 + 3) // (big * (big + 1)) and (r.l, r.r, r.n) == (big, big + 1, 10**14 + 3)


def test_mapped(spark):
    rng = random.Random(1)
    keys = [rng.getrandbits(63) - 2**62 for _ in range(500)]
    df = spark.createDataFrame([(k, i, f"v{i}") for i, k in enumerate(keys)] + [(keys[0], 1000, "again")], "k long, i long, v string")
    table = Mapped(tuple(write_mapped(df.repartition(3), "k", "test-mapped")), "k")
    at = table.find(np.array([*keys, 5, -(2**63), 2**63 - 1], np.int64))
    assert (at[:500] >= 0).all() and (at[500:] < 0).all()
    assert table.column("v", at[1:500]).to_pylist() == [f"v{i}" for i in range(1, 500)]
    assert sorted(table.rows(int(at[0])).column("i").to_pylist()) == [0, 1000]
    assert Mapped(tuple(write_mapped(df.filter(F.lit(False)), "k", "test-mapped")), "k").find(np.array([1])).tolist() == [-1]


def in_files(folder, *parts):
    """A ``Mapped`` of these sorted keys, a file each."""
    import pyarrow as pa

    for i, keys in enumerate(parts):
        t = pa.table({"k": pa.array(keys, pa.int64())})
        with pa.OSFile(f"{folder}/{i}.arrow", "wb") as out, pa.ipc.new_file(out, t.schema) as f:
            f.write_table(t)
    return Mapped(tuple(f"file://{folder}/{i}.arrow" for i in range(len(parts))), "k")


def test_look_ups_of_any_keys(tmp_path):
    rng = np.random.default_rng(3)
    ends = np.iinfo(np.int64)
    anywhere = lambda n: rng.integers(ends.min, ends.max, n)
    shapes = [[5], [7] * 50, range(0, 2048, 8), [ends.min, ends.max], [ends.min, -1, 0, 1, ends.max], anywhere(5000), rng.integers(-100, 100, 5000), [*anywhere(300), *range(1 << 40, (1 << 40) + 3000), *[9] * 4000]]
    for n, keys in enumerate(shapes):
        keys = np.sort(np.array(keys, np.int64))
        # no key lies in two files
        cuts = sorted({0, len(keys), *(int(np.searchsorted(keys, keys[i])) for i in rng.integers(0, len(keys), 3))})
        asked = np.concatenate([keys, np.clip(keys, ends.min + 1, None) - 1, np.clip(keys, None, ends.max - 1) + 1, anywhere(500), [0, ends.min, ends.max]])
        first = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        want = np.where(keys[first] == asked, first, -1)
        for k, parts in enumerate(([keys], [keys[a:b] for a, b in zip(cuts, cuts[1:])])):
            folder = tmp_path / f"{n}-{k}"
            folder.mkdir()
            assert (in_files(folder, *parts).find(asked) == want).all()


def test_look_ups_take_less_than_a_search_among_all_keys(tmp_path):
    """CPU time by CPU time, so that a slow machine slows both."""
    import time

    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(-(2**63), 2**63 - 1, 100_000))
    asked = rng.permutation(np.concatenate([rng.choice(keys, 500_000), rng.integers(-(2**63), 2**63 - 1, 500_000)]))
    table = in_files(tmp_path, keys)

    def least(f):
        times = []
        for _ in range(4):
            t = time.thread_time()
            f(asked)
            times.append(time.thread_time() - t)
        return min(times)

    assert least(table.find) < 0.6 * least(lambda x: np.searchsorted(keys, x))


def test_tally_adds_up_what_falls_apart():
    """Fingerprints that differ in the low bits alone are sorted by position: their runs fall apart and must still add up."""
    rng = np.random.default_rng(5)
    tally, want, places = module._Tally(), Counter(), {}
    for low, high in ((0, 40), (-40, 40), (-(2**63), 2**63 - 1), (-3, 0)):
        fp = rng.integers(low, high, 3000)
        fp[::7] = 1 << 62
        at = rng.integers(0, 1 << 50, 3000)
        tally.add(fp, at)
        want.update(fp.tolist())
        for x, y in zip(fp.tolist(), at.tolist(), strict=True):
            places.setdefault(x, set()).add(y)
    got = Counter()
    for b in tally.emit():
        for x, n, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[x] += n
            assert y in places[x]
    assert got == want and not tally.held
