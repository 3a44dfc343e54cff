"""Classifiers by held-out accuracy, perplexity rules and mixing against brute force, HTML and WARC by round trips."""

import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.llm import html_text, mixing, perplexity, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, score string"


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    v = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(v) for _ in range(rng.randint(30, 200))]
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(["moron", "Idiot", "clown,"])
        if poor:
            w = [x + rng.choice(["###", "%%%", "***"]) if rng.random() < 0.5 else x for x in w]
        docs.append((i, " ".join(w), "en", "s", "x"))
        labels.append((i, 0 if poor else rng.choice([1, 2]), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity_held_out(data):
    docs, labels = data
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def brute_evidence(rows, texts):
    """log p(w | toxic) - log p(w | ordinary) of each word of ``texts`` after the definition, from (text, is toxic) rows."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    d1, d2 = toxicity.WORD_DISCOUNT, toxicity.PAIR_DISCOUNT
    before, around, tokens = [{}, {}], [{}, {}], [Counter(), Counter()]
    for t, toxic in rows:
        w, k = split(t), 0 if toxic else 1
        for i, x in enumerate(w):
            tokens[k][x] += 1
            before[k].setdefault(x, set()).add(w[i - 1] if i else None)
            if i:
                around[k].setdefault((w[i - 1], x), set()).add(w[i - 2] if i > 1 else None)
    n = lambda k, x: len(before[k].get(x, ()))
    every = {x: len(before[0].get(x, set()) | before[1].get(x, set())) for x in {*before[0], *before[1]}}
    known = {x for x in every if n(0, x) > d1}
    total = [sum(map(len, b.values())) for b in before]
    gamma = [1 - sum(max(n(k, x) - d1, 0) for x in known) / total[k] for k in (0, 1)]
    low = lambda k, x: max(n(k, x) - d1, 0) / total[k] + gamma[k] * every[x] / sum(every.values())
    pairs = {v for v, c in around[0].items() if len(c) > d2}
    m = lambda k, v: max(len(around[k].get(v, ())) - d2, 0)
    rest = lambda k, v: 1 - sum(m(k, q) for q in pairs if q[0] == v) / tokens[k][v] if tokens[k][v] else 1.0
    out = []
    for t in texts:
        w = split(t)
        for i, x in enumerate(w):
            if i and (v := (w[i - 1], x)) in pairs:
                p = [(m(k, v) / tokens[k][v[0]] if tokens[k][v[0]] else 0.0) + rest(k, v[0]) * low(k, x) for k in (0, 1)]
                out.append(np.log(p[0] / p[1]))
            else:
                word = np.log(low(0, x) / low(1, x)) if x in known else np.log(gamma[0] / gamma[1])
                out.append(word + (np.log(rest(0, w[i - 1]) / rest(1, w[i - 1])) if i and w[i - 1] in known else 0.0))
    return np.array(out)


def test_class_models_against_brute_force(spark):
    rng = random.Random(6)
    v = [f"w{k}" for k in range(40)] + ["Ünd", "you", "moron"]
    say = lambda toxic: " ".join(rng.choice(v[:-2]) if not toxic or rng.random() < 0.7 else rng.choice(["you moron", "moron", "you"]) for _ in range(rng.randint(0, 60)))
    rows = [(say(toxic), toxic) for toxic in [rng.random() < 0.4 for _ in range(120)]] + [(None, True), ("", False)]
    table, rare = toxicity.class_models(spark.createDataFrame(rows, "text string, toxic boolean").repartition(3).select(F.col("text").cast("binary").alias("text"), "toxic"))
    t = table.toArrow()
    ratios = toxicity.Ratios.of(*(t.column(c).to_numpy() for c in ("key", "kind", "a", "g")), rare)
    texts = ["you moron, w1 W2 never seen moron", "", *(say(True) for _ in range(20)), *(say(False) for _ in range(20))]
    got = np.concatenate([ratios.evidence(toxicity.Words.of(b)) for b in toxicity.blocks(pa.array(texts).cast(pa.binary()))])
    want = brute_evidence([(x or "", k) for x, k in rows], texts)
    assert len(ratios.pairs) > 3 and len(got) == len(want) and np.abs(got - want).max() < 1e-9
    assert got.max() > 1  # "moron" tells the classes apart


def test_toxicity_of_a_model_too_large_to_broadcast(spark, data, monkeypatch):
    docs, labels = data
    odd = docs.unionByName(spark.createDataFrame([(None, None, "en", "s", "x"), (3, "", "en", "s", "x"), (3, "moron " * 900, "en", "s", "x")], DOCS))
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, round(r.score, 9), r.held_out, r.predicted)
    usual = sorted(map(key, toxicity.score_toxicity(odd, labels).collect()))
    monkeypatch.setattr(toxicity, "BROADCAST_ENTRIES", 0)
    assert sorted(map(key, toxicity.score_toxicity(odd, labels).collect())) == usual


def test_toxic_copies_of_one_document_tell_little(spark):
    """A word of one toxic document and its copies stands after the same words in all of them: it isn't an expression."""
    docs, labels = corpus(300, 9)
    copies = [(5000 + i, docs[0][1] + " somename", "en", "s", "x") for i in range(50)]
    model = toxicity.fit_toxicity(spark.createDataFrame(docs + copies, DOCS), spark.createDataFrame([*labels, *((i, 0, 1) for i, *_ in copies)], "doc_id long, quality int, toxic int"))
    names = [toxicity.Words.of(next(iter(toxicity.blocks(pa.array([w.encode()]))))) for w in ("somename", "idiot")]
    assert model.ratios().evidence(names[0])[0] == pytest.approx(model.rare) and model.ratios().evidence(names[1])[0] > 2


def test_toxicity_does_not_learn_from_held_out_rows_or_other_columns(data):
    docs, labels = data
    out = toxicity.held_out(F.col("doc_id"))
    other = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(d, x).collect()} for d, x in ((docs, labels), (docs.withColumn("lang", F.lit("?")), other)))
    assert a == pytest.approx(b)


def test_scores_of_odd_rows(spark, data):
    docs, labels = data
    long = "word " * 200_000 + "idiot " * 5_000
    odd = spark.createDataFrame([(9001, None, None, None, "x"), (9002, "", "", "", "x"), (None, "plain text", "en", "s", "x"), (9003, long, "en", "s", "x"), (9003, long, "en", "s", "x")], DOCS)
    both = docs.unionByName(odd)
    more = labels.unionByName(spark.createDataFrame([(9002, None, None), (None, 1, 1), (77777, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int"))
    t = toxicity.score_toxicity(both, more).filter("doc_id is null or doc_id > 9000").collect()
    q = quality.score_quality(both, more).filter("doc_id is null or doc_id > 9000").collect()
    assert len(t) == len(q) == 5 and all(r.score is not None for r in t) and all(r.tail_prob is not None for r in q)
    assert {r.predicted for r in t if r.doc_id == 9003} == {1} and {r.predicted for r in t if r.doc_id == 9002} == {0}


def test_scores_without_labels_or_documents(data):
    docs, labels = data
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert {r.selected for r in quality.score_quality(docs, labels.limit(0)).collect()} == {True}
    assert {r.selected for r in quality.score_quality(docs, labels.withColumn("quality", F.lit(1))).collect()} == {True}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0 and quality.score_quality(docs.limit(0), labels).count() == 0


def test_quality_held_out(data):
    docs, labels = data
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.selected == (r.quality > 0) for r in rows) / len(rows) > 0.95
    assert all(0 <= r.expected_grade <= 2 for r in rows)


def brute_features(text):
    """feature: weight of a text after the definition: words, shapes of words, and words equal to the one before."""
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shape = lambda b: 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    squeezed = bytearray()
    for b in map(shape, (text or "").encode()):
        if not squeezed or squeezed[-1] != b:
            squeezed.append(b)

    def hashed(b):
        return int(quality.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])

    out = Counter()
    for w in words:
        out[hashed(w.encode()) >> 50] += 1
    for w in bytes(squeezed).split():
        out[(hashed(w) >> 52) + quality.WORDS] += 1
    out[quality.SIZE - 1] += sum(a == b for a, b in zip(words, words[1:]))
    return {k: 10.0 * n / max(len(words), 1) for k, n in out.items() if n}


def test_quality_fit_is_bounded(spark, monkeypatch):
    """Rows that share a labelled doc_id, and long texts, don't bring more to the driver than the bounds say."""
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " ### ###").otherwise(" plain")).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    sizes = []
    real = quality.fit_ordinal
    monkeypatch.setattr(quality, "fit_ordinal", lambda grade, feature, value, first: sizes.append((len(grade), len(feature))) or real(grade, feature, value, first))
    quality.fit_quality(docs, labels, rows=500)
    monkeypatch.setattr(quality, "FIT_FEATURES", 900)
    quality.fit_quality(docs, labels)
    assert 300 < sizes[0][0] < 700 and 400 < sizes[1][1] < 1300


def test_quality_scores_against_brute_force(spark, data):
    docs, labels = data
    model = quality.fit_quality(docs, labels)
    texts = ["", None, "One two TWO two 3x ### Ünï *", "a  a a\n\na-b-c 12,5", *(r.text for r in docs.limit(30).collect())]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.q for r in rows.select("doc_id", quality.quality_udf(spark, model)(F.col("text").cast("binary")).alias("q")).collect()}
    for i, t in enumerate(texts):
        score = sum(float(model.weights[k]) * x for k, x in brute_features(t).items())
        tails = [1 / (1 + np.exp(-(score - c))) for c in model.thresholds]
        assert got[i].tail_prob == pytest.approx(tails[0], abs=1e-5) and got[i].expected_grade == pytest.approx(model.grades[0] + sum(p * d for p, d in zip(tails, np.diff(model.grades))), abs=1e-5)


def test_ordinal_fit_is_near_the_best():
    """No small change of a weight or threshold makes the graded documents likelier."""
    rng = np.random.default_rng(1)
    grade, feature = rng.integers(0, 3, 200), rng.integers(0, 5, 200)
    m = quality.fit_ordinal(grade, feature, np.ones(200), np.arange(201))

    def loss(weights, thresholds):
        below = [np.zeros(200), *(1 / (1 + np.exp(weights[feature] - t)) for t in thresholds), np.ones(200)]
        return -np.mean([np.log(below[g + 1][i] - below[g][i]) for i, g in enumerate(grade)]) + 0.5e-4 * (weights**2).sum()

    w, t = m.weights.astype(float), m.thresholds
    best = loss(w, t)
    for k in range(5):
        for step in (-0.05, 0.05):
            other = w.copy()
            other[k] += step
            assert loss(other, t) > best - 2e-5
    for k in range(2):
        for step in (-0.05, 0.05):
            other = t.copy()
            other[k] += step
            assert loss(w, other) > best - 2e-5


def test_ordinal_thresholds_are_ordered_and_recover_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 600)
    feature = np.where(rng.random(600) < 0.9, grade, rng.integers(0, 4, 600))
    m = quality.fit_ordinal(grade, feature, np.full(600, 5.0), np.arange(601))
    assert (np.diff(m.thresholds) > 0).all()
    guess = m.expected(m.weights[feature] * 5.0)
    assert np.abs(guess - feature).max() < 0.6
    t = m.tails(m.weights[feature] * 5.0)
    assert (np.diff(t, axis=1) <= 1e-9).all()


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_perplexity_base_columns(spark):
    rng = random.Random(1)
    v = ["a", "bé", "漢字", "d#", "<p>", "x|y"]
    texts = [None, "", " \n\t", "\n".join(["same line"] * 3 + [" ", "", " "]), "a " * 500]
    texts += ["".join(rng.choice(v) + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", "x") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", "x")]
    got = perplexity.perplexity_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((i, *brute_base(t)) for i, t, *_ in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert perplexity.perplexity_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_perplexity_rejects_noise_and_keeps_prose(spark):
    docs, _ = corpus(300, 5)
    prose = [(i, re.sub(r"[#%*]", "", t), "en", "s", "x") for i, t, *_ in docs]
    rng = random.Random(2)
    noise = [(1000 + i, " ".join("".join(rng.choice("qxzjkwvbgmpcfyhd*;()?!$") for _ in range(7)) for _ in range(60)), "en", "s", "x") for i in range(5)]
    got = {r.doc_id: r.kept for r in perplexity.perplexity_rules(spark.createDataFrame(prose + noise, DOCS)).collect()}
    assert all(got[i] for i, *_ in prose) and not any(got[i] for i, *_ in noise)


def test_perplexity_bands_tell_poor_documents_from_prose(spark):
    docs, _ = corpus(300, 5)
    prose = [(i, re.sub(r"[#%*]", "", t), "en", "s", "x") for i, t, *_ in docs]
    rng = random.Random(4)

    def spoil(w):  # three words of ten with two letters swapped for rarer ones
        return w if rng.random() > 0.3 else rng.choice("qxzjk") + w[1:-1] + rng.choice("qxzjk")

    poor = [(1000 + i, " ".join(map(spoil, t.split())), *r) for i, t, *r in rng.sample(prose, 15)]
    got = {r.doc_id: r for r in perplexity.perplexity_rules(spark.createDataFrame(prose + poor, DOCS)).collect()}
    assert all(got[i].kept for i, *_ in prose) and not any(got[i].kept or got[i].base_failed for i, *_ in poor)
    assert all(r.lower < r.upper < r.lower + 0.5 for r in got.values())


def test_perplexity_rejects_noise_of_any_length(spark):
    docs, _ = corpus(300, 5)
    prose = [(i, re.sub(r"[#%*]", "", t), "en", "s", "x") for i, t, *_ in docs]
    rng = random.Random(3)
    for n in (2_000, 100_000, 1_000_000):  # one at a time: two would vouch for each other
        noise = (1000, " ".join("".join(rng.choices("#*$%&|<>", k=7)) for _ in range(n // 8)), "en", "s", "x")
        got = {r.doc_id: r for r in perplexity.perplexity_rules(spark.createDataFrame([*prose, noise], DOCS)).collect()}
        assert not got[1000].base_failed and not got[1000].kept
        assert all(got[i].kept for i, *_ in prose)


def brute_perplexity(texts):
    """Mean log-perplexity of each text after the definition, and the probability of each character after each known context."""
    fold = lambda t: "".join(c.lower() if c.isascii() and c.isalpha() else "0" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r" else c for c in t)
    grams = [[("    " + f)[i : i + 5] for i in range(len(f))] for f in map(fold, texts)]
    raw = [Counter(g[-k:] for d in grams for g in d) for k in range(1, 6)]
    n = [Counter(g[1:] for g in raw[k]) for k in range(1, 5)] + [raw[4]]
    cut = [perplexity.discounts(*(sum(x == j for x in m.values()) for j in (1, 2, 3, 4))) for m in n]
    off = lambda k, x: cut[k - 1][min(x, 3) - 1]
    total, gamma = [None], [None]
    for k in range(2, 6):
        t, g = Counter(), Counter()
        for x, c in n[k - 1].items():
            t[x[:-1]] += c
            g[x[:-1]] += off(k, c)
        total.append(t)
        gamma.append({x: g[x] / t[x] for x in t})
    size = sum(n[0].values()) + 0.5 * (len(n[0]) + 1)

    def p(x):
        k = len(x)
        return (n[0][x] + 0.5) / size if k == 1 else (n[k - 1][x] - off(k, n[k - 1][x])) / total[k - 1][x[:-1]] + gamma[k - 1][x[:-1]] * p(x[1:])

    def log_prob(x, own):
        k = len(x)
        if raw[k - 1][x] > own[k - 1][x]:
            return np.log(p(x))
        return np.log(gamma[k - 1][x[:-1]]) + log_prob(x[1:], own) if k > 1 else np.log(0.5 / size)

    out = []
    for d in grams:
        own = [Counter(g[-k:] for g in d) for k in range(1, 6)]
        out.append(-sum(log_prob(g, own) for g in d) / max(len(d), 1))
    sums = {x: sum(p(x + c) for c in n[0] if x + c in n[k - 1]) for k in range(2, 6) for x in total[k - 1]}
    return out, sums


def test_perplexity_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    v = ["the", "Theme", "ab12", "é", "漢字", "🙂x", "qq"]
    texts = ["".join(rng.choice(v) + rng.choice([" ", "\n", ", "]) for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["", "zyzzyva zyzzyva zyzzyva", "x", "zyz"]
    texts += [texts[0], " ".join("".join(rng.choices("!?;:", k=5)) for _ in range(50))]
    want, sums = brute_perplexity(texts)
    assert all(x <= 1 + 1e-12 for x in sums.values())
    rows = [(i, t, rng.choice(["en", "de"]), "s", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    score = lambda: {r.doc_id: r.log_perplexity for r in perplexity.score_documents(docs).collect()}
    usual = score()
    assert max(abs(usual[i] - w) for i, w in enumerate(want)) < 1e-9
    monkeypatch.setattr(perplexity, "BROADCAST_ENTRIES", 0)
    assert score() == pytest.approx(usual, abs=1e-9)
    monkeypatch.undo()
    table, floor = perplexity.kneser_ney(perplexity.count_ngrams(docs))
    model = perplexity.KneserNey.of(*(table.toArrow().column(c).to_numpy() for c in ("kind", "hi", "lo", "a", "raw")), floor)
    monkeypatch.setattr(perplexity, "PIECE", 64)
    for i, t in enumerate(texts):  # in pieces
        assert -model.total(next(perplexity.blocks(pa.array([t.encode()]))))[0] / max(len(t), 1) == pytest.approx(usual[i], abs=1e-9)


def test_perplexity_of_long_texts_many_languages_and_clashing_names(spark):
    docs, _ = corpus(120, 5)
    rows = [(i, t, f"l{i}" if i % 3 else "en", "s", "x", 5.0, "y") for i, t, *_ in docs] + [(999, " ".join(docs[0][1].split() * 30_000), "en", "s", "x", 5.0, "y")]
    d = spark.createDataFrame(rows, DOCS + ", log_perplexity double, lower string")
    got = {r.doc_id: r for r in perplexity.perplexity_rules(d).collect()}
    assert len(got) == 121 and got[999].base_failed and got[999].n_words == 30_000 * len(docs[0][1].split()) and got[999].log_perplexity < 1
    assert all(r.lower < r.log_perplexity < r.upper for i, r in got.items() if i % 3)  # alone in their languages


def test_perplexity_bands_reject_on_both_sides_of_the_given_tables(spark):
    rows = perplexity.perplexity_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("not base_failed").collect()
    low, high = (sum(f(r) for r in rows) for f in (lambda r: r.log_perplexity < r.lower, lambda r: r.log_perplexity > r.upper))
    assert low > 20 and high > 20 and low + high < 0.05 * len(rows)
    assert all(r.kept == (r.lower <= r.log_perplexity <= r.upper) for r in rows if r.lower is not None)


def test_mixing(spark):
    rng = random.Random(4)
    rows = []
    for s, n in (("big", 900), ("mid", 250), ("small", 60), (None, 10)):
        rows += [(len(rows) + k, "w " * rng.randint(0, 30), "en", s, "x") for k in range(n)]
    rows += [(0, None, "en", "big", "x"), (None, "a b", "en", "big", "x"), (1, "w w w", "en", "big", "x")]
    docs = spark.createDataFrame([(*r, "y") for r in rows], DOCS + ", mix_epoch string")
    out = mixing.mix(docs, keep=tuple(docs.columns)).collect()
    tokens = Counter()
    for i, t, _, s, _ in rows:
        tokens[s or ""] += len((t or "").split())
    total, used = sum(tokens.values()), Counter()
    for r in out:
        used[r.mix_source] += r.mix_tokens
    weight = {r.mix_source: r.mix_weight for r in out}
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    for s in tokens:
        assert weight[s] * total - 40 <= used[s] <= weight[s] * total
        assert weight[s] * total <= 4.01 * tokens[s]
    assert weight["big"] < tokens["big"] / total and weight["small"] > tokens["small"] / total
    times = Counter((r.mix_source, r.doc_id, r.text, r.mix_epoch) for r in out)
    full = {s: int(weight[s] * total) // tokens[s] for s in tokens}
    repeated = Counter((s or "", i, t) for i, t, _, s, _ in rows)
    for (s, i, t), n in repeated.items():
        for e in range(full[s]):
            assert times[(s, i, t, e)] == n
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.mix_epoch, r.mix_block) for r in again) == Counter((r.doc_id, r.mix_epoch, r.mix_block) for r in out)


PAGE = "<html><head><title>T</title></head><body><div class='top'>Site of {h} <a href=/>home</a></div><section><p>{a}<p>{b} &amp; <b>bo</b>ld</section><div class=foot2>All rights {h}</div></body></html>"


def test_templates_go_and_text_stays(spark):
    rows = [(h * 100 + i, f"http://h{h}.com/{i}", PAGE.format(h=h, a=f"text {i} of {h}", b=f"more\n {i}"), "x") for h in range(2) for i in range(12)]
    rows += [(900, None, None, "x"), (901, "http://h0.com/e", "", "x"), (902, "http://h9.com/1", PAGE.format(h=9, a="alone", b="here"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert got[103].text == "text 3 of 1 more 3 & bold" and got[103].n_chars == len(got[103].text)
    assert got[900].text == got[901].text == "" and "Site of 9" in got[902].text
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_templates_decide_on_the_given_pages(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    key = lambda df: {r.page_id: r.text for r in df.collect()}
    usual, without = key(html_text.extract_text(pages)), key(html_text.extract_text(pages, template_share=0, main_share=-1))
    articles = {r.page_id: html_text.parse(r.html).text for r in pages.collect()}
    assert usual == articles and sum(usual[i] != without[i] for i in usual) > 120
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert key(html_text.extract_text(pages)) == usual


def test_subtree_counts_against_brute_force(spark):
    """Shapes of whole pages, by a walk over the pages' nested tags, and how many different pages of a host have each."""
    rng = random.Random(3)
    body = lambda d: "".join(f"<{t}>{body(d - 1) if d else rng.choice(['x', 'y', ''])}</{t}>" for t in rng.choices(["div", "section", "p", "ul"], k=rng.randint(0, 3)))
    rows = [(i, f"http://h{i % 3}.com/{i}", f"<body>{body(3)}</body>") for i in range(60)] + [(60, "http://h0.com/again", "<body><div>x</div></body>")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.subtrees(pages.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html", F.xxhash64("html").alias("html_key")))
    got = Counter((r.host, r.subtree) for r in found.select("host", "subtree", "page").distinct().filter("subtree <> 0").collect())

    def walk(html):  # whole subtrees of div and section, as text
        out, stack = set(), []
        for m in re.finditer(r"<(/?)(\w+)>", html):
            if not m[1]:
                stack.append((m[2], m.start()))
            else:
                tag, at = stack.pop()
                if tag in ("div", "section"):
                    out.add(html[at : m.end()])
        return out

    want: dict[tuple, set] = {}
    for _, url, html in rows:
        for x in walk(html):
            want.setdefault((url.split("/")[2], x), set()).add(html_text.parse(html).text)
    whole = Counter((r.host, r.subtree) for r in found.filter("not shape and subtree <> 0").select("host", "subtree", "page").distinct().collect())
    assert sorted(n for (h, _), n in whole.items()) == sorted(len(x) for x in want.values()) and sum(got.values()) > sum(whole.values())
    judged = {(r.host, r.subtree) for r in html_text.judge_subtrees(found, min_pages=4).filter("template").collect()}
    assert {k for k, n in whole.items() if n >= 4} <= judged


def test_parser_takes_linear_time():
    import time

    broken = ["<a " * 330_000, "<a '" * 250_000, "<a '" * 250_001 + ">", "<div>" * 60_000 + "</b>" * 100_000, "<p><div>" + "<b>" * 30_000 + "<h2></h2>" * 30_000, "<article>" * 30_000, "<script>" * 100_000, "<!--" * 250_000, "</" * 500_000 + ">"]
    for html in broken:
        began = time.process_time()
        html_text.parse(html)
        assert time.process_time() - began < 4


def test_parser():
    text = lambda html: html_text.parse(html).text
    assert text("<nav>x</nav><article><h1>A</h1><p>b<br>c<p>d<div class='ad box'>y</div><script>'</p>'</script></article><footer>z</footer>") == "A b c d"
    assert text("a<!-- <p> -->b<i>c</i> &lt;&nbsp;d &#233;") == "abc < d é"
    assert text("<main><p>m</main><p>out") == "m"
    assert text("<article>x<article class=comment>no</article></article>") == "x"
    assert text("<div " + "<div>" * 3000 + "deep") == "deep"
    assert text("<p title='a > b'>c<a href=\">\">d</a> 1 < 2 <3 <b") == "cd 1 < 2 <3 <b"
    assert text("<!doctype html><body>x<textarea><p>no</textarea>y</div></body>z") == "xy z"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == "a b c d e f g"


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/ b\r\nX: y", big, "x"), (5, "http://b", big, "x"), (3, None, big, "x"), (2, "u", None, "x"), (4, "u", "", "x"), (6, "v", "small", "x"), (7, "v", "small", "x"), (None, "w", big, "x"), (8, "z", "x" * 3_000_000, "x"), (9, "http://long/" + "é\n" * 600_000, "y", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.warc_round_trip(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert {i: (by[i].record_type, by[i].refers_to) for i in by} == {1: ("revisit", 5), 3: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None)}
    assert by[9].target_uri == "http://long/" + "é%0A" * 600_000
    import hashlib

    for i, _, h, _ in rows:
        assert by[i].payload_bytes == len((h or "").encode()) and by[i].payload_digest == hashlib.sha1((h or "").encode()).hexdigest()
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    manifest = warc.write_archives(warc.plan_records(pages), warc.scratch_path(spark, "warc"))
    back = {r.page_id: r.payload for r in warc.read_archives(manifest, payloads=True).collect() if r.record_type == "response"}
    assert bytes(back[8]) == b"x" * 3_000_000 and bytes(back[5]) == big.encode()


def test_warc_reader_finds_damage():
    import hashlib

    one = lambda p: warc.record(1, "u", p, hashlib.sha1(p).hexdigest(), len(p), None, False)
    good = one(b"abc" * 50_000) + one(b"")
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(good))] == [150_000, 0]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-20])))
    wrong = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), 3, None, False)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(wrong)))
    short = zlib.compress(b"")
    whole = zlib.decompress(one(b"abcdef"), 31).replace(b"Content-Length: ", b"Content-Length: 9", 1)
    squeeze = zlib.compressobj(wbits=31)
    with pytest.raises((warc.WarcError, ValueError)):
        list(warc.read_records(io.BytesIO(squeeze.compress(whole) + squeeze.flush() + short)))
