"""URL filter, decontamination, Jaccard join and token counts against brute force on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sylva.llm import decontaminate, jaccard_join
from sylva.llm import url_filter as url_filter_module
from sylva.llm.components import connected_components
from sylva.llm.registry import SITE_ENDS, SITE_WORDS, URL_RULES, listed_urls
from sylva.llm.token_count import RankMerger, count_tokens
from sylva.llm.url_filter import url_filter

LISTED = "host string, path string, verdict string, is_rule boolean"


ENTRIES = [(*r, True) for r in URL_RULES] + [(f"{a}-{b}.{c}", "/", "block", False) for a in SITE_WORDS for b in SITE_WORDS if a != b for c in SITE_ENDS]


def brute_url(url, entries):
    rest = url.partition("://")[2] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [e for e in entries if host and (host == e[0] or host.endswith("." + e[0])) and path.startswith(e[1])]
    rule, site = (max((e for e in fits if e[3] is kind), key=lambda e: (len(e[0] + e[1]), len(e[0])), default=None) for kind in (True, False))
    return host, path, rule and rule[0] + rule[1], (rule or site or (0, 0, "allow"))[2], site[0] + site[1] if site and not rule else None


URLS = [
    "http://A.Example.com/en/x", "https://www.example.com/en/1?x=/es/", "https://x.www.example.com/en/", "http://notexample.com/en/", "http://b.net/es/1", "http://net/fr/", "http://b.net/esx",
    "http://b.org/en/", "http://b.com", "http://b.com?x=://c.net/es/", "", None, "no scheme", "http:///en/", "http://www.cheap-pills.example.org/a#b", "http://ÄB.com/\n/x", "http://a.b.c.d.example.com/en/",
]


LISTED_UNDER_RULES = [
    ("http://www.cheap-pills.example.com/en/450?x=1", "example.com/en/", "block"), ("https://www.cheap-pills.example.com/fr/176/", "com/", "allow"),
    ("https://m.free-bets.example.net/fr/31", "net/fr/", "block"), ("http://www.example.com/en/free-bets.example.org/", "www.example.com/en/", "allow"),
    ("http://free-bets.example.net/en/1", None, "block"), ("http://x.casino-win.org/", None, "block"), ("http://x.casino-casino.org/", None, "allow"),
]


def judged(pages, entries):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in url_filter(pages, entries).collect()}


def test_url_filter(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS * 2 + [u for u, *_ in LISTED_UNDER_RULES])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    got = judged(pages, listed_urls(spark))
    assert got == {i: brute_url(u, ENTRIES) for i, u, *_ in rows}
    assert [got[i][2:4] for i in range(2 * len(URLS), len(rows))] == [(rule, verdict) for _, rule, verdict in LISTED_UNDER_RULES]


def test_url_filter_removes_false_positives(spark, monkeypatch):
    monkeypatch.setattr(url_filter_module, "BITS_PER_ENTRY", 2)
    monkeypatch.setattr(url_filter_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(url_filter_module, "BROADCAST_BYTES", 0)
    entries = listed_urls(spark)
    keys = entries.select(F.concat("host", "path").alias("key"))
    bloom = url_filter_module.BlockedBloom.of(keys, keys.count())
    names = [f"http://{a}{b}.example.org/{i}" for i, (a, b) in enumerate((a, b) for a in SITE_WORDS for b in SITE_WORDS)] + ["http://best-bets.org/"]
    probes = spark.createDataFrame([(u.split("/")[2] + "/",) for u in names], "key string")
    passed, truly = bloom.passing(probes).count(), probes.join(keys, "key", "left_semi").count()
    assert bloom.n_blocks > 20 and passed > truly + 20 and truly == 1
    assert judged(spark.createDataFrame(list(enumerate(names)), "page_id long, url string"), entries) == {i: brute_url(u, ENTRIES) for i, u in enumerate(names)}


def test_url_filter_random_entries_and_empty_tables(spark):
    rng = random.Random(1)
    part = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    way = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    entries = list({(h, p, k): (h, p, rng.choice(["allow", "block"]), k) for h, p, k in ((part(), way(), rng.random() < 0.6) for _ in range(80))}.values())
    urls = [(i, f"http://{part()}{way()}") for i in range(400)] + [(400, "http://" + "a." * 200 + "a/" + "x" * 100_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    assert judged(pages, spark.createDataFrame(entries, LISTED)) == {i: brute_url(u, entries) for i, u in urls}
    assert {r.verdict for r in url_filter(pages, spark.createDataFrame([], LISTED)).collect()} == {"allow"}
    assert url_filter(pages.limit(0), listed_urls(spark)).count() == 0


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute_items(text, items):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        i = words(t)
        if i:
            k = min(10, len(i))
            wins = {tuple(i[a : a + k]) for a in range(len(i) - k + 1)}
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit.update(range(a, a + k))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_find_items(spark, seed):
    rng = random.Random(seed)
    v = ["a", "B", "ü", "c1", "the"]
    say = lambda n: "".join(rng.choice(v) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 12, 30]))) for i in range(6)] + [(7, None), (3, say(11))]
    docs = [(i, say(rng.randint(0, 40)) + (items[i % 6][1] or "") + say(3), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (1, "a a", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(d, b).collect()
    want = sorted((i, *brute_items(t, items)) for i, t, _ in docs)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) and (r.n_hit > 0) <= (r.longest > 0) and r.longest <= r.n_hit for r in got)
    clean = decontaminate.remove_items(d, b, max_coverage=1.0)
    assert clean.columns == d.columns and all(brute_items(r.text, items)[1] == 0 for r in clean.collect())
    untouched = {(i, t) for i, t, _ in docs if not brute_items(t, items)[1]}
    assert untouched <= {(r.doc_id, r.text) for r in clean.collect()}


def test_items_of_several_parts(spark, monkeypatch):
    """Items that fill several automata, one of them longer than an automaton, give what one automaton gives."""
    rng = random.Random(11)
    say = lambda n, k=400: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, say(rng.choice([1, 4, 10, 15, 40]), 200_000 if i % 2 else 400)) for i in range(20)] + [(50, say(300))]
    inner = items[-1][1].split()
    # cutting the passage of one item out of these joins a window of another
    docs = [(i, f"{say(8)} {items[i % 20][1]} {say(5)}") for i in range(40)] + [(90, " ".join(inner[20:26] + inner[100:120] + inner[26:40])), (91, None), (91, ""), (92, say(20_000))]
    d, b = spark.createDataFrame([(*x, "x", 7) for x in docs], "doc_id long, text string, cut string, row int"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.collect())
    whole = key(decontaminate.find_items(d, b))
    found, cleaned = [x[:-1] for x in whole], [key(decontaminate.remove_items(d, b, max_coverage=c)) for c in (0.5, 1.0)]
    assert found == sorted(tuple(str(x) for x in (i, *brute_items(t, items), brute_items(t, items)[1] > 0)) for i, t in docs)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 60)
    monkeypatch.setattr(decontaminate, "WINDOW_HASHES", 200)
    assert decontaminate.item_parts(b)[1] > 5
    assert key(decontaminate.find_items(d, b)) == whole
    assert [key(decontaminate.remove_items(d, b, max_coverage=c)) for c in (0.5, 1.0)] == cleaned and len(cleaned[0]) < len(cleaned[1])


def test_remove_items_limits_and_empty_tables(spark):
    item = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"Before. {item}! After all of this there is more text, and more, and more of it.", 5), (2, item, 5), (3, None, None), (4, "Clean\ttext ", 11)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.remove_items(d, b).collect()}
    assert set(got) == {1, 3, 4} and got[4].text == "Clean\ttext " and got[4].n_chars == 11 and got[3].text is None
    assert got[1].text == "Before. ! After all of this there is more text, and more, and more of it." and got[1].n_chars == len(got[1].text)
    assert decontaminate.remove_items(d, b.limit(0)).count() == 4
    assert decontaminate.find_items(d.limit(0), b).count() == 0


def brute_components(rows, rule):
    sets = {}
    for i, t in rows:
        w, n = (t or "").encode().lower().split(), rule.words
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and rule.den * both >= rule.num * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("rule", "local", "copies"), [(jaccard_join.Rule(3, 9, 10), 4000, 3), (jaccard_join.Rule(5, 4, 5), 8, 3), (jaccard_join.Rule(5, 4, 5), 8, 100), (jaccard_join.Rule(3, 9, 10), 8, 0)])
def test_jaccard_components(spark, rule, local, copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOCAL_POINTS", local)
    monkeypatch.setattr(jaccard_join, "MOST_COPIES", copies)
    monkeypatch.setattr(jaccard_join, "PIVOT_BYTES", 0 if copies == 100 else 32 << 20)
    rng = random.Random(2)
    v = [f"w{k}" for k in range(300)]
    base = [[rng.choice(v) for _ in range(rng.choice([1, 2, 3, 9, 11, 40, 120, 300]))] for _ in range(15)]
    passage = [rng.choice(v) for _ in range(50)]
    rows = []
    for i in range(300):
        b = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(v) for _ in range(rng.randint(0, 90))]
        for _ in range(int(rng.random() ** 2 * len(b) * 0.08)):
            b[rng.randrange(len(b))] = rng.choice(v)
        rows.append((i * 7 % 307, " ".join(b + (passage if rng.random() < 0.1 else []))))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One Two"), (904, "one two"), (905, " ".join(rng.choice(v) for _ in range(30_000)))]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(d, rule).collect()}
    want = brute_components(rows, rule)
    assert got == want
    kept = jaccard_join.keep_one(d, rule)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_odd_rows(spark):
    t = " ".join(f"x{k}" for k in range(40))
    rows = [(None, t), (5, t), (5, t), (3, t), (5, "something else entirely here"), (8, "Something else entirely HERE")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.jaccard_components(d, jaccard_join.Rule()).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 3), (5, 3), (8, 3)]
    assert jaccard_join.jaccard_components(d.limit(0)).count() == 0


def test_span_hashes_of_strings_that_collide_in_powers_of_an_odd_number():
    """Thue-Morse words and their complements have equal sums of powers of any odd number modulo 2^64."""
    import numpy as np

    from sylva.llm._text import span_hashes

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048)).encode()
    data = np.frombuffer(a + a.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    x, y = span_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert x != y
    upper, lower = np.frombuffer(b"AbC" * 900, np.uint8), np.frombuffer(b"abc" * 900, np.uint8)
    assert span_hashes(upper, np.array([0]), np.array([2700]), True) == span_hashes(lower, np.array([0]), np.array([2700]), True)


def test_region_join_with_settled_points():
    import numpy as np

    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in range(4)] + [np.arange(500, 520, dtype=np.uint64)]
    rule = jaccard_join.Rule(3, 9, 10)  # neighbours share 19 of 21: linked
    assert len(jaccard_join.join_region(list(range(5)), sets, [False] * 5, rule)) == 3
    assert jaccard_join.join_region(list(range(5)), sets, [True] * 5, rule) == []
    assert len(jaccard_join.join_region(list(range(5)), sets, [True, True, True, False, False], rule)) == 1
    assert jaccard_join._connected_bits({0b011: 3, 0b110: 1, 0b1000: 3, 0: 9}) == 0b111


def test_pivots_make_regions_of_the_given_tables(spark, monkeypatch):
    """What joins the spaces of the given documents are pivots' regions: guests, cuts of cuts, and hardly any comparison."""
    import numpy as np

    rule, rows = jaccard_join.Rule(5, 4, 5), []
    links_of = jaccard_join.links_of
    monkeypatch.setattr(jaccard_join, "links_of", lambda r, rule: (rows.extend(r.collect()), links_of(r, rule))[1])
    jaccard_join.jaccard_components(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), rule).count()
    spaces = {}
    for r in rows:
        spaces.setdefault(r.region, []).append(r)
    total = {"regions": 0, "guests": 0, "depth": 0, "near pivots": 0, "compared": 0}
    for own in spaces.values():
        space = jaccard_join._Space([r.id for r in own], [np.frombuffer(r.body, np.uint64) for r in own], [False] * len(own), rule)
        links = space.join()
        for k, n in space.tally.items():
            total[k] = max(total[k], n) if k == "depth" else total[k] + n
        # what pivots tell is what a comparison of all pairs tells
        near = {(a, b) for a in range(len(own)) for b in range(a) if rule.linked(jaccard_join._shared(space.sets[a], space.sets[b]), len(space.sets[a]), len(space.sets[b]))}
        assert bool(near) == bool(links) and all(space.root[a] == space.root[b] for a, b in near)
    pairs = sum(len(x) * (len(x) - 1) // 2 for x in spaces.values())
    assert total["regions"] > 1000 and total["guests"] > 5 and total["depth"] >= 1 and total["near pivots"] > 20 and total["compared"] < pairs / 20


def test_local_regions_of_clusters_that_touch():
    """Clusters in chains: points between pivots are guests, and regions are cut again."""
    import numpy as np

    rng, rule = random.Random(8), jaccard_join.Rule(5, 4, 5)
    sets, seen = [], {"guests": 0, "depth": 0}
    for c in range(30):
        base = list(range(c * 10_000, c * 10_000 + 60))
        for k in range(rng.randint(1, 25)):  # each step changes a few shingles, so that ends of a chain are far apart
            for _ in range(rng.randint(1, 5)):
                base[rng.randrange(60)] = c * 10_000 + 100 + rng.randrange(5_000)
            sets.append(np.unique(np.array(base, np.uint64)))
    ids = list(range(len(sets)))
    rng.shuffle(ids)
    space = jaccard_join._Space(ids, sets, [False] * len(sets), rule)
    space.join()
    for a in range(len(sets)):
        for b in range(a):
            if rule.linked(jaccard_join._shared(space.sets[a], space.sets[b]), len(space.sets[a]), len(space.sets[b])):
                assert space.root[a] == space.root[b]
    assert len(set(space.root.tolist())) >= 30 and space.tally["guests"] > 30 and space.tally["depth"] > 1


def test_components_in_many_tasks(spark, monkeypatch):
    from sylva.llm import components

    monkeypatch.setattr(components, "TASK_EDGES", 40)
    monkeypatch.setattr(components, "HOT_LEAST", 20)
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(100)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(9)
    up = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    rows = connected_components(edges).collect()
    assert {r.node: r.root for r in rows} == {x: find(x) for x in up} and len(rows) == len(up)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (9, 9)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert connected_components(edges.limit(0)).count() == 0


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = "aaabcdehotin THE  \n\t'sé漢🙂019%$\x85\xa0"
    texts = ["", " ", "a" * 5000, "x<|endoftext|>y <|endoftext|>", "é" * 900] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1, None, 1), (None, "again again", 1), (1, " ", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(d, path).collect()) == want
    assert count_tokens(d.limit(0), path).count() == 0


def test_merging_one_by_one_where_a_merge_makes_a_lower_pair():
    import json

    vocabulary = {chr(c): c for c in range(256, 512)} | {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for k, x in enumerate(["bc", "abc", "abcab", "ab"]):
        vocabulary[x] = 1000 + k
    # abc may be made by rank 1 or by rank 4; abc + ab (rank 2) lies between
    merges = [["b", "c"], ["a", "bc"], ["abc", "ab"], ["a", "b"], ["ab", "c"]]
    m = RankMerger(json.dumps({"added_tokens": [], "model": {"vocab": vocabulary, "merges": merges}}))
    assert not m.at_once[4] and m.counts([b"abcabc", b"abab", b"abcab"]).tolist() == [2, 2, 1]
