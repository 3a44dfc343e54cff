"""Trees, polynomials and the search, against published counts, invariants and brute force."""

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sylva.functions import columns as C
from sylva.functions.trees import canonical_form, digest, graph6, graph6_edges, graph6_parent, packed_polynomial, rooted, shape_measures, slot_bits, unpack
from sylva.operators import search as S
from sylva.operators.polynomials import relational_polynomials, tree_polynomials, with_polynomial
from sylva.operators.store import SearchStore, SettingsMismatch, merge_stores, upsert
from sylva.plans import search as plan
from sylva.plans.search import build_dataset, check_polynomials, search, search_sharded
from sylva.sources import tables
from sylva.streaming.search import stream_collisions
from sylva.sources.enumeration import enumerate_trees, layout_graph6, layout_parent, layouts, register_functions

# Published numbers of trees, and texts that results must equal.
TREES = {2: 1, 3: 1, 4: 2, 5: 3, 6: 6, 7: 11, 8: 23, 9: 47, 10: 106, 11: 235, 12: 551}
N5 = [
    ("DqC", "0,0,1,3,15,30,66,103,148,174,200,174,148,103,66,30,15,3,1"),
    ("DqO", "0,0,1,5,15,32,66,105,144,174,196,174,144,105,66,32,15,5,1"),
    ("DiO", "0,1,1,9,16,36,65,109,136,173,188,173,136,109,65,36,16,9,1,1"),
]
DIGESTS5 = ["aeda259bbdfa69d594fbda9df246b565b51dc1dbfe7a17c6edc3cb1898329ba8", "fc0412ff61b37715f0f1c6a8f3f086502bc8f17f4e1730d8537a5aaf678f35bd", "56bb89cb3839408c17c1cdf40cfbf3075f797638ce438db19343890dd5ff9cad"]
# Labels of all trees in the order of enumeration, and SHA-256 of their polynomials, a line each.
GOLDEN = {
    4: ("Cq Ci", "b922d072d341cb4de93ae035ab0de51d2ded135c69da5bca362a523378d26d46"),
    5: ("DqC DqO DiO", "1b228b1d4a8142b27081666539c81b8bbf7e8339e75742cb0aad310fafa65d9a"),
    6: ("EpOG EsOG EsP? EqD? EqP? EiP?", "2ea714a63903199f0ff59b460bd312bbb3ed0cc9dd5ec6e4f4ce9ecdbb9b6d14"),
    7: ("FpOGG FpOGO FpOI? Fs`?G FsOGO FsOI? FsPA? FqD?G FqDA? FqPA? FiPA?", "24a361a60edfdaf7189689362a7ba1ad45b435b84cf541203c8f0b769bd2c1aa"),
    8: (
        "GpD?GC GpH?GC GpH?GG Gp`?GC Gp`?GG Gp`?I? GpOGI? GpOGOO GpOGQ? GpOI?C GpOIA? GsaA?C Gs`?GG Gs`?I? Gs`AA? GsOGQ? GsOI?C GsOIA? GsPAA? GqD?I? GqDAA? GqPAA? GiPAA?",
        "6f14d8c005755829b390e55da0b6b223f31a1b4ea112449416a31f238cb38c1c",
    ),
    9: (
        "HpD?GC@ HpD?GCA HpD?GCC HpD?GD? HpGa?C@ HpIA?C@ HpH?GCA HpH?GCC HpH?GD? HpH?GGC HpH?GH? HpH?I?@ HpH?I@? Hp_I?C@ HpaA?C@ Hp`?GCC Hp`?GD? Hp`?GGC Hp`?GH? Hp`?I?@ Hp`?I@? HpOGI?@ HpOGI@? HpOGOOG HpOGOP? HpOGQ?@ HpOGQ@? HpOI?D? HpOIA@? HsaCA?@ HsaA?CA HsaA?D? Hs`?GGC Hs`?GH? Hs`?I?@ Hs`?I@? Hs`AA@? HsOGQ?@ HsOGQ@? HsOI?D? HsOIA@? HsPAA@? HqD?I?@ HqD?I@? HqDAA@? HqPAA@? HiPAA@?",
        "a44edf94e0cd4d5fa7561392a00d5637c7b05e5185103cc4d37e3d024ddd2666",
    ),
}
# Two trees of 20 vertices: label, mean and variance of the coefficients as doubles, diameter, radius, leaves.
EQUAL_VARIANCE = [("SpCGGG_O??_@?@??_?_?@?C???G??G??O", 11, 6, 7), ("SpCGGG__??g??@??_?G?@??C??_?G???C", 12, 6, 7)]
MEAN20, VARIANCE20 = 1.0665335070945086e23, 3.694092914557426e46
PAIRS9 = {"none": {(7, 18), (7, 27), (7, 39), (8, 37), (10, 26)}, "known": {(7, 18), (7, 27), (7, 39), (8, 37), (10, 26)}, "leaves": {(7, 27), (10, 26), (18, 39)}, "leaves+minsum": {(7, 27), (10, 26), (18, 39)}}
BUCKETS9 = {"leaves+minsum": (12, 9, 44), "leaves": (7, 5, 45), "known": (4, 3, 46)}


def random_tree(rng, n):
    return [-1, *(rng.randrange(i) for i in range(1, n))]


def brute_polynomial(parent, k):
    out = [0] * (len(parent) * (k - 1) + 1)
    for colours in itertools.product(range(k), repeat=len(parent)):
        if all(colours[i] != colours[parent[i]] for i in range(1, len(parent))):
            out[sum(colours)] += 1
    while len(out) > 1 and not out[-1]:
        out.pop()
    return out


@pytest.mark.parametrize("n", TREES)
def test_enumeration_counts_and_classes(n):
    forms = [canonical_form(layout_parent(x.levels())) for x in layouts(n)]
    assert len(forms) == len(set(forms)) == TREES[n]


def test_labels_polynomials_and_digests_of_five_vertices():
    got = [(layout_graph6(x), packed_polynomial(layout_parent(x), 5)) for x in (t.levels() for t in layouts(5))]
    assert [(g, ",".join(map(str, unpack(p, 5, 5)))) for g, p in got] == N5
    assert [digest(p).hex() for _, p in got] == DIGESTS5


@pytest.mark.parametrize("seed", range(6))
def test_polynomial_against_all_colourings(seed):
    rng = random.Random(seed)
    n, k = rng.randint(1, 6), rng.randint(1, 5)
    p = random_tree(rng, n)
    assert unpack(packed_polynomial(p, k), n, k) == brute_polynomial(p, k)


def test_one_vertex_and_two():
    assert unpack(packed_polynomial([-1], 1), 1, 1) == [1]
    assert unpack(packed_polynomial([-1, 0], 2), 2, 2) == [0, 2]
    assert slot_bits(4, 4) == 8 and slot_bits(5, 5) == 12 and slot_bits(9, 9) == 29


def test_measures_against_polynomials_and_distances():
    rng = random.Random(3)
    trees = [random_tree(rng, rng.randint(1, 9)) for _ in range(60)]
    low, span = shape_measures(trees)
    for p, m, d in zip(trees, low, span, strict=True):
        n = len(p)
        c = unpack(packed_polynomial(p, max(n, 2)), n, max(n, 2))
        assert next(i for i, x in enumerate(c) if x) == m
        far = [[0 if i == j else 99 for j in range(n)] for i in range(n)]
        for i in range(1, n):
            far[i][p[i]] = far[p[i]][i] = 1
        for k, i, j in itertools.product(range(n), repeat=3):
            far[i][j] = min(far[i][j], far[i][k] + far[k][j])
        assert max(map(max, far)) == d and min(map(max, far)) == (d + 1) // 2


def test_graph6_round_trip_and_refusals():
    rng = random.Random(4)
    for n in (1, 2, 7, 20, 62, 63, 64, 300):
        p = random_tree(rng, n)
        edges = list(zip(p[1:], range(1, n)))
        assert graph6_edges(graph6(n, edges)) == (n, sorted(edges, key=lambda e: (e[1], e[0])))
        assert canonical_form(rooted(n, edges)) == canonical_form(p)
    with pytest.raises(ValueError):
        rooted(3, [(0, 1)])
    with pytest.raises(ValueError):
        rooted(4, [(0, 1), (1, 0), (2, 3)])
    # the mark and the size of 63 vertices and more, as the format has them
    assert graph6(63, [])[:4] == "~??~"
    for bad in ("", "~", "D", "DqCC", "\u00e9", "~??B?", "~~?????", "C\x7f", "A@", chr(63 + 63) + "??}" + "?" * 100):
        with pytest.raises(ValueError):
            graph6_edges(bad)


def test_enumeration_in_spark_is_dense_and_ordered(spark):
    rows = enumerate_trees(spark, 9, stride=7).orderBy("tree_index").collect()
    assert [r.tree_index for r in rows] == list(range(47))
    assert [r.graph6 for r in rows] == [layout_graph6(x.levels()) for x in layouts(9)]
    assert enumerate_trees(spark, 9, max_trees=10, stride=7).count() == 10
    with pytest.raises(ValueError):
        enumerate_trees(spark, 1)


@pytest.mark.parametrize("n", GOLDEN)
def test_golden_trees(spark, n):
    rows = tree_polynomials(enumerate_trees(spark, n)).orderBy("tree_index").select("graph6", C.polynomial_text(F.col("coeffs")).alias("p"), "digest", "coeffs").collect()
    labels, sha = GOLDEN[n]
    assert [r.graph6 for r in rows] == labels.split() and hashlib.sha256("\n".join(r.p for r in rows).encode()).hexdigest() == sha
    for r in rows:  # the digest, from the coefficients packed anew
        packed = sum(int(c) << (slot_bits(n, n) * k) for k, c in enumerate(r.coeffs))
        assert bytes(r.digest) == hashlib.blake2b(packed.to_bytes((packed.bit_length() + 7) // 8, "little"), digest_size=32).digest()


def test_two_trees_of_nearly_equal_variance(spark):
    t = spark.createDataFrame([(g, graph6_edges(g)[0]) for g, *_ in EQUAL_VARIANCE], "graph6 string, n int").withColumn("parent", graph6_parent("graph6"))
    rows = {r.graph6: r for r in tree_polynomials(S.with_bucket(t, "none")).collect()}
    exact = []
    for g, diameter, radius, leaves in EQUAL_VARIANCE:
        r = rows[g]
        c = [int(x) for x in r.coeffs]
        assert (r.diameter, r.radius, r.leaves, len(c)) == (diameter, radius, leaves, 371)
        assert sum(c) / len(c) == pytest.approx(MEAN20, rel=1e-14)
        exact.append(len(c) * sum(x * x for x in c) - sum(c) ** 2)
        assert exact[-1] / len(c) ** 2 == pytest.approx(VARIANCE20, rel=1e-14)
    assert exact[0] != exact[1]


def test_enumeration_goes_on_from_any_state():
    whole = [t.levels() for t in layouts(11)]
    for i, t in enumerate(layouts(11)):
        if i % 31 == 0:
            assert [x.levels() for x in layouts(11, t.state())] == whole[i:]


def test_sql_functions(spark):
    register_functions(spark)
    got = spark.sql("SELECT tree_index, graph6, tree_form(parent) AS f FROM enumerate_trees(5)").orderBy("tree_index").collect()
    assert [r.graph6 for r in got] == [g for g, _ in N5]


@pytest.mark.parametrize("mode", PAIRS9)
def test_few_colour_collisions(spark, mode):
    rows = S.scan_forest(enumerate_trees(spark, 9), mode, 3)
    assert {(r.tree_index_a, r.tree_index_b) for r in S.collisions(rows).collect()} == PAIRS9[mode]
    assert S.collisions(rows, all_pairs=True).count() == (8 if mode in ("none", "known") else 3)


def test_no_collision_with_all_colours_and_invariants(spark):
    rows = S.scan_forest(enumerate_trees(spark, 9), "none")
    assert S.collisions(rows).count() == 0
    assert check_polynomials(rows).count() == 0
    assert check_polynomials(rows.withColumn("coeffs", F.reverse("coeffs"))).count() > 0


@pytest.mark.parametrize("mode", BUCKETS9)
def test_bucket_numbers(spark, mode):
    counts = S.bucket_counts(S.with_bucket(enumerate_trees(spark, 9), mode))
    r = S.bucket_summary(counts).first()
    assert (r.buckets, r.multiple, counts.filter("count > 1").agg(F.sum("count")).first()[0]) == BUCKETS9[mode] and r.trees == 47
    with pytest.raises(ValueError):
        C.bucket_key(F.lit(1), F.lit(1), "other")


def test_relational_fold_agrees(spark):
    t = enumerate_trees(spark, 6).select(F.col("tree_index").alias("tree_id"), "n", "parent")
    long = with_polynomial(t).select("tree_id", F.posexplode("coeffs").alias("degree", "coefficient")).filter("coefficient <> 0")
    other = relational_polynomials(t, 6).select(*long.columns)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, other.collect()))


def test_wide_coefficients(spark):
    path = [-1, *range(19)]
    rows = with_polynomial(spark.createDataFrame([(1, 20, path)], "tree_id int, n int, parent array<int>"))
    c = [int(x) for x in rows.first().coeffs]
    assert c == unpack(packed_polynomial(path, 20), 20, 20) and sum(c) == 20 * 19**19
    with pytest.raises(Exception):
        with_polynomial(spark.createDataFrame([(1, 30, [-1, *range(29)])], "tree_id int, n int, parent array<int>")).collect()


def test_column_functions(spark):
    d = spark.sql("SELECT array(cast(0 AS decimal(38,0)), 2, 0, 3, 0) AS a, array(cast(1 AS decimal(38,0)), 1) AS b, array(cast(0 AS decimal(38,0))) AS z")
    r = d.select(C.polynomial_terms(F.col("a")).alias("t"), C.polynomial_terms(F.col("z")).alias("tz"), C.min_exponent(F.col("a")).alias("m"), C.min_exponent(F.col("z")).alias("mz"), C.polynomial_text(C.trim_polynomial(F.col("a"))).alias("trim"), C.polynomial_text(C.trim_polynomial(F.col("z"))).alias("trimz"), C.polynomial_text(C.add_polynomials(F.col("a"), F.col("b"))).alias("s"), C.polynomial_text(C.multiply_polynomials(F.col("a"), F.col("b"))).alias("p")).first()
    assert (r.t, r.tz, r.m, r.mz, r.trim, r.trimz, r.s, r.p) == ("2q^1 + 3q^3", "0", 1, None, "0,2,0,3", "0", "1,3,0,3,0", "0,2,2,3,3,0")
    t = spark.createDataFrame([(93784.0,), (3723.9,), (123.0,), (-5.0,), (float("nan"),), (None,)], "s double").select(C.duration_text(F.col("s")).alias("t")).collect()
    assert [x.t for x in t] == ["1d 02h 03m", "1h 02m 03s", "2m 03s", "0m 00s", "?", "?"]


def test_store_resumes_and_refuses_other_settings(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    first = search(spark, 9, path, "none", 3, range_size=10, max_trees=20, stop_on_collision=False, validate_every=5)
    assert {(r.tree_index_a, r.tree_index_b) for r in first.collect()} == {(7, 18)}
    whole = search(spark, 9, path, "none", 3, range_size=10, stop_on_collision=False)
    assert {(r.tree_index_a, r.tree_index_b) for r in whole.collect()} == PAIRS9["none"]
    again = search(spark, 9, path, "none", 3, range_size=10, stop_on_collision=False)
    assert again.count() == 5
    with pytest.raises(SettingsMismatch):
        SearchStore(spark, path, n=9, bucket_mode="leaves", colours=3, shards=1, shard_index=0, two_pass=True)
    with pytest.raises(ValueError):
        search(spark, 1, path)


def test_shards_find_the_same_pairs(spark, tmp_path):
    seen, pairs = search_sharded(spark, 9, f"file://{tmp_path}/sharded", 2, mode="none", colours=3)
    assert seen.count() == 47 and {(r.tree_index_a, r.tree_index_b) for r in pairs.collect()} == PAIRS9["none"]


def test_each_tree_gets_one_polynomial_over_all_shards_and_ranges(spark, tmp_path, monkeypatch):
    taken, walks = [], []

    def counted(trees, colours=None):
        taken.append(trees.count())
        return tree_polynomials(trees, colours)

    def walked(*a, **b):
        walks.append(1)
        return enumerate_trees(*a, **b)

    monkeypatch.setattr(plan, "tree_polynomials", counted)
    monkeypatch.setattr(plan, "enumerate_trees", walked)
    seen, pairs = search_sharded(spark, 9, f"file://{tmp_path}/s", 2, mode="leaves", colours=3, range_size=16)
    assert {(r.tree_index_a, r.tree_index_b) for r in pairs.collect()} == PAIRS9["leaves"]
    assert sum(taken) == seen.count() == BUCKETS9["leaves"][2] and len(taken) == 6 and len(walks) == 1


def test_merging_shards_of_different_searches_is_refused(spark, tmp_path):
    path = lambda x: f"file://{tmp_path}/{x}"
    for name, n, mode in (("a", 6, "none"), ("b", 7, "none"), ("c", 6, "leaves")):
        search(spark, n, path(name), mode)
    for other in "bc":
        with pytest.raises(SettingsMismatch):
            merge_stores([SearchStore(spark, path("a")), SearchStore(spark, path(other))])
    with pytest.raises(SettingsMismatch):
        SearchStore(spark, path("none"))


def test_command_line(spark, tmp_path, capsys):
    path = lambda x: f"file://{tmp_path}/{x}"
    for k in range(2):
        plan.main(["scan", "7", "--db", path(f"s{k}"), "--bucket-mode", "none", "--shards", "2", "--shard-index", str(k), "--no-stop-on-collision"])
    with pytest.raises(SystemExit):
        plan.main(["scan", "7", "--db", path("s0"), "--bucket-mode", "none", "--shards", "2"])
    plan.main(["scan", "7", "--db", path("s0"), "--resume", "--bucket-mode", "none", "--shards", "2"])
    plan.main(["merge", path("merged"), path("s0"), path("s1")])
    assert "11 trees, 0 collisions" in capsys.readouterr().out
    pairs = search(spark, 9, path("few"), "none", 3, stop_on_collision=False)
    assert plan.write_reports(pairs, 9, path("reports"), 3) == 5
    report = json.loads(sorted(x for f in (tmp_path / "reports").glob("part*") for x in f.read_text().splitlines())[0])
    a, b = report["tree_index_a"], report["tree_index_b"]
    labels = GOLDEN[9][0].split()
    assert (a, b) in PAIRS9["none"] and (report["graph6_a"], report["graph6_b"]) == (labels[a], labels[b])
    assert list(report)[:2] == ["n", "bucket"] and len(report["degree_sequence_a"]) == 9 and sum(report["coefficients"]) == 3 * 2**8


def test_stream_pairs_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(4)
    rows = [(n, f"d{rng.randrange(12)}", i) for i, n in enumerate(rng.choice([3, 4]) for _ in range(120))]
    schema = "n long, digest string, tree_id long"
    first = {}
    for n, d, i in rows:
        first.setdefault((n, d), i)
    want = sorted((n, d, first[n, d], i) for n, d, i in rows if i != first[n, d])
    for k in range(2):
        rng.shuffle(rows)
        for j in range(6):
            spark.createDataFrame(rows[j * 20 : j * 20 + 20], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in{k}", mode="append")
        seen, pairs = stream_collisions(spark, f"file://{tmp_path}/in{k}", spark.createDataFrame([], schema).schema, files_per_batch=1)
        assert sorted(map(tuple, pairs.collect())) == want
        assert {(r.n, r.digest): r.tree_id for r in seen.collect()} == first


def test_dataset_round_trip(spark, tmp_path):
    assert build_dataset(spark, 5, f"file://{tmp_path}/n5") == 3
    assert [(r.graph6, r.polynomial) for r in tables.read_dataset(spark, f"file://{tmp_path}/n5").collect()] == N5
    r = tables.read_dataset(spark, f"file://{tmp_path}/n5").select(C.polynomial_text(C.polynomial_parse(F.col("polynomial"))).alias("p")).collect()
    assert [x.p for x in r] == [p for _, p in N5]


def test_tree_pair_text(spark, tmp_path):
    (tmp_path / "pair.txt").write_text("4 3\n0 1\n1 2\n1 3\n0 2\n2 1\n2 3\n")
    edges, k = tables.read_tree_pair(spark, f"file://{tmp_path}/pair.txt")
    p = with_polynomial(tables.trees_of_edges(edges), k + 1)
    terms = {r.t for r in p.select(C.polynomial_terms(F.col("coeffs")).alias("t")).collect()}
    assert terms == {"1q^1 + 1q^2 + 8q^3 + 12q^4 + 19q^5 + 26q^6 + 19q^7 + 12q^8 + 8q^9 + 1q^10 + 1q^11"}
    pair = spark.createDataFrame([(1, 2)], "a int, b int")
    assert S.compare_pairs(pair, p).first().verdict == "The special functions are equal."


def test_bucket_cache_survives_a_broken_file(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    counts = spark.createDataFrame([("a", 2), ("b", 1)], "bucket string, count long")
    assert tables.cached_bucket_counts(spark, path, 9, "none", lambda: counts).count() == 2
    assert tables.cached_bucket_counts(spark, path, 9, "none", lambda: counts.limit(0)).count() == 2
    assert tables.cached_bucket_counts(spark, path, 8, "none", lambda: counts.filter("count > 1")).count() == 1
    for f in (tmp_path / "cache").glob("part*"):
        f.write_text("{broken")
    assert tables.cached_bucket_counts(spark, path, 8, "none", lambda: counts).count() == 2


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 5)], "key string, value string, version long")
    new = spark.createDataFrame([("a", "3", 2), ("b", "0", 4), ("c", "9", 1)], "key string, value string, version long")
    assert {(r.key, r.value) for r in upsert(old, new).collect()} == {("a", "3"), ("b", "2"), ("c", "9")}


def test_entry_and_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    q, sql = entry.queries(), entry.oracle_sql()
    for name in ("tree_attributes", "polynomials", "bucket_counts_leaves_minsum", "collision_pairs", "diameter_radius", "graph6_text", "meta_upsert", "dataset_decode", "polynomial_arithmetic", "enumeration_sizes", "stream_pairs"):
        got = q[name](spark, d)
        want = con.execute(sql[name]).fetchall()
        names = [c[0] for c in con.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want), name


def test_entry_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "sylva"), tmp_path / "sylva", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr
