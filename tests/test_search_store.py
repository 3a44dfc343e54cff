"""Stored searches that stop at any point, the bucketed table of first trees, and what Spark observes of a range."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import sylva.plans.search as plan
from sylva.functions.columns import same_polynomial
from sylva.operators.store import SearchStore, new_firsts, pairs_with_firsts
from sylva.plans.search import candidates, search

# Fixed: pairs of the trees of nine vertices with one polynomial in three colours.
PAIRS9 = {(7, 18), (7, 27), (7, 39), (8, 37), (10, 26)}


class Stop(Exception):
    pass


def stored(spark, path):
    s = SearchStore(spark, path)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    return rows(s.found(), "tree_index_a", "tree_index_b"), rows(s.seen(), "tree_index", "graph6"), rows(s.firsts(), "tree_index", "graph6"), s.checkpoint()


def stopping(monkeypatch, step):
    """Let a commit stop after its first, second or third table, or before its mark."""
    real = SearchStore.commit

    def commit(self, seen, firsts, pairs, upto):
        with monkeypatch.context() as m:
            if step == "firsts":
                seen = seen.select(F.raise_error(F.lit("stop")).alias("x"), "*")
            elif step == "seen":
                pairs = pairs.select(F.raise_error(F.lit("stop")).alias("x"), "*")
            else:
                m.setattr(SearchStore, "_mark", lambda self, upto: (_ for _ in ()).throw(Stop()))
            real(self, seen, firsts, pairs, upto)

    return commit


@pytest.mark.parametrize("step", ["firsts", "seen", "mark"])
def test_resume_after_a_stop_within_a_commit(spark, tmp_path, monkeypatch, step):
    args = dict(mode="none", colours=3, stop_on_collision=False)
    trees = candidates(spark, 9, "none")
    search(spark, 9, f"file://{tmp_path}/whole", range_size=20, trees=trees, **args)
    path = f"file://{tmp_path}/broken"
    search(spark, 9, path, range_size=20, trees=trees.filter("tree_index < 20"), **args)  # one range is done
    with monkeypatch.context() as m:
        m.setattr(SearchStore, "commit", stopping(monkeypatch, step))
        with pytest.raises(Exception):  # noqa: B017
            search(spark, 9, path, range_size=10, trees=trees, **args)
    assert SearchStore(spark, path).checkpoint() == 19  # what stopped has no mark
    # taken up with the same ranges, and with others, so that what was left lies inside a later range
    for size in (20, 10):
        search(spark, 9, path, range_size=size, trees=trees, **args)
        assert set(stored(spark, path)[0]) == PAIRS9
    whole, again = stored(spark, f"file://{tmp_path}/whole"), stored(spark, path)
    assert whole == again and whole[3] == 46


def test_first_trees_stay_in_their_buckets(spark, tmp_path):
    """Joins of a range with the stored first trees, of several ranges, deal out the range alone."""
    path = f"file://{tmp_path}/s"
    trees = candidates(spark, 9, "none")
    search(spark, 9, path, "none", 3, range_size=16, stop_on_collision=False, trees=trees)
    store = SearchStore(spark, path)
    assert store.settings["buckets"] == "64" and len(store.marks()) == 3
    # another session knows the files too
    other = spark.newSession()
    spark.sql(f"DROP TABLE {store._firsts_table()}")
    again = SearchStore(other, path)
    assert again.firsts().count() == 42
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen, known = store.seen(), store.firsts()
        for joined in (pairs_with_firsts(seen, known), new_firsts(seen, known)):
            plan_text = joined._jdf.queryExecution().executedPlan().toString()
            lines = plan_text.splitlines()
            at = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
            depth, above = lines[at].index("FileScan"), []
            for x in lines[:at][::-1]:  # the scan's ancestors, from the nearest on
                own = next(i for i, c in enumerate(x) if c.isalpha() or c in "(*")
                if own < depth:
                    depth = own
                    above.append(x)
            join = next(i for i, x in enumerate(above) if "Join" in x)
            assert not any("Exchange" in x for x in above[:join]), plan_text
            assert any("Exchange" in x for x in lines), plan_text
        assert new_firsts(seen, known).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_equal_digests_of_different_polynomials_are_no_pair(spark):
    columns = "bucket string, digest binary, coeffs array<decimal(38,0)>, tree_index long, graph6 string, form string"
    d = bytearray(b"same")
    rows = [("b", d, [1, 2], 0, "x", "x"), ("b", d, [1, 3], 1, "y", "y"), ("b", d, [1, 2, 0], 2, "z", "z"), ("c", d, [1, 2], 3, "u", "u"), ("b", d, [1, 2], 4, "v", "v")]
    seen = spark.createDataFrame([(b, d, [Decimal(x) for x in c], *r) for b, d, c, *r in rows], columns)
    firsts = new_firsts(seen, seen.limit(0))
    assert sorted(r.tree_index for r in firsts.collect()) == [0, 1, 2, 3]
    assert [(r.tree_index_a, r.tree_index_b) for r in pairs_with_firsts(seen, firsts).collect()] == [(0, 4)]
    assert sorted(r.tree_index for r in new_firsts(seen, firsts.filter("tree_index = 0")).collect()) == [1, 2, 3]


def test_same_polynomial(spark):
    rng = random.Random(0)
    rows = [([rng.randrange(3) for _ in range(rng.randrange(3))], [rng.randrange(3) for _ in range(rng.randrange(3))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", same_polynomial(F.col("a"), F.col("b")).alias("same"))
    assert all(r.same == (r.a == r.b) for r in df.collect())


def test_candidates_are_made_once(spark, tmp_path, monkeypatch):
    """The semi-join of pass 1 runs once, however many ranges and shards read it."""
    made = []
    real = plan.keep_multiple
    monkeypatch.setattr(plan, "keep_multiple", lambda *a, **b: made.append(1) or real(*a, **b))
    trees = candidates(spark, 9, "leaves")
    assert made == [1] and trees._sylva_path and "Join" not in trees._jdf.queryExecution().optimizedPlan().toString()


def test_progress_is_what_is_stored(spark, tmp_path):
    told = []
    path = f"file://{tmp_path}/p"
    search(spark, 9, path, "leaves", 3, range_size=16, stop_on_collision=False, progress=told.append)
    found, seen, *_ = stored(spark, path)
    assert [t["upto"] for t in told] == [15, 31, 45] or [t["upto"] for t in told] == [15, 31, 46]
    assert sum(t["processed"] for t in told) == len(seen) and sum(t["collisions"] for t in told) == len(found)
    assert all(t["processed"] + t["skipped"] == t["generated"] and t["trees_per_sec"] > 0 for t in told)
