"""The enumeration shared by tasks, and its data source."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

import sylva.sources.enumeration as module
from sylva.sources.datasource import PushedTreeReader, read_trees_of_size, register_source
from sylva.sources.enumeration import Layout, block_starts, enumerate_trees, layouts, skip, tree_starts, walk

# Fixed: free trees of 1, 2, ... vertices.
FREE_TREES = [1, 1, 1, 2, 3, 6, 11, 23, 47, 106, 235, 551, 1301, 3159, 7741, 19320, 48629, 123867]


@pytest.mark.parametrize("n", range(2, 13))
def test_skipping_meets_the_next_tree_of_another_prefix(n):
    trees = [t.levels() for t in layouts(n)]
    assert len(trees) == FREE_TREES[n - 1]
    for keep in range(1, n + 1):
        after = None
        for k in range(len(trees) - 1, -1, -1):
            if k + 1 < len(trees) and trees[k + 1][:keep] != trees[k][:keep]:
                after = trees[k + 1]
            assert skip(trees[k], keep) == after


@pytest.mark.parametrize("n", [4, 7, 11, 12])
def test_states_of_levels_go_on_like_the_walk(n):
    trees = [t.levels() for t in layouts(n)]
    for k in range(0, len(trees), 5):
        assert [t.levels() for t in layouts(n, Layout.of_levels(trees[k]).state())] == trees[k:]


def test_walks_of_blocks_are_the_enumeration():
    trees = [t.levels() for t in layouts(12)]
    starts, out = block_starts(12, 40), []
    assert 40 <= len(starts) < 200
    for start, stop in zip(starts, [*starts[1:], None], strict=True):
        for first, size, state in walk(start, stop, 7):
            assert first % 7 == 0 and 0 < size <= 7
            out += [t.levels() for t, _ in zip(layouts(12, state), range(size), strict=False)]
    assert out == trees
    with pytest.raises(RuntimeError):
        list(walk(starts[-1], starts[0], 7))
    assert [x[:2] for x in walk(starts[0], None, 7, 10)] == [(0, 7), (7, 3)]


@pytest.mark.parametrize("n", range(2, 15))
def test_indices_are_dense_and_as_before(spark, n):
    want = [(i, module.layout_graph6(t.levels())) for i, t in enumerate(layouts(n))]
    rows = enumerate_trees(spark, n, stride=50).select("tree_index", "graph6").collect()
    assert sorted(map(tuple, rows)) == want


def test_bound_on_trees(spark):
    assert sorted(r.tree_index for r in enumerate_trees(spark, 11, 25, 4).collect()) == list(range(25))
    assert enumerate_trees(spark, 5, 100).count() == 3 and enumerate_trees(spark, 5, 0).count() == 0


def test_no_task_walks_through_all_trees(spark):
    starts = tree_starts(spark, 14, 20)
    assert starts.agg(F.sum("size")).first()[0] == 3159
    walked = [x for _, x, _ in walk(block_starts(14, 64)[0], block_starts(14, 64)[1], 20)]
    assert sum(walked) < 3159 // 10
    rows = sorted((r.first, r.size) for r in starts.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


def test_reader_makes_only_the_range(monkeypatch, spark):
    steps = []
    real = Layout.advance
    monkeypatch.setattr(Layout, "advance", lambda self: steps.append(1) or real(self))
    path = tree_starts(spark, 13, 10)._sylva_path
    want = [module.layout_graph6(t.levels()) for t in layouts(13)]
    for filters, low, high in [
        ([GreaterThanOrEqual(("tree_index",), 300), LessThan(("tree_index",), 317)], 300, 317), ([EqualTo(("tree_index",), 44)], 44, 45), ([GreaterThan(("tree_index",), 1290)], 1291, 1301),
        ([LessThanOrEqual(("tree_index",), 3)], 0, 4), ([GreaterThan(("tree_index",), 5000)], 0, 0), ([LessThan(("tree_index",), -3)], 0, 0),
    ]:
        for options in ({"n": "13", "starts": path}, {"n": "13"}):
            r = PushedTreeReader(options)
            assert list(r.pushFilters(filters)) == []
            parts = r.partitions()
            steps.clear()
            got = [x for p in parts for b in r.read(p) for x in zip(b.column("tree_index").to_pylist(), b.column("graph6").to_pylist(), strict=True)]
            assert sorted(got) == [(i, want[i]) for i in range(low, high)]
            if "starts" in options:
                assert len(steps) <= high - low + 20
    r = PushedTreeReader({"n": "13", "starts": path})
    kept = [In(("tree_index",), (3, 900)), IsNotNull(("tree_index",)), EqualTo(("graph6",), "x")]
    assert list(r.pushFilters(kept)) == kept and (r.low, r.high) == (3, 901)
    with pytest.raises(ValueError):
        PushedTreeReader({"n": "1"})


def test_source_in_sql(spark):
    trees = read_trees_of_size(spark, 12, stride=30)
    assert trees.count() == 551 and trees.filter("tree_index >= 100 and tree_index < 120 and n = 12").count() == 20
    low, high = trees.filter("tree_index < 100"), trees.filter("tree_index >= 100")
    assert low.unionByName(high).select("tree_index").distinct().count() == 551
    assert sorted(r.tree_index for r in read_trees_of_size(spark, 12, 540, 9999, 30).collect()) == list(range(540, 551))
    assert read_trees_of_size(spark, 12, 7, 7).count() == 0
    register_source(spark)
    spark.read.format("trees").option("n", 9).load().createOrReplaceTempView("nine")
    assert spark.sql("select count(*), max(tree_index), count(distinct graph6) from nine where tree_index between 10 and 30").first() == (21, 30, 21)


def test_pushed_filters(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: read_trees_of_size(spark, 12, stride=30, pushdown=True)
        assert sorted(r.tree_index for r in load().filter("tree_index in (5, 500, 9999)").collect()) == [5, 500]
        assert load().filter("tree_index > 551").count() == 0 and load().filter("tree_index = 8").count() == 1
        assert load().filter("tree_index < 100").unionByName(load().filter("tree_index >= 100")).select("tree_index").distinct().count() == 551
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
