"""Recursive SQL over edges against parent arrays."""

import random

import pytest

from sylva import catalog
from sylva.functions.trees import canonical_form, shape_measures
from sylva.operators import rooting
from sylva.operators.rooting import NoTree, checked_edges, depths, relational_forms, rooted_measures

SCHEMA = "tree_id long, u long, v long"


def brute(parent):
    """Depth, eccentricity and centre of each vertex from distances."""
    n = len(parent)
    far = [[0 if i == j else n for j in range(n)] for i in range(n)]
    for i in range(1, n):
        for j in range(i):
            far[i][j] = far[j][i] = far[parent[i]][j] + 1
    ecc = [max(r) for r in far]
    return [(parent[i] if i else None, far[i][0], ecc[i], ecc[i] == min(ecc)) for i in range(n)]


def test_against_distances(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for t, p in enumerate([[-1, *(rng.randrange(i) for i in range(1, n))] for n in (2, 3, 5, 9, 20)] + [[-1, *range(9)]]):
        rows += [(t, *rng.sample((p[i], i), 2)) for i in range(1, len(p))]
        want[t] = brute(p)
        low, span = shape_measures([p])
        assert max(e for _, _, e, _ in want[t]) == span[0]
    rng.shuffle(rows)
    got = {}
    for r in rooted_measures(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", depth string")).collect():
        got[r.tree_id, r.v] = (r.parent, r.depth, r.eccentricity, r.is_centre)
    assert got == {(t, v): x for t, w in want.items() for v, x in enumerate(w)}
    assert rooted_measures(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forms_are_those_of_the_array_path(spark):
    rng = random.Random(2)
    trees = [[-1, *(rng.randrange(i) for i in range(1, n))] for n in (2, 2, 3, 4, 4, 4, 5, 6, 6, 7, 9)]
    rows = []
    for t, p in enumerate(trees):
        name = rng.sample(range(100), len(p))
        name = [0 if x == name[0] else x + 1 for x in name]
        rows += [(t, name[p[i]], name[i]) for i in range(1, len(p))]
    got = {r.tree_id: (r.n, r.form) for r in relational_forms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {t: (len(p), canonical_form(p)) for t, p in enumerate(trees)}


def test_more_levels_than_spark_allows_unasked(spark):
    arcs = checked_edges(spark.range(103).selectExpr("1L as tree_id", "id as u", "id + 1 as v"))
    deepest = depths(arcs, spark.createDataFrame([(1, 0)], "tree_id long, v long")).orderBy("depth", ascending=False).first()
    assert (deepest.v, deepest.parent, deepest.depth) == (103, 102, 103)


@pytest.mark.parametrize(
    "edges",
    [
        [(0, 0)], [(0, 1), (1, 0)], [(0, 1), (0, 1)], [(0, None)], [(0, 1), (1, 2), (2, 0)],  # loops, repeats, nulls, a cycle
        [(0, 1), (2, 3)], [(0, 1), (2, 3), (3, 4), (4, 2)], [(0, 1), (1, 2), (2, 0), (3, 4)],  # not connected, with a cycle elsewhere or at the root
        [(1, 2)],  # no vertex 0
    ],
)
def test_malformed_edges_are_refused(spark, edges):
    good = [(7, 0, 1), (7, 1, 2)]
    with pytest.raises(NoTree):
        rooted_measures(spark.createDataFrame(good + [(8, u, v) for u, v in edges], SCHEMA))


def copied_orders(spark, path, copies=20):
    """lineitem at ``path`` with copies of some orders; their parent arrays by order."""
    rng, rows, trees = random.Random(5), [], {}
    kinds = [[rng.randrange(100) for _ in range(n)] for n in (1, 2, 3, 7, 8, 12)]
    for t in range(copies * len(kinds)):
        parts = kinds[t % len(kinds)]
        rows += [(t, line, part, 1) for line, part in enumerate(parts)]
        trees[t] = [-1, *(part % v for v, part in enumerate(parts) if v)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"file://{path}/lineitem.parquet")
    return trees


def test_each_parent_array_is_rooted_once(spark, tmp_path, monkeypatch):
    taken = []
    monkeypatch.setattr(rooting, "rooted_measures", lambda edges: taken.append(edges.count()) or rooted_measures(edges))
    trees = copied_orders(spark, tmp_path)
    got = {(r.tree_id, r.v): (r.parent, r.depth, r.eccentricity, r.is_centre) for r in catalog.recursive_measures(spark, f"file://{tmp_path}").collect()}
    assert got == {(t, v): x for t, p in trees.items() if len(p) > 1 for v, x in enumerate(brute(p))}
    assert taken == [1 + 2 + 6 + 7 + 11]


def test_each_parent_array_gets_its_form_once(spark, tmp_path, monkeypatch):
    taken = []
    monkeypatch.setattr(rooting, "relational_forms", lambda edges: taken.append(edges.count()) or relational_forms(edges))
    trees = copied_orders(spark, tmp_path)
    want = {}
    for p in trees.values():
        if len(p) > 1:
            classes, k = want.get(len(p), (set(), 0))
            want[len(p)] = classes | {canonical_form(p)}, k + 1
    got = catalog.relational_classes(spark, f"file://{tmp_path}")
    assert {(r.n, r.classes, r.trees) for r in got.collect()} == {(n, len(c), k) for n, (c, k) in want.items()}
    assert taken == [1 + 2 + 6 + 7 + 11]
