"""Pairs by values modulo primes and by the SQL table function, against the definition."""

import random

import pytest
from pyspark.sql import functions as F

import sylva.operators.search as S

SCHEMA = "n int, bucket string, digest binary, coeffs array<decimal(38,0)>, form string, tree_index long"


def table(spark, seed):
    from decimal import Decimal

    rng = random.Random(seed)
    rows = []
    for i in range(150):
        coeffs = [rng.randrange(2) for _ in range(3)] + [10**30 * rng.randrange(2)]
        # digests of different polynomials may agree here
        rows.append((rng.choice([3, 4]), "all", bytearray([sum(map(bool, coeffs))]), [Decimal(c) for c in coeffs], f"f{rng.randrange(60)}", i))
    # a form has one polynomial
    own = {}
    rows = [(n, b, *own.setdefault((n, f), (d, c)), f, i) for n, b, d, c, f, i in rows]
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    classes = {}
    for n, _, _, c, f, i in rows:
        classes.setdefault((n, tuple(c)), {}).setdefault(f, []).append(i)
    out = []
    for (n, _), forms in classes.items():
        firsts = sorted(min(x) for x in forms.values())
        out += [(n, firsts[0], i) for i in firsts[1:]]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_pairs_by_values(spark, seed, monkeypatch):
    rows, df = table(spark, seed)
    pairs = lambda: sorted(map(tuple, S.collisions_by_values(df).select("n", "tree_index_a", "tree_index_b").collect()))
    assert pairs() == brute(rows) == sorted(map(tuple, S.collisions(df).select("n", "tree_index_a", "tree_index_b").collect()))
    monkeypatch.setattr(S, "value_mod", lambda c, x, p: F.lit(0).cast("long"))  # all polynomials have the same values
    assert pairs() == brute(rows)


def test_pairs_by_table_function(spark):
    rows, df = table(spark, 5)
    S.register_pairs(spark)
    df.repartition(3).createOrReplaceTempView("some_trees")
    assert sorted(map(tuple, spark.sql("SELECT n, tree_index_a, tree_index_b FROM tree_pairs(TABLE(some_trees))").collect())) == brute(rows)
    df.drop("form").createOrReplaceTempView("formless")
    with pytest.raises(Exception, match="form"):
        spark.sql("SELECT * FROM tree_pairs(TABLE(formless))").collect()
