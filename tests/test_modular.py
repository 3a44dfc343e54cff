"""Polynomials modulo primes against big integers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.functions import columns as C
from sylva.functions import modular
from sylva.functions.trees import digest, packed_polynomial, unpack
from sylva.operators.polynomials import tree_polynomials, wide_polynomials
from sylva.sources.tables import stacked_forest


def tree(rng, n):
    return [-1] + [rng.randrange(i) for i in range(1, n)]


def by_integers(parent, colours):
    v = packed_polynomial(parent, colours)
    return ",".join(map(str, unpack(v, len(parent), colours))), digest(v)


def test_primes_and_roots():
    found = modular.primes(20)
    assert len(set(found)) == 20 and all(p < 1 << 31 and p % (1 << modular.ROOTS) == 1 and pow(3, p - 1, p) == 1 for p in found)
    for p in found[:3]:
        for points in (1, 2, 64, 1 << modular.ROOTS):
            w = modular.root(p, points)
            assert pow(w, points, p) == 1 and (points == 1 or pow(w, points // 2, p) == p - 1)
    with pytest.raises(ValueError):
        modular.primes(10_000)


def test_remainders_give_numbers_back():
    rng = random.Random(1)
    moduli = modular.primes(9)
    numbers = [rng.getrandbits(rng.randrange(1, 270)) for _ in range(50)] + [0, 1]
    digits = modular.mixed_digits([np.array([x % p for x in numbers], np.uint64) for p in moduli], moduli)
    for base in (10**9, 1 << 32):
        got = modular.limbs(digits, moduli, base, 10)
        assert [sum(int(v) * base**k for k, v in enumerate(row)) for row in got] == numbers


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 27, 33, 40])
def test_against_integers(n):
    rng = random.Random(n)
    for colours in (None, 1, 2, 3, 7):
        if n > 30 and colours is None and n != 40:
            continue
        parents = [tree(rng, n) for _ in range(3 if n < 40 else 1)]
        assert modular.polynomial_texts(parents, colours) == [by_integers(p, colours or n) for p in parents]


def test_mixed_sizes_and_slices(monkeypatch):
    monkeypatch.setattr(modular, "HELD", 3000)
    rng = random.Random(2)
    parents = [tree(rng, rng.randrange(1, 20)) for _ in range(60)]
    assert modular.polynomial_texts(parents, 4) == [by_integers(p, 4) for p in parents]
    coeffs, digests = modular.polynomial_decimals(parents, 4)
    for p, c, d in zip(parents, coeffs.to_pylist(), digests.to_pylist(), strict=True):
        assert (",".join(map(str, c)), d) == by_integers(p, 4)


def test_bound_of_decimals():
    assert modular.polynomial_decimals([], 3)[0].to_pylist() == []
    star = [-1] + [0] * 25
    assert ",".join(map(str, modular.polynomial_decimals([star])[0].to_pylist()[0])) == by_integers(star, 26)[0]
    with pytest.raises(OverflowError):
        modular.polynomial_decimals([[-1, *range(39)]])
    # the sum is beyond 38 digits, no coefficient is
    path = [-1, *range(26)]
    assert ",".join(map(str, modular.polynomial_decimals([path])[0].to_pylist()[0])) == by_integers(path, 27)[0]


def test_operators(spark):
    rng = random.Random(3)
    rows = [(i, tree(rng, n)) for i, n in enumerate([1, 4, 27, 30, 30, 36])]
    trees = spark.createDataFrame(rows, "tree_id int, parent array<int>")
    got = {r.tree_id: (r.polynomial, bytes(r.digest)) for r in wide_polynomials(trees).collect()}
    assert got == {i: by_integers(p, len(p)) for i, p in rows}
    small = {r.tree_id: r.c for r in tree_polynomials(trees, 5).select("tree_id", C.polynomial_text(F.col("coeffs")).alias("c")).collect()}
    assert small == {i: by_integers(p, 5)[0] for i, p in rows}
    with pytest.raises(Exception, match="38 digits"):
        tree_polynomials(spark.createDataFrame([(0, [-1, *range(39)])], trees.schema)).collect()


def test_values_modulo_primes(spark):
    rng = random.Random(4)
    numbers = [0, 1, 999999999, 10**9, 10**18 - 1, *(rng.getrandbits(rng.randrange(1, 400)) for _ in range(40))]
    rows = spark.createDataFrame([(str(x), ",".join(str(y) for y in numbers[i : i + 4])) for i, x in enumerate(numbers)], "x string, poly string")
    p, at = 2147483629, 98765
    got = rows.select(C.decimal_mod(F.col("x"), p).alias("m"), C.evaluate_mod(F.col("poly"), at, p).alias("v")).collect()
    assert [r.m for r in got] == [x % p for x in numbers]
    assert [r.v for r in got] == [sum(y * at**k for k, y in enumerate(numbers[i : i + 4])) % p for i in range(len(numbers))]


def test_stacked_forest(spark):
    for r in stacked_forest(spark, "/root/testdata/sf0.001").collect():
        assert r.n == len(r.parent) and r.parent[0] == -1 and all(0 <= p < i for i, p in enumerate(r.parent) if i)


@pytest.mark.parametrize("held", [modular.HELD, 500])
def test_values_without_coefficients(spark, monkeypatch, held):
    monkeypatch.setattr(modular, "HELD", held)
    rng, points = random.Random(6), ((3, 2147483647), (1234567, 2147483629), (1, 97))
    parents = [tree(rng, n) for n in (1, 40, 2, 7, 1, 90, 40, 3, 15)]
    got = modular.polynomial_values(pa.array([None, *parents], pa.list_(pa.int32()))[1:], 8, points)
    coeffs = [unpack(packed_polynomial(p, 8), len(p), 8) for p in parents]
    assert got.tolist() == [[sum(c * pow(x, i, q) for i, c in enumerate(cs)) % q for x, q in points] for cs in coeffs]
    assert modular.polynomial_values(pa.array([], pa.list_(pa.int32())), 8, points).shape == (0, 3)


def test_stacked_query_makes_no_coefficients(spark, monkeypatch):
    """The coefficients of a stacked tree took a hundred times what its values take."""
    from sylva import catalog

    monkeypatch.setattr(catalog.P, "wide_polynomials", None)
    d = "/root/testdata/sf0.001"
    got = {r.tree_id: r for r in catalog.stacked_polynomials(spark, d).collect()}
    for t in stacked_forest(spark, d).limit(20).collect():
        c = unpack(packed_polynomial(t.parent, catalog.STACK_COLOURS), t.n, catalog.STACK_COLOURS)
        want = [sum(x * pow(at, i, p) for i, x in enumerate(c)) % p for at, p in catalog.POINTS]
        assert list(got[t.tree_id]) == [t.tree_id, t.n, *want]
