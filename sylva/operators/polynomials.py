"""Polynomials of the trees of a table, computed once for each isomorphism class."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.functions.modular import polynomial_decimals, polynomial_texts, polynomial_values
from sylva.functions.trees import tree_form, tree_measures
from sylva.runtime import materialize, ship_package

_COMPUTED = T.StructType([T.StructField("coeffs", T.ArrayType(T.DecimalType(38, 0))), T.StructField("digest", T.BinaryType())])


def with_form(trees: DataFrame) -> DataFrame:
    """Adds ``form``, the canonical form. Each different parent array goes through Python once, however many trees have it.

    ``trees`` is read twice and should be a table, not a long plan.
    """
    ship_package(trees.sparkSession)
    shapes = trees.groupBy("parent").agg(F.lit(1).alias("one")).select(F.col("parent").alias("shape"), tree_form("parent").alias("form"))
    return trees.join(shapes, F.col("parent") == F.col("shape")).drop("shape")


def tree_polynomials(trees: DataFrame, colours: int | None = None) -> DataFrame:
    """Adds coeffs and digest to each row of ``trees`` (parent); for tables with a row for each class of trees.

    ``colours`` defaults to the number of vertices. mapInArrow is opaque to the optimizer: no later filter makes the
    polynomials be computed twice. A coefficient beyond 38 digits is an error, never a rounded value: with as many colours as
    vertices there are none up to 26 vertices; ``wide_polynomials`` takes trees of any size.
    """
    ship_package(trees.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *polynomial_decimals(batch.column("parent").to_pylist(), colours)], [*batch.schema.names, "coeffs", "digest"])

    return trees.mapInArrow(compute, T.StructType([*trees.schema.fields, *_COMPUTED.fields]))


def wide_polynomials(trees: DataFrame, colours: int | None = None) -> DataFrame:
    """Adds polynomial (comma-joined coefficients, low degree first) and digest to each row of ``trees`` (parent), whatever the
    number of vertices and of digits; see ``sylva.functions.modular``."""
    ship_package(trees.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50):  # texts are long
                some = batch.slice(i, 50)
                texts = polynomial_texts(some.column("parent").to_pylist(), colours)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([t for t, _ in texts], pa.string()), pa.array([d for _, d in texts], pa.binary())], [*batch.schema.names, "polynomial", "digest"])

    return trees.mapInArrow(compute, T.StructType([*trees.schema.fields, T.StructField("polynomial", T.StringType()), T.StructField("digest", T.BinaryType())]))


def tree_values(trees: DataFrame, points: tuple[tuple[int, int], ...], colours: int) -> DataFrame:
    """The columns of ``trees`` without parent, and value_0, value_1, ..: the values of the exact polynomials at points (x, p) modulo
    p (below 2^31), whatever the number of vertices, without their coefficients."""
    ship_package(trees.sparkSession)
    fields = [f for f in trees.schema.fields if f.name != "parent"]
    names = [f"value_{k}" for k in range(len(points))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = polynomial_values(batch.column("parent"), colours, points)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *(pa.array(x) for x in values.T)], [*(f.name for f in fields), *names])

    return trees.mapInArrow(compute, T.StructType([*fields, *(T.StructField(x, T.LongType()) for x in names)]))


def class_polynomials(classes: DataFrame, colours: int | None = None) -> DataFrame:
    """form, coeffs, digest of each row of ``classes`` (form, parent)."""
    return tree_polynomials(classes.select("form", "parent"), colours).drop("parent")


def with_polynomial(trees: DataFrame, colours: int | None = None) -> DataFrame:
    """Adds form, coeffs and digest. Classes are few next to trees: they are found by partial aggregation, spread again for
    the costly step, and joined back; the join is broadcast only if the classes turn out small at run time."""
    named = materialize(with_form(trees), "forms")  # read twice
    classes = named.groupBy("form").agg(F.min("parent").alias("parent"))
    known = class_polynomials(classes.repartition("form"), colours)
    return named.join(known, "form")


def with_measures(trees: DataFrame) -> DataFrame:
    """Adds min_color_sum, diameter and radius, once for each different parent array. ``trees`` is read twice."""
    ship_package(trees.sparkSession)
    shapes = trees.groupBy("parent").agg(F.lit(1).alias("one")).select(F.col("parent").alias("shape"), tree_measures.asNondeterministic()("parent").alias("m"))
    return trees.join(shapes, F.col("parent") == F.col("shape")).select(*trees.columns, "m.*")


def relational_polynomials(trees: DataFrame, max_vertices: int, colours: int | None = None) -> DataFrame:
    """tree_id, degree, coefficient by joins and aggregates alone: the independent check of ``with_polynomial``.

    State is a long table (tree_id, v, colour, degree, coefficient). Vertices are folded into their parents from the last
    to the first; a parent's colour takes the child's total less the child's part of that colour.
    """
    k = F.lit(colours) if colours else F.col("n")
    edges = trees.select("tree_id", F.posexplode("parent").alias("v", "up"))
    state = trees.select("tree_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("v"), F.explode(F.array(k)).alias("k")).select("tree_id", "v", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("colour"))
    state = state.select("tree_id", "v", "colour", F.col("colour").alias("degree"), F.lit(1).cast("decimal(38,0)").alias("coefficient"))
    for v in range(max_vertices - 1, 0, -1):
        up = edges.filter(F.col("v") == v).select("tree_id", "up")
        own = state.filter(F.col("v") == v)
        colour_set = own.groupBy("tree_id").agg((F.max("colour") + 1).alias("k"))
        total = own.groupBy("tree_id", "degree").agg(F.sum("coefficient").cast("decimal(38,0)").alias("total"))
        wide = total.join(colour_set, "tree_id").select("tree_id", "degree", "total", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("colour"))
        toll = wide.join(own.select("tree_id", "colour", "degree", "coefficient"), ["tree_id", "colour", "degree"], "left").select("tree_id", "colour", "degree", (F.col("total") - F.coalesce("coefficient", F.lit(0))).cast("decimal(38,0)").alias("toll")).filter("toll <> 0")
        toll = toll.join(up, "tree_id").select("tree_id", F.col("up").alias("v"), "colour", F.col("degree").alias("d2"), "toll")
        changed = state.join(toll, ["tree_id", "v", "colour"]).groupBy("tree_id", "v", "colour", (F.col("degree") + F.col("d2")).alias("degree")).agg(F.sum((F.col("coefficient") * F.col("toll")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("coefficient"))
        # without a cut each step would hold all plans before it several times
        rest = state.filter(F.col("v") < v).join(up.select("tree_id", F.col("up").alias("v")), ["tree_id", "v"], "left_anti")
        state = materialize(rest.unionByName(changed.select("tree_id", "v", "colour", "degree", "coefficient")), "fold")
    return state.groupBy("tree_id", "degree").agg(F.sum("coefficient").cast("decimal(38,0)").alias("coefficient"))
