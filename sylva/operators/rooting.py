"""Trees as edge tables in recursive SQL: rooting, depths, eccentricities and centres, without arrays and without Python."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.runtime import materialize

#: A tree of more levels than this is refused: each level is a round of joins.
LEVELS = 1000
_ROWS = "spark.sql.cteRecursionRowLimit"


class NoTree(ValueError):
    """Edges that don't make trees."""


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    old = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROWS, old)


def checked_edges(edges: DataFrame) -> DataFrame:
    """tree_id, u, v in both directions, written, of an undirected edge table (tree_id, u, v). Refuses loops, repeated edges, nulls, and
    graphs that haven't one edge less than vertices."""
    both = materialize(edges.select("tree_id", "u", "v").unionByName(edges.select("tree_id", F.col("v").alias("u"), F.col("u").alias("v"))), "arcs")
    if both.filter("tree_id is null or u is null or v is null or u = v").limit(1).count():
        raise NoTree("an edge has no end, or ends where it begins")
    if both.groupBy("tree_id", "u", "v").count().filter("count > 1").limit(1).count():
        raise NoTree("an edge is there twice")
    sizes = both.groupBy("tree_id", "u").agg(F.count("*").alias("k")).groupBy("tree_id").agg(F.count("*").alias("n"), F.sum("k").alias("m2"))
    if sizes.filter("m2 <> 2 * (n - 1)").limit(1).count():
        raise NoTree("a graph hasn't one edge less than vertices")
    return both


def depths(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """tree_id, v, parent (null at the root), depth of each vertex, written, with the root of each tree from ``roots`` (tree_id, v).

    ``arcs`` has passed ``checked_edges``. What isn't connected is refused: with one edge less than vertices it has a cycle
    as well, which a walk away from the root goes around until it is longer than the tree.
    """
    spark = arcs.sparkSession
    sizes = arcs.groupBy("tree_id").agg(F.countDistinct("u").alias("n"))
    with _any_number_of_rows(spark):
        walked = spark.sql(
            f"""WITH RECURSIVE walk(tree_id, v, parent, depth, n) MAX RECURSION LEVEL {LEVELS} AS (
                  SELECT r.tree_id, r.v, CAST(NULL AS BIGINT), 0, s.n FROM {{roots}} r JOIN {{sizes}} s ON s.tree_id = r.tree_id
                  UNION ALL
                  SELECT w.tree_id, a.v, w.v, w.depth + 1, w.n FROM walk w JOIN {{arcs}} a ON a.tree_id = w.tree_id AND a.u = w.v
                  WHERE (w.parent IS NULL OR a.v <> w.parent) AND w.depth < w.n)
                SELECT tree_id, v, parent, depth, n FROM walk""",
            roots=roots.select("tree_id", F.col("v").cast("long").alias("v")), sizes=sizes, arcs=arcs.select("tree_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")),
        )
        walked = materialize(walked, "walk")
    met = walked.groupBy("tree_id").agg(F.count("*").alias("rows"), F.countDistinct("v").alias("vertices"), F.max("n").alias("n"))
    if met.filter("rows <> n or vertices <> n").limit(1).count():
        raise NoTree("a graph isn't connected")
    return walked.drop("n")


def rooted_measures(edges: DataFrame, root: int = 0) -> DataFrame:
    """tree_id, v, parent, depth, eccentricity, is_centre of each vertex of the trees of an edge table, rooted at vertex ``root``.

    The vertex farthest from any vertex is an end of a longest path; distances from that path's two ends give every
    eccentricity, and the vertices of the least one are the centre. Trees of one vertex have no edges and aren't there.
    """
    arcs = checked_edges(edges)
    roots = arcs.groupBy("tree_id").agg(F.lit(root).alias("v"), F.max((F.col("u") == root).cast("int")).alias("there"))
    if roots.filter("there = 0").limit(1).count():
        raise NoTree(f"a tree has no vertex {root}")
    own = depths(arcs, roots)
    farthest = lambda d: d.groupBy("tree_id").agg(F.max_by("v", F.struct("depth", -F.col("v"))).alias("v"))
    one = depths(arcs, farthest(own))
    two = depths(arcs, farthest(one))
    reach = one.select("tree_id", "v", F.col("depth").alias("a")).join(two.select("tree_id", "v", F.col("depth").alias("b")), ["tree_id", "v"]).select("tree_id", "v", F.greatest("a", "b").alias("eccentricity"))
    least = reach.groupBy("tree_id").agg(F.min("eccentricity").alias("radius"))
    out = own.join(reach, ["tree_id", "v"]).join(least, "tree_id")
    return out.select("tree_id", "v", "parent", "depth", "eccentricity", (F.col("eccentricity") == F.col("radius")).alias("is_centre"))


def relational_forms(edges: DataFrame) -> DataFrame:
    """tree_id, n, form: the canonical form of the trees of an edge table, equal for isomorphic trees and for no others, as
    ``sylva.functions.trees.canonical_form`` has it, by joins and aggregates alone.

    Trees are rooted at their centres; from the deepest level up, a vertex is its children's forms, sorted, in brackets. Of two
    centres the larger form counts. Rounds are as many as a radius; each is written.
    """
    measures = materialize(rooted_measures(edges).select("tree_id", "v", "is_centre"), "centres")
    centres = measures.filter("is_centre").select(F.struct("tree_id", "v").alias("rooted"), "tree_id", "v")
    arcs = checked_edges(edges).join(centres.select("rooted", "tree_id"), "tree_id").select(F.col("rooted").alias("tree_id"), "u", "v")
    walked = depths(materialize(arcs, "centre-arcs"), centres.select(F.col("rooted").alias("tree_id"), "v"))
    kids = None
    for depth in range(walked.agg(F.max("depth")).first()[0] or 0, -1, -1):
        own = walked.filter(F.col("depth") == depth)
        own = own.withColumn("kids", F.lit("")) if kids is None else own.join(kids, ["tree_id", "v"], "left")
        forms = own.select("tree_id", "parent", F.concat(F.lit("("), F.coalesce("kids", F.lit("")), F.lit(")")).alias("form"))
        if depth:
            kids = materialize(forms.groupBy("tree_id", F.col("parent").alias("v")).agg(F.array_join(F.sort_array(F.collect_list("form")), "").alias("kids")), "forms")
    sizes = measures.groupBy("tree_id").agg(F.count("*").alias("n"))
    return forms.groupBy("tree_id.tree_id").agg(F.max("form").alias("form")).join(sizes, "tree_id").select("tree_id", "n", "form")
