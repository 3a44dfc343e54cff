"""Buckets, candidates and collisions: pairs of different trees with the same polynomial."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from sylva.functions.columns import bucket_key, degree_sequence, leaf_count, value_mod
from sylva.functions.modular import primes
from sylva.operators.polynomials import with_measures, with_polynomial
from sylva.runtime import ship_package


def with_bucket(trees: DataFrame, mode: str) -> DataFrame:
    """Adds leaves, min_color_sum, diameter, radius and bucket."""
    return with_measures(trees).withColumn("leaves", leaf_count(F.col("parent"))).withColumn("bucket", bucket_key(F.col("leaves"), F.col("min_color_sum"), mode))


def bucket_counts(trees: DataFrame, by: tuple[str, ...] = ("n", "bucket")) -> DataFrame:
    return trees.groupBy(*by).agg(F.count("*").alias("count"))


def bucket_summary(counts: DataFrame, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """Trees, buckets, buckets of one tree, and of more."""
    return counts.groupBy(*by).agg(F.sum("count").alias("trees"), F.count("*").alias("buckets"), F.count_if(F.col("count") == 1).alias("singletons"), F.count_if(F.col("count") >= 2).alias("multiple"))


def keep_multiple(trees: DataFrame, by: tuple[str, ...] = ("n", "bucket")) -> DataFrame:
    """Trees in buckets of at least two: a tree alone in its bucket can't collide, so its polynomial isn't needed.

    Counts are partially aggregated before the shuffle; the semi-join splits large buckets at run time.
    """
    return trees.join(bucket_counts(trees, by).filter("count >= 2").select(*by), list(by), "left_semi")


def keep_first(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The first row of each key by ``order``, by partial aggregation: a key with most of the rows is no burden."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(order, *rest), order).alias("first"))
    return first.select(*key, "first.*")


def collisions(trees: DataFrame, index: str = "tree_index", by: tuple[str, ...] = ("n", "bucket"), all_pairs: bool = False) -> DataFrame:
    """Pairs (a, b) of trees that aren't isomorphic but have equal polynomials in the same bucket.

    ``trees`` has n, bucket, digest, coeffs, form and ``index``. Trees of one isomorphism class count as one, its smallest
    index. Of each group of equal polynomials the smallest index is paired with each other (or all pairs are given). The
    digest only brings candidates together: the coefficients decide.
    """
    keys = [*by, "digest", "coeffs"]
    # coefficients travel only for digests of more than one form
    shared = trees.groupBy(*by, "digest").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low <> high")
    trees = trees.join(shared.select(*by, "digest"), [*by, "digest"], "left_semi")
    classes = trees.groupBy(*keys, "form").agg(F.min(index).alias("i"))
    if all_pairs:
        a, b = (classes.select(*keys, F.col("i").alias(x)) for x in ("tree_index_a", "tree_index_b"))
        return a.join(b, keys).filter("tree_index_a < tree_index_b").select(*by, "tree_index_a", "tree_index_b", "coeffs")
    groups = classes.groupBy(*keys).agg(F.min("i").alias("tree_index_a"), F.count("*").alias("size")).filter("size > 1")
    return classes.join(groups, keys).filter("i <> tree_index_a").select(*by, "tree_index_a", F.col("i").alias("tree_index_b"), "coeffs")


def collisions_by_values(trees: DataFrame, index: str = "tree_index", by: tuple[str, ...] = ("n", "bucket"), points: int = 4, seed: int = 0) -> DataFrame:
    """The pairs of ``collisions`` without digests: polynomials meet by their values at random points modulo primes below 2^31.

    Different polynomials of degree d have the same ``points`` values with a probability of (d / 2^30)^points at most (Schwartz
    and Zippel), which costs work alone: coefficients decide. ``trees`` has n, bucket, coeffs, form and ``index``.
    """
    rng = random.Random(seed)
    at = [(rng.randrange(2, p), p) for p in primes(points)]
    fingerprint = F.array(*[value_mod(F.col("coeffs"), x, p) for x, p in at])
    return collisions(trees.drop("digest").withColumn("digest", fingerprint), index, by)


class _PairRows:
    """Of the rows of one (n, digest), in the order of their index: each class's first tree with the first of its polynomial."""

    @staticmethod
    def analyze(trees: AnalyzeArgument) -> AnalyzeResult:
        missing = {"n", "digest", "coeffs", "form", "tree_index"} - {f.name for f in trees.dataType.fields}
        if missing:
            raise ValueError(f"the table has no {', '.join(sorted(missing))}")
        return AnalyzeResult(StructType().add("n", "long").add("tree_index_a", "long").add("tree_index_b", "long"), partitionBy=[PartitioningColumn("n"), PartitioningColumn("digest")], orderBy=[OrderingColumn("tree_index")])

    def __init__(self):
        self.first, self.met = {}, set()

    def eval(self, row):
        key = tuple(row["coeffs"])
        if (key, row["form"]) in self.met:
            return
        self.met.add((key, row["form"]))
        first = self.first.setdefault(key, row["tree_index"])
        if first != row["tree_index"]:
            yield int(row["n"]), first, row["tree_index"]


def register_pairs(spark: SparkSession) -> None:
    """The SQL table function ``tree_pairs(TABLE(t))`` over any table with n, digest, coeffs, form, tree_index: it asks for the
    rows of each digest together and in order, and holds the classes of one digest."""
    ship_package(spark)
    spark.udtf.register("tree_pairs", F.udtf(_PairRows))


def collision_reports(pairs: DataFrame, trees: DataFrame, index: str = "tree_index") -> DataFrame:
    """One structured report for each pair, with both trees' attributes; ``trees`` has graph6, parent, leaves, min_color_sum."""
    def side(x: str) -> DataFrame:
        return trees.select(F.col(index).alias(f"tree_index_{x}"), F.col("graph6").alias(f"graph6_{x}"), degree_sequence(F.col("parent")).alias(f"degree_sequence_{x}"), F.col("leaves").alias(f"leaf_count_{x}"), F.col("min_color_sum").alias(f"min_color_sum_{x}"))

    return pairs.join(side("a"), "tree_index_a").join(side("b"), "tree_index_b").select(
        "n", "bucket", *[f"{c}_{x}" for c in ("tree_index", "graph6", "degree_sequence", "leaf_count", "min_color_sum") for x in "ab"], F.col("coeffs").alias("coefficients"),
    )


def first_collision(pairs: DataFrame) -> DataFrame:
    """The pair that a scan in index order meets first."""
    return pairs.orderBy("tree_index_b", "tree_index_a").limit(1)


def scan_forest(trees: DataFrame, mode: str = "leaves+minsum", colours: int | None = None, two_pass: bool = True) -> DataFrame:
    """Bucketed trees with polynomials; with two passes only of buckets with more than one tree."""
    bucketed = with_bucket(trees, mode)
    return with_polynomial(keep_multiple(bucketed) if two_pass and mode != "none" else bucketed, colours)


def compare_pairs(pairs: DataFrame, polynomials: DataFrame) -> DataFrame:
    """Whether both trees of each pair (a, b: tree ids) have the same polynomial, by degree: a full comparison of terms."""
    one = polynomials.select(F.col("tree_id").alias("a"), F.col("coeffs").alias("x"))
    two = polynomials.select(F.col("tree_id").alias("b"), F.col("coeffs").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    same = F.forall(F.zip_with("x", "y", lambda x, y: F.coalesce(x, F.lit(0)) == F.coalesce(y, F.lit(0))), lambda t: t)
    return both.select("a", "b", same.alias("equal"), F.when(same, "The special functions are equal.").otherwise("The special functions are different.").alias("verdict"))


def neighbours_of_equal_size(trees: DataFrame, slots: int = 1024) -> DataFrame:
    """Pairs (a, b) of trees of the same size whose ids follow each other among those of one slot of ids."""
    w = Window.partitionBy("n", F.expr(f"tree_id div {slots}")).orderBy("tree_id")
    return trees.select(F.col("tree_id").alias("a"), F.lead("tree_id").over(w).alias("b")).filter("b is not null")
