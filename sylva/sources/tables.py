"""Trees from tables and files: orders, edge lists, data sets of graph6 and polynomial texts, cached bucket counts."""

from __future__ import annotations

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.functions.trees import graph6_parent, rooted
from sylva.runtime import ship_package, table


def order_forest_edges(lineitem: DataFrame) -> DataFrame:
    """tree_id, v, parent: an order is a tree of its lines. Line v > 0 (in order of number, part, supplier) hangs on line
    part number modulo v."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    v = lineitem.select(F.col("l_orderkey").alias("tree_id"), (F.row_number().over(w) - 1).alias("v"), "l_partkey")
    return v.select("tree_id", "v", F.when(F.col("v") == 0, -1).otherwise(F.expr("l_partkey % greatest(v, 1)")).cast("int").alias("parent"))


def order_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, n, parent (array) of each order: one shuffle, by the order."""
    edges = order_forest_edges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = edges.groupBy("tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "parent"))), lambda x: x["parent"]).alias("parent"))
    return rows.select("tree_id", F.size("parent").alias("n"), "parent")


def stacked_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, n, parent of each customer: their order trees, by order key, in one. The first stays as it is; the root of each
    further one hangs on the vertex that has the order's key modulo the vertices before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    trees = order_forest(spark, sf_dir).join(orders, F.col("tree_id") == F.col("o_orderkey"))
    own = trees.groupBy(F.col("o_custkey").alias("tree_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "parent"))).alias("trees"))
    hang = "transform(t.parent, (p, i) -> if(i = 0, if(size(a) = 0, -1, cast(t.o_orderkey % greatest(size(a), 1) as int)), p + size(a)))"
    return own.select("tree_id", F.expr(f"aggregate(trees, cast(array() as array<int>), (a, t) -> concat(a, {hang}))").alias("parent")).select("tree_id", F.size("parent").alias("n"), "parent")


def trees_of_edges(edges: DataFrame) -> DataFrame:
    """tree_id, n, parent from an edge table (tree_id, u, v); vertices are 0 .. number of edges. Fails for what is no tree."""
    ship_package(edges.sparkSession)

    @F.arrow_udf("array<int>")
    def parents(pairs: pa.Array) -> pa.Array:
        return pa.array([rooted(len(p) + 1, [(x["u"], x["v"]) for x in p]) for p in pairs.to_pylist()], pa.list_(pa.int32()))

    return edges.groupBy("tree_id").agg(F.collect_list(F.struct("u", "v")).alias("pairs")).select("tree_id", (F.size("pairs") + 1).alias("n"), parents("pairs").alias("parent"))


def read_tree_pair(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Edges (tree_id 1 and 2, u, v) and the highest colour k from a text: ``n k``, then the edges of either tree."""
    words = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").cast("array<int>").alias("x"))
    n, k = words.select(F.col("x")[0], F.col("x")[1]).first()
    pairs = words.select(F.posexplode(F.expr(f"transform(sequence(0, {2 * (n - 1)} - 1), i -> struct(x[2 + 2 * i] as u, x[3 + 2 * i] as v))")))
    return pairs.select(F.expr(f"if(pos < {n - 1}, 1, 2)").alias("tree_id"), "col.u", "col.v"), k


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """graph6, polynomial from CSV files with a header."""
    return spark.read.schema("graph6 string, polynomial string").option("header", True).option("escape", '"').csv(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """graph6, polynomial, n, m (vertices and edges) and parent of the trees of a data set."""
    ship_package(spark)
    rows = read_dataset(spark, path).withColumn("parent", graph6_parent.asNondeterministic()("graph6"))
    return rows.select("graph6", "polynomial", F.size("parent").alias("n"), (F.size("parent") - 1).alias("m"), "parent")


def write_dataset(df: DataFrame, path: str, order: str = "tree_index", single: bool = True) -> int:
    """Write graph6, polynomial in the order of a column as CSV; one file where ``single``. Returns the rows, checked by count."""
    rows = df.count()
    out = df.orderBy(order)
    (out.coalesce(1) if single else out).select("graph6", "polynomial").write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    written = read_dataset(df.sparkSession, path).count()
    if written != rows:
        raise RuntimeError(f"{written} rows were written instead of {rows}")
    return rows


def cached_bucket_counts(spark: SparkSession, path: str, n: int, mode: str, count) -> DataFrame:
    """bucket, count from the JSON cache at ``path`` if it was made for n and mode and can be read, else from ``count()``,
    which is then cached."""
    schema = "n int, bucket_mode string, counts map<string, bigint>"
    try:
        old = spark.read.schema(schema).option("mode", "FAILFAST").json(path).filter((F.col("n") == n) & (F.col("bucket_mode") == mode)).filter("counts is not null")
        if old.limit(1).count():
            return old.select(F.explode("counts").alias("bucket", "count"))
    except AnalysisException:  # there is none
        pass
    except (PySparkException, Py4JJavaError) as e:  # a broken one is made anew; failures of the cluster are not its own
        if not any(x in str(e) for x in ("MALFORMED_RECORD", "ChecksumException", "CANNOT_PARSE")):
            raise
    fresh = count().select("bucket", F.col("count").cast("long").alias("count"))
    one = fresh.orderBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "count")))).alias("counts"))
    one.select(F.lit(n).alias("n"), F.lit(mode).alias("bucket_mode"), "counts").coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema(schema).json(path).select(F.explode("counts").alias("bucket", "count"))
