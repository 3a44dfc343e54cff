"""A search over all trees of n vertices, in ranges and shards; merging shards; building a data set; the command line."""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sylva.functions.columns import coefficient_sum, min_exponent, polynomial_text
from sylva.functions.trees import graph6_parent
from sylva.operators.polynomials import tree_polynomials
from sylva.operators.search import collision_reports, keep_multiple, with_bucket
from sylva.operators.store import SearchStore, merge_stores, new_firsts, pairs_with_firsts
from sylva.runtime import discard, materialize, ship_package
from sylva.sources.enumeration import enumerate_trees
from sylva.sources.tables import write_dataset


def check_polynomials(rows: DataFrame, colours: int | None = None) -> DataFrame:
    """Rows (n, parent, coeffs, min_color_sum) that break an invariant: the sum of coefficients is k(k-1)^(n-1), the lowest
    exponent is the least colour sum (with at least n colours), and coefficients are a palindrome."""
    k = F.lit(colours) if colours else F.col("n")
    total = F.aggregate(F.sequence(F.lit(1), F.col("n")), k.cast("decimal(38,0)"), lambda a, i: F.when(i < F.col("n"), (a * (k - 1)).cast("decimal(38,0)")).otherwise(a))
    bad = coefficient_sum(F.col("coeffs")) != total
    if not colours:
        bad = bad | (min_exponent(F.col("coeffs")) != F.col("min_color_sum"))
    low = F.col("coeffs")
    span = F.col("n") * (k - 1) + 1
    padded = F.concat(low, F.array_repeat(F.lit(0).cast("decimal(38,0)"), (span - F.size(low)).cast("int")))
    return rows.filter(bad | (padded != F.reverse(padded)))


def candidates(spark: SparkSession, n: int, mode: str = "leaves+minsum", two_pass: bool = True, max_trees: int | None = None) -> DataFrame:
    """Pass 1, written once for all ranges and shards: the trees of n vertices with their buckets; with two passes only those
    whose bucket has others, over all shards, so that shards keep the same trees as one run."""
    bucketed = materialize(with_bucket(enumerate_trees(spark, n, max_trees), mode), "bucketed")
    if not two_pass or mode == "none":
        return bucketed
    kept = materialize(keep_multiple(bucketed), "candidates")
    discard(bucketed)
    return kept


def search(
    spark: SparkSession, n: int, path: str, mode: str = "leaves+minsum", colours: int | None = None, shards: int = 1, shard_index: int = 0, two_pass: bool = True, range_size: int = 1 << 20,
    max_trees: int | None = None, stop_on_collision: bool = True, validate_every: int = 10_000, trees: DataFrame | None = None, progress: Callable[[dict], None] | None = None,
) -> DataFrame:
    """Collisions among all trees of n vertices, stored under ``path``; goes on after what is stored there.

    Only the trees of a range and shard get polynomials; a range meets the first tree of each stored key, not all trees seen.
    ``trees`` are the ``candidates``, where they are made already. With ``stop_on_collision`` no further range is begun after
    one that has a collision. ``progress`` is called after each range with what Spark observed while it was written: upto,
    generated (indices of the range), processed (trees that got a polynomial), skipped (alone in their bucket, or another
    shard's), collisions, seconds and trees_per_sec.
    """
    if n < 2 or not 0 <= shard_index < shards:
        raise ValueError("n is at least 2 and the shard index below the number of shards")
    store = SearchStore(spark, path, n=n, bucket_mode=mode, colours=colours or n, shards=shards, shard_index=shard_index, two_pass=two_pass)
    if trees is None:
        trees = candidates(spark, n, mode, two_pass, max_trees)
    last = trees.agg(F.max("tree_index")).first()[0]
    last = -1 if last is None else last
    tasks = 4 * spark.sparkContext.defaultParallelism
    while (done := store.checkpoint()) < last:
        upto = min(done + range_size, last)
        part = trees.filter((F.col("tree_index") > done) & (F.col("tree_index") <= upto) & (F.col("tree_index") % shards == shard_index))
        began, watched, paired = time.time(), Observation(), Observation()
        # each enumerated tree is a class of its own, so that its label names it
        part = tree_polynomials(part.withColumn("form", F.col("graph6")).repartition(tasks), colours)
        part = materialize(part.observe(watched, F.count(F.lit(1)).alias("processed")), "search-range")
        if validate_every and check_polynomials(part.filter(F.col("tree_index") % validate_every == 0), colours).limit(1).count():
            raise RuntimeError("a polynomial breaks an invariant")
        seen = part.select("bucket", "digest", "graph6", "tree_index", "form", "coeffs")
        known = store.firsts()
        firsts = materialize(new_firsts(seen, known), "search-firsts")
        # the stored first trees stay in their buckets: a union would have them shuffled
        pairs = pairs_with_firsts(seen, known).unionByName(pairs_with_firsts(seen, firsts))
        store.commit(seen, firsts, pairs.observe(paired, F.count(F.lit(1)).alias("collisions")), upto)
        discard(part, firsts)
        if progress:
            took, processed = time.time() - began, watched.get["processed"]
            progress({"upto": upto, "generated": upto - done, "processed": processed, "skipped": upto - done - processed, "collisions": paired.get["collisions"], "seconds": took, "trees_per_sec": processed / took})
        if stop_on_collision and store.found().limit(1).count():
            break
    return store.found()


def search_sharded(spark: SparkSession, n: int, path: str, shards: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """Each shard's search, then all of them merged: trees seen, collisions. Trees are enumerated and bucketed once."""
    options.setdefault("stop_on_collision", False)
    mode, colours, two_pass = options.get("mode", "leaves+minsum"), options.get("colours"), options.get("two_pass", True)
    trees = candidates(spark, n, mode, two_pass, options.get("max_trees"))
    stores = []
    for k in range(shards):
        where = f"{path}/n={n}/mode={mode}/shards={shards}/shard={k}"
        search(spark, n, where, shards=shards, shard_index=k, trees=trees, **options)
        stores.append(SearchStore(spark, where, n=n, bucket_mode=mode, colours=colours or n, shards=shards, shard_index=k, two_pass=two_pass))
    return merge_stores(stores)


def write_reports(pairs: DataFrame, n: int, path: str, colours: int | None = None) -> int:
    """Write a JSON report for each collision of trees of n vertices, one a line; returns the number of reports."""
    ship_package(pairs.sparkSession)
    pairs = pairs.select(F.lit(n).alias("n"), "bucket", "tree_index_a", "tree_index_b", "graph6_a", "graph6_b")
    both = pairs.select(F.col("tree_index_a").alias("tree_index"), F.col("graph6_a").alias("graph6")).unionByName(pairs.select(F.col("tree_index_b").alias("tree_index"), F.col("graph6_b").alias("graph6"))).distinct()
    trees = materialize(tree_polynomials(with_bucket(both.withColumn("parent", graph6_parent.asNondeterministic()("graph6")).withColumn("n", F.lit(n)), "none"), colours), "reported")
    coeffs = trees.select(F.col("tree_index").alias("tree_index_a"), "coeffs")
    reports = collision_reports(pairs.drop("graph6_a", "graph6_b").join(coeffs, "tree_index_a"), trees)
    reports = materialize(reports, "reports")
    reports.orderBy("tree_index_b").write.mode("errorifexists").json(path)
    return reports.count()


def report_name(n: int) -> str:
    return f"sylva-pairs-n{n}-{int(time.time())}.json"


def build_dataset(spark: SparkSession, n: int, path: str) -> int:
    """Write graph6 and polynomial of all trees of n vertices as CSV in enumeration order; returns the rows."""
    rows = tree_polynomials(enumerate_trees(spark, n)).select("tree_index", "graph6", polynomial_text(F.col("coeffs")).alias("polynomial"))
    return write_dataset(rows, path)


def self_test(spark: SparkSession, largest: int = 7) -> int:
    """Both computations of all trees up to a size against each other and the invariants; returns the trees."""
    from sylva.operators.polynomials import relational_polynomials

    count = 0
    for n in range(2, largest + 1):
        rows = materialize(tree_polynomials(with_bucket(enumerate_trees(spark, n), "none")), "self-test")
        if check_polynomials(rows).limit(1).count():
            raise RuntimeError(f"n={n}: a polynomial breaks an invariant")
        long = rows.select(F.col("tree_index").alias("tree_id"), F.posexplode("coeffs").alias("degree", "coefficient")).filter("coefficient <> 0")
        other = relational_polynomials(rows.select(F.col("tree_index").alias("tree_id"), "n", "parent"), n).select(*long.columns)
        if long.exceptAll(other).limit(1).count() or other.exceptAll(long).limit(1).count():
            raise RuntimeError(f"n={n}: the two computations differ")
        count += rows.count()
    return count


def main(argv: list[str] | None = None) -> None:
    # names and defaults of commands and options are fixed values
    parser = argparse.ArgumentParser(prog="sylva", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="search one shard")
    scan.add_argument("n", type=int)
    scan.add_argument("--db", default="search-store", help="folder of the stored state")
    scan.add_argument("--resume", action="store_true", help="go on after what is stored; else the folder must be new")
    scan.add_argument("--bucket-mode", default="leaves+minsum")
    scan.add_argument("--shards", type=int, default=1)
    scan.add_argument("--shard-index", type=int, default=0)
    scan.add_argument("--max-trees", type=int)
    scan.add_argument("--validate-every", type=int, default=10_000)
    scan.add_argument("--range-size", type=int, default=1 << 20)
    scan.add_argument("--no-two-pass", action="store_true")
    scan.add_argument("--collision-report", help="where to write reports of collisions")
    scan.add_argument("--stop-on-collision", action=argparse.BooleanOptionalAction, default=True)
    scan.add_argument("--progress", action="store_true", help="a line for each range that is done")
    merge = sub.add_parser("merge", help="put the stored states of shards together")
    merge.add_argument("output")
    merge.add_argument("databases", nargs="+")
    merge.add_argument("--collision-report")
    sharded = sub.add_parser("sharded", help="search all shards and merge them")
    sharded.add_argument("--n", type=int, default=19)
    sharded.add_argument("--db", default="search-store")
    sharded.add_argument("--shards", type=int, default=4)
    sharded.add_argument("--bucket-mode", default="leaves+minsum")
    sharded.add_argument("--collision-report")
    build = sub.add_parser("build", help="write the data set of one size")
    build.add_argument("--n", type=int, required=True)
    build.add_argument("--output", default="public_dataset")
    sub.add_parser("self-test")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sylva").getOrCreate()

    def tell(seen: int, pairs: DataFrame, n: int) -> None:
        pairs.show(truncate=False)
        print(f"{seen} trees, {pairs.count()} collisions")
        if pairs.limit(1).count():
            where = a.collision_report or report_name(n)
            print(f"{write_reports(pairs, n, where)} reports in {where}")

    if a.command == "scan":
        if not a.resume and SearchStore.exists(spark, a.db):
            parser.error(f"{a.db} is there already; give --resume to go on")
        line = lambda x: print("up to {upto}: {processed} of {generated} trees, {skipped} skipped, {collisions} collisions, {trees_per_sec:.2f} trees/s".format(**x))
        pairs = search(spark, a.n, a.db, a.bucket_mode, None, a.shards, a.shard_index, not a.no_two_pass, a.range_size, a.max_trees, a.stop_on_collision, a.validate_every, progress=line if a.progress else None)
        tell(SearchStore(spark, a.db).seen().count(), pairs, a.n)
    elif a.command == "merge":
        stores = [SearchStore(spark, path) for path in a.databases]
        seen, pairs = merge_stores(stores)
        seen.write.mode("errorifexists").parquet(f"{a.output}/seen")
        pairs.write.mode("errorifexists").parquet(f"{a.output}/collisions")
        tell(spark.read.parquet(f"{a.output}/seen").count(), spark.read.parquet(f"{a.output}/collisions"), int(stores[0].settings["n"]))
    elif a.command == "sharded":
        seen, pairs = search_sharded(spark, a.n, a.db, a.shards, mode=a.bucket_mode)
        tell(seen.count(), pairs, a.n)
    elif a.command == "build":
        print(f"{build_dataset(spark, a.n, os.path.join(a.output, f'trees_n{a.n}'))} trees")
    else:
        print(f"{self_test(spark)} trees agree")
