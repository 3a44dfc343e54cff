"""Stored state of a search as Parquet tables: settings, trees seen, collisions; keyed by all settings, resumable."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.functions.columns import same_polynomial
from sylva.operators.search import keep_first

VERSION = "2"
#: Buckets of the table of first trees, unless a store is made with another number.
BUCKETS = 64
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("version", T.LongType())])
SEEN = "bucket string, digest binary, graph6 string, tree_index long, form string, coeffs array<decimal(38,0)>"
FIRSTS = "bucket string, digest binary, coeffs array<decimal(38,0)>, tree_index long, graph6 string, form string"
COLLISIONS = "bucket string, digest binary, graph6_a string, graph6_b string, tree_index_a long, tree_index_b long, created_at timestamp"


class SettingsMismatch(ValueError):
    """A store was made with other settings than those asked for."""


def upsert(old: DataFrame, new: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The latest row of each key; of equal versions the larger value."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (key, version)]
    return both.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("last")).select(key, "last.*")


def leave_out_known(rows: DataFrame, known: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows whose key isn't stored yet."""
    return rows.join(known.select(*key), list(key), "left_anti")


class SearchStore:
    """Tables under one path. Every range of indices is a directory of its own in each table, written whole, and counts once its
    mark is in ``ranges``, which is written last. What has no mark is never read and is overwritten when its range comes again, so
    that a run that stops at any point is taken up after the last marked range.

    The first trees are bucketed by digest: a range meets them bucket by bucket, and what is stored isn't shuffled again.
    Without settings: a store that is there already, with the settings it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, **settings):
        self.spark, self.path = spark, path.rstrip("/")
        settings = {"program_version": VERSION, **{k: str(v) for k, v in settings.items()}}
        have = self._read("meta", META)
        stored = {r.key: r.value for r in have.collect()} if have is not None else {}
        other = {k: (stored[k], v) for k, v in settings.items() if k in stored and stored[k] != v}
        if other:
            raise SettingsMismatch(f"{path} was made with other settings: {other}")
        if not stored:
            if "n" not in settings:
                raise SettingsMismatch(f"{path} is no stored search")
            settings.setdefault("buckets", str(BUCKETS))
            spark.createDataFrame([(k, v, 0) for k, v in settings.items()], META).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        self.settings = stored | settings

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/meta")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, schema) -> DataFrame | None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def marks(self) -> list[int]:
        """The last indices of the ranges that are done: one a range."""
        got = self._read("ranges", "upto long")
        return sorted({r.upto for r in got.collect()}) if got is not None else []

    def _marked(self, name: str, columns: str) -> DataFrame:
        """A table without what unfinished ranges have left of it."""
        got, marks = self._read(name, f"{columns}, upto long"), self.marks()
        if got is None or not marks:
            return self.spark.createDataFrame([], columns)
        return got.filter(F.col("upto").isin(marks)).drop("upto")

    def seen(self) -> DataFrame:
        return self._marked("seen", SEEN)

    def _firsts_table(self) -> str:
        """The name under which this session knows the bucketed table; whatever session made its files."""
        name = "sylva_firsts_" + hashlib.md5(self.path.encode()).hexdigest()
        place = f"{self.path}/firsts".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({FIRSTS}, upto long) USING parquet PARTITIONED BY (upto) CLUSTERED BY (digest) SORTED BY (digest) INTO {int(self.settings['buckets'])} BUCKETS LOCATION '{place}'")
        return name

    def firsts(self) -> DataFrame:
        """The first tree of each key of all ranges that are done; ranges come in the order of their trees."""
        name, marks = self._firsts_table(), self.marks()
        if not marks:
            return self.spark.createDataFrame([], FIRSTS)
        self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (upto={u})" for u in marks))
        return self.spark.table(name).filter(F.col("upto").isin(marks)).drop("upto")

    def found(self) -> DataFrame:
        """Collisions, each pair once however often a range ran."""
        return keep_first(self._marked("collisions", COLLISIONS), ("tree_index_a", "tree_index_b"), "created_at").select(*[c.split()[0] for c in COLLISIONS.split(", ")])

    def checkpoint(self) -> int:
        """The last index of all ranges that are done; -1 at the start."""
        return max(self.marks(), default=-1)

    def commit(self, seen: DataFrame, firsts: DataFrame, pairs: DataFrame, upto: int) -> None:
        """Write a range's rows, and last its mark. ``pairs`` may read the stored first trees: only those of marked ranges
        are, none of which is written here."""
        view = f"sylva_new_{hashlib.md5(self.path.encode()).hexdigest()}"
        firsts.createOrReplaceTempView(view)
        columns = ", ".join(c.split()[0] for c in FIRSTS.split(", "))
        self.spark.sql(f"INSERT OVERWRITE TABLE {self._firsts_table()} PARTITION (upto={upto}) SELECT {columns} FROM {view}")
        self.spark.catalog.dropTempView(view)
        seen.write.mode("overwrite").parquet(f"{self.path}/seen/upto={upto}")
        pairs.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.path}/collisions/upto={upto}")
        self._mark(upto)

    def _mark(self, upto: int) -> None:
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{self.path}/ranges")


def new_firsts(seen: DataFrame, known: DataFrame) -> DataFrame:
    """The first tree of each key of ``seen`` that ``known`` hasn't. Rows meet by digest; coefficients decide."""
    key = ["bucket", "digest", "coeffs"]
    first = seen.groupBy(*key).agg(F.min_by(F.struct("tree_index", "graph6", "form"), "tree_index").alias("f"))
    k = known.select(F.col("digest").alias("k_digest"), F.col("bucket").alias("k_bucket"), F.col("coeffs").alias("k_coeffs"))
    same = (F.col("digest") == F.col("k_digest")) & same_polynomial(F.col("coeffs"), F.col("k_coeffs")) & _same(F.col("bucket"), F.col("k_bucket"))
    return first.join(k, same, "left_anti").select(*key, "f.*")


def pairs_with_firsts(seen: DataFrame, firsts: DataFrame) -> DataFrame:
    """Each tree of ``seen`` with the first one of its key, a tree of another form. Rows meet by digest; coefficients decide."""
    f = firsts.select(F.col("digest").alias("f_digest"), F.col("bucket").alias("f_bucket"), F.col("coeffs").alias("f_coeffs"), F.col("tree_index").alias("tree_index_a"), F.col("graph6").alias("graph6_a"), F.col("form").alias("form_a"))
    same = (F.col("digest") == F.col("f_digest")) & same_polynomial(F.col("coeffs"), F.col("f_coeffs")) & _same(F.col("bucket"), F.col("f_bucket"))
    both = seen.join(f, same).filter("form <> form_a")
    return both.select("bucket", "digest", "graph6_a", F.col("graph6").alias("graph6_b"), "tree_index_a", F.col("tree_index").alias("tree_index_b"))


def _same(a: Column, b: Column) -> Column:
    """Equality that doesn't become a key of a join: stored rows are dealt by digest alone."""
    return (a <= b) & (a >= b)


def merge_stores(stores: list[SearchStore]) -> tuple[DataFrame, DataFrame]:
    """All trees seen and all collisions of shards of one search, those across shards included; settings must agree."""
    agree = {tuple((k, s.settings[k]) for k in ("program_version", "n", "bucket_mode")) for s in stores}
    if len(agree) != 1:
        raise SettingsMismatch(f"shards of different searches: {sorted(agree)}")
    seen = stores[0].seen()
    for s in stores[1:]:
        seen = seen.unionByName(s.seen())
    seen = seen.dropDuplicates(["tree_index"])
    return seen, pairs_of_seen(seen)


def pairs_of_seen(seen: DataFrame) -> DataFrame:
    """Each tree of an equal polynomial with the first such one of its bucket."""
    key = ["bucket", "digest", "coeffs"]
    first = seen.groupBy(*key).agg(F.min_by(F.struct("tree_index", "graph6", "form"), "tree_index").alias("f"), F.count("*").alias("size")).filter("size > 1")
    return seen.join(first, key).filter("form <> f.form").select("bucket", "digest", F.col("f.graph6").alias("graph6_a"), F.col("graph6").alias("graph6_b"), F.col("f.tree_index").alias("tree_index_a"), F.col("tree_index").alias("tree_index_b"))
