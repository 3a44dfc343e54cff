"""Structured Streaming over files of trees, with the first tree of each key as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sylva.runtime import scratch_path, ship_package

KEY = ("n", "digest")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOLD = "n long, digest string, tree_id_a long, tree_id_b long"


class FirstTree(StatefulProcessor):
    """The state of a key is the first tree that came with it. Each tree is told once: with itself if it is that first one,
    else with the first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "tree_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.first.get()[0] if self.first.exists() else None
        for batch in rows:
            ids = batch["tree_id"]
            if first is None and len(ids):
                first = int(ids.iloc[0])
                self.first.update((first,))
            yield pd.DataFrame({"n": int(key[0]), "digest": key[1], "tree_id_a": first, "tree_id_b": ids.astype("int64")})

    def close(self) -> None:
        pass


def follow(trees: DataFrame, told: str, checkpoint: str):
    """Start a query that appends to the Parquet files under ``told`` a row (n, digest, tree_id_a, tree_id_b) for each row of the
    stream ``trees`` (n, digest, tree_id), b being the tree and a the first of its key to arrive.

    What a batch costs doesn't grow with the trees seen: a key's state is one number in RocksDB, looked up by key. The file
    sink and the checkpoint together give each row once, also after a restart.
    """
    ship_package(trees.sparkSession)
    rows = trees.select(F.col("n").cast("long").alias("n"), "digest", F.col("tree_id").cast("long").alias("tree_id"))
    out = rows.groupBy(*KEY).transformWithStateInPandas(FirstTree(), outputStructType=_TOLD, outputMode="append", timeMode="none")
    return out.writeStream.format("parquet").option("path", told).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def settled(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first tree of each key (n, digest, tree_id), and the pairs of each other tree with it, from what ``follow`` has told.

    In both the smallest tree_id of a key is its first, so that they don't depend on the order of arrival.
    """
    least = told.groupBy(*KEY).agg(F.min("tree_id_b").alias("least"), F.count("*").alias("trees"))
    first = least.select(*KEY, F.col("least").alias("tree_id"))
    # keys of one tree have no pairs; the others' rows meet their key's least
    pairs = told.join(least.filter("trees > 1").select(*KEY, "least"), list(KEY)).filter("tree_id_b <> least")
    return first, pairs.select(*KEY, F.col("least").alias("tree_id_a"), "tree_id_b").distinct()


def stream_collisions(spark: SparkSession, source: str, schema, files_per_batch: int = 4, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first tree of each key (n, digest, tree_id), and the pairs (n, digest, tree_id_a, tree_id_b) of each other tree
    with it, over the tree files under ``source`` (n, digest, tree_id) that are there now.

    ``folder`` holds the state and what was told; called again with it, the stream goes on with the files that are new. Without
    one a fresh folder is taken.
    """
    folder = folder or scratch_path(spark, "stream")
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        follow(stream, f"{folder}/told", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, old)
    return settled(spark.read.schema(_TOLD).parquet(f"{folder}/told"))
