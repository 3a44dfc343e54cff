"""Steps that several operators share: running totals within groups of any size, and joins to keys of any weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.runtime import fresh_name, materialize, ship_package

#: A key with more than this share of the rows is heavy; there are at most 1 / HEAVY_SHARE such keys.
HEAVY_SHARE, HEAVY_LEAST = 0.001, 10_000


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, number: str | None = None) -> DataFrame:
    """``df``, written, with what stands before each row in its group in ``order``: sums and exclusive ors of long columns (new
    name: column), and the number of rows.

    ``group`` is a long column without nulls. Rows are dealt by ranges of (group, order), not by group, so that a group with
    most of the rows is spread over tasks; each task runs through its rows in order, and what the tasks before have of a
    group that goes on across tasks is added after. There are fewer such parts than tasks.
    """
    spark = df.sparkSession
    ship_package(spark)
    sums, xors = dict(sums or {}), dict(xors or {})
    part, one = fresh_name(df, "part"), fresh_name(df, "one")
    if number:
        df, sums = df.withColumn(one, F.lit(1).cast("long")), sums | {number: one}
    columns = [(name, c, False) for name, c in sums.items()] + [(name, c, True) for name, c in xors.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, held = TaskContext.get().partitionId(), None, [0] * len(columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(group).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(g))))
            added = []
            for k, (_, c, xor) in enumerate(columns):
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = (np.bitwise_xor if xor else np.add).accumulate(x)
                before = np.concatenate([[0], upto[:-1]])
                start = before[begins]
                carry = held[k] if g[0] == last else 0
                lift = np.zeros(len(begins), np.int64)
                lift[0] = carry
                out = (before ^ start[of] ^ lift[of]) if xor else (before - start[of] + lift[of])
                held[k] = int(out[-1] ^ x[-1]) if xor else int(out[-1] + x[-1])
                added.append(pa.array(out, pa.int64()))
            last = g[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added, pa.array(np.full(len(g), own), pa.int64())], [*batch.schema.names, *(name for name, *_ in columns), part])

    schema = df.schema
    for name, *_ in columns:
        schema = schema.add(name, "long")
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = materialize(dealt.mapInArrow(run, schema.add(part, "long")), "running")
    # groups that end one task's rows and begin a later one's
    ends = local.groupBy(part).agg(F.min(group).alias("low"), F.max(group).alias("high"))
    cut = ends.select(F.col("high").alias(group)).join(ends.select(F.col("low").alias(group)), group, "left_semi").distinct()
    totals = [(F.bit_xor(c) if xor else F.sum(c)).alias(f"t{k}") for k, (_, c, xor) in enumerate(columns)]
    tails = local.join(F.broadcast(cut), group, "left_semi").groupBy(F.col(group).alias("g"), F.col(part).alias("p")).agg(*totals)
    tails = materialize(tails, "running-tails")  # at most two groups a task are cut
    earlier = F.broadcast(tails.select("g", F.col("p").alias("q"), *(F.col(f"t{k}").alias(f"e{k}") for k in range(len(columns)))))
    bases = tails.join(earlier, "g").filter("q < p").groupBy("g", "p").agg(*((F.bit_xor if xor else F.sum)(f"e{k}").alias(f"e{k}") for k, (*_, xor) in enumerate(columns)))
    bases = bases.select(F.struct("g", "p").alias("key"), F.struct(*(f"e{k}" for k in range(len(columns)))).alias("base"))
    key, base = fresh_name(local, "key"), fresh_name(local, "base")
    out = local.withColumn(key, F.struct(F.col(group).alias("g"), F.col(part).alias("p"))).join(F.broadcast(bases.toDF(key, base)), key, "left")
    for k, (name, _, xor) in enumerate(columns):
        e = F.coalesce(F.col(base)[f"e{k}"], F.lit(0))
        out = out.withColumn(name, F.col(name).bitwiseXOR(e) if xor else F.col(name) + e)
    return out.drop(key, base, part, one)


def join_unique(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has each key once at most; ``how`` is inner or left. ``rows`` is read several times.

    Rows of heavy keys don't meet in one task: there are at most a thousand keys with more than a thousandth of the rows, and
    their part of ``table`` is broadcast. The other keys are joined by a shuffle.
    """
    bound = max(HEAVY_LEAST, int(rows.count() * HEAVY_SHARE))
    heavy = materialize(rows.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > bound).select(*on), "heavy-keys")
    if heavy.limit(1).count() == 0:
        return rows.join(table, on, how)
    heavy = F.broadcast(heavy)
    few = F.broadcast(table.join(heavy, on, "left_semi"))
    return rows.join(heavy, on, "left_semi").join(few, on, how).unionByName(rows.join(heavy, on, "left_anti").join(table, on, how))
