"""Entries of a model that is too large to broadcast, brought to the texts that need them by a join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm._text import Block, blocks
from sylva.runtime import fresh_name, materialize

#: From a block: the number (in the block) of the text of each key, and the key's columns by name, as int64.
Keys = Callable[[Block], tuple[np.ndarray, dict[str, np.ndarray]]]


def with_entries(docs: DataFrame, text: str, table: DataFrame, on: list[str], keys: Keys) -> tuple[DataFrame, str, str]:
    """``docs`` with a number for each row and the rows of ``table`` whose columns ``on`` (long) are among the text's keys.

    Returns the names of both columns too. ``keys`` gives each key of a text once; a text has as many entries as different
    keys at most. The numbers are written with the rows, so that a lost executor doesn't change them.
    """
    row, found = fresh_name(docs, "row"), fresh_name(docs, "entries")
    base = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "lookup-rows")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for b in blocks(batch.column("text")):
                of, columns = keys(b)
                yield pa.RecordBatch.from_arrays([pa.array(ids[b.first : b.first + b.n][of]), *(pa.array(columns[c]) for c in on)], ["row", *on])

    own = base.select(F.col(row).alias("row"), F.col(text).cast("binary").alias("text")).mapInArrow(emit, ", ".join(f"{c} long" for c in ("row", *on)))
    parts = own.join(table, on).groupBy("row").agg(F.collect_list(F.struct(*table.columns)).alias(found)).withColumnRenamed("row", row)
    return base.join(parts, row, "left"), row, found


def entries_of(column: pa.Array, i: int, names: list[str]) -> list[np.ndarray]:
    """The columns of the entries of row ``i``; empty ones if it has none."""
    values = column[i].values
    return [values.field(c).to_numpy(zero_copy_only=False) if values is not None else np.zeros(0, np.int64) for c in names]
