"""All trees of n vertices as a data source: ``spark.read.format("trees").option("n", 18).load()``.

Partitions are ranges of ``tree_index``. Only the trees of a range are made where the options ``low`` and ``high`` say so, or, with the
option ``pushdown`` in a session that has ``spark.sql.python.filterPushdown.enabled``, where filters compare tree_index with
constants. Spark 4.1 keeps one reader for each ``load()``: with pushdown, two different filters on one loaded DataFrame in one
query share what was pushed last, so load once for each range; the options have no such trap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from sylva.runtime import ship_package
from sylva.sources.enumeration import SCHEMA, STRIDE, Layout, grow, tree_starts, walk

#: States that a partition of the source has, at most.
STATES = 16


@dataclass
class TreeRange(InputPartition):
    """The trees that begin from some states, cut to indices from ``low`` to before ``high``."""

    first: int
    last: int
    low: int
    high: int


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.n, self.path = int(options["n"]), options.get("starts")
        if self.n < 2:
            raise ValueError("trees are enumerated from 2 vertices on")
        self.low, self.high = max(0, int(options.get("low", 0))), int(options["high"]) if "high" in options else None
        self.walked: list[tuple[int, int, list[int]]] | None = None

    def _states(self, low: int, high: int | None, columns: list[str]) -> list[tuple]:
        """Rows of the starts that have an index from ``low`` to before ``high``, in order."""
        if self.path is None:
            if self.walked is None:
                self.walked = list(walk(Layout.first(self.n).levels(), None, STRIDE, self.high))
            rows = [dict(zip(("first", "size", "state"), x, strict=True)) for x in self.walked]
            return [tuple(r[c] for c in columns) for r in rows if r["first"] + r["size"] > low and (high is None or r["first"] < high)]
        fs, base = pafs.FileSystem.from_uri(self.path)
        want = pads.field("first") + pads.field("size") > low
        if high is not None:
            want &= pads.field("first") < high
        rows = pads.dataset(base, filesystem=fs, format="parquet").to_table(columns, filter=want).sort_by("first")
        return list(zip(*(rows.column(c).to_pylist() for c in columns), strict=True))

    def partitions(self) -> list[TreeRange]:
        """Some states each. The states themselves are read by the tasks, or, where there is no table of them, walked to."""
        if self.high is not None and self.high <= self.low:
            return []
        rows = self._states(self.low, self.high, ["first", "size"])
        out = []
        for i in range(0, len(rows), STATES):
            part = rows[i : i + STATES]
            end = part[-1][0] + part[-1][1]
            out.append(TreeRange(part[0][0], end, max(self.low, part[0][0]), end if self.high is None else min(end, self.high)))
        return out

    def read(self, part: TreeRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions: no trees
            return
        for first, size, state in self._states(part.low, part.high, ["first", "size", "state"]):
            yield grow(self.n, first, min(size, part.high - first), state, part.low)


class PushedTreeReader(TreeReader):
    """A reader that takes bounds from filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of tree_index are kept here; all else is left to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("tree_index",):
                yield f
            elif isinstance(f, In) and all(isinstance(x, int) for x in value):
                self._bound(min(value, default=0), max(value, default=-1) + 1)
                yield f  # between the bounds Spark decides
            elif not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self._bound(value, value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self._bound(value + isinstance(f, GreaterThan), None)
            elif isinstance(f, LessThan | LessThanOrEqual):
                self._bound(0, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _bound(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)


class TreeSource(DataSource):
    """Options: ``n``, the number of vertices; ``low`` and ``high``, the first index and the one after the last; ``starts``, the
    path of a table of ``tree_starts``; ``pushdown``: true to take bounds from filters too. Without ``starts`` the driver walks through the trees to find where partitions begin,
    1.5 microseconds a tree."""

    @classmethod
    def name(cls) -> str:
        return "trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return (PushedTreeReader if self.options.get("pushdown", "false").lower() == "true" else TreeReader)(self.options)


def register_source(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship_package(spark)
    spark.dataSource.register(TreeSource)


def read_trees_of_size(spark: SparkSession, n: int, low: int = 0, high: int | None = None, stride: int = STRIDE, starts: DataFrame | None = None, pushdown: bool = False) -> DataFrame:
    """The source over states that tasks have walked to together (``starts``, or made here)."""
    register_source(spark)
    starts = tree_starts(spark, n, stride, high) if starts is None else starts
    source = spark.read.format("trees").option("n", n).option("low", low).option("starts", starts._sylva_path)
    return (source if high is None else source.option("high", high)).option("pushdown", pushdown).load()
