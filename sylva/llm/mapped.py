"""Sorted tables as Arrow files in the shared folder, mapped into memory by the workers that look keys up.

Nothing goes through the driver but the paths (one a task), and the workers of a machine share the pages that they touch, so
that a table may be larger than what could be broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.runtime import materialize, scratch_path, ship_package


def write_mapped(table: DataFrame, key: str, name: str) -> list[str]:
    """Write ``table`` sorted by the long column ``key`` (no nulls; keys may repeat), a file for each range of keys; the files' paths in
    order. Files of failed attempts are not among them. Rows of one key go to one task: keys are hashes or other even values.
    """
    spark = table.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            whole = pa.Table.from_batches(rows).combine_chunks()
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            own = uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/{own}.arrow", compression=None) as out, pa.ipc.new_file(out, whole.schema) as f:
                f.write_table(whole)
            k = whole.column(key)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{own}.arrow"]), pa.array([k[0].as_py()], pa.int64())], ["path", "first"])

    files = materialize(table.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(write, "path string, first long"), f"{name}-files")
    return [r.path for r in files.orderBy("first").collect()]


#: Ranges of keys, over all files of a table, for which a worker knows where they begin.
RANGES = 1 << 20


def _ranges(keys: np.ndarray, most: int) -> tuple[np.uint64, np.ndarray]:
    """Cuts what lies between the first and the last key into at most ``most`` equal ranges, about one or two for each key: by how many
    bits a distance from the first key is shifted to give its range, and where each range begins."""
    span = int(keys[-1]) - int(keys[0])
    shift = max(0, span.bit_length() - min(len(keys).bit_length() + 1, max(most, 2).bit_length() - 1))
    starts = (np.arange((span >> shift) + 1, dtype=np.uint64) << np.uint64(shift)).view(np.int64) + keys[0]
    return np.uint64(shift), np.append(np.searchsorted(keys, starts), len(keys)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)


class Mapped:
    """Look-ups in the files of ``write_mapped``.

    A key is searched for in the few rows of its range: a search among all of them takes a miss of the cache or of the branch
    prediction for each halving.
    """

    def __init__(self, paths: tuple[str, ...], key: str):
        self.parts = []
        for p in paths:
            fs, base = pafs.FileSystem.from_uri(p)
            source = pa.memory_map(base) if isinstance(fs, pafs.LocalFileSystem) else pa.BufferReader(fs.open_input_file(base).read_buffer())
            self.parts.append(pa.ipc.open_file(source).read_all().combine_chunks())
        self.keys = [t.column(key).chunk(0).to_numpy() for t in self.parts]
        self.firsts = np.array([k[0] for k in self.keys], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(k) for k in self.keys])]).astype(np.int64)
        self.ranges = [_ranges(k, RANGES // len(self.keys)) for k in self.keys]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of the first entry of each key, -1 where there is none."""
        if len(self.parts) == 1:
            return self._within(0, keys)
        out = np.full(len(keys), -1, np.int64)
        part = np.searchsorted(self.firsts, keys, "right") - 1
        for k in np.unique(part[part >= 0]).tolist():
            at = np.flatnonzero(part == k)
            row = self._within(k, keys[at])
            out[at] = np.where(row >= 0, row + self.begin[k], -1)
        return out

    def _within(self, k: int, keys: np.ndarray) -> np.ndarray:
        """The row in file ``k`` of the first entry of each key, -1 where there is none."""
        own, (shift, begin) = self.keys[k], self.ranges[k]
        # a key before the first one is farther from it, without sign, than any key of the file
        of = np.minimum((keys - own[0]).view(np.uint64) >> shift, np.uint64(len(begin) - 2)).view(np.int64)
        low, high = begin[of], begin[of + 1]
        at = np.flatnonzero(low < high)
        low, high, want = low[at].astype(np.int64), high[at].astype(np.int64), keys[at]
        out = np.full(len(keys), -1, np.int64)
        while len(at):
            middle = (low + high - 1) >> 1
            there = own[middle]
            hit = there == want
            out[at[hit]] = middle[hit]  # a later halving overwrites it by an earlier row of the key, if there is one
            before = there < want
            low, high = np.where(before, middle + 1, low), np.where(before, high, middle)
            on = np.flatnonzero(low < high)
            at, low, high, want = at[on], low[on], high[on], want[on]
        return out

    def rows(self, first: int) -> pa.Table:
        """All rows of the key whose first row is ``first``."""
        k = int(np.searchsorted(self.begin, first, "right")) - 1
        own, row = self.keys[k], int(first - self.begin[k])
        return self.parts[k].slice(row, int(np.searchsorted(own, own[row], "right")) - row)

    def column(self, name: str, rows: np.ndarray) -> pa.Array:
        """The values of a column in some rows."""
        whole = [t.column(name) for t in self.parts]
        return pa.chunked_array([c for w in whole for c in w.chunks], whole[0].type).take(pa.array(rows)).combine_chunks() if whole else pa.array([])


@lru_cache(maxsize=4)
def mapped(paths: tuple[str, ...], key: str) -> Mapped:
    return Mapped(paths, key)
