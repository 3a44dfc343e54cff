"""All trees of n vertices up to isomorphism, after Wright, Richmond, Odlyzko and McKay, "Constant time generation of free
trees" (SIAM J. Comput. 15, 1986), in the paper's form with arrays of levels and parents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.functions.trees import graph6
from sylva.runtime import materialize, ship_package

#: Trees that a task makes from one state.
STRIDE = 2000
SCHEMA = "tree_index long, n int, parent array<int>, graph6 string"


@dataclass
class Layout:
    """A free tree of n vertices as the paper's state, indices from 1: levels (1 at the root), parents, and the marks that make
    the next tree cost a constant on average. p: where the next change begins; q: the parent of p, 0 after the last tree; h1, h2: ends
    of the first longest path of the first subtree of the root and of the rest; r: last vertex of that subtree; c: where the
    rest, if it is as high and as large, becomes smaller than the subtree."""

    n: int
    level: list[int]
    parent: list[int]
    p: int
    q: int
    h1: int
    h2: int
    r: int
    c: int

    @staticmethod
    def first(n: int) -> Layout:
        """Two paths of half the vertices each, from the root."""
        k, never = n // 2 + 1, n + 2
        level = [0, *range(1, k + 1), *range(2, n - k + 2)]
        parent = [0, *range(k), *([1] if n > k else []), *range(k + 1, n)]
        return Layout(n, level, parent, 3 if n == 4 else n, 0 if n <= 3 else n - 1, k, n, k, never if n % 2 else n + 1)

    @staticmethod
    def of_levels(levels: list[int]) -> Layout:
        """The state of the paper's algorithm at a tree, from its levels in preorder (0 at the root) alone."""
        n = len(levels)
        level, parent, last = [0, *(x + 1 for x in levels)], [0] * (n + 1), {}
        for i in range(1, n + 1):
            parent[i] = last.get(level[i] - 1, 0)
            last[level[i]] = i
        r = next((i - 1 for i in range(3, n + 1) if level[i] == 2), n)
        first_highest = lambda span: max(span, key=lambda i: (level[i], -i))
        h1, h2 = first_highest(range(min(2, n), r + 1)), first_highest(range(r + 1, n + 1)) if r < n else n
        p, c = max((i for i in range(1, n + 1) if level[i] > 2), default=0), n + 2
        if r < n and level[h2] == level[h1] - 1 and n - h2 == r - h1:
            c = next((i for i in range(h2 + 1, n + 1) if level[i] != level[h1 - h2 + i] - 1), n + 1)
        return Layout(n, level, parent, p, parent[p] if p else 0, h1, h2, r, c)

    def state(self) -> list[int]:
        return [*self.level[1:], *self.parent[1:], self.p, self.q, self.h1, self.h2, self.r, self.c]

    @staticmethod
    def of(state: list[int]) -> Layout:
        n = (len(state) - 6) // 2
        return Layout(n, [0, *state[:n]], [0, *state[n : 2 * n]], *state[2 * n :])

    def advance(self) -> bool:
        """To the next tree; false if this is the last."""
        if not self.q:
            return False
        n, never, level, parent = self.n, self.n + 2, self.level, self.parent
        p, q, h1, h2, r, c = self.p, self.q, self.h1, self.h2, self.r, self.c
        # the first subtree stays the larger one, by height, then by size, then by levels; else it must shrink itself
        rest = n - h2
        equal = c == n + 1 or p == h2 and (level[h1] == level[h2] + 1 and rest > r - h1 or level[h1] == level[h2] and rest + 1 < r - h1)
        anew = equal and level[r] > 3
        if equal:
            p = r
            if anew:
                q = parent[r]
                h1 -= h1 == r
            else:
                r, q = r - 1, 2
        find_r = find_c = find_h2 = False
        h1 = min(h1, p - 1)
        if p <= r:
            find_r = True
        elif p <= h2:
            find_h2 = True
        elif level[h2] == level[h1] - 1 and rest == r - h1:
            find_c = p <= c
        else:
            c = never
        at, back, top, above = p, p - q, level[q], parent[q]
        p = 0
        for i in range(at, n + 1):  # all from here on repeats what stands before, from the parent on
            level[i] = level[i - back]
            if level[i] == 2:
                parent[i] = 1
            else:
                p = i
                q = above if level[i] == top else parent[i - back] + back
                parent[i] = q
            if find_r and level[i] == 2:
                find_r, find_h2, r = False, True, i - 1
            if find_h2 and level[i] <= level[i - 1] and i > r + 1:
                find_h2, h2 = False, i - 1
                find_c = level[h2] == level[h1] - 1 and n - h2 == r - h1
                if not find_c:
                    c = never
            if find_c:
                find_c = level[i] == level[h1 - h2 + i] - 1
                c = i + 1 if find_c else i
        if anew:  # the rest becomes a path as high as the subtree
            r = n - h1 + 1
            for i in range(r + 1, n + 1):
                level[i], parent[i] = i - r + 1, i - 1
            parent[r + 1] = 1
            h2 = p = n
            q, c = n - 1, never
        else:
            if not p:
                p = at - 1 if level[at - 1] != 2 else at - 2
                q = parent[p]
            if find_h2:
                h2 = n
                c = n + 1 if level[h2] == level[h1] - 1 and h1 == r else never
        self.p, self.q, self.h1, self.h2, self.r, self.c = p, q, h1, h2, r, c
        return True

    def levels(self) -> list[int]:
        """Levels in preorder, 0 at the root."""
        return [x - 1 for x in self.level[1:]]


def layouts(n: int, start: list[int] | None = None) -> Iterator[Layout]:
    """The trees of n vertices, from the first or from a given state on; each is valid until the next is taken."""
    tree = Layout.of(start) if start else Layout.first(n)
    yield tree
    while tree.advance():
        yield tree


def layout_parent(levels: list[int]) -> list[int]:
    """Parents of vertices in preorder by their levels; -1 for the root."""
    last, parent = {}, []
    for i, x in enumerate(levels):
        parent.append(last.get(x - 1, -1))
        last[x] = i
    return parent


def layout_graph6(levels: list[int]) -> str:
    """The label of an enumerated tree: the first two vertices change places."""
    name = [1, 0, *range(2, len(levels))] if len(levels) > 1 else [0]
    return graph6(len(levels), [(name[p], name[i]) for i, p in enumerate(layout_parent(levels)) if p >= 0])


def _lower(levels: list[int], at: int) -> list[int] | None:
    """The first rooted tree after all that share the levels before ``at`` and have at ``at`` no less: the last vertex up to ``at``
    below the root's children moves up, and what follows repeats what stands before it."""
    while at > 0 and levels[at] <= 1:
        at -= 1
    if at <= 0:
        return None
    back = next(at - i for i in range(at - 1, -1, -1) if levels[i] == levels[at] - 1)
    out = levels[:at]
    while len(out) < len(levels):
        out.append(out[-back])
    return out


def skip(levels: list[int], keep: int) -> list[int] | None:
    """The first tree after all those that share the first ``keep`` levels of a tree, without walking through them; None if
    there is none.

    Rooted trees come in falling order of their levels. One stands for a free tree if what hangs beside the first subtree is
    high enough, and at equal height large enough and no later in order. If not, nothing with this first subtree does any
    more, as the rest only falls: the subtree has to change at its end, and what is beside it begins as high as it must.
    """
    tree = _lower(levels, keep - 1)
    while tree is not None:
        end = next((i for i in range(2, len(tree)) if tree[i] == 1), len(tree))
        own, rest = [x - 1 for x in tree[1:end]], [0, *tree[end:]]
        if (max(own), len(own), own) <= (max(rest), len(rest), rest) if max(own) == max(rest) else max(own) < max(rest):
            return tree
        deep = tree[end - 1] > 2
        tree = _lower(tree, end - 1)
        if tree is not None and deep:
            end = next((i for i in range(2, len(tree)) if tree[i] == 1), len(tree))
            high = max(tree[1:end])
            tree[len(tree) - high :] = range(1, high + 1)
    return None


def block_starts(n: int, least: int) -> list[list[int]]:
    """Levels of the first trees of blocks that cut the enumeration: trees that share a prefix, just so long that there are at
    least ``least`` blocks, or one for each tree."""
    starts: list[list[int]] = []
    for keep in range(2, n + 1):
        starts, tree = [], Layout.first(n).levels()
        while tree is not None:
            starts.append(tree)
            tree = skip(tree, keep)
        if len(starts) >= least:
            break
    return starts


def walk(start: list[int], stop: list[int] | None, stride: int, most: int | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """first, size, state of each ``stride`` trees from ``start`` up to before ``stop`` (both levels), or of at most ``most`` trees."""
    end = [0, *(x + 1 for x in stop)] if stop is not None else None
    tree, i, state = Layout.of_levels(start), 0, None
    while most is None or i < most:
        if i % stride == 0:
            if state is not None:
                yield i - stride, stride, state
            state = tree.state()
        i += 1
        if not tree.advance():
            if end is not None:
                raise RuntimeError("a block of the enumeration doesn't lead to the next one")
            break
        if tree.level == end:
            break
    if i:
        yield (i - 1) // stride * stride, (i - 1) % stride + 1, state


def tree_starts(spark: SparkSession, n: int, stride: int = STRIDE, max_trees: int | None = None, blocks: int | None = None) -> DataFrame:
    """first, size, state: where each ``stride`` trees of n vertices or fewer begin in the enumeration; written.

    The driver lists the first trees of blocks of a common prefix, a few for each task slot, by skipping. Tasks walk through a
    block each, at a constant cost a tree, and check that it ends where the next one begins; the blocks' sizes add up to
    indices. No task walks through all trees.
    """
    if n < 2:
        raise ValueError("trees are enumerated from 2 vertices on")
    ship_package(spark)
    least = blocks or 16 * spark.sparkContext.defaultParallelism
    starts = block_starts(n, least)
    if len(starts) < least:  # each tree is a block: the driver has met them all
        return materialize(spark.createDataFrame(list(walk(starts[0], None, stride, max_trees)), "first long, size long, state array<int>").coalesce(1), "tree-starts")
    rows = [(k, x, starts[k + 1] if k + 1 < len(starts) else None) for k, x in enumerate(starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, start, stop in zip(*(batch.column(c).to_pylist() for c in ("block", "start", "stop")), strict=True):
                for first, size, state in walk(start, stop, stride, max_trees):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([first]), pa.array([size]), pa.array([state], pa.list_(pa.int32()))], ["block", "first", "size", "state"])

    tasks = min(len(rows), 4 * spark.sparkContext.defaultParallelism)
    cut = spark.createDataFrame(rows, "block long, start array<int>, stop array<int>").repartition(tasks)
    walked = materialize(cut.mapInArrow(run, "block long, first long, size long, state array<int>"), "tree-walk")
    # one row a block: some for each task slot
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = walked.groupBy("block").agg(F.sum("size").alias("trees")).select("block", F.coalesce(F.sum("trees").over(before), F.lit(0)).alias("base"))
    out = walked.join(F.broadcast(base), "block").select((F.col("first") + F.col("base")).alias("first"), "size", "state")
    if max_trees is not None:
        out = out.filter(F.col("first") < max_trees).withColumn("size", F.least("size", F.lit(max_trees) - F.col("first")))
    return materialize(out, "tree-starts")


def grow(n: int, first: int, size: int, state: list[int], low: int = 0) -> pa.RecordBatch:
    """tree_index, n, parent, graph6 of the trees from a state on, those before index ``low`` left out."""
    rows = []
    for i, tree in enumerate(islice(layouts(n, state), size), first):
        if i >= low:
            levels = tree.levels()
            rows.append((i, layout_parent(levels), layout_graph6(levels)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([n] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], ["tree_index", "n", "parent", "graph6"])


def enumerate_trees(spark: SparkSession, n: int, max_trees: int | None = None, stride: int = STRIDE) -> DataFrame:
    """tree_index, n, parent, graph6 of the trees of n vertices (2 or more), in the order of the algorithm; see ``tree_starts``."""
    starts = tree_starts(spark, n, stride, max_trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size, state in zip(*(batch.column(c).to_pylist() for c in ("first", "size", "state")), strict=True):
                yield grow(n, first, size, state)

    return starts.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, SCHEMA)


def register_functions(spark: SparkSession) -> None:
    """SQL names: the table function enumerate_trees(n), and tree_form, tree_graph6, tree_measures, graph6_parent."""
    from sylva.functions import trees

    ship_package(spark)

    class Enumerate:
        def eval(self, n: int):
            for i, tree in enumerate(layouts(n)):
                levels = tree.levels()
                yield i, layout_parent(levels), layout_graph6(levels)

    spark.udtf.register("enumerate_trees", F.udtf(Enumerate, returnType="tree_index: bigint, parent: array<int>, graph6: string"))
    for name in ("tree_form", "tree_graph6", "tree_measures", "graph6_parent"):
        spark.udf.register(name, getattr(trees, name))
