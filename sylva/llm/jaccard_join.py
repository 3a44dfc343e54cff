"""N-gram Jaccard join: exact links between documents' shingle sets, by pivots in the metric space of the Jaccard distance.

1. Equal sets become one point. Points are cut into blocks that lose no link: sizes fall in overlapping windows, and in a
   window the shingle universe is dealt by hash into ``m`` slices. Linked sets differ in at most ``k < m`` shingles, so they
   agree in some slices entirely; a block is the points that agree in a slice. Unrelated sets are all at distance near 1
   from any pivot, so that pivots alone would copy every point to every region; the blocks keep them apart first.
2. Points that share blocks, directly or by others, are a space of their own. Pivots create its Voronoi regions: a point
   goes to its nearest pivot. Points within the threshold of a pivot are linked by it. A point goes as a guest also to all
   pivots that are nearer than its nearest one plus twice the threshold: by the triangle inequality it meets there whatever
   it may be linked with. Regions are cut again by new pivots of their own until all of one is
   connected or a pivot; those that pivots can't cut are compared: windows of distances to pivots and counts of shingles in slices rule pairs out, the rest is
   compared in full, and pairs already connected, or guests both, need not be.
3. A space that fits a task is cut there. A larger one is cut by Spark first, up to ``DEPTH`` times. Where pivots would copy
   points to most regions, as in a space that a passage of all its points holds together, its points are tied instead by
   the rarest of their shingles, one of which any two linked sets share. What is large in the end is joined by pairs of
   chunks. Components of the links follow by star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm._text import Block, blocks, mix, span_hashes, windows, word_spans
from sylva.llm.components import connected_components
from sylva.runtime import discard, fresh_name, materialize, ship_package

#: A region of so many points and shingles at most is joined in one task.
LOCAL_POINTS, LOCAL_SHINGLES = 4000, 4_000_000
#: Pivots that Spark takes of a region that is cut, and how often regions are cut before chunks.
PIVOTS, DEPTH = 16, 3
#: Pivots of so many bytes together are broadcast to the points; beyond, points go to copies of their region's pivots.
PIVOT_BYTES = 32 << 20
#: Pivots don't cut a region if they would make more copies of its points than this on average.
MOST_COPIES = 3
#: Inside a task: pivots of a region of n points, at most, as a multiple of the root of n; how often regions are cut at most.
LOCAL_PIVOTS, LOCAL_DEPTH = 4.0, 24
#: Pivots are taken until each point is nearer to one than this, less than which a point reaches no unrelated pivot.
_CLEAR = 0.1
#: Up to so many points (40 bytes each) are broadcast to the documents to fetch their sets; beyond, the two are shuffled.
BROADCAST_POINTS = 1_000_000
#: Blocks of more points than this are needed only by points with many of them.
HOT_BLOCK = 3
_SIGNATURE = 128
_GROWTH = 1.4


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; two sets are linked if ``den * intersection >= num * union``."""

    words: int = 5
    num: int = 4
    den: int = 5

    @property
    def theta(self) -> float:
        return 1 - self.num / self.den

    @cached_property
    def size_windows(self) -> list[tuple[int, int, int, int]]:
        """Least and largest size, slices and spare slices of each window. Linked sets share the smaller one's window."""
        out, low = [], 1
        while len(out) < 64:
            below = int(low * _GROWTH) + 1
            high = (below - 1) * self.den // self.num
            k = (below - 1 + high) * (self.den - self.num) // (self.den + self.num)
            spare = int((k + 1) * (0.1 if self.light > 1 else 0.15))
            out.append((low, high, k + 1 + spare, spare))
            low = below
        return out

    @property
    def light(self) -> int:
        """Slices of fewer shingles say little; a point gives them up as long as its spare slices allow."""
        return 3 if 8 * (self.den - self.num) <= self.den else 1

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def shingle_sets(b: Block, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block. Fewer words than a shingle: all of them as one."""
    s, e, first = word_spans(b.data, b.offsets)
    h = span_hashes(b.data, s, e, lower=True)
    whole = windows(h, words)
    out = []
    for i in range(b.n):
        a, z = int(first[i]), int(first[i + 1])
        if z - a >= words:
            out.append(np.unique(whole[a : z - words + 1]))
        elif z > a:
            out.append(windows(h[a:z], z - a) ^ np.uint64(z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def digest(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        two = np.array([mix(u + np.uint64(k)).sum(dtype=np.uint64) for k in (0x1234567, 0x89ABCDEF)], np.uint64)
    return tuple(two.view(np.int64).tolist())


def block_keys(u: np.ndarray, rule: Rule) -> tuple[np.ndarray, list[int], list[int]]:
    """Keys of a set's blocks (window in the low 6 bits), its windows, and how many keys it could do without in each."""
    n = len(u)
    keys, names, slack = [], [], []
    for q, (low, high, m, spare) in enumerate(rule.size_windows):
        if low > n:
            break
        if n > high:
            continue
        slice_of = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        bounds = np.searchsorted(slice_of, np.arange(m + 1, dtype=np.uint64))
        count = np.diff(bounds)
        name = mix(np.arange(m, dtype=np.uint64) * np.uint64(64) + np.uint64(q))
        key = mix(_sums(mix(u ^ np.uint64(0x5851F42D4C957F2D)), bounds) + name + count.astype(np.uint64))
        light = count < rule.light
        dropped = int(light.sum())
        if dropped <= spare:
            key = key[~light]
        keys.append((key & ~np.uint64(63)) | np.uint64(q))
        names.append(q)
        slack.append(max(0, spare - dropped))  # also of a set that keeps its light slices: its partner may give up the same ones
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64), names, slack


def _points(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, hi, lo, keys, windows (names and slack) of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for b in blocks(batch.column("text")):
                sets = shingle_sets(b, rule.words)
                cuts = [block_keys(u, rule) for u in sets]
                sums = np.array([digest(u) for u in sets], np.int64).reshape(-1, 2)
                ragged = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else [], kind))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(b.first, b.n), pa.array([len(u) for u in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), ragged([c[0] for c in cuts], pa.int64()), ragged([np.array(c[1], np.int32) for c in cuts], pa.int32()), ragged([np.array(c[2], np.int32) for c in cuts], pa.int32())],
                    ["doc_id", "n", "hi", "lo", "keys", "names", "slack"],
                )

    return docs.mapInArrow(make, "doc_id long, n long, hi long, lo long, keys array<long>, names array<int>, slack array<int>")


def candidate_edges(points: DataFrame) -> DataFrame:
    """a, b: ties of the points (id, keys, names, slack) of a block to its smallest; every linked pair is tied by some block."""
    keyed = points.select("id", F.explode("keys").alias("key"))
    inside = Window.partitionBy("key").orderBy("id")
    # a block has more rows than HOT_BLOCK if and only if so many lie around each of its rows
    near = F.count("*").over(inside.rowsBetween(-HOT_BLOCK, HOT_BLOCK))
    rows = keyed.select("id", "key", F.first("id").over(inside).alias("least"), near.alias("n")).filter("n > 1")
    rows = materialize(rows.select("id", "key", "least", F.col("key").bitwiseAND(63).cast("int").alias("window"), (F.col("n") > HOT_BLOCK).cast("long").alias("hot")), "blocks")
    # a linked pair agrees in more blocks of a window than a point has to spare, so if it has no more hot ones than that,
    # one of those blocks isn't hot
    spare = points.select("id", F.explode(F.arrays_zip("names", "slack")).alias("z")).select("id", F.col("z.names").alias("window"), F.col("z.slack").alias("slack"))
    needs = rows.filter("hot = 1").groupBy("id", "window").agg(F.count("*").alias("n_hot")).join(spare, ["id", "window"]).filter("n_hot > slack").select("id", "window")
    hot = rows.filter("hot = 1").join(needs, ["id", "window"], "left_semi").select("id", "key")
    least = hot.groupBy("key").agg(F.min("id").alias("b"))
    ties = rows.filter("hot = 0").select(F.col("id").alias("a"), F.col("least").alias("b"))
    return ties.unionByName(hot.join(least, "key").select(F.col("id").alias("a"), "b")).filter("a <> b")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Space:
    """The points of a region, smaller sets first, and what of them is connected so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], settled: list[bool], rule: Rule):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets, self.rule = [ids[i] for i in order], [sets[i] for i in order], rule
        self.size = np.array([len(u) for u in self.sets], np.int64)
        self.root = np.arange(len(ids))
        calm = np.flatnonzero([settled[i] for i in order])
        if len(calm):
            self.root[calm] = calm[0]
        self.links: list[tuple[int, int]] = []
        self.tally = {"regions": 0, "guests": 0, "depth": 0, "near pivots": 0, "compared": 0}

    def tie(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
            self.links.append((self.ids[i], self.ids[j]))

    def join(self) -> list[tuple[int, int]]:
        if len(self.ids) > 1:
            self.cut(np.arange(len(self.ids)), np.zeros(len(self.ids), bool), 0)
        return self.links

    def cut(self, at: np.ndarray, guest: np.ndarray, depth: int) -> None:
        """Links of the region of points ``at`` that aren't between two guests."""
        root = self.root[at]
        if (root == root[0]).all() or guest.all():
            return  # nothing left to tell
        self.tally["depth"] = max(self.tally["depth"], depth)
        if depth >= LOCAL_DEPTH:
            self.compare(at, guest, None)
            return
        rule, size = self.rule, self.size[at]
        values = np.concatenate([self.sets[i] for i in at.tolist()])  # given back before the cuts of cuts
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        far, nearest, pivot = [], np.full(len(at), 2.0), len(at) // 2
        for _ in range(math.ceil(LOCAL_PIVOTS * math.sqrt(len(at)))):  # each pivot is the point farthest from those before
            u = self.sets[int(at[pivot])]
            place = np.minimum(np.searchsorted(u, values), len(u) - 1)
            both = np.add.reduceat((u[place] == values).astype(np.int64), starts)
            union = len(u) + size - both
            close = at[rule.den * both >= rule.num * union]
            self.tally["near pivots"] += len(close) - 1
            for j in close.tolist():
                self.tie(int(at[pivot]), j)
            far.append(1 - both / union)
            nearest = np.minimum(nearest, far[-1])
            pivot = int(nearest.argmax())
            if nearest[pivot] < 1 - 2 * rule.theta - _CLEAR:
                break
        del values, place, both
        far = np.stack(far)
        home = far.argmin(0)
        reach = far <= nearest + 2 * rule.theta + 1e-9
        held = reach.sum(1)
        if held.max() > 0.9 * len(at) or held.sum() > 4 * len(at):
            self.compare(at, guest, far)
            return
        for c in range(len(far)):
            visits = guest | (home != c)
            own = reach[c] & ~visits
            if own.any():
                d = far[c]
                inside = reach[c] & (d >= d[own].min() - rule.theta - 1e-9) & (d <= d[own].max() + rule.theta + 1e-9)
                self.tally["regions"] += 1
                self.tally["guests"] += int((inside & visits).sum())
                self.cut(at[inside], visits[inside], depth + 1)

    @cached_property
    def signature(self) -> np.ndarray:
        """Numbers of shingles in hashed bins; 255 and more are counted whole where the sets are that large."""
        kind = np.int32 if self.size.max() // _SIGNATURE * 4 > 255 else np.uint8
        out = np.zeros((len(self.sets), _SIGNATURE), kind)
        for i, u in enumerate(self.sets):
            c = np.bincount((u >> np.uint64(57)).astype(np.int64), minlength=_SIGNATURE)
            out[i] = c if kind is np.int32 else np.minimum(c, 255)
        return out

    def compare(self, at: np.ndarray, guest: np.ndarray, far: np.ndarray | None) -> None:
        rule, size = self.rule, self.size[at]
        counts = self.signature[at] if len(at) > 8 else None
        for i in range(1, len(at)):
            near = np.arange(int(np.searchsorted(size[:i], -(-rule.num * size[i] // rule.den))), i)
            near = near[self.root[at[near]] != self.root[at[i]]]
            if guest[i]:
                near = near[~guest[near]]
            if far is not None and len(near):
                near = near[(np.abs(far[:, near] - far[:, [i]]) <= rule.theta + 1e-9).all(0)]
            if not len(near):
                continue
            if counts is not None:
                most = np.minimum(counts[near], counts[i]).sum(1, dtype=np.int64)
                if counts.dtype == np.uint8:  # bins of 255 may hold more
                    most = np.where(counts[near].max(1) == 255, size[near], most) if counts[i].max() < 255 else np.minimum(size[near], size[i])
                near = near[rule.den * most >= rule.num * (size[near] + size[i] - most)]
            self.tally["compared"] += len(near)
            for j in near[::-1].tolist():
                x, y = int(at[i]), int(at[j])
                if self.root[x] != self.root[y] and rule.linked(_shared(self.sets[x], self.sets[y]), int(size[i]), int(size[j])):
                    self.tie(x, y)


def join_region(ids: list[int], sets: list[np.ndarray], settled: list[bool], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect all linked pairs of a region, given that the settled points are connected already."""
    return _Space(ids, sets, settled, rule).join()


_REGION = "region long, id long, n long, settled boolean, body binary"


def _fetch_sets(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """The sets of the points in ``members`` (id, region, hi, lo) from the documents' texts."""
    members = members.select(F.col("id").alias("doc_id"), "region", "hi", "lo")
    members = F.broadcast(members) if members.count() <= BROADCAST_POINTS else members

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, regions, hi, lo = (batch.column(c).to_pylist() for c in ("doc_id", "region", "hi", "lo"))
            for b in blocks(batch.column("text")):
                rows = [(regions[k], ids[k], len(u), False, u.tobytes()) for k, u in enumerate(shingle_sets(b, rule.words), b.first) if digest(u) == (hi[k], lo[k])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["region", "id", "n", "settled", "body"])

    return docs.join(members, "doc_id").select("doc_id", "text", "region", "hi", "lo").mapInArrow(make, _REGION)


def _join_small(rows: DataFrame, rule: Rule) -> DataFrame:
    """a, b: links inside regions that fit a task; a task takes one region after the other."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            links = join_region(ids, sets, settled, rule)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, ids, sets, settled = None, [], [], []
        for batch in batches:
            for region, i, s, body in zip(*(batch.column(c).to_pylist() for c in ("region", "id", "settled", "body")), strict=True):
                if region != now:
                    if len(ids) > 1:
                        yield flush()
                    now, ids, sets, settled = region, [], [], []
                ids.append(i)
                sets.append(np.frombuffer(body, np.uint64))
                settled.append(s)
        if len(ids) > 1:
            yield flush()

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(join, "a long, b long")


def _connected_bits(masks: dict[int, int]) -> int:
    """Of the groups of bits that masks (with the number of points of each) connect, the one with the most points."""
    groups: list[int] = []
    for m in masks:
        if m:
            touching = [g for g in groups if g & m]
            groups = [g for g in groups if not g & m]
            for g in touching:
                m |= g
            groups.append(m)
    return max(groups, key=lambda g: (sum(n for m, n in masks.items() if m & g), g), default=0)


def _spread_with_pivots(rows: DataFrame, sizes: DataFrame, pivots: DataFrame, distances, put, schema: str) -> DataFrame:
    """The points with their distances where pivots are too many to broadcast: a region's points go to as many tasks as they
    would fill, each after a copy of its pivots."""
    parts = sizes.select("region", F.greatest(F.ceil(F.col("points") / LOCAL_POINTS), F.ceil(F.col("shingles") / LOCAL_SHINGLES)).cast("long").alias("parts"))
    points = rows.join(parts, "region").select("region", F.pmod(F.xxhash64("id", F.lit("part")), "parts").alias("part"), F.lit(1).alias("tag"), "id", "n", "settled", "body")
    copies = pivots.join(parts, "region").select("region", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(0).alias("tag"), "id", F.lit(0).cast("long").alias("n"), F.lit(False).alias("settled"), "body")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("region", "part", "tag", "settled", "body")]
            at, far, mask = [], [], []
            for i, (region, part, tag, settled, body) in enumerate(zip(*columns, strict=True)):
                if (region, part) != now:
                    now, sets = (region, part), []
                if tag == 0:
                    sets.append(np.frombuffer(body, np.uint64))
                    continue
                (d,), (m,) = distances([region], [settled], [body], lambda _: sets)  # noqa: B023
                at.append(i)
                far.append(d)
                mask.append(m)
            yield put(batch.take(pa.array(at, pa.int64())), far, mask)

    spread = points.unionByName(copies).repartition("region", "part").sortWithinPartitions("region", "part", "tag", "id")
    return spread.mapInArrow(measure, schema)


def _cut_by_pivots(rows: DataFrame, sizes: DataFrame, rule: Rule, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voronoi regions of each region of ``rows`` (whose points and shingles ``sizes`` has), links (a, b) that pivots tell of,
    and the regions that they don't cut."""
    order = F.xxhash64("id", F.lit(turn))
    pick = rows.groupBy("region", F.pmod(order, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(order.alias("o"), F.col("id").alias("id"), F.col("body").alias("body"))).alias("p"))
    pivots = materialize(pick.select("region", "p.id", "p.body").dropDuplicates(["region", "id"]), "pivots")  # PIVOTS rows a region
    bits = "region long, id long, n long, body binary, far array<double>, mask long"

    def distances(region: list, settled: list, bodies: list, pivots_of) -> tuple[list, list]:
        """Distances to the region's pivots of each point, and as bits which it is linked with; the bit after them: settled."""
        far, mask = [], []
        for r, calm, body in zip(region, settled, bodies, strict=True):
            u, sets = np.frombuffer(body, np.uint64), pivots_of(r)
            both = [_shared(u, v) for v in sets]
            far.append([1 - x / max(1, len(u) + len(v) - x) for x, v in zip(both, sets, strict=True)])
            mask.append(sum(1 << k for k, (x, v) in enumerate(zip(both, sets, strict=True)) if rule.linked(x, len(u), len(v))) | int(calm) << PIVOTS)
        return far, mask

    def put(batch: pa.RecordBatch, far: list, mask: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("region", "id", "n", "body")), pa.array(far, pa.list_(pa.float64())), pa.array(mask, pa.int64())], ["region", "id", "n", "body", "far", "mask"])

    if (pivots.agg(F.sum(F.octet_length("body"))).first()[0] or 0) <= PIVOT_BYTES:
        by_region: dict[int, list[np.ndarray]] = {}
        for r in sorted(pivots.collect(), key=lambda r: (r.region, r.id)):  # PIVOT_BYTES bounds them
            by_region.setdefault(r.region, []).append(np.frombuffer(bytes(r.body), np.uint64))
        shared = rows.sparkSession.sparkContext.broadcast(by_region)

        def measure_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield put(batch, *distances(*(batch.column(c).to_pylist() for c in ("region", "settled", "body")), shared.value.__getitem__))

        placed = materialize(rows.select("region", "id", "n", "settled", "body").mapInArrow(measure_here, bits), "voronoi")
    else:
        placed = materialize(_spread_with_pivots(rows, sizes, pivots, distances, put, bits), "voronoi")

    def settle(t: pa.Table) -> pa.Table:
        """Of one region: the bits of its settled points; t has a row for each different mask."""
        masks = dict(zip(t.column("mask").to_pylist(), t.column("points").to_pylist(), strict=True))
        return pa.table({"region": pa.array([t.column("region")[0].as_py()], pa.int64()), "calm": pa.array([_connected_bits(masks)], pa.int64())})

    masks = placed.groupBy("region", "mask").agg(F.count("*").alias("points"))
    calm = materialize(masks.groupBy("region").applyInArrow(settle, "region long, calm long"), "settled")  # at most 2^(PIVOTS + 1) rows a region
    names = pivots.groupBy("region").agg(F.sort_array(F.collect_list("id")).alias("names"))
    tied = placed.filter(F.col("mask").bitwiseAND((1 << PIVOTS) - 1) != 0).select("region", "id", "mask").join(names, "region")
    tied = tied.withColumn("own", F.expr("filter(names, (x, i) -> (shiftright(mask, i) & 1) = 1)"))
    # a point is tied to one pivot, and the pivots of each different mask to each other
    links = tied.select(F.col("id").alias("a"), F.col("own")[0].alias("b")).unionByName(tied.select("own").distinct().select(F.explode("own").alias("a"), F.col("own")[0].alias("b"))).filter("a <> b").distinct()

    rest = placed.join(calm, "region").withColumn("settled", F.col("mask").bitwiseAND(F.col("calm")) != 0).withColumn("best", F.array_min("far"))
    rest = rest.withColumn("home", F.array_position("far", F.col("best")) - 1)
    reach = F.when(F.col("settled"), F.array(F.col("home"))).otherwise(F.transform(F.filter(F.transform("far", lambda d, i: F.struct(d.alias("d"), i.cast("long").alias("i"))), lambda x: x["d"] <= F.col("best") + 2 * rule.theta + 1e-9), lambda x: x["i"]))
    rest = rest.withColumn("reach", reach)
    whole = materialize(rest.groupBy("region").agg((F.sum(F.size("reach")) > MOST_COPIES * F.count("*")).alias("uncut")).filter("uncut").select("region"), "uncut")
    cells = rest.join(whole, "region", "left_anti").withColumn("cell", F.explode("reach")).withColumn("d", F.get("far", F.col("cell").cast("int")))
    cells = materialize(cells.select(F.xxhash64("region", "cell", F.lit(turn)).alias("region"), "id", "n", "settled", "body", "d"), "cells")
    # a settled point needs to meet only unsettled ones whose distance to the pivot allows a link
    open_cells = cells.filter("not settled").groupBy("region").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    kept = cells.join(open_cells, "region").filter(~F.col("settled") | F.col("d").between(F.col("least") - rule.theta - 1e-9, F.col("most") + rule.theta + 1e-9))
    return kept.select("region", "id", "n", "settled", "body"), links, whole


def _cut_by_rare_shingles(rows: DataFrame, rule: Rule) -> DataFrame:
    """Regions of points of ``rows`` that share one of their rarest shingles, directly or by others; points that don't go.

    A set of n shingles that is linked with another shares at least n * num / den of them with it. So of the order from the
    rarest shingle of the region on, each of the two has a shared one among its first n - ceil(n * num / den) + 1. Shingles
    of one point alone come first and are only counted.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(b, np.uint64) for b in batch.column("body").to_pylist()]
            size = [len(u) for u in sets]
            if sets:
                region, node = (np.repeat(batch.column(c).to_numpy(), size) for c in ("region", "node"))
                key = mix(np.concatenate(sets) ^ mix(region.view(np.uint64)))  # of one region, another for each shingle
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key.view(np.int64))], ["node", "key"])

    rows = rows.withColumn("node", F.xxhash64("region", "id"))  # two points of one hash would only be taken together
    every = rows.select("region", "node", "body").mapInArrow(spread, "node long, key long")
    common = every.withColumn("points", F.count("*").over(Window.partitionBy("key"))).filter("points > 1")
    own = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("points", "key"))).alias("all")).join(rows.select("node", "n").distinct(), "node")
    first = (F.size("all") - F.ceil(F.col("n") * rule.num / rule.den) + 1).cast("int")
    rare = materialize(own.filter(first > 0).select("node", F.explode(F.slice("all", F.lit(1), first)).alias("x")).select("node", "x.key"), "rare-shingles")
    least = rare.groupBy("key").agg(F.min("node").alias("b"))
    spaces = connected_components(rare.join(least, "key").select(F.col("node").alias("a"), "b"))
    few = F.broadcast(spaces) if spaces.count() <= BROADCAST_POINTS else spaces
    out = materialize(rows.join(few, "node").select(F.col("root").alias("region"), "id", "n", "settled", "body"), "refined")
    discard(rare)
    return out


def _cut_by_chunks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of chunks of a region as regions of their own: each chunk of unsettled points with every chunk."""
    part = F.greatest(F.ceil(F.col("points") / (LOCAL_POINTS // 2)), F.ceil(F.col("shingles") / (LOCAL_SHINGLES // 2))).cast("long")
    cut = rows.join(sizes.select("region", part.alias("parts")), "region").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), "parts"))
    other = cut.withColumn("with", F.explode(F.expr("sequence(0L, parts - 1)")))
    pair = F.xxhash64("region", F.least("chunk", "with"), F.greatest("chunk", "with"))
    return other.select(pair.alias("region"), "id", "n", "settled", "body")


def links_of(rows: DataFrame, rule: Rule) -> DataFrame:
    """a, b: links that connect all linked pairs of each region of ``rows`` (region, id, n, settled, body)."""
    found: DataFrame | None = None
    fits = (F.col("points") <= LOCAL_POINTS) & (F.col("shingles") <= LOCAL_SHINGLES)
    for turn in range(DEPTH + 1):
        sizes = materialize(rows.groupBy("region").agg(F.count("*").alias("points"), F.sum("n").alias("shingles")).filter("points > 1"), "regions")
        large = sizes.filter(~fits)
        more = _join_small(rows.join(sizes.filter(fits).select("region"), "region", "left_semi"), rule)
        found = more if found is None else found.unionByName(more)
        if not large.limit(1).count():
            return found
        rows = materialize(rows.join(large.select("region"), "region", "left_semi"), "large")
        if turn == DEPTH:
            return found.unionByName(_join_small(_cut_by_chunks(rows, large), rule))
        cells, links, whole = _cut_by_pivots(rows, large, rule, turn)
        cells, found = materialize(cells, "regions"), found.unionByName(links)
        if whole.limit(1).count():
            cells = cells.unionByName(_cut_by_rare_shingles(rows.join(whole, "region", "left_semi"), rule))
        rows = cells
    return found


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of each row, exactly.

    Words are runs without ASCII white space, A-Z lower-cased. Null and empty texts have empty sets and are linked with
    nothing. Rows that share a doc_id are one document for links. A null doc_id takes no part; its component is null. A doc_id that
    is no whole number is refused by the cast to long. Other columns of the input are not looked at.
    Equal sets are linked whatever the number of copies, and copies are never paired one by one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    points = materialize(_points(own, rule), "points")
    sizes = materialize(points.select("doc_id", "n", "hi", "lo"), "sizes")
    named = sizes.filter("n > 0 and doc_id is not null")
    reps = materialize(named.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep")), "sets")
    r = reps.select(F.col("rep").alias("doc_id"), "n", "hi", "lo")
    distinct = points.join(r, ["doc_id", "n", "hi", "lo"]).select(F.col("doc_id").alias("id"), "keys", "names", "slack")
    spaces = materialize(connected_components(candidate_edges(distinct)), "spaces")
    discard(points)
    members = spaces.join(reps, spaces.node == reps.rep).select(F.col("node").alias("id"), F.col("root").alias("region"), "hi", "lo")
    rows = materialize(_fetch_sets(own, materialize(members, "members"), rule), "members-sets")
    # the texts of a doc_id that has several are one document
    several = named.groupBy("doc_id").agg(F.min(F.struct("n", "hi", "lo")).alias("x"), F.max(F.struct("n", "hi", "lo")).alias("y")).filter("x <> y").select("doc_id")
    same = named.join(several, "doc_id", "left_semi").join(reps, ["n", "hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = materialize(connected_components(links_of(rows, rule).unionByName(same)), "components")
    discard(rows, spaces)
    known = sizes.select("doc_id", F.col("n").alias("n_shingles"), "n", "hi", "lo").join(reps, ["n", "hi", "lo"], "left")
    out = known.join(roots, known.rep == roots.node, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """``docs`` with one row for each component, that of the smallest doc_id; rows without an id or without words all stay.

    Rows that share that doc_id stay together.
    """
    found = jaccard_components(docs, rule, doc_id, text)
    name = fresh_name(docs, "gone")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
