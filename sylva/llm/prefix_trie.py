"""The trie of conversations' turns: every prefix that conversations share, by one ROLLUP over positional columns of turns.

A conversation is cut into blocks of ``BLOCK`` turns; a block is a row with a column for each position, keyed by the node of
the trie where the block before ends. ``GROUP BY block, that node, ROLLUP (t0, .. t7)`` aggregates the prefixes of all
lengths of all blocks together, the grouping id tells each one's length.

A turn is known by 128 bits of SHA-256 of its role and text, a node by its depth and the exclusive or of two 64-bit hashes
of each turn with its place. The latter make that every block's key is a running total, so that blocks of one conversation
needn't wait for each other, however long it is; that two of n nodes of a depth share 128 bits is as likely as n^2 / 2^129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.shared_steps import join_unique, running
from sylva.runtime import materialize, ship_package

#: Turns of a block.
BLOCK = 8
#: Bytes of joined conv_ids that are handed on at once.
CHUNK_BYTES = 256 << 10
_TURNS = [f"t{k}" for k in range(BLOCK)]
_NODE = ["depth", "s1", "s2"]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that identify role and text, and 8 that give the text's UTF-8 bytes; nulls are empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(both, 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def _bytes(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long")


def _place(turn: Column, at: Column, lane: int) -> Column:
    """A hash of a turn at its place in the conversation; 0 where there is none."""
    return F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(lane), at.cast("long"), turn))


def _xor(values: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), values)


def order_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos, tid of each turn in the order of its conversation: by turn, null first, and turns of one number by the
    SHA-256 of role and text. Rows without a conv_id belong to no conversation. Written."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("tid")).filter("conv_id is not null")
    return running(rows, "conv_id", ["turn", "tid"], number="pos").select("conv_id", "pos", "tid")


def rebuild(turns: DataFrame, span: int = 5, most: int = 9) -> DataFrame:
    """conv_id, pos, tid, n_turns: every conversation c with the first h turns of conversation c - c % ``span`` instead of its own
    first h, where h is the CRC-32 of the decimal c modulo ``most``. A conversation without turns has one row with pos null.

    ``turns`` (conv_id, pos, tid) is read several times.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    base = (F.col("conv_id") - F.col("conv_id") % span).cast("long")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    convs = own.select("conv_id", base.alias("base"), h.alias("h"), "n_own")
    lengths = own.filter(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    lent = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)).cast("long"))
    convs = materialize(convs.join(lengths, "base", "left").select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n_own") - F.col("h"), F.lit(0).cast("long"))).alias("n_turns")), "trie-conversations")
    heads = turns.filter((F.col("conv_id") % span == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "tid")
    borrowed = heads.join(convs, "base").filter("pos < h").select("conv_id", "pos", "tid", "n_turns")
    kept = turns.filter(F.col("pos") >= h)
    kept = join_unique(kept, convs.select("conv_id", "h", "lent", "n_turns"), ["conv_id"]).select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "tid", "n_turns")
    none = convs.filter("n_turns = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"), "n_turns")
    return borrowed.unionByName(kept).unionByName(none)


def _blocks(rebuilt: DataFrame) -> DataFrame:
    """conv_id, n_turns, block, p1, p2 (the node before the block), t0 .. t7; written."""
    cells = [F.max(F.when(F.col("pos") % BLOCK == k, F.col("tid"))).alias(t) for k, t in enumerate(_TURNS)]
    rows = rebuilt.groupBy("conv_id", F.coalesce(F.expr(f"pos div {BLOCK}"), F.lit(0)).alias("block")).agg(F.max("n_turns").alias("n_turns"), *cells)
    for lane in (1, 2):
        rows = rows.withColumn(f"x{lane}", _xor([_place(F.col(t), F.col("block") * BLOCK + k, lane) for k, t in enumerate(_TURNS)]))
    return materialize(running(rows, "conv_id", ["block"], xors={"p1": "x1", "p2": "x2"}).drop("x1", "x2"), "trie-blocks")


def _rollup(blocks: DataFrame, **measures: str) -> DataFrame:
    """depth, s1, s2 of every node with its last turn and the measures over all conversations that begin with it."""
    spark, name = blocks.sparkSession, "blocks"
    said = ", ".join(f"{m} AS {c}" for c, m in measures.items())
    turns = ", ".join(_TURNS)
    out = spark.sql(f"SELECT block, p1, p2, {turns}, {BLOCK} - bit_count(grouping_id()) AS level, {said} FROM {{{name}}} GROUP BY block, p1, p2, ROLLUP ({turns})", **{name: blocks})
    out = out.withColumn("last", F.get(F.array(*_TURNS), F.col("level") - 1))
    # shorter conversations have no turn at the further places; the node before a block is the last one of the block before
    out = out.filter("last is not null or level = 0 and block = 0")
    for lane in (1, 2):
        out = out.withColumn(f"s{lane}", _xor([F.col(f"p{lane}"), *(_place(F.col(t), F.col("block") * BLOCK + k, lane) for k, t in enumerate(_TURNS))]))
    return out.select((F.col("block") * BLOCK + F.col("level")).alias("depth"), "s1", "s2", "last", *measures)


def _end_hashes(blocks: DataFrame) -> DataFrame:
    """Of each node at which conversations end, the SHA-256 of their conv_ids, ascending, decimal, joined by commas.

    The ids are sorted by ranges, so that a node with most of the conversations is spread over tasks; what remains for one
    task is to hash a node's text, which has to go in order, a piece at a time.
    """
    ship_package(blocks.sparkSession)
    keys = [F.col("n_turns").alias("depth")] + [_xor([F.col(f"p{lane}"), *(_place(F.col(t), F.col("block") * BLOCK + k, lane) for k, t in enumerate(_TURNS))]).alias(f"s{lane}") for lane in (1, 2)]
    last = blocks.filter(F.col("block") == F.expr(f"greatest(n_turns - 1, 0) div {BLOCK}")).select(*keys, "conv_id")
    chunk_schema = "depth long, s1 long, s2 long, first long, ids string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for *node, c in zip(*(batch.column(k).to_pylist() for k in (*_NODE, "conv_id")), strict=True):
                if held and (node != key or size > CHUNK_BYTES):
                    out.append((*key, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    key, first = node, c
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if k == 4 else pa.int64()) for k in range(5)], [*_NODE, "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*key, first)), pa.array([",".join(held)])], [*_NODE, "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in (*_NODE, "ids")), strict=True):
                if node != key:
                    if sha is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if k == 3 else pa.int64()) for k in range(4)], [*_NODE, "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([sha.hexdigest()])], [*_NODE, "ends_sha256"])

    chunks = last.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(pieces, chunk_schema)
    return chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashes, "depth long, s1 long, s2 long, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """Every node of the trie of ``rebuilt`` (conv_id, pos, tid, n_turns): conv_id (its smallest conversation), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Totals over subtrees come without going down the tree. Each node belongs to its smallest conversation, and the nodes of a
    conversation r are a chain that ends where r ends. Let W(r) be the sum over its chain. What lies below v are the chains
    of all conversations through v, except that the chain that v is on counts from v on: the sum of W over v's
    conversations, which is one more measure of the ROLLUP, less what stands before v on its own chain. Leaves are counted
    by the conversations whose chain ends in one.
    """
    blocks = _blocks(rebuilt)
    value = (F.col("n_convs") - 1) * F.coalesce(_bytes(F.col("last")), F.lit(0))
    first = _rollup(blocks, n_convs="count(*)", rep="min(conv_id)", longest="max(n_turns)")
    chains = first.groupBy(F.col("rep").alias("conv_id")).agg(F.sum(value).alias("w"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    weighed = join_unique(blocks, materialize(chains, "trie-chains"), ["conv_id"], "left")
    nodes = _rollup(weighed, n_convs="count(*)", conv_id="min(conv_id)", w="coalesce(sum(w), 0)", n_leaves="coalesce(sum(leaf), 0)").withColumn("value", value)
    up = F.col("depth") - 1
    for lane in (1, 2):
        nodes = nodes.withColumn(f"u{lane}", F.col(f"s{lane}").bitwiseXOR(_place(F.col("last"), up, lane)))
    nodes = running(nodes.drop("last"), "conv_id", ["depth"], sums={"above": "value"}, number="at")
    nodes = materialize(nodes.select("conv_id", *_NODE, "u1", "u2", "n_convs", "n_leaves", (F.col("w") - F.col("above")).alias("saved_tokens"), "at"), "trie-nodes")
    parent = [up.alias("depth"), F.col("u1").alias("s1"), F.col("u2").alias("s2")]
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    # a node that isn't the first of its chain has its parent there; others are found by the parent's key
    branches = materialize(nodes.filter("depth > 0 and at = 0").select(*parent, F.col("s1").alias("c1"), F.col("s2").alias("c2")), "trie-branches")
    above = join_unique(branches, nodes.select(*_NODE, F.col("conv_id").alias("parent")), _NODE).select((F.col("depth") + 1).alias("depth"), F.col("c1").alias("s1"), F.col("c2").alias("s2"), "parent")
    out = nodes.join(children, _NODE, "left").join(above, _NODE, "left").join(_end_hashes(blocks), _NODE, "left")
    own = F.when((F.col("depth") > 0) & (F.col("at") > 0), F.col("conv_id")).otherwise(F.col("parent"))
    return out.select("conv_id", "depth", own.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, span: int = 5, most: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuild`` and ``prefix_trie``).

    Null role or text is empty; null turns come first; turns of one number are in the order of their hashes; repeated rows are
    turns of their own. Rows without a conv_id are left out. No conversations give no nodes, not even the root. Other
    columns aren't looked at. A conversation of any length, and a prefix, turn or text that most conversations share, are
    spread over tasks.
    """
    turns = order_turns(conversations)
    return prefix_trie(rebuild(materialize(turns, "trie-turns"), span, most))
