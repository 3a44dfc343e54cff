"""The conversation trie against brute force, and the steps it shares with others."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sylva.llm import shared_steps
from sylva.llm.prefix_trie import conversation_trie
from sylva.llm.shared_steps import join_unique, running

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie by the definition; rows are (conv_id, turn, role, text)."""
    said = lambda r, t: f"{len(r.encode())}:{r}{t}"
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.sha256(said(role or "", text or "").encode()).digest()[:16]), (role or "", text or "")))
    order = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    built = {}
    for c, own in order.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = order.get(c - c % 5, [])[:h] + own[h:]
    nodes, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    totals = {}
    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below = [totals[k] for k in children.get(key, [])]
        totals[key] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(
        (min(cs), len(key), min(nodes[key[:-1]]) if key else None, len(cs), len(children.get(key, [])), *totals[key], hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest())
        for key, cs in nodes.items()
    )


def trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, *more.values()) for r in rows], SCHEMA + "".join(f", {c} string" for c in more))
    return sorted(tuple(r) for r in conversation_trie(df.repartition(3)).select(*COLUMNS).collect())


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_trie_against_brute_force(spark, seed, monkeypatch):
    if seed:  # heavy keys from two rows on
        monkeypatch.setattr(shared_steps, "HEAVY_LEAST", 1)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), 60):
        base = [("user", "hi"), ("bot", "héllo")][: rng.randint(0, 2)]
        for k, (role, text) in enumerate(base + [(rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "ccc", "", None])) for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 16, 17, 40]))]):
            rows.append((c, k, role, text))
    rows += [(1000, None, "user", "no turn"), (1000, 3, "user", "x"), (1000, 3, "user", "x"), (1000, 3, "bot", "y"), (1001, 0, "user", "hi"), (None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    assert key(trie(spark, rows, depth="x", n_convs="y")) == key(brute(rows))


def test_long_and_common_conversations(spark, monkeypatch):
    """One conversation with most of the rows, cut over tasks, and a conversation that most ids have."""
    monkeypatch.setattr("sylva.llm.prefix_trie.CHUNK_BYTES", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(15, k, "user", f"turn {k // 2}") for k in range(300)] + [(16, k, "user", f"turn {k // 2}") for k in range(290)]
        rows += [(c, k, "bot", "same") for c in range(100, 160) for k in range(9)]
        assert key(trie(spark, rows)) == key(brute(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_turnless(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, 0, "user", "a")]  # its base is absent, its own turn is taken off where h > 0
    assert trie(spark, rows) == brute(rows)


def test_running(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(3)
        rows = [(rng.choice([-5, 1, 1, 1, 1, 2**40]), k, rng.randint(-9, 9), rng.getrandbits(63), "x") for k in range(3000)]
        df = spark.createDataFrame(rows, "g long, k long, a long, x long, part string").repartition(7)
        got = {r.k: (r.s, r.y, r.i) for r in running(df, "g", ["k"], {"s": "a"}, {"y": "x"}, "i").collect()}
        state, want = {}, {}
        for g, k, a, x, _ in rows:
            s, y, i = state.get(g, (0, 0, 0))
            want[k] = (s, y, i)
            state[g] = (s + a, y ^ x, i + 1)
        assert got == want
        out = running(df.limit(0), "g", ["k"], {"s": "a"})
        assert out.count() == 0 and out.columns == [*df.columns, "s"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_join_unique(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        monkeypatch.setattr(shared_steps, "HEAVY_LEAST", 1 << 40)
        plain = key(map(tuple, join_unique(rows, table, ["k"], how).collect()))
        monkeypatch.setattr(shared_steps, "HEAVY_LEAST", 10)
        assert key(map(tuple, join_unique(rows, table, ["k"], how).collect())) == plain
        assert len(plain) == (4000 if how == "inner" else 5000)
