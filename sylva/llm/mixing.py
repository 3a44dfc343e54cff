"""Temperature mixing of sources: exponentiated token shares, an exponent found by bisection, block permutations up to a budget.

All of it is DataFrame operations. A source's documents are dealt by hash into blocks; an epoch of a source is a
permutation of its blocks. Whole epochs need no ordering, and of the last epoch only one block for each source is cut
document by document, so no source is ever sorted or summed in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.runtime import materialize

#: Hash slots of a source; a block is a run of slots.
SLOTS = 1 << 16
#: Tokens of a block, while a source has no more blocks than slots.
BLOCK_TOKENS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixTarget:
    """``entropy``: how far from the natural mixture's entropy (0) to the uniform one's (1); ``max_repeats``: passes over
    any source at most (at least what the budget itself needs); ``budget``: tokens of the mixture as a part of all tokens."""

    entropy: float = 0.5
    max_repeats: float = 4.0
    budget: float = 1.0


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def find_exponent(sources: DataFrame, target: MixTarget, probes: int = 64, passes: int = 6) -> float:
    """The exponent of the shares: bisection between 0 (uniform) and 1 (natural), by ``probes`` cuts in each pass over the
    sources for the target entropy and as many for the repetition limit.

    Entropy falls and repetition falls as the exponent grows. The result is the exponent of the target entropy, or the
    least one that keeps the repetition limit if that is larger; rounded to 6 places.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    if not total.t or total.n < 2:
        return 1.0
    t, n, p_min, budget = total.t, total.n, total.least / total.t, target.budget

    def measure(alphas: set[float]) -> dict[float, tuple[float, float]]:
        """Entropy, and passes over the smallest source, of each exponent."""
        p = F.col("tokens") / F.lit(float(t))
        grid = sources.select(p.alias("p"), F.explode(F.array(*[F.lit(float(a)) for a in sorted(alphas)])).alias("a"))
        rows = grid.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("e")).collect()
        return {r.a: (math.log(r.z) - r.a * r.e / r.z, budget * p_min ** (r.a - 1) / r.z) for r in rows}

    brackets, most = [(0.0, 1.0), (0.0, 1.0)], [math.inf, max(target.max_repeats, budget)]
    for turn in range(passes):
        grids = [[a + (b - a) * (i + 1) / (probes + 1) for i in range(probes)] for a, b in brackets]
        found = measure({1.0, *grids[0], *grids[1]})
        if not turn:
            natural = found[1.0][0]
            most[0] = natural + target.entropy * (math.log(n) - natural)
        for k, (a, b) in enumerate(brackets):
            a = max([a, *(x for x in grids[k] if found[x][k] > most[k])])
            brackets[k] = a, min([b, *(x for x in grids[k] if x > a)])
    return round(max(b for _, b in brackets), 6)


def mix(docs: DataFrame, target: MixTarget = MixTarget(), keep: tuple[str, ...] = ("doc_id",), seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:  # noqa: B008
    """The mixture: a row for each time that a document is used, with the ``keep`` columns and mix_source, mix_tokens
    (words of the text), mix_weight (of the source), mix_epoch (from 0) and mix_block (its block in the epoch's permutation).

    A source's quota is its weight times the budget. Whole epochs take each document once; the last one takes the blocks
    in the order of the permutation while they fit in what is left of the quota, and of the first block that doesn't fit,
    the documents in hash order while they fit. A document that doesn't fit in the quota of its source is left out.

    Null text: 0 tokens. A null source is the source ''. Rows without a doc_id are ordered by a hash of their text. Documents of 0 tokens go with their block. Rows that share a
    doc_id are separate documents; ties in hash order are broken by doc_id, then by tokens. Empty input: empty result. A
    column to keep that has one of these names gives way.
    """
    keep = tuple(k for k in keep if k not in ("mix_source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block"))
    d = docs.select(*[F.col(f"`{k}`").alias(f"keep_{k}") for k in keep], F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit("")).alias("id"), token_count(F.col(text)).alias("tokens"))
    d = d.withColumn("slot", F.pmod(_hash32(F.lit(seed), F.col("id")), F.lit(SLOTS)))
    slots = materialize(d.groupBy("source", "slot").agg(F.sum("tokens").alias("tokens")), "mix-slots")
    totals = slots.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    sources = materialize(totals.filter("tokens > 0"), "mix-sources")
    alpha = find_exponent(sources, target)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    z = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha)))).first()[0] or 1.0
    budget = math.floor(total * target.budget)
    weight = F.round(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha)) / F.lit(z), 9)
    quotas = sources.select(
        "source", F.col("tokens").alias("source_tokens"), weight.alias("weight"), F.floor(weight * F.lit(float(budget))).cast("long").alias("quota"),
        F.greatest(F.lit(1), F.least(F.lit(SLOTS), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)))).cast("long").alias("n_blocks"),
    ).withColumn("epochs", F.expr("quota div source_tokens")).withColumn("left", F.expr("quota - epochs * source_tokens"))

    # the last epoch's permutation of blocks: at most SLOTS rows for each source
    block = F.expr(f"slot * n_blocks div {SLOTS}")
    per_block = slots.join(quotas, "source").groupBy("source", block.alias("block"), "weight", "epochs", "left").agg(F.sum("tokens").alias("block_tokens"))
    order = _hash32(F.lit(seed), F.col("source"), F.col("epochs").cast("string"), F.col("block").cast("string"))
    w = Window.partitionBy("source").orderBy("order", "block")
    plan = per_block.withColumn("order", order).withColumn("end", F.sum("block_tokens").over(w)).withColumn("mix_block", F.row_number().over(w) - 1)
    plan = plan.withColumn("spare", F.col("left") - (F.col("end") - F.col("block_tokens")))
    plan = plan.withColumn("state", F.when(F.col("end") <= F.col("left"), "whole").when(F.col("spare") > 0, "cut").otherwise("out"))
    first_cut = F.min(F.when(F.col("state") == "cut", F.col("mix_block"))).over(Window.partitionBy("source"))
    plan = materialize(plan.withColumn("state", F.when((F.col("state") == "cut") & (F.col("mix_block") != first_cut), "out").otherwise(F.col("state"))).select("source", "block", "weight", "epochs", "mix_block", "spare", "state"), "mix-plan")

    placed = d.join(quotas.select("source", "n_blocks"), "source").withColumn("block", block).drop("n_blocks").join(plan, ["source", "block"])
    whole = placed.filter("state <> 'cut'").withColumn("uses", F.col("epochs") + F.when(F.col("state") == "whole", 1).otherwise(0))
    inside = Window.partitionBy("source").orderBy(_hash32(F.lit(seed), F.lit("doc"), F.col("epochs").cast("string"), F.col("id")), "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.filter("state = 'cut'").withColumn("so_far", F.sum("tokens").over(inside)).withColumn("uses", F.col("epochs") + F.when(F.col("so_far") <= F.col("spare"), 1).otherwise(0)).drop("so_far")
    used = whole.unionByName(cut).filter("uses > 0")
    out = used.select(*[F.col(f"`keep_{k}`").alias(k) for k in keep], F.col("source").alias("mix_source"), F.col("tokens").alias("mix_tokens"), F.col("weight").alias("mix_weight"), F.explode(F.expr("sequence(0L, uses - 1)")).alias("mix_epoch"), F.col("mix_block").cast("long").alias("mix_block"))
    return out
