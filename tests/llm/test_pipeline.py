"""The pipeline on the smallest tables: each stage's decisions take effect on what the one before kept."""

import math
import re
import zlib

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from sylva.llm import sql
from sylva.llm.quality import fit_quality
from sylva.llm.registry import queries
from sylva.llm.toxicity import fit_toxicity
from sylva.runtime import table

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in table(spark, SMALL, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(before)
        changed = {i for i in now if now[i] != before[i]}
        assert not changed or name == "decontamination"
        if name == "near_duplicates":
            from tests.llm.test_matching import brute_components

            found = brute_components(list(before.items()), corpus_pipeline.NEAR)
            assert set(now) == {i for i, (_, c) in found.items() if i == c}
        if name == "decontamination":
            from tests.llm.test_matching import brute_items

            items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
            hit = {i for i, t in before.items() if brute_items(t, items)[1]}
            assert hit and changed <= hit and not any(brute_items(t, items)[1] for t in now.values())
        if name == "quality":
            gone = set(before) - set(now)
            judged = [i for i in before if i in labels]
            assert sum((i in gone) == (labels[i].quality == 0) for i in judged) / len(judged) > 0.9
            prob = brute_quality(spark, before)
            assert all((p >= 0.5) == (i in now) for i, p in prob.items() if abs(p - 0.5) > 1e-4)
        if name == "toxicity":
            score = brute_toxicity(spark, before, labels)
            assert all((x < 0.3) == (i in now) for i, x in score.items() if abs(x - 0.3) > 1e-6)
        before = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    # the mixture of these documents by the SQL of the operator's own query
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(sql.oracles([], [], [])["op3_source_mixing"])
    assert sorted(map(str, map(tuple, out.select(*want.columns).collect()))) == sorted(map(str, want.fetchall())) and out.count() > 0


def brute_quality(spark, texts):
    """P(at least the second lowest grade) of each text, its features made one by one, by the weights that the stage fits."""
    from tests.llm.test_scoring import brute_features

    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = fit_quality(rows, table(spark, SMALL, "labels"))
    return {i: 1 / (1 + math.exp(model.thresholds[0] - sum(float(model.weights[k]) * x for k, x in brute_features(t).items()))) for i, t in texts.items()}


def brute_toxicity(spark, texts, labels):
    """The score of each text: its words' evidence by counting in plain Python, by the link that the stage fits."""
    from tests.llm.test_scoring import brute_evidence

    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    link = fit_toxicity(rows, table(spark, SMALL, "labels")).link
    learnt = [(texts[i], labels[i].toxic > 0) for i in texts if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    out = {}
    words = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    evidence, at = brute_evidence(learnt, texts.values()), 0
    for i, w in words.items():
        x = sum(max(min(e, 8.0) - 0.5, 0.0) for e in evidence[at : at + len(w)]) / math.sqrt(max(len(w), 1))
        at += len(w)
        out[i] = 1 / (1 + math.exp(-(link[0] + link[1] * x)))
    return out


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, extra columns of clashing names."""
    docs = table(spark, SMALL, "documents").limit(120)
    names = ["quality", "_quality", "toxicity", "gone", "cut", "row", "entries", "mix_epoch", "label", "features"]
    long = " ".join(f"word{k % 977} of {k % 31}" for k in range(60_000)) + "."
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9001, None, "en", "web", None), (9002, "", "en", None, 0), (9003, " \n\t", None, "web", 3), (9004, long, "en", "web", len(long)), (9004, long, "en", "web", len(long)), (None, "Some plain words without a number.", "en", "web", 34)],
        docs.schema,
    )
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    docs = corpus_pipeline.materialize(docs, "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SMALL), f"odd-{name}")
        assert docs.columns == before.columns and docs.exceptAll(before).filter("doc_id is null or doc_id > 9000").count() == 0
        kept = [(r.doc_id, r.text) for r in docs.filter("doc_id is null or doc_id > 9000").collect()]
        # no words, no id: nothing tells against them; copies of a doc_id stay together
        assert {(None, None), (9001, None), (9002, ""), (9003, " \n\t")} <= set(kept) or name == "quality"
        assert sum(t == long for _, t in kept) in (0, 2)
        assert all(r[n] == k for k, n in enumerate(names) for r in docs.select(*names).distinct().collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert set(docs.columns) - {"mix_epoch"} < set(out.columns) and out.filter("mix_epoch = 0").count() <= docs.count()


def test_stages_with_empty_documents(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_registry():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "mixing"]
