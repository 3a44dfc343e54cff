"""The corpus pipeline: stages that turn ``documents`` into a training mixture.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each stage's result as
Parquet in the shared folder and reads it again, so that a lost executor never sends the work back beyond a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.decontaminate import remove_items
from sylva.llm.jaccard_join import Rule, keep_one
from sylva.llm.mixing import MixTarget, mix
from sylva.llm.quality import fit_quality, quality_udf
from sylva.llm.toxicity import fit_toxicity, with_score
from sylva.runtime import discard, fresh_name, materialize, table

#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
NEAR = Rule(words=5, num=4, den=5)
LEAST_QUALITY, MOST_TOXIC = 0.5, 0.3
TARGET = MixTarget(entropy=0.5, max_repeats=4.0, budget=1.0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of at least the second lowest grade is 1/2 or more, by their texts alone.

    Null and empty texts have no features: the thresholds alone decide on them, for all alike. Repeated rows, and rows of one
    doc_id, are judged each by its text; a null doc_id has no label and is judged like others. No labels or one grade:
    all stay. All columns are kept, whatever their names.
    """
    model, name = fit_quality(docs, table(spark, sf_dir, "labels")), fresh_name(docs, "quality")
    scored = docs.withColumn(name, quality_udf(spark, model)(F.col("text").cast("binary")))
    return scored.filter(F.col(f"{name}.tail_prob") >= LEAST_QUALITY).drop(name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, by their texts alone.

    Null and empty texts show no evidence and stay. Repeated rows are judged alike; a null doc_id has no label. No labels or
    labels of one class: a constant score, below 0.3 unless all are toxic. All columns are kept, whatever their names.
    """
    name = fresh_name(docs, "toxicity")
    return with_score(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), name=name).filter(F.col(name) < MOST_TOXIC).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the smallest doc_id; links are exact, ties don't matter.

    Rows without a doc_id, and texts without words, are duplicates of nothing and stay. Rows that share the kept doc_id stay
    together. All columns are kept, whatever their names.
    """
    return keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their passages of test items, n_chars counted anew; documents that are mostly such passages go.

    Null and empty texts, and texts without hits, stay as they are. No items: nothing changes. Repeated rows are treated
    alike. All columns are kept, whatever their names.
    """
    return remove_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: a row for each use of a document, with its place in the mixture.

    A null source is the source '', a null text has no tokens; repeated rows are documents of their own, and ties of their
    order are broken by doc_id and tokens. A column of the documents that has a name of the mixture's gives way.
    """
    return mix(docs, TARGET, keep=tuple(docs.columns))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifiers' fits can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents. The table of a stage is deleted when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
