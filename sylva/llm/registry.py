"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.llm import sql
from sylva.runtime import table

#: URL rules of the ``op2`` query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Words of which sites to block are named, two with a hyphen between, under the given ends: all pairs of different words
#: make the list of the ``op2`` query, as canonical URLs with the path /.
SITE_WORDS = "best bets bingo bonus buy casino cheap cialis dating deals diet escort free hot loans lotto lucky online pills poker porn replica slots viagra win xxx".split()
SITE_ENDS = ["com", "net", "org", "example.com", "example.net", "example.org"]


def listed_urls(spark):
    """host, path, verdict, is_rule: the rules, and the sites to block."""
    words, ends = (F.array(*[F.lit(w) for w in x]) for x in (SITE_WORDS, SITE_ENDS))
    sites = spark.range(1).select(F.explode(words).alias("a")).select("a", F.explode(words).alias("b")).filter("a <> b").select("a", "b", F.explode(ends).alias("c"))
    sites = sites.select(F.concat("a", F.lit("-"), "b", F.lit("."), "c").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))
    return spark.createDataFrame([(*r, True) for r in URL_RULES], "host string, path string, verdict string, is_rule boolean").unionByName(sites)


def op1_quality_classifier(spark, sf_dir):
    from sylva.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark, sf_dir):
    from sylva.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), listed_urls(spark))


def op3_source_mixing(spark, sf_dir):
    from sylva.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    from sylva.llm.decontaminate import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def op5_toxicity(spark, sf_dir):
    from sylva.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    from sylva.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_html_extraction(spark, sf_dir):
    from sylva.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark, sf_dir):
    from sylva.llm.jaccard_join import Rule, jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), Rule(words=3, num=9, den=10))


def op9_perplexity_rules(spark, sf_dir):
    from sylva.llm.perplexity import perplexity_rules

    return perplexity_rules(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    from sylva.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_token_files(spark, sf_dir):
    import public_tokenizers

    from sylva.llm.token_files import token_file_round_trip

    return token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_prefix_trie(spark, sf_dir):
    from sylva.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark, sf_dir):
    from sylva.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = (
        op1_quality_classifier, op2_url_filter, op3_source_mixing, op4_decontamination, op5_toxicity, op6_token_counts,
        op7_html_extraction, op8_jaccard_join, op9_perplexity_rules, op10_warc, op11_token_files, op12_prefix_trie,
        op13_collocations, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql():
    return sql.oracles(URL_RULES, SITE_WORDS, SITE_ENDS)
