"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from mailsift.llm import (
    fingerprints,
    hard_negatives,
    html_extraction,
    language_id,
    lexical_search,
    license_scan,
    mixing,
    neighbours,
    ngram_join,
    packing,
    sharding,
    token_attribution,
    toxicity,
)
from mailsift.llm.common import Workspace, table


def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_fingerprints(spark, sf_dir):
    return fingerprints.edited_versions(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op5_mixing(spark, sf_dir):
    planned = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), Workspace(spark, "mixing"))
    return planned.select("doc_id", *[F.col(f"mix_plan.{c}") for c in ("size", "source_size", "target", "taken")])


def op6_token_attribution(spark, sf_dir):
    return token_attribution.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(
        table(spark, sf_dir, "documents"), Workspace(spark, "ngram-join"), words=3, percent=90)


def op8_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.learn(pages))


def op9_packing(spark, sf_dir):
    return packing.packed(
        table(spark, sf_dir, "documents"), Workspace(spark, "packing"), public_tokenizers.path("word_bpe_49k.json"))


def op10_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "lexical-search"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(
        table(spark, sf_dir, "embeddings").withColumn("label", moved), Workspace(spark, "hard-negatives"))


def op13_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), Workspace(spark, "sharding"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_token_attribution": op6_token_attribution,
    "op7_ngram_join": op7_ngram_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_packing": op9_packing,
    "op10_neighbours": op10_neighbours,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}
