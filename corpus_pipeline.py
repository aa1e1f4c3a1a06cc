"""The corpus pipeline: language ID, toxicity, near duplicates, mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and all but the last return
the columns of ``documents``. ``run`` applies them to the documents of a folder and writes what each stage
returns to the shared folder, from which the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mailsift.llm import language_id, mixing, ngram_join, packing, toxicity
from mailsift.llm.common import Workspace, table

# Near duplicates share 80 % of their distinct five-word shingles.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
# The stages before packing leave their executors less memory than a query of its own has.
CHUNKS_KEPT = 150_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.stage(docs, language_id.learn(docs), Workspace(spark, "language-id"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, Workspace(spark, "near-duplicates"), SHINGLE_WORDS, SIMILARITY_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(mixing.mix(docs, Workspace(spark, "mixing")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, Workspace(spark, "packing"), public_tokenizers.path("word_bpe_49k.json"), chunks_kept=CHUNKS_KEPT)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Trained models and a tokenizer decide; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
