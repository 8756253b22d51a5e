"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the folder that driver and executors share and gives it to the next stage. All but the last return the
columns of documents.

1. language ID: documents whose language is undetermined go.
2. toxicity: documents that are predicted toxic go.
3. n-gram Jaccard join: one document of each group of near duplicates (SHINGLE words, PERCENT) stays.
4. mixing: a row for each pass that the schedule makes over a document, cut where the mix ends.
5. BPE: token counts and digests of ids and of the text decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe_tree, common, jaccard_join, language_mix, mix_schedule, toxicity

#: What counts as a near duplicate here; op5_jaccard_join has values of its own.
SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mix.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=SHINGLE, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_schedule.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.drop(before)
        before = docs
    return docs


#: The tokenizer and the learned stages have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None
