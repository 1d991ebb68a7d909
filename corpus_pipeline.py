"""The corpus pipeline: five stages from raw documents to token ids. Part of subpackage llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it back as the
next stage's docs. All but the last return the columns of documents.

Defined cases: null and empty texts, and texts of white space, fail the quality rules and go; very long texts pass every stage whole; repeated rows
are judged alike and become one in exact dedup, of equal texts the one with the largest doc_id, and of a group of near copies the one with the
smallest; a null doc_id passes like others, but is never the reason for another row to go; ties are decided as the stages' operators say; an empty
table passes every stage; other columns, whatever their names, stay with their rows until the last stage, whose outputs replace columns of their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import bpe, dedup, jaccard, mixing, quality
from hearthline.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_stage(spark, docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.dedup_stage(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links stays; shingles of five words and a similarity of 0.8."""
    return jaccard.jaccard_stage(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixing_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep_ids=True).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Quality scores, budget fitting and BPE aren't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, tables.table(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
