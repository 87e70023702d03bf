"""Corpus pipeline: documents to packed training sequences.

Five stages, each one operator of ``logsieve.llm`` with production parameters:

1. quality rules: failing lines are removed, rejected documents go;
2. exact dedup: of equal texts (A-Z folded) the smallest id stays;
3. near dedup: of each group of near copies (five-word shingles, similarity of 0.8
   or more) the smallest id stays;
4. mixing: sources at tempered weights, every document drawn at least once, none
   more than twice, in the order of the draw;
5. packing: pieces of at most 1024 tokens in as few sequences as possible.

Every stage but the last returns the columns of ``documents``; the last returns a
row for each piece. A document drawn twice is packed twice.

Defined results: null and empty texts fail the quality rules. Rows that repeat both text and id stay once; of rows that
repeat an id with different texts each is judged by its text, and near dedup by the id's smallest component. Ties keep the smallest id. A null id stays
null; a null source is the source of the empty name to mixing and stays null. Very long texts pass whole and are cut by
packing only. Columns beyond those of ``documents``, whatever their names, go in the first stage. An empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import content_sort, line_rules, mixing, near_dup, packing
from logsieve.llm.runtime import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = line_rules.judge_lines(docs.select(*COLUMNS), rules=line_rules.PRODUCTION)
    # One row or none for each document: a filter on top would evaluate the rules twice.
    row = F.struct(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source", F.char_length("clean_text").cast("long").alias("n_chars")
    )
    kept = judged.select(F.explode(F.when(F.col("kept"), F.array(row))).alias("row"))
    return kept.select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.sort_content(docs.select(*COLUMNS), keep="smallest").where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_weights),
    ("packing", best_fit_packing),
]

#: SQL expresses neither the tokenizer nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what passes between stages is checkpointed."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
