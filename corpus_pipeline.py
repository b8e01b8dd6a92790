"""Cleans the documents in five stages: quality rules, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
documents, the last one digests of the tokens. ``run`` writes each stage's rows to the shared folder and reads them again.

A stage that changes the text sets n_chars anew. An empty table stays empty; null texts fail the first stage and are near
copies of nothing in the second. Rows are told apart by numbers of their own where a stage joins its verdict to them, so null
or repeated ids neither lose rows nor share a verdict; of equal rows one stays. Of columns other than those of documents none
is read or returned, so none can clash. Very long texts are worked on whole.
"""

from __future__ import annotations

import functools

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import bpe, decontaminate, jaccard, quality, queries, suffix_dedup
from inkframe.llm.common import Scratch, numbered, table
from inkframe.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a passage that two documents may not share.
PASSAGE = 51
_held: list[Scratch] = []


def _stage(f):
    """When a stage begins, the result of the one before has been written, so the tables that it was read from go."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        for s in _held:
            if s.spark is spark:
                s.drop(*list(s.paths))
        _held.clear()
        before = len(Scratch.made)
        out = f(spark, docs, sf_dir)
        _held.extend(Scratch.made[before:])
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    ratio = quality.fit(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality.score(docs.select(*COLUMNS), ratio).where("kept").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    rows = numbered(docs.select(*COLUMNS), Scratch(spark, "rows"))
    found = jaccard.groups(rows, "_row").join(rows.select("_row", "doc_id"), "_row")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("f")).select("f._row")
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 400 bytes that occur twice, and passages of over 50 words that stand in two documents; documents without a word left go."""
    out = suffix_dedup.dedup(docs.select(*COLUMNS), words=PASSAGE).where(r"n_removed = 0 OR text RLIKE r'[^\x20\x09-\x0D]'")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with windows of two benchmark items or more."""
    rows = numbered(docs.select(*COLUMNS), Scratch(spark, "rows"))
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), "_row")
    return rows.join(found.where("contaminated").select("_row"), "_row", "left_anti").select(*COLUMNS)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return bpe.digests(docs, tokenizers.path(queries.RANKS), tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark passages", benchmark_passages), ("tokens", tokens)]

#: SQL expresses neither the likelihood ratios nor the merges of the tokenizer; a test compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    s = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = s.store(stage(spark, docs, sf_dir), str(i))
        s.drop(str(i - 1))
    return docs
