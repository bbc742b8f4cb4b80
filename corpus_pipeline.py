"""A training corpus from raw documents: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
with the columns of ``documents``, the last one the encoded corpus. Every stage works on all
rows its predecessor kept.

Edge cases: extra columns, whatever their names, come through all stages but the last; null ids and
repeated rows are rows like others, of which the second stage keeps one a text; empty tables stay
empty; texts of any length are read whole. Each stage's docstring says what becomes of null texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from dumploom.llm import bpe, decontam, langid, ngram_join, suffix_dedup
from dumploom.llm.common import drop_path, scratch_tables, shared_dir

#: A text is rejected if it has no letter, or if its best language knows less than this share of its n-grams.
LEAST_KNOWN = 0.25

#: Scratch tables that the last stage's result reads; by the contract they are free once the next stage begins.
_of_last_stage: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``work``; the scratch tables of the stage before it are deleted first, those of other operators stay."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _free(spark)
        before = set(scratch_tables())
        out = work(spark, docs, sf_dir)
        _of_last_stage.extend(p for p in scratch_tables() if p not in before)
        return out

    return run


def _free(spark: SparkSession) -> None:
    while _of_last_stage:
        drop_path(spark, _of_last_stage.pop())


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's labelled rows teach; null, empty and letterless texts go, and without labels all."""
    return langid.keep_known(docs, langid.fit(langid.training_rows(docs)), LEAST_KNOWN)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; texts without words all stay."""
    return ngram_join.drop_near_duplicates(docs)


@_stage
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 400 that occur elsewhere; rows all stay, null texts too."""
    return suffix_dedup.remove_repeats(docs)


@_stage
def remove_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents with several items go, null texts stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids; a null text has none."""
    import public_tokenizers as P

    return bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("benchmark_items", remove_benchmark_items),
    ("encode", encode),
]

#: Similarity, repeats and byte-pair merging have no SQL form; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder until the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    _free(spark)
    return docs
