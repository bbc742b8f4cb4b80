"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dumploom.llm import bpe, decontam, html_extract, langid, ngram_join, shards, suffix_dedup, token_files, toxicity, vector_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_bitmask": langid.query,
    "op2_host_path_extraction": html_extract.query,
    "op3_byte_bpe": bpe.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_token_files": token_files.query,
    "op6_splitter_shards": shards.query,
    "op7_vector_join": vector_join.query,
    "op8_decontamination": decontam.query,
    "op9_toxicity": toxicity.query,
    "op10_ngram_join": ngram_join.query,
}

#: Only decontamination has whole results that SQL can state; the other queries are tested against brute force.
ORACLE: dict[str, str] = {"op8_decontamination": decontam.ORACLE}
