"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

language ID -> line dedup -> SimHash near-dedup -> benchmark decontamination -> packing.
The first four return the columns of ``documents``; packing returns pieces of token sequences.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from repograph.llm.common import stored, table
from repograph.llm.decontam import clean_documents
from repograph.llm.lang_id import identified_documents, train
from repograph.llm.line_dedup import deduped_documents
from repograph.llm.packing import pack_documents
from repograph.llm.simhash import one_per_group

VOCAB_PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled documents teach."""
    return identified_documents(docs, train(docs, RANKS_PATH))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that an earlier document has; documents stay."""
    return deduped_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of ``benchmark``."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents into sequences: a row per piece, with its ids."""
    return pack_documents(docs, VOCAB_PATH)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: SimHash and the tokenizer cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage keeps is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
