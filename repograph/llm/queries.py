"""The registered corpus queries: thin projections of the operators onto their contracts."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm.common import table
from repograph.llm.decontam import contained_items
from repograph.llm.embedding_dedup import embedding_groups
from repograph.llm.html_text import extract_main_text
from repograph.llm.importance import importance_resample
from repograph.llm.lang_id import held_out, predict, train
from repograph.llm.licenses import license_matches
from repograph.llm.line_dedup import line_dedup
from repograph.llm import oracles
from repograph.llm.token_files import read_token_shards, write_token_shards
from repograph.llm.simhash import simhash_groups
from repograph.llm.packing import pack_documents
from repograph.llm.secret_scan import BASE_KINDS, secret_spans, span_string
from repograph.llm.vector_codes import codebook_digest, vector_codes
from repograph.llm.warc import build_index, read_captures, write_archives

#: The tokenizer file of the registered queries; the operators take any path.
VOCAB_PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = oracles.OP5_LINE_DEDUP


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}")
              for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_string("base"), 256).alias("base_sha256"),
                        span_string("spans").alias("spans"))


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op3_decontamination"] = oracles.OP3_DECONTAMINATION


@_query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         "component_id")


@_query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_shards(table(spark, sf_dir, "documents"), VOCAB_PATH, end_id=2)
    return read_token_shards(manifest)


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), VOCAB_PATH)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), RANKS_PATH)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents")).withColumn(
        "base", F.filter("found", lambda m: m["base"]))
    labels = {name: F.array_join(F.array_sort(F.array_distinct(F.transform(
        of, lambda m: m["label"]))), ",").alias(name) for name, of in
        (("base_labels", "base"), ("labels", "found"))}
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels["base_labels"], labels["labels"],
        F.coalesce(F.array_max(F.transform("found", lambda m: m["score"])), F.lit(0.0)).alias("score"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    shards = build_index(write_archives(pages, min_bytes=0))
    return read_captures(pages, shards).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = oracles.OP9_WARC


@_query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = embedding_groups(table(spark, sf_dir, "embeddings"))
    return groups.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLES["op10_embedding_dedup"] = oracles.OP10_EMBEDDING_DEDUP


@_query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebook = vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return codes.select("vec_id", "code", "error", "label_error",
                        F.lit(codebook_digest(codebook, 16)).alias("codebooks_sha256"))


ORACLES["op11_vector_codes"] = oracles.OP11_VECTOR_CODES


@_query
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                max_words=1, buckets=10_000, percent=10, min_words=20, seed="2024")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_importance_resample"] = oracles.OP12_IMPORTANCE_RESAMPLE


@_query
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


ORACLES["op13_html_text"] = oracles.OP13_HTML_TEXT
