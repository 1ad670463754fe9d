"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, line_rules, mixing, near_duplicates, neighbours, packing, prefix_trie, quality, substrings, swap_packing, token_counts, token_files, whitening, words
from plumbline.session import materialise

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

#: Ids that end each document, by the vocabulary of the query.
END_ID = 2
SWAP_END_ID = 0


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf: str) -> DataFrame:
    words.small_batches(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def definition(name: str) -> str:
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def word_bpe() -> str:
    return definition("word_bpe_49k.json")


@query
def op1_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.jaccard_join(documents(spark, sf)).select("doc_id", "class_id", "n_links", "n_shingles")


ORACLES["op1_jaccard_join"] = near_duplicates.JACCARD_SQL


@query
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_files.write_token_files(documents(spark, sf), word_bpe(), END_ID)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return language.predict(docs, language.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rank(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return token_counts.count_tokens(documents(spark, sf), model)


@query
def op6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.in_order(mixing.mix(documents(spark, sf), keep=["doc_id"]))
    return mixed.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op7_mixing"] = mixing.MIX_SQL


@query
def op8_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = line_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return line_rules.judge(docs, model)


def op9_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return op9_digest(packing.pack(documents(spark, sf), word_bpe(), END_ID))


@query
def op10_substrings(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    spans = materialise(substrings.repeated_spans(docs), "repeated-spans")
    cut = substrings.remove_spans(docs, spans, join_all=True)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op10_substrings"] = substrings.SUBSTRING_SQL


@query
def op11_swap_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = swap_packing.pack_whole(documents(spark, sf), definition("byte_bpe_50k.json"), SWAP_END_ID)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))
