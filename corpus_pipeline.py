"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, mixing, near_duplicates, packing, substrings, words
from plumbline.llm.queries import END_ID, documents, op9_digest, word_bpe
from plumbline.session import materialise

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those that get ``und`` or a posterior below ``LEAST_SCORE`` go."""
    words.small_batches(spark)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    predicted = language.predict(rows, language.fit(docs), keep=["row"])
    return predicted.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect: the one with the smallest id."""
    words.small_batches(spark)
    return near_duplicates.keep_first(docs, materialise(near_duplicates.jaccard_join(docs), "near-duplicates"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller id has; n_chars follows the text."""
    words.small_batches(spark)
    cut = substrings.remove_spans(docs, materialise(substrings.repeated_spans(docs), "repeated-spans"))
    changed = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        own = F.col("text") if c == "text" else F.col("row")[c]
        if c == "n_chars":
            own = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return cut.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row for each copy that the mix takes, in the order of the curriculum."""
    return mixing.stream(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, as ``op9_packing`` gives them."""
    words.small_batches(spark)
    return op9_digest(packing.pack(docs, word_bpe(), END_ID))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Code lengths, tokens and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
