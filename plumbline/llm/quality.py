"""Quality of documents by pairwise ranking after Bradley and Terry."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text_features as tf
from plumbline.llm import words
from plumbline.llm.folds import held_out
from plumbline.plans.ranks import exact_quantiles
from plumbline.session import materialise

FEATURES = (
    "log_words", "log_lines", "word_length", "long_words", "short_words", "capitals", "upper_words", "symbols", "symbol_words", "bare_symbol_words",
    "digits", "marks", "double_marks", "same_as_before", "distinct_words", "repeated_windows", "repeated_lines", "words_per_line", "non_ascii", "braces",
)

_BRACE = np.zeros(256, bool)
_BRACE[list(b"{}[]()=/\\_@")] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all 0 for a null or empty one."""
    found = words.of(texts)
    raw, first, bounds = found.raw, found.first, found.bounds
    n, size = np.diff(first), np.diff(bounds)
    length = found.ends - found.starts
    hashes = found.hashes()
    lines = tf.Lines(found)
    n_lines = np.maximum(1, np.bincount(lines.owner[lines.n_words > 0], minlength=len(n)))

    def in_words(kind: np.ndarray) -> np.ndarray:
        total = tf.running(kind[raw])
        return tf.between(total, found.starts, found.ends)

    upper, lower, symbols = in_words(tf.UPPER), in_words(tf.LOWER), in_words(tf.SYMBOLS)
    mark = tf.MARK[raw]
    double = np.zeros(len(raw), bool)
    double[1:] = mark[1:] & mark[:-1]
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][n > 0]] = False
    owner = np.repeat(np.arange(len(n)), n)

    order = np.lexsort((hashes, owner))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(n))
    words_, bytes_ = np.maximum(1, n), np.maximum(1, size)

    def by_word(flags: np.ndarray) -> np.ndarray:
        return words.per_text(flags, first) / words_

    def by_byte(kind: np.ndarray) -> np.ndarray:
        return tf.between(tf.running(kind), bounds[:-1], bounds[1:]) / bytes_

    out = np.stack([
        np.log1p(n),
        np.log1p(n_lines) * (n > 0),
        by_word(length),
        by_word(length > 14),
        by_word(length <= 3),
        by_byte(tf.UPPER[raw]),
        by_word((upper >= 2) & (lower == 0)),
        by_byte(tf.SYMBOLS[raw]),
        by_word(symbols > 0),
        by_word((symbols > 0) & (upper + lower == 0)),
        by_byte(tf.DIGIT[raw]),
        by_byte(mark),
        by_byte(double) * 10,
        by_word(same),
        distinct / words_,
        by_word(tf.repeated_windows(hashes, first, 3)),
        np.bincount(lines.owner[lines.repeats(found)], minlength=len(n)) / n_lines,
        np.log1p(n / n_lines),
        by_byte(raw >= 0x80),
        by_byte(_BRACE[raw]),
    ], axis=1)
    return out.astype(np.float64)


def featured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id and features (array of double) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.steps(batches):
            rows = features(batch.column("text"))
            flat = pa.array(rows.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "features"])

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {id_type}, features array<double>")


@dataclass(frozen=True)
class QualityModel:
    """``score = sigmoid(weights . clip((features - mean) / spread) - cut + logit(level))``: ``level`` where the raw score is ``cut``."""

    mean: list[float]
    spread: list[float]
    weights: list[float]
    cut: float
    level: float

    def raw(self, column: Column) -> Column:
        terms = [F.lit(w) * _standard(column[k], m, s) for k, (w, m, s) in enumerate(zip(self.weights, self.mean, self.spread, strict=True)) if w]
        out = F.lit(0.0)
        for t in terms:
            out = out + t
        return out

    def score(self, column: Column) -> Column:
        return 1 / (1 + F.exp(-(self.raw(column) - F.lit(self.cut) + F.lit(math.log(self.level / (1 - self.level))))))


def _standard(x: Column, mean: float, spread: float) -> Column:
    return F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (x - F.lit(mean)) / F.lit(spread)))


def fit(
    scored: DataFrame,
    labels: DataFrame,
    level: float = 0.7,
    max_rows: int = 40_000,
    pairs_per_row: int = 6,
    strength: float = 1e-3,
    label_column: str = "quality",
) -> QualityModel:
    """Learn weights from preference pairs: a document with label 1 is preferred to one with label 0.

    ``scored`` has doc_id and features. Labelled rows that are not held out count; about ``max_rows`` of them are drawn by a hash
    of the id. Each gets ``pairs_per_row`` slots by hash, a pair is one row of either label in one slot, and the logistic
    loss on the difference of their features is minimised without an intercept. The cut is the exact quantile of the raw
    scores of all labelled rows that are not held out, drawn or not, that leaves as many above as have label 1; there the score is
    ``level``. Without rows of both labels every score is the same: above ``level`` if only 1 was seen, else below. Labels that differ from 0 and 1,
    null ids and repeated rows of a label (each counts) do no harm.
    """
    usable = labels.select("doc_id", F.col(label_column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    total = max(1, usable.count())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < min(1_000_000, max_rows * 1_000_000 // total + 1)
    train = materialise(scored.join(usable.filter(drawn), "doc_id"), "quality-train")
    n = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    width = len(FEATURES)
    if not 0 < n["ones"] < n["n"]:
        return QualityModel([0.0] * width, [1.0] * width, [0.0] * width, -1.0 if n["ones"] else 1.0, level)
    moments = train.agg(*[f(F.col("features")[k]).alias(f"{f.__name__}{k}") for k in range(width) for f in (F.avg, F.stddev_pop)]).first()
    mean = [moments[f"avg{k}"] for k in range(width)]
    spread = [max(moments[f"stddev_pop{k}"], 1e-9) for k in range(width)]
    standard = train.select("doc_id", "label", F.array(*[_standard(F.col("features")[k], mean[k], spread[k]) for k in range(width)]).alias("x"))
    slots = max(n["ones"], n["n"] - n["ones"]) * pairs_per_row
    dealt = standard.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(pairs_per_row)))).withColumn("slot", F.pmod(F.xxhash64("doc_id", "round", "label"), F.lit(slots)))
    good = dealt.filter("label = 1").select("slot", F.col("x").alias("good"), "doc_id")
    bad = dealt.filter("label = 0").select("slot", F.col("x").alias("bad"))
    flip = F.pmod(F.xxhash64("doc_id", "slot"), F.lit(2)) * 2 - 1
    pairs = good.join(bad, "slot").select(
        ((flip + 1) / 2).cast("double").alias("label"),
        array_to_vector(F.zip_with("good", "bad", lambda a, b: (a - b) * flip)).alias("features"),
    )
    pairs = materialise(pairs.coalesce(8), "quality-pairs")
    if pairs.agg(F.countDistinct("label")).first()[0] < 2:
        return QualityModel(mean, spread, [0.0] * width, -1.0 if n["ones"] * 2 > n["n"] else 1.0, level)
    fitted = LogisticRegression(fitIntercept=False, regParam=strength, standardization=False, maxIter=60).fit(pairs)
    model = QualityModel(mean, spread, [float(w) for w in fitted.coefficients], 0.0, level)
    judged = materialise(scored.join(usable, "doc_id").select("label", model.raw(F.col("features")).alias("raw")), "quality-judged")
    ones = judged.agg(F.avg("label")).first()[0]
    ((cut,),) = exact_quantiles(judged, ["raw"], [1 - ones])
    return QualityModel(mean, spread, model.weights, float(cut), level)


def predict(scored: DataFrame, model: QualityModel) -> DataFrame:
    """Columns doc_id, held_out, score and predicted (1 where the score reaches the model's level)."""
    out = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("features")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.level).cast("int"))


def rank(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Features, fit and scores in one call. Null and empty texts have features of 0 and a score like any other."""
    scored = materialise(featured(docs, id_column, text_column), "quality-features")
    return predict(scored, fit(scored, labels))
