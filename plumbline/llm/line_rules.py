"""Quality rules: base counts of words, symbols, lines and repeats, and a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text_features as tf
from plumbline.llm import words

#: States of a line.
CONTENT, BOILERPLATE = 0, 1

LINE_FEATURES = ("always", "few_words", "many_words", "symbols", "symbol_words", "upper_words", "digits", "same_as_before", "seen_line", "ends_in_mark", "double_marks", "short_words")


def line_features(found: words.Words, lines: tf.Lines) -> np.ndarray:
    """One row of ``LINE_FEATURES``, all between 0 and 1, for each line with a word."""
    raw = found.raw
    has = lines.n_words > 0
    a, b, wa, wb = lines.begin[has], lines.end[has], lines.word_from[has], lines.word_to[has]
    n, size = wb - wa, np.maximum(1, b - a)
    upper, lower = (tf.between(tf.running(k[raw]), found.starts, found.ends) for k in (tf.UPPER, tf.LOWER))
    symbol = tf.between(tf.running(tf.SYMBOLS[raw]), found.starts, found.ends)
    hashes = found.hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    if len(wa):
        same[wa] = False
    mark = tf.MARK[raw]
    double = np.zeros(len(raw), bool)
    double[1:] = mark[1:] & mark[:-1]

    def words_with(flags: np.ndarray) -> np.ndarray:
        return tf.between(tf.running(flags), wa, wb) / n

    last = raw[found.ends[wb - 1] - 1] if len(wb) else raw[:0]
    return np.stack([
        np.ones(len(n)),
        n < 4,
        n > 30,
        np.minimum(1, 5 * tf.between(tf.running(tf.SYMBOLS[raw]), a, b) / size),
        words_with(symbol > 0),
        words_with((upper >= 2) & (lower == 0)),
        np.minimum(1, 5 * tf.between(tf.running(tf.DIGIT[raw]), a, b) / size),
        words_with(same),
        lines.repeats(found)[has],
        tf.MARK[last],
        np.minimum(1, 10 * tf.between(tf.running(double), a, b) / size),
        words_with(found.ends - found.starts <= 3),
    ], axis=1).astype(np.float64)


@dataclass(frozen=True)
class LineModel:
    """``emission`` scores boilerplate against content, ``change[i, j]`` scores state j after state i."""

    emission: np.ndarray
    change: np.ndarray

    def decode(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi: the best state of each line; text i has the lines ``first[i]`` to ``first[i + 1] - 1``. Ties are content."""
        gain = rows @ self.emission
        n = np.diff(first)
        states = np.zeros(len(gain), np.int8)
        came = np.zeros((len(gain), 2), np.int8)
        order = np.argsort(-n, kind="stable")
        alive = int((n > 0).sum())
        begin = first[:-1][order]
        length = n[order]
        best = np.zeros((alive, 2))
        if alive:
            best[:, 1] = gain[begin[:alive]]
        for t in range(1, int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length, -t, side="left"))  # texts with more than t lines
            at = begin[:alive] + t
            from_0, from_1 = best[:alive, 0], best[:alive, 1]
            now = np.empty((alive, 2))
            for s in (0, 1):
                x, y = from_0 + self.change[0, s], from_1 + self.change[1, s]
                came[at, s] = y > x
                now[:, s] = np.maximum(x, y)
            now[:, 1] += gain[at]
            best[:alive] = now
        done = np.flatnonzero(length > 0)
        state = (best[:, 1] > best[:, 0]).astype(np.int8)
        if len(done):
            states[begin[done] + length[done] - 1] = state
        for t in range(int(length[0]) - 1 if len(length) else 0, 0, -1):
            alive = int(np.searchsorted(-length, -t, side="left"))
            at = begin[:alive] + t
            states[at - 1] = came[at, states[at]]
        return states


def learn(rows: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.5, strength: float = 1e-3) -> LineModel:
    """Maximum conditional likelihood by gradient ascent, forward and backward over all texts at once."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, length = first[:-1][order], n[order]
    longest = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest)]
    emission, change = np.zeros(rows.shape[1]), np.zeros((2, 2))
    gold_pairs = np.zeros((2, 2))
    for t in range(1, longest):
        at = begin[: alive[t]] + t
        np.add.at(gold_pairs, (labels[at - 1], labels[at]), 1)
    lines = max(1, len(rows))
    for step in range(rounds):
        gain = rows @ emission
        ahead, behind = np.zeros((len(rows), 2)), np.zeros((len(rows), 2))
        for t in range(longest):
            at = begin[: alive[t]] + t
            if t:
                prev = ahead[at - 1]
                for s in (0, 1):
                    ahead[at, s] = np.logaddexp(prev[:, 0] + change[0, s], prev[:, 1] + change[1, s])
            ahead[at, 1] += gain[at]
        for t in range(longest - 1, 0, -1):
            at = begin[: alive[t]] + t
            after = behind[at].copy()
            after[:, 1] += gain[at]
            for s in (0, 1):
                behind[at - 1, s] = np.logaddexp(change[s, 0] + after[:, 0], change[s, 1] + after[:, 1])
        both = ahead + behind
        total = np.logaddexp(both[:, 0], both[:, 1])
        is_1 = np.exp(both[:, 1] - total)
        pairs = np.zeros((2, 2))
        for t in range(1, longest):
            at = begin[: alive[t]] + t
            for i in (0, 1):
                for j in (0, 1):
                    pairs[i, j] += np.exp(ahead[at - 1, i] + change[i, j] + j * gain[at] + behind[at, j] - total[at]).sum()
        now = rate * 8 / (1 + step / 100)
        emission = emission + now * ((labels - is_1) @ rows / lines - strength * emission)
        change = change + now * ((gold_pairs - pairs) / lines - strength * change)
    return LineModel(emission, change)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 200, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> LineModel:
    """Learn from labelled documents: lines of a document with label 0 count as boilerplate, with label 1 as content.

    A sample bounded by ``max_docs`` documents of each label, drawn by a hash of the id, with at most ``max_lines`` lines with
    words (longer documents don't serve as examples), so at most max_docs * max_lines rows of line figures reach the
    driver. Without documents of both labels every line is content.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label_column).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    none = LineModel(np.zeros(len(LINE_FEATURES)), np.zeros((2, 2)))
    if len(sizes) < 2:
        return none
    share = F.when(F.col("label") == 1, F.lit(max_docs * 1_000_000 // sizes[1] + 1)).otherwise(F.lit(max_docs * 1_000_000 // sizes[0] + 1))
    drawn = usable.filter(F.pmod(F.xxhash64("id", F.lit("lines")), F.lit(1_000_000)) < share)
    drawn = F.broadcast(drawn)  # about 2 * max_docs rows of an id and a label
    sample = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(drawn, "id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.steps(batches):
            found = words.of(batch.column("text"))
            lines = tf.Lines(found)
            rows = line_features(found, lines)
            n = np.bincount(lines.owner[lines.n_words > 0], minlength=batch.num_rows)
            first = np.concatenate([[0], np.cumsum(n)])
            flat = [rows[a:b].astype(np.float32).tobytes() if b - a <= max_lines else b"" for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "rows": pa.array(flat, pa.binary())})

    got = sample.mapInArrow(run, "label int, rows binary").filter(F.length("rows") > 0).orderBy("label", F.xxhash64("rows")).toArrow().to_pylist()
    if len({r["label"] for r in got}) < 2:
        return none
    rows = [np.frombuffer(r["rows"], np.float32).reshape(-1, len(LINE_FEATURES)).astype(np.float64) for r in got]
    n = np.array([len(x) for x in rows])
    is_junk = np.repeat(np.array([1 - r["label"] for r in got]), n)
    return learn(np.concatenate(rows), np.concatenate([[0], np.cumsum(n)]), is_junk)


def judge(
    docs: DataFrame,
    model: LineModel,
    least_content: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    width: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Base counts and the verdict for every whole text.

    Columns: doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words (words in windows of ``width`` words that the text holds twice or more), base_failed
    (fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them repeated), content_words (words of lines
    that the field marks as content), and kept: not base_failed, and content words are at least ``least_content`` of
    all. Null and empty texts have counts of 0 and fail. Repeated ids and rows each get a row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.emission, model.change))
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = LineModel(*shared.value)
        for batch in words.steps(batches):
            found = words.of(batch.column("text"))
            raw, bounds, first = found.raw, found.bounds, found.first
            lines = tf.Lines(found)
            has = lines.n_words > 0
            owner = lines.owner[has]
            per = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
            state = field.decode(line_features(found, lines), per)
            content = np.bincount(owner, lines.n_words[has] * (state == CONTENT), batch.num_rows).astype(np.int64)
            n = np.diff(first)
            repeats = words.per_text(tf.repeated_windows(found.hashes(), first, width), first)
            bad = (n < min_words) | (100 * repeats > max_repeat_percent * n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": n.astype(np.int64),
                "word_chars": tf.between(tf.running(tf.FIRST_BYTE[raw] & found.solid), bounds[:-1], bounds[1:]),
                "n_symbols": tf.between(tf.running(tf.SYMBOLS[raw]), bounds[:-1], bounds[1:]),
                "n_dup_lines": np.bincount(lines.owner[lines.repeats(found)], minlength=batch.num_rows).astype(np.int64),
                "n_repeat_words": repeats,
                "content_words": content,
                "base_failed": bad,
                "kept": ~bad & (content >= least_content * n),
            })

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
