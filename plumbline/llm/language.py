"""Language of texts by prediction by partial matching under frozen statistics.

For each language there is a tree of byte contexts of up to three bytes. A byte that the longest known context has not
seen is coded by an escape and the next shorter context, without the symbols already excluded, down to a uniform code
over all bytes. Statistics are frozen after learning, so the code length of a byte depends on its context alone, and the
lengths of all (context, byte) pairs are a table. The language with the shortest code for the whole text wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.folds import held_out
from plumbline.llm.tokens import per_worker
from plumbline.session import materialise

#: Symbols of the model: 0 stands for every rarer byte and for the place before a text.
ALPHABET = 128
#: Code lengths are whole numbers of this part of a bit, at most 31 bits, so that sums don't depend on their order.
PART = 2048

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``symbol`` maps bytes, ``state`` three preceding symbols to a row of ``cost``; cost[language, state, symbol]."""

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    cost: np.ndarray

    def lengths(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in parts of a bit."""
        sym = self.symbol[raw]
        at = np.zeros(len(raw), np.int32)
        for back in (3, 2, 1):
            before = np.zeros(len(raw), np.uint8)
            before[back:] = sym[:-back] if back < len(raw) else sym[:0]
            for first in range(back):  # nothing stands before a text
                inside = bounds[:-1] + first
                before[inside[inside < bounds[1:]]] = 0
            at = at * ALPHABET + before
        key = self.state[at] * np.int32(ALPHABET) + sym
        out = np.zeros((len(bounds) - 1, len(self.languages)), np.int64)
        total = np.zeros(len(raw) + 1, np.int64)
        for k in range(len(self.languages)):
            np.cumsum(self.cost[k].reshape(-1)[key], out=total[1:])
            out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        return out


def code_lengths(grams: pd.DataFrame, languages: list[str], rare_bytes: int, max_states: int) -> tuple[np.ndarray, np.ndarray]:
    """State map and cost table from counts (lang, key, n) of four-symbol windows, key in base ``ALPHABET``.

    States are the empty context, all contexts of one symbol that occur, and the most frequent longer ones.
    """
    a = ALPHABET
    keys, codes, n = grams["key"].to_numpy(np.int64), grams["lang"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
    # contexts of each order: the last symbols before the coded one
    contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
    room = max_states - 1 - a
    contexts.append(np.arange(a))
    for order in (2, 3):
        own, back = np.unique(keys // a % a**order, return_inverse=True)
        weight = np.bincount(back, n, len(own)) if len(own) else np.zeros(0)
        # a context needs its own shorter context, and at least two symbols seen
        fit = (weight >= 2) & (np.isin(own % a ** (order - 1), contexts[-1]) if order == 3 else True)
        best = np.flatnonzero(fit)
        best = best[np.argsort(-weight[best], kind="stable")][: max(0, room if order == 3 else room // 2)]
        contexts.append(np.sort(own[best]))
        room -= len(best)
    offsets = np.cumsum([0, *[len(c) for c in contexts]])
    cost = np.zeros((len(languages), int(offsets[-1]), a), np.uint16)
    uniform = np.ones(a)
    uniform[0] = rare_bytes
    for lang in range(len(languages)):
        mine = codes == lang
        tables = []
        for order, own in enumerate(contexts):
            table = np.zeros((len(own), a), np.float64)
            context = keys[mine] // a % a**order
            row = np.searchsorted(own, context)
            ok = (row < len(own)) & (own[np.minimum(row, len(own) - 1)] == context) if len(own) else np.zeros(len(context), bool)
            np.add.at(table, (row[ok], keys[mine][ok] % a), n[mine][ok])
            tables.append(table)
        for order, own in enumerate(contexts):
            bits = np.zeros((len(own), a))
            spent = np.zeros(len(own))
            open_ = np.ones((len(own), a), bool)
            for below in range(order, -1, -1):
                row = np.searchsorted(contexts[below], own % a**below)
                seen = tables[below][row] * open_
                total, kinds = seen.sum(1), (seen > 0).sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    here = spent[:, None] - np.log2(seen / (total + kinds)[:, None])
                    bits = np.where(seen > 0, here, bits)
                    left = open_ & ~(seen > 0)
                    # when no symbol is left there is nothing to escape to
                    escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                spent = spent + escape
                open_ = left
            rest = (open_ * uniform).sum(1)
            flat = spent[:, None] + np.log2(np.maximum(rest, 1))[:, None]
            bits = np.where(open_, flat, bits)
            bits[:, 0] += np.where(open_[:, 0], 0.0, np.log2(rare_bytes))
            cost[lang, offsets[order] : offsets[order + 1]] = np.minimum(np.rint(bits * PART), 31 * PART)
    state = np.zeros((a, a, a), np.int32)
    state[:] = offsets[1] + np.arange(a)
    if len(contexts[2]):
        state[:, contexts[2] // a, contexts[2] % a] = offsets[2] + np.arange(len(contexts[2]))
    if len(contexts[3]):
        state.reshape(-1)[contexts[3]] = offsets[3] + np.arange(len(contexts[3]))
    return state.reshape(-1), cost


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (three preceding bytes, byte), zeros before a text, for each language of a batch."""
    for batch in words.steps(batches):
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        raw, bounds = words.utf8(batch.column("text"))
        lead = np.concatenate([np.concatenate([np.zeros(3, np.uint8), raw[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)])
        begins = bounds[:-1] + 3 * np.arange(len(bounds) - 1)
        size = np.diff(bounds)
        window = np.zeros(max(0, len(lead) - 3), np.int64)
        for k in range(4):
            window = window << 8 | lead[k : len(lead) - 3 + k]
        owner = np.repeat(codes, size)
        at = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(len(raw))
        found, n = np.unique(owner.astype(np.int64) << 32 | window[at], return_counts=True)
        yield pa.RecordBatch.from_pydict({"lang": langs.dictionary.take(pa.array(found >> 32)), "gram": found & 0xFFFFFFFF, "n": n})


def fit(
    docs: DataFrame,
    rows_per_language: int = 3000,
    max_states: int = 12_000,
    max_grams: int = 2_000_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> LanguageModel:
    """Learn the statistics from documents with a language that are not held out.

    From each language about ``rows_per_language`` documents are drawn by a hash of the id (whole texts). The model has at
    most ``max_states`` contexts for all languages together, so the cost table is at most ``max_states`` x 128 x 2 bytes
    for each language, and at most ``max_grams`` counts, the largest, come to the driver.
    """
    spark = docs.sparkSession
    usable = ~held_out(F.col(id_column)) & F.col(lang_column).isNotNull()
    sizes = docs.filter(usable).groupBy(F.col(lang_column).alias("lang")).count().collect()  # one row per language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([], np.zeros(256, np.uint8), np.zeros(ALPHABET**3, np.int32), np.zeros((0, 1, ALPHABET), np.uint16))
    # share of each language's rows, in millionths
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1_000_000, rows_per_language * 1_000_000 // r["count"] + 1))])
    drawn = F.pmod(F.xxhash64(F.col(id_column), F.lit("language")), F.lit(1_000_000)) < shares[F.col(lang_column)]
    sample = docs.filter(usable & drawn & F.col(text_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    grams = materialise(sample.mapInArrow(_windows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "byte-windows")
    frequent = grams.groupBy((F.col("gram") % 256).alias("b")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "b").limit(ALPHABET - 1)
    symbol = np.zeros(256, np.uint8)
    for k, r in enumerate(frequent.collect()):
        symbol[r["b"]] = k + 1
    mapped = F.array(*[F.lit(int(s)) for s in symbol])
    key = F.lit(0).cast("long")
    for shift in (24, 16, 8, 0):
        byte = F.shiftright("gram", shift).bitwiseAND(255)
        # a zero byte before the coded one marks the place before a text
        key = key * ALPHABET + F.element_at(mapped, (byte + 1).cast("int"))
    counts = grams.groupBy("lang", key.alias("key")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang", "key").limit(max_grams).toPandas()
    counts["lang"] = counts["lang"].map({name: k for k, name in enumerate(languages)})
    rare = 256 - int((symbol > 0).sum())
    state, cost = code_lengths(counts, languages, rare, max_states)
    return LanguageModel(languages, symbol, state, cost)


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns lang_pred, score, bits_per_byte and held_out of every whole text, after the columns in ``keep`` (default: the id).

    ``score`` is the posterior of the language from the code lengths and equal priors. Ties go to the first language by name.
    A null text or one without a letter, or any text if no language was learned, gets ``und`` with score 0. Rows are
    handled one by one, so repeated ids and rows keep their places. A kept column that is called like a new one is replaced.
    """
    names = model.languages
    shared = docs.sparkSession.sparkContext.broadcast((names, model.symbol, model.state, model.cost))
    new = {"lang_pred", "score", "bits_per_byte", "held_out"}
    keep = [c for c in ([id_column] if keep is None else keep) if c not in new]
    key = hashlib.sha256(model.cost.tobytes() + repr(names).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker("language " + key, lambda: LanguageModel(*shared.value))
        for batch in words.steps(batches, "_text"):
            raw, bounds = words.utf8(batch.column("_text"))
            lettered = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            if names:
                bits = own.lengths(raw, bounds)
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                with np.errstate(under="ignore"):
                    score = 1 / np.exp2(-(bits - least[:, None]) / PART).sum(1)
                per_byte = least / PART / np.maximum(1, np.diff(bounds))
            else:
                best, score, per_byte = np.zeros(len(lettered), int), np.zeros(len(lettered)), np.zeros(len(lettered))
            lang = pa.array([*names, UNKNOWN]).take(pa.array(np.where(lettered & bool(names), best, len(names))))
            known = lettered & bool(names)
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, lang, pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, per_byte, 0.0)), batch.column("_held")], names=[f"c{k}" for k in range(len(keep))] + ["lang_pred", "score", "bits_per_byte", "held_out"])

    text = F.col(text_column)
    source = docs.select(
        *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)],
        text.alias("_text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
        held_out(F.col(id_column)).alias("_held"),
    )
    schema = ", ".join([f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)] + ["lang_pred string, score double, bits_per_byte double, held_out boolean"])
    return source.mapInArrow(run, schema).withColumnsRenamed({f"c{k}": c for k, c in enumerate(keep)})
