"""Token counts by a two-tier table of word lengths, without a shuffle of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.tokens import per_worker

#: Longest text of the sample that frequent words come from.
SAMPLED_BYTES = 1 << 16


class FrequentWords:
    """The most frequent words of a stream of batches by the space-saving rule on batches, in bounded memory.

    Keeps ``size`` counters. When there are more, the smaller ones go and their count becomes the error that later words
    start from, so a word with more than total / size occurrences always stays.
    """

    def __init__(self, size: int) -> None:
        self.size, self.floor, self.counts = size, 0, {}

    def add(self, distinct: np.ndarray, counts: np.ndarray) -> None:
        own, floor = self.counts, self.floor
        for w, n in zip(distinct.tolist(), counts.tolist(), strict=True):
            own[w] = own.get(w, floor) + n
        if len(own) > 4 * self.size:
            self._trim()

    def _trim(self) -> None:
        if len(self.counts) > self.size:
            values = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            order = np.argpartition(values, -self.size)
            self.floor = int(values[order[: -self.size]].max())
            stay = np.zeros(len(values), bool)
            stay[order[-self.size :]] = True
            self.counts = {w: n for (w, n), s in zip(self.counts.items(), stay.tolist(), strict=True) if s}

    def top(self) -> dict[bytes, int]:
        self._trim()
        return self.counts


class Counter:
    """Tokens of each text: first the broadcast table, then the worker's own, then the library."""

    def __init__(self, model: bytes, table: tuple[bytes, bytes], limit: int = 150_000) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lengths, joined = table
        entries = joined.split(b" ") if joined else []
        self.common = dict(zip(entries, np.frombuffer(lengths, np.uint8).tolist(), strict=True))
        self.met: dict[bytes, int] = {}
        self.limit, self.hits, self.misses = limit, 0, 0

    def words(self, distinct: list[bytes]) -> np.ndarray:
        common, met = self.common, self.met
        found = np.fromiter((common.get(w, -1) for w in distinct), np.int64, len(distinct))
        open_ = np.flatnonzero(found < 0)
        if len(open_):
            if len(met) > self.limit:
                met.clear()
            rest = [distinct[k] for k in open_.tolist()]
            own = np.fromiter((met.get(w, -1) for w in rest), np.int64, len(rest))
            new = np.flatnonzero(own < 0).tolist()
            if new:
                sizes = self.sizes([rest[k] for k in new])
                own[new] = sizes
                met.update((rest[k], n) for k, n in zip(new, sizes, strict=True))
            found[open_] = own
        return found

    def sizes(self, pieces: list[bytes]) -> list[int]:
        # the dummy prefix of a text stands for the blank before the word
        return [len(i) for i in self.library.encode([p.decode("utf-8", "replace") for p in pieces], num_threads=1)]


def _runs(texts: pa.Array) -> tuple[words.Words, np.ndarray]:
    """Texts cut before each single blank that follows a non-blank and precedes one; the others stay inside.

    The cut blanks are left out: the library's dummy prefix restores them. What stands between two cuts is encoded
    independently, because no vocabulary piece has a blank mark after another character.
    """
    raw, bounds = words.utf8(texts)
    space = raw == 0x20
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    lone = space.copy()
    lone[1:] &= ~space[:-1] & ~edge[1:-1]
    lone[:-1] &= ~space[1:] & ~edge[1:-1]
    # next to a blank mark that stands in the text itself
    lone[1:] &= raw[:-1] != 0x81
    lone[:-1] &= raw[1:] != 0xE2
    if len(raw):
        lone[0] = lone[-1] = False
        lone[bounds[:-1][bounds[:-1] < len(raw)]] = False
        lone[bounds[1:][bounds[1:] > 0] - 1] = False
    return words.split(raw, bounds, None, blank=lone), np.diff(bounds)


def independent_words(model: bytes) -> bool:
    """Whether the model's texts fall apart at blanks: blank marks begin pieces only, and texts are taken as they are."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    return plain and not any("▁" in p.piece.lstrip("▁") or p.type == 4 for p in proto.pieces)


def count_tokens(
    docs: DataFrame,
    model: bytes,
    limit: int = 4096,
    frequent: int = 40_000,
    sample_docs: int = 4_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    The ``frequent`` words that occur most in a bounded sample, at most ``sample_docs`` documents of up to ``SAMPLED_BYTES`` each, become a
    broadcast table of token lengths (words of at most 64 bytes). Then one pass over all documents: words in the table
    are looked up, others go through a bounded cache of the worker to the library. No word is ever shuffled, and the table
    affects speed only.

    A null text is empty: no bytes, no tokens. Rows with equal or null ids each get a row. Other columns are not read. An
    empty table gives no rows. The model must let texts fall apart at single blanks, which is checked; else every text is
    encoded as a whole.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    apart = independent_words(model)
    lengths = joined = b""
    if apart:

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = FrequentWords(frequent)
            for batch in words.steps(batches):
                distinct, codes = _runs(batch.column("text"))[0].coded()
                seen.add(distinct, np.bincount(codes, minlength=len(distinct)))
            top = [w for w in seen.top() if len(w) <= 64 and b" " not in w]
            yield pa.RecordBatch.from_pydict({"word": pa.array(top, pa.binary())})

        share = min(1.0, 1.5 * sample_docs / max(1, source.count()))
        short = F.octet_length("text") <= SAMPLED_BYTES
        drawn = source.select("text").filter((F.rand(7) < share) & short).limit(sample_docs)
        # at most ``sample_docs`` short texts meet in one task, and ``frequent`` words in the driver
        table = sorted(bytes(r.word) for r in drawn.repartition(1).mapInArrow(sketch, "word binary").collect())
        sizes = Counter(model, (b"", b"")).sizes(table)
        joined, lengths = b" ".join(table), bytes(min(n, 255) for n in sizes)
    shared = spark.sparkContext.broadcast((model, lengths, joined))
    key = hashlib.sha256(model + lengths + joined).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, lengths, joined = shared.value
        counter = per_worker("count " + key, lambda: Counter(proto, (lengths, joined)))
        for batch in words.steps(batches):
            if apart:
                found, size = _runs(batch.column("text"))
                distinct, codes = found.coded()
                n = words.per_text(counter.words(distinct.tolist())[codes], found.first)
            else:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                n = np.array([len(i) for i in counter.library.encode(texts, num_threads=1)], np.int64)
                size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(size, pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array(n > limit),
            })

    id_type = docs.schema[id_column].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
