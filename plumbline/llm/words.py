"""Words of whole Arrow batches of texts, found with vector operations on their UTF-8 bytes.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. A null text has no words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that one vectorised step handles, so that its working arrays stay small.
STEP_BYTES = 2_000_000


#: Rows of one Arrow batch between Spark and a worker, so that neither holds many texts at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most ``BATCH_ROWS`` rows; Spark's own default suits rows of numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that allocators hold in reserve back to the system, as workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``step_bytes`` of text each; one longer text is a piece of its own."""
    for batch in batches:
        size = np.array(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, before + step_bytes, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    release()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text begins in it (one entry more than texts)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if texts.null_count or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of some texts: word j is ``raw[starts[j]:ends[j]]``, and text i has the words ``first[i]`` to ``first[i + 1] - 1``."""

    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray
    bounds: np.ndarray
    solid: np.ndarray

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words as bytes objects, and for each word occurrence its place among them."""
        offsets = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        solid = np.ascontiguousarray(self.raw[self.solid])
        values = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
        found = values.dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word occurrence."""
        return span_hashes(self.raw, self.starts, self.ends, seed)


#: Fixed sets: letters A to Z in both cases, and marks that no letter joins in a token.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b'.,;:!?*$#%&()"')] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def pieces(texts: pa.Array) -> Words:
    """Words, cut once more where a mark follows a letter, in lower case as far as ASCII goes.

    For tokenizers that ignore case and never join a letter and a mark, so that fewer distinct pieces occur. Texts
    that hold the beginning of a special token keep their case, since special tokens are told apart by it.
    """
    raw, bounds = utf8(texts)
    if not np.any((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))):
        raw = _LOWER[raw]
    letter = _letters(raw)
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = letter[:-1] & _MARK[raw[1:]]
    return split(raw, bounds, cut)


def spaced_pieces(texts: pa.Array) -> Words:
    """Pieces that together are the whole texts: white space stands before the word that follows it.

    A text is cut before white space that follows anything but white space, and before a mark that follows a letter.
    """
    raw, bounds = utf8(texts)
    blank = BLANK[raw]
    wide = np.zeros(len(raw), dtype=bool)  # last bytes of white space beyond ASCII; some other characters' too, which only cuts less
    wide[1:] = (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))
    if len(raw) > 2:
        lead, mid, tail = raw[:-2], raw[1:-1], raw[2:]
        wide[2:] |= ((lead == 0xE1) & (mid == 0x9A)) | ((lead == 0xE2) & (mid >= 0x80) & (mid <= 0x81)) | ((lead == 0xE3) & (mid == 0x80) & (tail == 0x80))
    letter = _letters(raw)
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = (blank[1:] & ~blank[:-1] & ~wide[:-1]) | (letter[:-1] & _MARK[raw[1:]])
    return split(raw, bounds, cut, np.zeros(len(raw), dtype=bool))


def _letters(raw: np.ndarray) -> np.ndarray:
    """ASCII letters, and the last bytes of U+00C0 to U+00FF without the two signs among them."""
    letter = _LETTER[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    return letter


def of(texts: pa.Array) -> Words:
    return split(*utf8(texts))


def split(raw: np.ndarray, bounds: np.ndarray, cut: np.ndarray | None = None, blank: np.ndarray | None = None) -> Words:
    """``cut`` marks bytes at which a word ends and another begins; ``blank`` those between words, if not the usual ones."""
    solid = ~BLANK[raw] if blank is None else ~blank
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    if cut is not None:
        edge[:-1] |= cut
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(np.searchsorted(starts, bounds), starts, ends, raw, bounds, solid)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text; texts without values get 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, n.bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, _ODD, np.uint64)
            up[0] = 1
            down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
            down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial of random byte values modulo 2**64, from prefix sums."""
    up, down = _powers_upto(len(raw) + 1)
    values = np.random.default_rng([seed, 0x5EED]).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[raw] * up[: len(raw)], out=total[1:])
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on, across the whole array; entry i covers [i, i + width).

    Polynomial modulo 2**64 from prefix sums, then mixed. Windows that run over a text's end are the caller's to leave out.
    """
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers_upto(len(word_hashes) + 1)
    total = np.zeros(len(word_hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(word_hashes * up[: len(word_hashes)], out=total[1:])
        return mixed((total[width:] - total[:-width]) * down[:n])


def whole(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the ``n`` windows from ``window_hashes`` lie within one text."""
    ok = np.ones(n + width, dtype=bool)
    for k in first[1:]:
        ok[max(0, k - width + 1) : k] = False
    return ok[:n]
