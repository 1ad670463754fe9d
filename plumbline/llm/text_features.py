"""Figures of whole texts and of their lines, from vector operations on Arrow batches."""

from __future__ import annotations

import numpy as np

from plumbline.llm import words

#: Fixed sets of bytes.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LOWER = np.zeros(256, bool)
LOWER[0x61:0x7B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?")] = True
FIRST_BYTE = np.ones(256, bool)  # of a code point
FIRST_BYTE[0x80:0xC0] = False


def running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def between(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return total[b] - total[a]


def repeated_windows(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether it lies in a window of ``width`` words that its text holds twice or more."""
    n = len(hashes)
    covered = np.zeros(n, bool)
    keys = words.window_hashes(hashes, width)
    if not len(keys):
        return covered
    inside = words.whole(first, width, len(keys))
    at = np.flatnonzero(inside)
    owner = np.searchsorted(first, at, side="right") - 1
    # the text's number is mixed in, so that one sort finds repeats within texts only
    with np.errstate(over="ignore"):
        keys = keys[at] ^ words.mixed(owner.astype(np.uint64) + np.uint64(0x9E37))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    begins = at[again]
    for k in range(width):
        covered[begins + k] = True
    return covered


class Lines:
    """Lines (between line feeds) of the texts of a batch: bounds, owner, number of words, and whether an equal line came earlier."""

    def __init__(self, found: words.Words) -> None:
        raw, bounds = found.raw, found.bounds
        feeds = np.flatnonzero(raw == 0x0A)
        self.begin = np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable")
        # a text's begin and the byte after a line feed that ends the text before coincide; order by owner settles it
        owner_of_feed = np.searchsorted(bounds, feeds, side="right") - 1
        owner = np.concatenate([np.arange(len(bounds) - 1), owner_of_feed])
        begin = np.concatenate([bounds[:-1], feeds + 1])
        order = np.lexsort((begin, owner))
        self.begin, self.owner = begin[order], owner[order]
        nxt = np.concatenate([self.begin[1:] - 1, [0]])
        last = np.concatenate([self.owner[1:] != self.owner[:-1], [True]]) if len(self.owner) else np.zeros(0, bool)
        self.end = np.where(last, bounds[self.owner + 1], nxt[: len(self.begin)]) if len(self.begin) else self.begin
        self.first = np.searchsorted(self.owner, np.arange(len(bounds)))
        self.word_from = np.searchsorted(found.starts, self.begin)
        self.word_to = np.searchsorted(found.starts, self.end)
        self.n_words = self.word_to - self.word_from

    def repeats(self, found: words.Words) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        raw, n = found.raw, len(found.raw)
        keys = words.span_hashes(raw, self.begin, self.end)
        with np.errstate(over="ignore"):
            keys = keys ^ words.mixed(self.owner.astype(np.uint64) + np.uint64(0x51ED))
        order = np.argsort(keys, kind="stable")  # equal lines keep their order
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order][1:] == keys[order][:-1]
        return again & (self.n_words > 0)
