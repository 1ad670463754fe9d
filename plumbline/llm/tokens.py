"""Exact token ids of whole texts at the speed of a word table.

The tokenizers used here cut every text at blanks first, so the ids of a text are the ids of its words in order.
Each worker keeps a bounded table from word to ids and asks the library only for words it has not met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import tokenizers

from plumbline.llm import words


def per_worker(key: str, make: Callable[[], Any]) -> Any:
    """The object of this key in this worker process, kept until another key is asked for, so that one is held at a time.

    It hangs on an installed module, because this package travels by value with each task.
    """
    kept = vars(tokenizers).setdefault("_kept_by_worker", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


#: The characters that stand for the bytes in a byte-level vocabulary. Printable Latin-1 stands for itself, the
#: others for 256, 257 and so on in ascending order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = iter(range(256, 512))
_BYTE_LEVEL = {b: b if b in _PRINTABLE else next(_OTHERS) for b in range(256)}

#: One blank at most, then letters: ASCII, and U+00C0 to U+00FF without the two signs among them.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class WordIds:
    """Ids of texts by a tokenizer that drops white space, begins anew at each word and has no state across words.

    ``limit`` bounds the words that are remembered. Beyond it those met least often are forgotten, which costs time only.
    """

    #: Whether a piece of letters may hold capitals that the tokenizer would make small.
    folds = True

    def __init__(self, definition: str, limit: int = 300_000) -> None:
        self.library = tokenizers.Tokenizer.from_str(definition)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        special = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special and t.content.startswith("<")]
        self.mark: tuple[str | None, int] = special[0] if special else (None, -1)
        self.limit = limit
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)

    def _forget(self) -> None:
        """Keeps the half of the limit that was met in most steps; their counts are halved, so that old ones fade."""
        n = len(self.known)
        keep = np.sort(np.argsort(-self.met[:n], kind="stable")[: self.limit // 2])
        names = list(self.known)  # in the order of their rows
        size = self.first[keep + 1] - self.first[keep]
        to = np.concatenate([[0], np.cumsum(size)])
        own = np.arange(to[-1]) + np.repeat(self.first[keep] - to[:-1], size)
        self.ids[: to[-1]] = self.ids[own]
        self.first[: len(to)] = to
        self.met[: len(keep)] = self.met[keep] // 2
        self.met[len(keep) :] = 0
        self.known = {names[k]: row for row, k in enumerate(keep.tolist())}

    def _append(self, new: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), int(self.first[len(self.known)])
        while len(self.ids) < m + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.first) < n + len(new) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.ids[m : m + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(new)] = m + np.cumsum(sizes)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Adds these pieces; returns them in the order of their rows.

        A piece of letters is one word for the tokenizer's model, which is asked directly. The others go through the whole
        library, several in one text with a special token between them; pieces that may hold one go alone.
        """
        letters, rest = [], []
        for w in new:
            (letters if _LETTERS.fullmatch(w) else rest).append(w)
        ask, flat, sizes = self.model.tokenize, [], []
        for w in letters:
            if self.folds:
                w = w.decode().lower().encode()
            found = ask(w.decode("latin-1").translate(_BYTE_LEVEL))
            flat.extend([t.id for t in found])
            sizes.append(len(found))
        if letters:
            self._append(letters, np.array(flat, np.uint32), np.array(sizes, np.int64))
        if rest:
            self._append(rest, *self._asked(rest))
        return letters + rest

    def _asked(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        mark, mark_id = self.mark
        runs: list[tuple[str, int]] = []
        plain: list[str] = []
        for t in [w.decode("utf-8", "replace") for w in new]:
            alone = mark is None or "<" in t
            if plain and (alone or len(plain) == 20):
                runs.append((mark.join(plain), len(plain)))
                plain = []
            if alone:
                runs.append((t, 0))
            else:
                plain.append(t)
        if plain:
            runs.append((mark.join(plain), len(plain)))
        ids, sizes = [], []
        for found, (_, joined) in zip(self.library.encode_batch_fast([r[0] for r in runs], add_special_tokens=False), runs, strict=True):
            own = np.array(found.ids, dtype=np.uint32)
            if joined:
                at = np.flatnonzero(own == mark_id)
                sizes.append(np.diff(np.concatenate([[-1], at, [len(own)]])) - 1)
                own = own[own != mark_id]
            else:
                sizes.append(np.array([len(own)]))
            ids.append(own)
        return np.concatenate(ids), np.concatenate(sizes)

    def pieces(self, texts: pa.Array) -> words.Words:
        return words.pieces(texts)

    def __call__(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids as 32-bit numbers, and where each text begins; each text ends with ``end_id`` unless that is None."""
        if len(self.known) > self.limit:
            self._forget()
        found = self.pieces(texts)
        distinct, codes = found.coded()
        rows = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        for at in range(0, len(new), 10_000):  # the library's results take far more room than the ids
            self._learn(distinct[new[at : at + 10_000]].tolist())
        if len(new):
            rows[new] = np.fromiter(map(self.known.__getitem__, distinct[new]), np.int64, len(new))
        self.met[rows] += 1
        # one list of ids for each distinct piece, and one more that holds the end
        ends = [] if end_id is None else [end_id]
        size = np.concatenate([self.first[rows + 1] - self.first[rows], [len(ends)]])
        at = np.concatenate([[0], np.cumsum(size)])
        own = np.arange(at[-2]) + np.repeat(self.first[rows] - at[:-2], size[:-1])
        lists = pa.LargeListArray.from_arrays(at, np.concatenate([self.ids[own], np.array(ends, np.uint32)]))
        codes = np.insert(codes, found.first[1:], len(distinct))
        stops = np.concatenate([[0], np.cumsum(size[codes])])
        return lists.take(pa.array(codes)).flatten().to_numpy(), stops[found.first + np.arange(len(found.first))]


class SpacedWordIds(WordIds):
    """The same for a byte-level tokenizer that keeps white space and joins one blank to the word behind it.

    A text is cut where white space follows something else, and where a mark follows a letter: there each of its
    pre-tokens ends as well.
    """

    folds = False

    def pieces(self, texts: pa.Array) -> words.Words:
        return words.spaced_pieces(texts)


def word_ids(definition: str, spaced: bool = False) -> WordIds:
    """The worker's own encoder for a tokenizer given as the text of its file."""
    kind = SpacedWordIds if spaced else WordIds
    return per_worker(kind.__name__ + hashlib.sha256(definition.encode()).hexdigest(), lambda: kind(definition))
