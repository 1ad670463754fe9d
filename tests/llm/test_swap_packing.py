"""Packing of whole documents against the library's ids, and the local search against bounds and an exhaustive one."""

import itertools
import random
import zlib

import numpy as np
import pytest
import tokenizers

from plumbline.llm import swap_packing
from plumbline.llm.queries import QUERIES, SWAP_END_ID, definition

WINDOW = 2048


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_str(definition("byte_bpe_50k.json"))


def ids_of(bpe, text):
    return np.array([*bpe.encode(text or "", add_special_tokens=False).ids, SWAP_END_ID], "<u4")


def check(rows, docs, bpe, window):
    """Every id of every document lies in one piece; only long documents are cut; sequences are gapless and fit."""
    want = {}
    for i, text in docs:
        ids = ids_of(bpe, text)
        first = (len(ids) - 1) % window + 1
        cuts = [0, *range(first, len(ids) + 1, window)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            key = (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    sequences = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_whole_table(spark, sf, bpe):
    rows = QUERIES["op11_swap_packing"](spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = check(rows, docs, bpe, WINDOW)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // WINDOW) + 1


def test_odd_rows(table, odd_rows, no_rows, bpe):
    for window in (16, WINDOW):
        rows = swap_packing.pack_whole(table(odd_rows), definition("byte_bpe_50k.json"), SWAP_END_ID, window=window, pool_tokens=500, carried=2)
        check(rows.collect(), [r[:2] for r in odd_rows], bpe, window)
    assert swap_packing.pack_whole(no_rows, definition("byte_bpe_50k.json"), SWAP_END_ID).count() == 0


def test_merges_in_rounds(spark, table, bpe, monkeypatch):
    monkeypatch.setattr(swap_packing, "FAN_IN", 2)
    rng = random.Random(4)
    docs = [(i, " ".join(["word"] * rng.randrange(5, 60)), "en", "a") for i in range(300)]
    many = table(docs).repartition(9)
    rows = swap_packing.pack_whole(many, definition("byte_bpe_50k.json"), SWAP_END_ID, window=64, pool_tokens=300, carried=4)
    got = rows.collect()
    n = check(got, [r[:2] for r in docs], bpe, 64)
    assert n <= len(swap_packing.best_fit([r["length"] for r in got], 64)) * 1.1


@pytest.mark.parametrize("low, high", [(1, 60), (20, 45), (34, 50), (51, 99)])
def test_search_never_worsens_and_keeps_all(low, high):
    rng = random.Random(low)
    sizes = [rng.randrange(low, high) for _ in range(400)]
    start = swap_packing.best_fit(sizes, 100)
    search = swap_packing.Search(sizes, start, 100)

    def squares():
        return sum(sum(sizes[i] for i in w) ** 2 for w in search.windows)

    exchange, seen = search._exchange, []

    def watched(*args):
        exchange(*args)
        seen.append(int((search.fill.astype(np.int64) ** 2).sum()))

    search._exchange = watched
    before = squares()
    found = search.run()
    assert sorted(i for w in found for i in w) == list(range(400)) and all(sum(sizes[i] for i in w) <= 100 for w in found)
    assert len(found) <= len(start) and [before, *seen] == sorted({before, *seen}) and squares() == [before, *seen][-1]


def test_search_empties_windows_that_best_fit_leaves():
    sizes = [random.Random(2).randrange(1) + s for s in np.random.default_rng(0).integers(500, 900, 2000)]
    start = swap_packing.best_fit(sizes, 2048)
    assert len(swap_packing.Search(sizes, start, 2048).run()) < 0.97 * len(start)


@pytest.mark.parametrize("seed", range(8))
def test_search_near_the_best_of_all_arrangements(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(2, 10) for _ in range(8)]

    def least(left, rooms):
        if not left:
            return len(rooms)
        options = [least(left[1:], rooms[:k] + (r - left[0],) + rooms[k + 1 :]) for k, r in enumerate(rooms) if r >= left[0]]
        return min([*options, least(left[1:], (*rooms, 12 - left[0]))])

    assert len(swap_packing.arrange(sizes, 12)) <= least(tuple(sizes), ()) + 1
