"""Best-fit packing of whole documents into windows of a fixed size, improved by swaps between underfull windows.

Documents that fit a window are never cut. A best-fit-decreasing arrangement is the start of a local search: documents
move from the emptiest windows to fuller ones, one by one, one for one, two for one or one for two, and each step increases
the sum of squared fills. So the emptiest windows run dry, and those that are empty are gone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm import words
from plumbline.llm.tokens import word_ids
from plumbline.session import materialise

#: Partitions whose open windows meet in one task of a merge.
FAN_IN = 64

#: Candidates of each kind of step that one look over the takers may bring.
AT_ONCE = 32

#: Documents of one window, longest first, that a search joins to pairs. Shorter ones take part one by one.
PAIRED = 16


def best_fit(lengths: Sequence[int], window: int) -> list[list[int]]:
    """Windows as lists of positions in ``lengths``: longest first, each into the fullest window that has room."""
    free: list[tuple[int, int]] = []  # (room, window), ascending
    made: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        k = bisect_left(free, (need, -1))
        if k < len(free):
            room, n = free.pop(k)
            made[n].append(i)
        else:
            room, n = window, len(made)
            made.append([i])
        if room > need:
            insort(free, (room - need, n))
    return made


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of two of the longest ``PAIRED`` sizes, and the places of both."""
    longest = np.argsort(-sizes, kind="stable")[:PAIRED]
    a, b = np.triu_indices(len(longest), 1)
    a, b = longest[a], longest[b]
    return sizes[a] + sizes[b], a, b


class Search:
    """Local search over the underfull windows of a start arrangement; ``windows`` holds the result."""

    def __init__(self, lengths: Sequence[int], windows: list[list[int]], window: int) -> None:
        self.lengths, self.window = np.asarray(lengths, np.int32), window
        self.windows = [list(w) for w in windows]
        self.fill = np.array([self.lengths[w].sum() for w in self.windows], np.int64)
        self.steps = 0
        self.known: dict[int, tuple[np.ndarray, ...]] = {}  # by window, until a step changes it: its sizes, and sums and places of its pairs

    def _of(self, w: int) -> tuple[np.ndarray, ...]:
        if w not in self.known:
            sizes = self.lengths[self.windows[w]]
            self.known[w] = (sizes, *_pairs(sizes))
        return self.known[w]

    def run(self) -> list[list[int]]:
        """Steps until none increases the sum of squared fills, emptiest windows as givers first.

        All free room together can empty so many windows and no more; only these, the emptiest, give.
        """
        moved = True
        while moved:
            moved = False
            open_ones = [w for w in np.argsort(self.fill, kind="stable").tolist() if 0 < self.fill[w] < self.window]
            room = sum(self.window - int(self.fill[w]) for w in open_ones)
            for k, giver in enumerate(open_ones[: -(-room // self.window)]):
                takers = [w for w in open_ones[k + 1 :] if self.fill[giver] <= self.fill[w] < self.window]
                while self.fill[giver] and takers and self._step(giver, takers):
                    moved = True
                    takers = [w for w in takers if self.fill[giver] <= self.fill[w] < self.window]
        return [w for w in self.windows if w]

    def _step(self, giver: int, takers: list[int]) -> bool:
        """Steps from ``giver`` to some of ``takers`` that each increase the sum of squared fills, the best ones first; False if none does.

        Several are taken at a time where they concern different takers and different documents of the giver: as its fill
        falls, the others gain more than was computed.
        """
        sizes, sums, pair_a, pair_b = self._of(giver)
        order, pair_order = np.argsort(sizes, kind="stable"), np.argsort(sums, kind="stable")
        gives = [sizes[order], sums[pair_order]]
        parts = [self._of(w) for w in takers]
        fills = self.fill[takers]
        singles, pairs = [p[0] for p in parts], [p[1] for p in parts]
        # what a taker gives back: nothing, one document or two; two for two is not tried
        every = np.arange(len(takers))
        backs = [
            (every, np.zeros(len(takers), np.int32), (0, 1)),
            (np.repeat(every, [len(s) for s in singles]), np.concatenate(singles), (0, 1)),
            (np.repeat(every, [len(s) for s in pairs]), np.concatenate(pairs), (0,)),
        ]
        found: list[tuple[int, int, int, int, int]] = []
        for kind, (whose, back, kinds) in enumerate(backs):
            room = back + (self.window - fills[whose])
            for give in kinds:
                values = gives[give]
                if not len(values) or not len(whose):
                    continue
                at = np.searchsorted(values, room, side="right") - 1
                more = np.where(at >= 0, values[at] - back, 0)
                gain = np.where(more > 0, more * (fills[whose] - self.fill[giver] + more), 0)
                best = np.argpartition(-gain, min(AT_ONCE, len(gain)) - 1)[:AT_ONCE]
                found.extend((int(gain[k]), kind, give, int(k), int(at[k])) for k in best if gain[k] > 0)
        used: set[int] = set()
        served: set[int] = set()
        for _, kind, give, k, at in sorted(found, key=lambda f: (-f[0], f[1:])):
            whose = int(backs[kind][0][k])
            given = (int(order[at]),) if give == 0 else (int(pair_a[pair_order[at]]), int(pair_b[pair_order[at]]))
            if whose in served or used.intersection(given):
                continue
            returned: tuple[int, ...] = ()
            if kind:
                own = k - int(np.searchsorted(backs[kind][0], whose))
                returned = (own,) if kind == 1 else (int(parts[whose][2][own]), int(parts[whose][3][own]))
            served.add(whose)
            used.update(given)
            self._exchange(giver, takers[whose], given, returned)
        # what was given leaves the giver last, so that places in it stay valid meanwhile
        self.windows[giver] = [x for i, x in enumerate(self.windows[giver]) if i not in used]
        self.known.pop(giver, None)
        return bool(used)

    def _exchange(self, giver: int, taker: int, given: tuple[int, ...], returned: tuple[int, ...]) -> None:
        a, b = self.windows[giver], self.windows[taker]
        out, back = [a[i] for i in given], [b[i] for i in returned]
        a.extend(back)
        self.windows[taker] = [x for i, x in enumerate(b) if i not in returned] + out
        more = int(self.lengths[out].sum() - self.lengths[back].sum())
        self.fill[giver] -= more
        self.fill[taker] += more
        self.known.pop(taker, None)
        self.steps += 1


def arrange(lengths: Sequence[int], window: int) -> list[list[int]]:
    """Windows as lists of positions in ``lengths``, each of at most ``window``: best fit, then the search."""
    return Search(lengths, best_fit(lengths, window), window).run()


#: One piece: document, its piece number, where it starts, ids of the document, id width, ids as bytes, their crc32.
Piece = tuple[object, int, int, int, int, bytes, int]


def _length(p: Piece) -> int:
    return len(p[5]) // p[4]


def pack_whole(
    docs: DataFrame,
    definition: str,
    end_id: int,
    window: int = 2048,
    pool_tokens: int = 2_000_000,
    carried: int = 64,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Sequences of at most ``window`` tokens in which no document is cut that fits one.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), length, doc_tokens, sequence_id, offset
    (place in the sequence), ids (bytes of little-endian unsigned 16-bit numbers, or 32-bit with ``id_width`` 4 where one needs
    more) and ids_crc32 (unsigned, of the ids as 32-bit numbers). A longer document is cut so that its first piece alone may be
    shorter than the window.

    Each partition of ``docs`` gathers pieces up to ``pool_tokens`` ids, arranges them, emits the windows and carries the
    ``carried`` emptiest ones that are not full into its next pool. What is open at its end is arranged again with that of
    ``FAN_IN`` - 1 others, round by round, until one task arranges the last few windows. So texts are never shuffled, and a
    task holds one pool, or ``FAN_IN`` times ``carried`` windows, whatever the table's size; one document longer than a pool
    adds no more than its first piece, as whole windows leave at once.

    A null text is an empty document, which is its end id alone; a very long one is handled whole. Rows with equal or null ids
    are documents of their own. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    text = docs.sparkSession.sparkContext.broadcast(definition)
    id_field = docs.schema[id_column].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"doc_id {id_field}, piece int, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "id_width int, ids binary, ids_crc32 long, part int, open boolean"
    )
    arrow = to_arrow_schema(schema)

    def batches_of(windows: list[list[Piece]], first: int, part: int, is_open: bool) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for k, pieces in enumerate(windows):
            offset = 0
            for p in pieces:
                doc, piece, start, n, wide, ids, crc = p
                rows.append((doc, piece, start, _length(p), n, first + k, offset, wide, ids, crc, part, is_open))
                offset += rows[-1][3]
            if rows and (len(rows) > 2000 or k == len(windows) - 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                rows = []

    def settled(pool: list[Piece], keep: int) -> tuple[list[list[Piece]], list[list[Piece]]]:
        """The arranged pool: windows to emit, and the ``keep`` emptiest of those that are not full."""
        found = [[pool[i] for i in w] for w in arrange([_length(p) for p in pool], window)]
        found.sort(key=lambda w: sum(map(_length, w)))
        n = min(keep, sum(sum(map(_length, w)) < window for w in found))
        return found[n:], found[:n]

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_ids(text.value, spaced=True), TaskContext.get().partitionId()
        made = part << 32
        pool: list[Piece] = []
        waiting = 0
        rest: list[list[Piece]] = []
        for batch in words.steps(batches):
            ids, first = encode(batch.column("text"), end_id)
            ids = ids.astype("<u4", copy=False)
            wide = 2 if not len(ids) or ids.max() <= 0xFFFF else 4
            plain, narrow = memoryview(ids).cast("B"), memoryview(ids.astype(f"<u{wide}")).cast("B")
            full: list[list[Piece]] = []
            for doc, a, b in zip(batch.column("id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                at, piece = a, 0
                upto = a + (b - a - 1) % window + 1
                while at < b:
                    p = (doc, piece, at - a, b - a, wide, bytes(narrow[at * wide : upto * wide]), zlib.crc32(plain[at * 4 : upto * 4]))
                    if upto - at == window:
                        full.append([p])
                    else:
                        pool.append(p)
                        waiting += upto - at
                    at, upto, piece = upto, upto + window, piece + 1
            yield from batches_of(full, made, part, False)
            made += len(full)
            if waiting >= pool_tokens:
                done, rest = settled(pool, carried)
                yield from batches_of(done, made, part, False)
                made += len(done)
                pool = [p for w in rest for p in w]
                waiting = sum(map(_length, pool))
                words.release()
        done, rest = settled(pool, carried)
        yield from batches_of(done, made, part, False)
        yield from batches_of(rest, made + len(done), part, True)

    def merge(last: bool, level: int):  # noqa: ANN202
        def run(key: tuple, group: pa.Table) -> pa.Table:
            part = key[0].as_py()
            base = (level << 58) | (part << 32)
            rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
            pool = [(r["doc_id"], r["piece"], r["start"], r["doc_tokens"], r["id_width"], r["ids"], r["ids_crc32"]) for r in rows]
            done, rest = settled(pool, 0 if last else carried)
            return pa.Table.from_batches([*batches_of(done, base, part, False), *batches_of(rest, base + len(done), part, True)], arrow)

        return run

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    packed = materialise(source.mapInArrow(online, schema), "swap-packed")
    done = [packed.filter(~F.col("open"))]
    waiting = packed.filter("open")
    parts, level = (packed.agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        parts = -(-parts // FAN_IN)
        merged = waiting.withColumn("to", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("to").applyInArrow(merge(parts == 1, level), schema)
        if parts == 1:
            done.append(merged)
            break
        merged = materialise(merged, "swap-merged")
        done.append(merged.filter(~F.col("open")))
        waiting, level = merged.filter("open"), level + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.drop("part", "open")
