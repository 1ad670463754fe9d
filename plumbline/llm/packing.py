"""Bounded-space online packing of token sequences into windows of a fixed size."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

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


class Packer:
    """At most ``slots`` open windows. A piece is (anything, start, length); ``done`` gets each full or emitted window."""

    def __init__(self, window: int, slots: int, least: int) -> None:
        self.window, self.slots, self.least = window, slots, least
        self.free: list[tuple[int, int]] = []  # (room, number of the window), ascending
        self.held: dict[int, list[tuple[object, int, int]]] = {}
        self.opened = 0

    def add(self, what: object, start: int, length: int) -> Iterator[list[tuple[object, int, int]]]:
        """Places one piece; yields the windows that this completes."""
        while length > self.window:
            yield [(what, start, self.window)]
            start, length = start + self.window, length - self.window
        while length:
            k = bisect_left(self.free, (length, -1))
            if k < len(self.free):
                room, n = self.free.pop(k)
                self.held[n].append((what, start, length))
                if room == length:
                    yield self.held.pop(n)
                else:
                    insort(self.free, (room - length, n))
                return
            if len(self.free) < self.slots:
                self.held[self.opened] = [(what, start, length)]
                if length == self.window:
                    yield self.held.pop(self.opened)
                else:
                    insort(self.free, (self.window - length, self.opened))
                self.opened += 1
                return
            room, n = self.free.pop(0)
            if room >= self.least and length - room >= self.least:  # the fullest window takes the head, and is then full
                self.held[n].append((what, start, room))
                start, length = start + room, length - room
            yield self.held.pop(n)

    def rest(self) -> list[list[tuple[object, int, int]]]:
        """The windows that are still open, fullest first."""
        return [self.held[n] for _, n in self.free]


def cut(pieces: list[tuple[object, int, int]], sizes: Iterator[int]) -> Iterator[list[tuple[object, int, int]]]:
    """The pieces in order, cut into runs of exactly the given sizes."""
    room, run = next(sizes), []
    for what, start, length in pieces:
        while length:
            n = min(room, length)
            run.append((what, start, n))
            start, length, room = start + n, length - n, room - n
            if not room:
                yield run
                room, run = next(sizes, 0), []


def checksum(ids: bytes, width: int) -> int:
    """Unsigned crc32 of ids of ``width`` bytes, as if each had 4."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def pack(
    docs: DataFrame,
    definition: str,
    end_id: int,
    window: int = 4096,
    slots: int = 64,
    least: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Sequences of at most ``window`` tokens, one row per piece of a document.

    Columns: doc_id, start (ids of the document before the piece), length, doc_tokens, sequence_id, offset (place in the
    sequence), ids (bytes of little-endian unsigned 16-bit numbers, or 32-bit with ``id_width`` 4 where one needs more),
    ids_crc32 (unsigned, of the ids as 32-bit numbers).

    Each partition of ``docs`` keeps ``slots`` open windows. A document goes to the open window with the least room that
    takes it whole, or to a new one; if there is none, the fullest window is emitted, filled up first with the
    document's head unless that would cut off less than ``least`` tokens. Longer documents are cut into whole windows
    first. What is open at the end of a partition is packed again with that of ``FAN_IN`` - 1 others, round by round, until
    one task merges the last few; there pieces are cut to fill every window, and the last, part-filled one is cut into
    powers of two, which need no padding.

    Works on the table as it is dealt, without a shuffle of texts. Open windows hold at most ``slots`` times ``window``
    ids for each partition. A null text is an empty document, which is its end id alone. Rows with equal or null ids are
    documents of their own. Other columns are not read. An empty table gives no rows.
    """
    text = docs.sparkSession.sparkContext.broadcast(definition)
    id_field = docs.schema[id_column].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"doc_id {id_field}, start long, length long, doc_tokens long, sequence_id long, offset long, id_width int, ids binary, ids_crc32 long, part int, open boolean"
    )

    def rows_of(windows: list[list], first: int, part: int, is_open: bool) -> Iterator[tuple]:
        for k, pieces in enumerate(windows):
            offset = 0
            for (doc, n, wide, ids, shift), start, length in pieces:
                # ids of the piece lie ``shift`` ids into the document
                at = (start - shift) * wide
                own = bytes(ids[at : at + length * wide])
                yield doc, start, length, n, first + k, offset, wide, own, checksum(own, wide), part, is_open
                offset += length

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(list(c), arrow_types[i]) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, schema.names)

    arrow_types = to_arrow_schema(schema).types

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_ids(text.value), TaskContext.get().partitionId()
        packer, made, base = Packer(window, slots, least), 0, part << 32
        for batch in words.steps(batches):
            ids, first = encode(batch.column("text"), end_id)
            wide = 2 if not len(ids) or ids.max() <= 0xFFFF else 4
            raw = memoryview(ids.astype(f"<u{wide}").tobytes())
            rows: list[tuple] = []
            for k, doc in enumerate(batch.column("id").to_pylist()):
                a, b = int(first[k]), int(first[k + 1])
                for full in packer.add((doc, b - a, wide, raw[a * wide : b * wide], 0), 0, b - a):
                    rows.extend(rows_of([full], base + made, part, False))
                    made += 1
            for pieces in packer.held.values():  # what waits keeps no more than its own ids
                pieces[:] = [((d, n, w, bytes(x[(s - shift) * w : (s - shift + size) * w]), s) if isinstance(x, memoryview) else (d, n, w, x, shift), s, size) for (d, n, w, x, shift), s, size in pieces]
            for at in range(0, len(rows), 2000):
                yield batch_of(rows[at : at + 2000])
        left = list(rows_of(packer.rest(), base + made, part, True))
        if left:
            yield batch_of(left)

    def merge(last: bool, level: int):  # noqa: ANN202
        def run(key: tuple, group: pa.Table) -> pa.Table:
            part = key[0].as_py()
            base = (level << 58) | (part << 32)
            rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
            pieces = [((r["doc_id"], r["doc_tokens"], r["id_width"], r["ids"], r["start"]), r["start"], r["length"]) for r in rows]
            if last:
                total = sum(p[2] for p in pieces)
                sizes = [window] * (total // window) + [1 << b for b in reversed(range(total.bit_length())) if (total % window) >> b & 1]
                rows = list(rows_of(list(cut(pieces, iter(sizes))), base, part, False))
            else:
                packer = Packer(window, slots, least)
                full = [w for p in sorted(pieces, key=lambda p: -p[2]) for w in packer.add(*p)]
                rows = [*rows_of(full, base, part, False), *rows_of(packer.rest(), base + len(full), part, True)]
            return pa.Table.from_batches([batch_of(rows)])

        return run

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    packed = materialise(source.mapInArrow(online, schema), "packed")
    done = [packed.filter(~F.col("open"))]
    waiting = packed.filter("open")
    parts, level = (packed.agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        parts = -(-parts // FAN_IN)
        keyed = waiting.withColumn("to", F.floor(F.col("part") / FAN_IN).cast("int"))
        merged = keyed.groupBy("to").applyInArrow(merge(parts == 1, level), schema)
        if parts == 1:
            done.append(merged)
            break
        merged = materialise(merged, "merged")
        done.append(merged.filter(~F.col("open")))
        waiting, level = merged.filter("open"), level + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.drop("part", "open")
