"""CSV whose quoted fields hold line breaks, read by many tasks a file.

A byte range does not show whether it begins inside a quoted field. So a first pass counts the quotes of each range; their parity,
summed over the ranges before, says in which state a range begins. With that a range finds its first record by itself, and
reads on past its end until its last record is complete.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise, small_table
from plumbline.sources.digests import open_store

#: Bytes of one range, and of one piece of it in memory.
RANGE = 32 << 20
PIECE = 1 << 20
QUOTE, BREAK = ord('"'), ord("\n")


class StrayQuotes(ValueError):
    """A quote inside an unquoted field, whose parity says nothing about fields."""


def _files(path: str) -> list[tuple[str, int]]:
    store, root = open_store(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
    hidden = lambda f: f.base_name.startswith((".", "_"))
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not hidden(f))


def _header(path: str, place: str) -> tuple[list[str], int]:
    """Names in the first record, and where the next one begins."""
    store, _ = open_store(path)
    data = b""
    with store.open_input_file(place) as f:
        while True:
            more = f.read(PIECE)
            data += more
            raw = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero((raw == BREAK) & (np.cumsum(raw == QUOTE) % 2 == 0))
            if len(ends) or not more:
                end = int(ends[0]) + 1 if len(ends) else len(data)
                (names,) = list(csv.reader(io.StringIO(data[:end].decode("utf-8-sig"), newline="")))[:1] or [[]]
                return names, end


def _count(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = open_store(path)
                n = 0
                with store.open_input_file(row["place"]) as f:
                    f.seek(row["begin"])
                    left = row["end"] - row["begin"]
                    while left and (data := f.read(min(PIECE, left))):
                        n += data.count(b'"')
                        left -= len(data)
                yield pa.RecordBatch.from_pylist([row | {"quotes": n}])

    return run


def _records(path: str, names: list[str]):  # noqa: ANN202
    """Rows of the records that begin in a range, as text columns; a short record is filled up, a long one cut."""
    schema = pa.schema([(f"c{i}", pa.string()) for i in range(len(names))])

    def parse(data: bytes) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(data, np.uint8)
        quotes = raw == QUOTE
        opens = np.flatnonzero(quotes & (np.cumsum(quotes) % 2 == 1))
        # a field is opened behind a comma or a line break; behind a quote, it is a quote in a field
        before = raw[opens[opens > 0] - 1]
        if not np.isin(before, [ord(","), BREAK, QUOTE]).all():
            raise StrayQuotes("a quote inside an unquoted field")
        rows: list[list[str | None]] = []
        for record in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline="")):
            if record:
                rows.append([v or None for v in record[: len(names)]] + [None] * (len(names) - len(record)))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = open_store(path)
                with store.open_input_file(row["place"]) as f:
                    inside, at = bool(row["inside"]), row["begin"]
                    f.seek(at - 1)
                    # a record may begin with the range
                    started = bool(row["starts"]) or f.read(1) == b"\n" and not inside
                    f.seek(at)
                    held, done = b"", False
                    while not done and (data := f.read(PIECE)):
                        raw = np.frombuffer(data, np.uint8)
                        state = (np.cumsum(raw == QUOTE) + inside) % 2
                        breaks = np.flatnonzero((raw == BREAK) & (state == 0))
                        inside = bool(state[-1])
                        if not started and len(breaks):
                            # the record behind the first break is the first one that begins here, if it does
                            cut = int(breaks[0]) + 1
                            if at + cut >= row["end"]:
                                break
                            data, breaks, at, started = data[cut:], breaks[1:] - cut, at + cut, True
                        if started:
                            # the last record that begins before the end of the range is read to its own end
                            over = breaks[at + breaks + 1 >= row["end"]]
                            if len(over):
                                yield from parse(held + data[: int(over[0]) + 1])
                                held, done = b"", True
                            elif len(breaks):
                                cut = int(breaks[-1]) + 1
                                yield from parse(held + data[:cut])
                                held = data[cut:]
                            else:
                                held += data
                        at += len(data)
                    if held:
                        yield from parse(held)

    return run


def read_quoted(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame | None:
    """All columns as text, empty fields null, or None where this way can't read the files: a store that only Spark opens, files with
    different headers, or stray quotes. Then one task a file is the way.
    """
    try:
        files = _files(path)
    except ValueError:
        return None
    if not files:
        return None
    heads = [_header(path, place) for place, _ in files]
    names = heads[0][0]
    if not names or len(set(names)) < len(names) or any(h[0] != names for h in heads):
        return None
    ranges = [
        (place, k, begin, min(size, begin + range_bytes), k == 0)
        for (place, size), (_, first) in zip(files, heads, strict=True)
        for k, begin in enumerate(range(first, size, range_bytes))
    ]
    schema = T.StructType(
        [T.StructField("place", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("k", "begin", "end")], T.StructField("starts", T.BooleanType())]
    )
    empty = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    if not ranges:
        return spark.createDataFrame([], empty).toDF(*names)
    # one row for each range: where its state meets that of the ranges before
    dealt = small_table(spark, ranges, schema).repartition(len(ranges))
    counted = materialise(dealt.mapInArrow(_count(path), T.StructType([*schema.fields, T.StructField("quotes", T.LongType())])), "quotes")
    before = Window.partitionBy("place").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    found = known.repartition(len(ranges)).mapInArrow(_records(path, names), empty)
    try:
        return materialise(found, "quoted-csv").toDF(*names)
    except Exception as why:  # noqa: BLE001 - Spark wraps what a task raises
        if StrayQuotes.__name__ in str(why):
            return None
        raise
