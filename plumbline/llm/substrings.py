"""Substring dedup by levels of doubling length.

A window of n words that occurs in two documents holds windows of n / 2 words that do. So windows of the shorter length
are matched first, and only those that repeat are extended to twice the length, level by level up to the wanted
length; longer repeats cover no further words. At the first level a window stands for all that overlap it: of the
short windows inside each long one, only the one with the smallest hash is matched. Equal long windows
choose equal short ones, so no repeat is lost, and about one short window in thirteen is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.key_filters import among, bit_map, bits_of, slot, text_key
from plumbline.session import materialise

#: Stands for a null id: no document comes after it.
LAST = (1 << 63) - 1


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[: len(x) - k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def levels(width: int, start: int) -> list[int]:
    """Lengths from about ``start`` that double up to ``width``; two at least."""
    out = [(width + 1) // 2, width]
    while out[0] > 1 and (out[0] + 1) // 2 >= start:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _key(id_column: str) -> Column:
    return F.coalesce(F.col(id_column).cast("long"), F.lit(LAST))


def _chosen(hashes: np.ndarray, short: int, long: int) -> np.ndarray:
    """For each window of ``long`` words, the smallest hash among its windows of ``short`` words."""
    return smallest(words.window_hashes(hashes, short), long - short + 1)


def _unpacked(texts: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else unpack.decompress(t) for t in texts.to_pylist()], pa.large_binary())


def _packed(docs: DataFrame, wanted: np.ndarray, keys: tuple[str, ...], id_column: str, text_column: str, *carried: Column) -> DataFrame:
    """key, tie, compressed text and carried columns of the rows that the bit map of ``keys`` lets through: what a join has to shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    rows = docs.select(_key(id_column).alias("key"), text_key(text_column).alias("tie"), *carried, F.col(text_column).alias("text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        bitmap = shared.value
        for whole in batches:
            batch = whole.filter(pa.array(among(bitmap, whole.column("slot"))))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            column = pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column], names=[*names, "packed"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.withColumn("slot", slot(bits_of(wanted), *keys)).mapInArrow(run, f"{schema}, packed binary")


def repeated_spans(docs: DataFrame, width: int = 50, start: int = 25, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Word ranges that are covered by a window of ``width`` words which also starts in a document with a smaller id.

    One row for each distinct (id, text): key (the id, the largest long for null), tie (128 bits of the text, which
    tell rows with equal ids apart), n_words, and spans, an array of (begin, end) word numbers. A null text has no words. A
    null id comes after all others. Rows with equal ids don't count against each other. Ids must be whole numbers.
    An empty table gives no rows.

    Marks, windows and spans belong to a (key, tie), never to an id alone, so what is gathered for a row is bounded by its
    own text. Whole copies of a text are settled by its tie, and only the one with the smallest id goes through the
    levels. Windows are compared by 64-bit hashes at the levels below ``width`` and by 128 bits at the last.
    """
    lengths = levels(width, start)
    first_length = lengths[0]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.steps(batches):
            found = words.of(batch.column("text"))
            chosen = _chosen(found.hashes(), first_length, width)
            ok = words.whole(found.first, width, len(chosen))
            owner = np.repeat(np.arange(batch.num_rows), found.counts())[: len(chosen)][ok]
            picked = chosen[ok].view(np.int64)
            change = np.ones(len(picked), bool)
            change[1:] = (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])
            ends = np.searchsorted(owner[change], np.arange(batch.num_rows + 1))
            lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(picked[change])).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "tie")], pa.array(found.counts().astype(np.int64)), lists], names=["key", "tie", "n_words", "chosen"])

    rows = docs.select(_key(id_column).alias("key"), text_key(text_column).alias("tie"), F.col(text_column).alias("text"))
    slim = materialise(rows.mapInArrow(begin, "key long, tie binary, n_words long, chosen array<long>"), "substring-windows")
    firsts = slim.groupBy("tie").agg(F.min("key").alias("earliest"))
    known = slim.join(firsts, "tie")
    # at each level: which hashes occur under two ids, and in which texts
    pairs = known.filter("key = earliest").select("key", "tie", F.explode(F.array_distinct("chosen")).alias("h"))
    for short, long in zip(lengths, lengths[1:], strict=False):
        ends = pairs.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("h")
        marked = materialise(pairs.join(ends, "h").groupBy("key", "tie").agg(F.collect_set("h").alias("marked")), "substring-marks")
        # repeated rows are one text
        texts = _packed(docs, bit_map(marked, "key", "tie"), ("key", "tie"), id_column, text_column).dropDuplicates(["key", "tie"])
        last = long == width
        pairs = texts.join(marked, ["key", "tie"]).mapInArrow(_extend(short, long, width, last), "key long, tie binary, at int, h long, h2 long" if last else "key long, tie binary, h long")
    earliest = pairs.groupBy("h", "h2").agg(F.min("key").alias("low"))
    later = pairs.join(earliest, ["h", "h2"]).filter("key > low")
    starts = later.groupBy("key", "tie").agg(F.collect_list("at").alias("starts"))
    every = known.groupBy("key", "tie").agg(F.first("n_words").alias("n_words"), F.max(F.col("key") > F.col("earliest")).alias("copy"))
    return every.join(starts, ["key", "tie"], "left").mapInArrow(_spans(width), "key long, tie binary, n_words long, spans array<struct<begin: long, end: long>>")


def _extend(short: int, long: int, width: int, last: bool):  # noqa: ANN202
    """Windows of ``long`` words that hold a marked window of ``short`` words; before the last level, the chosen one of each window of ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            found = words.of(_unpacked(batch.column("packed")))
            n = batch.num_rows
            hashes = found.hashes()
            chosen = _chosen(hashes, short, width)
            counts = found.counts()
            owner = np.repeat(np.arange(n), counts)[: len(chosen)]
            marked = batch.column("marked")
            mark_owner = np.repeat(np.arange(n), np.diff(np.asarray(marked.offsets)))
            values = marked.flatten().to_numpy().view(np.uint64)
            # (text, hash) pairs as one number, since a hash counts only in the texts it was marked for
            with np.errstate(over="ignore"):
                wanted = np.unique(values ^ words.mixed(mark_owner.astype(np.uint64)))
                asked = chosen ^ words.mixed(owner.astype(np.uint64))
            at = np.searchsorted(wanted, asked)
            hit = words.whole(found.first, width, len(chosen))
            hit &= wanted[np.minimum(at, len(wanted) - 1)] == asked if len(wanted) else False
            begins = np.flatnonzero(hit)
            own = owner[begins]
            if last:
                one = words.window_hashes(hashes, width)[begins].view(np.int64)
                two = words.window_hashes(found.hashes(1), width)[begins].view(np.int64)
                columns = {"at": (begins - found.first[own]).astype(np.int32), "h": one, "h2": two}
            else:
                columns = {"h": _chosen(hashes, long, width)[begins].view(np.int64)}
            for k in range(0, len(begins), 200_000):
                of = pa.array(own[k : k + 200_000])
                names = {c: batch.column(c).take(of) for c in ("key", "tie")}
                yield pa.RecordBatch.from_pydict(names | {c: pa.array(v[k : k + 200_000]) for c, v in columns.items()})

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches with compressed texts; they grow to about four times their size."""
    return words.steps(batches, "packed", words.STEP_BYTES // 4)


def _spans(width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict[str, int]]] = []
            n_words, copies = batch.column("n_words").to_numpy(), batch.column("copy").to_numpy(zero_copy_only=False)
            column = batch.column("starts")
            for k in range(batch.num_rows):
                if copies[k]:
                    out.append([{"begin": 0, "end": int(n_words[k])}] if n_words[k] >= width else [])
                elif not column[k].is_valid:
                    out.append([])
                else:
                    at = np.sort(column[k].values.to_numpy())
                    cut = np.flatnonzero(np.diff(at) > width)
                    begins, ends = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + width
                    out.append([{"begin": int(a), "end": int(b)} for a, b in zip(begins, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "tie", "n_words")], pa.array(out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=["key", "tie", "n_words", "spans"])

    return run


def remove_spans(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text", join_all: bool = False) -> DataFrame:
    """``docs`` without the words in ``spans`` (from ``repeated_spans``), and two columns: n_words before, n_removed.

    Columns: row (struct of all columns but the text), text, n_words, n_removed. The kept words of a changed text are
    joined by one blank; an unchanged text stays as it is, null included, unless ``join_all``. Every row stays, also
    one that loses all its words. ``spans`` should be a written table, as it is read twice; only rows that may have a
    span are shuffled.
    """
    others = [c for c in docs.columns if c != text_column]
    row = (F.struct(*others) if others else F.struct(F.lit(None).alias("nothing"))).alias("row")
    touched = bit_map(spans.filter(F.size("spans") > 0), "key", "tie")
    rows = docs.select(_key(id_column).alias("key"), text_key(text_column).alias("tie"), row, F.col(text_column).alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, text string, n_words long, n_removed long"
    shared = docs.sparkSession.sparkContext.broadcast(touched)

    def made(rows: pa.Array, texts: pa.Array, found: words.Words, stay: np.ndarray) -> pa.RecordBatch:
        counts = found.counts()
        removed = counts - words.per_text(stay, found.first)
        if join_all:
            column = joined_words(found, stay)
        elif removed.any():
            column = pc.if_else(pa.array(removed > 0), joined_words(found, stay), texts)
        else:
            column = texts
        return pa.RecordBatch.from_arrays([rows, column.cast(pa.large_string()).cast(pa.string()), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64))], names=["row", "text", "n_words", "n_removed"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that have no span for certain; they need no join."""
        bitmap = shared.value
        for batch in words.steps(batches):
            batch = batch.filter(pa.array(~among(bitmap, batch.column("slot"))))
            texts = batch.column("text").cast(pa.large_binary())
            found = words.of(texts)
            yield made(batch.column("row"), texts, found, np.ones(len(found.starts), bool))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            texts = _unpacked(batch.column("packed"))
            found = words.of(texts)
            lists = batch.column("spans")
            offsets = np.asarray(lists.offsets) if len(lists) else np.zeros(1, int)
            flat = lists.flatten()
            base = found.first[:-1][np.repeat(np.arange(batch.num_rows), np.diff(offsets))]
            gone = np.zeros(len(found.starts) + 1, np.int64)
            np.add.at(gone, base + flat.field("begin").to_numpy(), 1)
            np.add.at(gone, base + flat.field("end").to_numpy(), -1)
            yield made(batch.column("row"), texts, found, np.cumsum(gone[:-1]) == 0)

    rest = rows.withColumn("slot", slot(bits_of(touched), "key", "tie")).select("row", "text", "slot").mapInArrow(untouched, schema)
    packed = _packed(docs, touched, ("key", "tie"), id_column, text_column, row)
    joined = packed.join(spans.select("key", "tie", "spans"), ["key", "tie"])
    return rest.unionByName(joined.select("row", "packed", "spans").mapInArrow(cut, schema))


def joined_words(found: words.Words, stay: np.ndarray) -> pa.Array:
    """The words marked in ``stay`` of each text, joined by one blank."""
    starts, ends = found.starts[stay], found.ends[stay]
    owner = np.repeat(np.arange(len(found.first) - 1), found.counts())[stay]
    follows = np.zeros(len(starts), bool)
    follows[1:] = owner[1:] == owner[:-1]
    size = ends - starts + follows
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    keep = np.zeros(len(found.raw) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    body = np.ones(len(out), bool)
    body[to[:-1][follows]] = False
    out[body] = found.raw[np.cumsum(keep[:-1]).astype(bool)]
    per = np.searchsorted(owner, np.arange(len(found.first)))
    return pa.Array.from_buffers(pa.large_binary(), len(found.first) - 1, [None, pa.py_buffer(to[per].astype(np.int64)), pa.py_buffer(out)])


#: The same in SQL.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
e AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM g JOIN e USING (h) WHERE doc_id > low),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
