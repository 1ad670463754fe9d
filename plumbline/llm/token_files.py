"""Token ids in binary files of independent zstandard frames with a seek table.

One file holds the documents of one range of ids, in ascending order. Its parts:

* data frames: the token stream, cut every ``frame_tokens`` ids, each frame compressed on its own. Ids are
  little-endian unsigned numbers of 2 bytes if the vocabulary allows it, else 4;
* a skippable frame with the directory: id and number of tokens of each document, and the width of an id;
* a skippable frame with the seek table of the public seekable format: compressed size, plain size and checksum
  (low half of XXH64) of each data frame.

Any zstandard reader can decompress a file as a whole; a reader that wants some documents fetches the two tables from
the end and then only the frames that hold these documents.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.tokens import word_ids
from plumbline.session import materialise, scratch_path

#: Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKED = 0x80

#: Tokens of a file that one task reads back, with the documents that begin in them.
READ_TOKENS = 1 << 22

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"


class CorruptFrame(ValueError):
    """A frame's content doesn't match its checksum."""


class FrameWriter:
    """Writes one file; ids come in any pieces, documents are declared by their length."""

    def __init__(self, out, width: int, frame_tokens: int, level: int = 3) -> None:  # noqa: ANN001
        self.out, self.width, self.frame_tokens = out, width, frame_tokens
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_bytes = 0
        self.table: list[tuple[int, int, int]] = []

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(f"<u{self.width}"))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_tokens:
            stream = np.concatenate(self.waiting)
            upto = len(stream) - len(stream) % self.frame_tokens
            for at in range(0, upto, self.frame_tokens):
                self._frame(stream[at : at + self.frame_tokens])
            self.waiting, self.n_waiting = [stream[upto:]], len(stream) - upto

    def _frame(self, ids: np.ndarray) -> None:
        plain = ids.tobytes()
        packed = self.pack.compress(plain)
        self._put(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def close(self, doc_ids: pa.Array, lengths: pa.Array) -> None:
        if self.n_waiting:
            self._frame(np.concatenate(self.waiting))
        sink = io.BytesIO()
        schema = pa.schema([("id", doc_ids.type), ("n", pa.int64())], {"width": str(self.width), "frame_tokens": str(self.frame_tokens)})
        with pa.ipc.new_stream(sink, schema) as w:
            w.write_batch(pa.record_batch([doc_ids, lengths], schema=schema))
        directory = self.pack.compress(sink.getvalue())
        self._put(struct.pack("<II", SKIPPABLE, len(directory) + 4) + directory + struct.pack("<I", xxhash.xxh64_intdigest(directory) & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self._put(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE))


class FrameReader:
    """Reads one file by parts: the tables first, then frames on demand."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & CHECKED:
            raise CorruptFrame("no seek table with checksums at the end of the file")
        at = size - 9 - 12 * n - 8
        self.table = np.frombuffer(source.read_at(12 * n, at + 8), "<u4").reshape(n, 3).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        data_end = int(self.begins[-1])
        packed = source.read_at(at - data_end - 8, data_end + 8)
        if xxhash.xxh64_intdigest(packed[:-4]) & 0xFFFFFFFF != struct.unpack("<I", packed[-4:])[0]:
            raise CorruptFrame("the directory doesn't match its checksum")
        self.unpack = zstandard.ZstdDecompressor()
        found = pa.ipc.open_stream(self.unpack.decompress(packed[:-4], max_output_size=1 << 31)).read_all()
        self.width, self.frame_tokens = (int(found.schema.metadata[k]) for k in (b"width", b"frame_tokens"))
        self.doc_ids = found.column("id").combine_chunks()
        lengths = found.column("n").to_numpy()
        self.first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            plain = self.unpack.decompress(self.source.read_at(int(self.table[k, 0]), int(self.begins[k])), max_output_size=int(self.table[k, 1]))
            if len(plain) != self.table[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
                raise CorruptFrame(f"frame {k} doesn't match its checksum")
            self.held = k, np.frombuffer(plain, f"<u{self.width}").astype("<u4")
        return self.held[1]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frames are decompressed."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        out = []
        while a < b:
            f, at = divmod(a, self.frame_tokens)
            upto = min(b - f * self.frame_tokens, self.frame_tokens)
            out.append(self.frame(f)[at:upto])
            a = f * self.frame_tokens + upto
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, "<u4"), *out])


def write_token_files(
    docs: DataFrame,
    definition: str,
    end_id: int,
    folder: str | None = None,
    frame_tokens: int = 1 << 16,
    width: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode whole texts and write them as files in ascending order of the id; returns the manifest, one row per file.

    ``definition`` is the text of a tokenizer file that drops white space (see ``WordIds``). ``folder`` must be reachable
    from every executor by ``pyarrow.fs``; by default it lies in the shared scratch folder. A null text is an empty
    document: its end id alone. Rows with equal ids stay, next to each other; a null id comes first. Other columns
    are not read. An empty table gives an empty manifest.

    The rows are dealt by ranges of (id, hash of the text), so that repeated ids spread too. Each attempt of a task
    writes a file with a name of its own; the manifest, written by Spark's commit protocol, names the ones that count, so
    lost executors and repeated attempts do no harm.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    text = spark.sparkContext.broadcast(definition)
    id_type = docs.schema[id_column].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_ids(text.value), TaskContext.get().partitionId()
        names: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        writer = out = None
        for batch in words.steps(batches):
            ids, first = encode(batch.column("text"), end_id)
            if writer is None:
                system, root = pafs.FileSystem.from_uri(folder)
                system.create_dir(root, recursive=True)
                path = f"{root}/{part:06d}-{uuid.uuid4().hex}.ids"
                out = system.open_output_stream(path, compression=None)
                writer = FrameWriter(out, width, frame_tokens)
            if width == 2 and len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id needs more than 2 bytes; give width=4")
            writer.add(ids)
            names.append(batch.column("id"))
            lengths.append(np.diff(first))
        if writer is not None:
            n = np.concatenate(lengths)
            writer.close(pa.concat_arrays(names), pa.array(n, pa.int64()))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(n)], "n_tokens": [int(n.sum())], "n_bytes": [writer.n_bytes]})

    rows = docs.select(F.col(id_column).cast(id_type).alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return materialise(rows.mapInArrow(write, MANIFEST), "token-manifest").withColumn("folder", F.lit(folder))


def _open(folder: str, path: str) -> FrameReader:
    return FrameReader(pafs.FileSystem.from_uri(folder)[0].open_input_file(path))


def read_token_files(manifest: DataFrame, wanted: DataFrame | None = None, id_type: str = "long") -> DataFrame:
    """Documents of the files in ``manifest``: doc_id, start (tokens before it in all files), n_tokens, ids.

    ``ids`` are the bytes of little-endian unsigned 32-bit numbers. With ``wanted``, a table with the column doc_id, only
    the frames that hold these documents are decompressed; every occurrence of a wanted id is returned, null ids never are.
    A frame that doesn't match its checksum is an error.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per file: the only place where all files meet
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    schema = f"doc_id {id_type}, start long, n_tokens long, ids binary"

    def pick(reader: FrameReader, before: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            yield pa.RecordBatch.from_pydict({
                "doc_id": reader.doc_ids.take(pa.array(some)),
                "start": pa.array(before + reader.first[some], pa.int64()),
                "n_tokens": pa.array(reader.first[some + 1] - reader.first[some], pa.int64()),
                "ids": pa.array([reader.document(k).tobytes() for k in some], pa.binary()),
            })

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = _open(row["folder"], row["path"])
                # the documents that begin in this run of tokens; empty ones don't exist, as each has its end id
                a, b = np.searchsorted(reader.first[:-1], [row["run"] * READ_TOKENS, (row["run"] + 1) * READ_TOKENS])
                yield from pick(reader, row["before"], np.arange(a, b))

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = _open(row["folder"], row["path"])
                n = len(reader.doc_ids)
                yield pa.RecordBatch.from_pydict({"doc_id": reader.doc_ids, "at": pa.array(np.arange(n)), "path": [row["path"]] * n, "folder": [row["folder"]] * n, "before": pa.array([row["before"]] * n, pa.int64())})

    def some_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            table = batch.to_pandas()
            for (folder, own), rows in table.groupby(["folder", "path"], sort=False):
                if own != path:
                    reader, path = _open(folder, own), own
                yield from pick(reader, int(rows["before"].iloc[0]), rows["at"].to_numpy())

    runs = F.ceil(F.col("n_tokens") / READ_TOKENS)
    n_files, n_runs = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum(runs), F.lit(0))).first()
    if wanted is None:
        # a number of partitions that is given is not made smaller by the planner: one task for each run of tokens
        each = files.select("folder", "path", "before", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)).alias("run"))
        return each.repartition(max(1, n_runs)).mapInArrow(all_of, schema)
    tasks = files.select("folder", "path", "before").repartition(max(1, n_files))
    entries = tasks.mapInArrow(directory, f"doc_id {id_type}, at long, path string, folder string, before long")
    found = entries.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.repartition("path").sortWithinPartitions("path", "at").mapInArrow(some_of, schema)
