"""Jaccard join of documents on word n-grams with Bayesian pruning of candidates.

1. Documents with the same set of n-grams form a class; only classes go on.
2. Each class has MinHash values; classes that agree on all values of a band share a bucket.
3. The pairs of a bucket compare their values a few at a time. With m of n values equal, the posterior probability that the
   similarity reaches the threshold (from a flat prior) is a binomial tail; below ``tolerance`` the pair is dropped.
4. What survives joins classes to clusters. The n-gram sets of each cluster are compared exactly, which gives the links.

Large buckets and clusters are split into blocks, and each task compares two blocks; only counts and spanning edges
leave a task, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words
from plumbline.llm.components import components
from plumbline.llm.key_filters import among, bit_map, bits_of, slot, text_key
from plumbline.session import materialise

#: Classes in one block of a large bucket or cluster.
BLOCK = 1024
#: Pairs that one vectorised step compares.
STEP_PAIRS = 400_000


def shingles(found: words.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``n`` words of each text, ascending, and where each text begins. A shorter text is one run."""
    hashes = found.hashes()
    counts = found.counts()
    runs = words.window_hashes(hashes, n)
    at = np.flatnonzero(words.whole(found.first, n, len(runs))) if len(runs) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    keys, owners = runs[at], owner[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = [words.window_hashes(hashes[found.first[k] : found.first[k + 1]], int(counts[k]))[0] for k in short]
        keys, owners = np.concatenate([keys, np.array(own, np.uint64)]), np.concatenate([owners, short])
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], np.searchsorted(owners[new], np.arange(len(counts) + 1))


def signatures(keys: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (high 16 bits of the smallest of a random linear function, mixed by its place) of each set; sets must not be empty."""
    rng = np.random.default_rng(20_240_229)
    factors = rng.integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(first) - 1, size), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(size):
            least = np.minimum.reduceat(keys * factors[k], first[:-1])
            # the value must tell apart, so take bits that the minimum leaves random
            out[:, k] = (words.mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def least_matches(size: int, chunk: int, threshold: float, tolerance: float) -> dict[int, int]:
    """For n = chunk, 2 chunk, ...: the fewest equal values with which the posterior still reaches ``tolerance``.

    With a flat prior the posterior after m of n is Beta(m + 1, n - m + 1), whose mass above t is P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(chunk, size + 1, chunk):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of ``n`` nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), low)
        while True:
            next_ = root[root]
            if (next_ == root).all():
                break
            root = next_
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _pairs(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs between two blocks, or within one, in steps of bounded size."""
    if right is None:
        per = max(1, STEP_PAIRS // max(1, len(left)))
        for at in range(0, len(left), per):
            i, j = np.meshgrid(np.arange(at, min(at + per, len(left))), np.arange(len(left)), indexing="ij")
            keep = i < j
            yield left[i[keep]], left[j[keep]]
    else:
        per = max(1, STEP_PAIRS // max(1, len(right)))
        for at in range(0, len(left), per):
            i, j = np.meshgrid(left[at : at + per], right, indexing="ij")
            yield i.ravel(), j.ravel()


def _blocks(rows: DataFrame, key: str, size: str, member: str, weight: int) -> DataFrame:
    """Deals groups out to tasks: columns task and pair besides the given ones.

    A group of up to ``BLOCK`` members stays whole (pair 0, 0), and small groups share tasks by hash. A larger one is cut into
    blocks by a hash of the member, each block meets each, itself included, and each meeting is a task of its own.
    ``weight``: members that the groups of one task have together, about.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("long")
    own = F.pmod(F.xxhash64(member, F.lit("block")), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    spread = F.pmod(F.xxhash64(key, "p", "q"), F.lit(max(1, weight)))
    task = F.when(F.col("blocks") == 1, spread).otherwise(F.xxhash64(key, "p", "q"))
    return dealt.withColumn("task", task).drop("blocks", "other")


def _groups(table: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    """Row ranges of the groups (key, p, q) of a table that is sorted by them."""
    columns = [table.column(c).to_numpy() for c in (key, "p", "q")]
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if n else True
    begins = np.flatnonzero(new)
    yield from zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True)


def _sides(table: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray | None]:
    p, q = table.column("p")[a].as_py(), table.column("q")[a].as_py()
    rows = np.arange(a, b)
    if p == q:
        return rows, None
    own = table.column("own").to_numpy()[a:b]
    return rows[own == p], rows[own == q]


class Pruner:
    """Compares MinHash values step by step and keeps the pairs that may still reach the threshold."""

    def __init__(self, bands: int, rows: int, chunk: int, threshold: float, tolerance: float) -> None:
        self.rows, self.chunk = rows, chunk
        self.least = least_matches(bands * rows, chunk, threshold, tolerance)

    def __call__(self, values: np.ndarray, band: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for earlier in range(band):  # such pairs met in the bucket of an earlier band
            at = slice(earlier * self.rows, (earlier + 1) * self.rows)
            new = ~(values[i, at] == values[j, at]).all(1)
            i, j = i[new], j[new]
        same = np.zeros(len(i), np.int64)
        for n, least in self.least.items():
            at = slice(n - self.chunk, n)
            same += (values[i, at] == values[j, at]).sum(1)
            stay = same >= least
            i, j, same = i[stay], j[stay], same[stay]
        return i, j


def _documents(docs: DataFrame, ngram: int, size: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, tie (128 bits of the text), cls (hash of the set of n-grams, null without words), n (size of the set) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.steps(batches):
            found = words.of(batch.column("text"))
            keys, first = shingles(found, ngram)
            n = np.diff(first)
            full = np.flatnonzero(n)
            values = signatures(keys, np.concatenate([first[:-1][full], first[-1:]]), size) if len(full) else np.zeros((0, size), np.uint16)
            total = np.zeros(len(keys) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(words.mixed(keys + np.uint64(0xC1A55)), out=total[1:])
                cls = words.mixed(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64)
            lists: list[bytes | None] = [None] * len(n)
            for k, v in zip(full.tolist(), values, strict=True):
                lists[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(cls, mask=n == 0), pa.array(n.astype(np.int64)), pa.array(lists, pa.binary())], names=["doc_id", "tie", "cls", "n", "signature"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text_column).alias("tie"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie binary, cls long, n long, signature binary")


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.8,
    ngram: int = 5,
    bands: int = 32,
    rows: int = 5,
    chunk: int = 16,
    tolerance: float = 1e-5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, tie (128 bits of the text), class_id, n_links, n_shingles.

    Two documents are linked if the Jaccard similarity of their sets of runs of ``ngram`` words (a shorter text is one run) is at
    least ``threshold``; n_links counts the documents that a document is linked with, copies included. class_id is the
    smallest id of the documents that links connect. A pair at the threshold shares no bucket with probability
    (1 - threshold ** rows) ** bands, 3e-6 by default, and is dropped wrongly with about ``tolerance``.

    Null, empty and blank texts have no runs and no links; each is its own class. Repeated rows are documents that are linked
    with each other. Null ids stay; a class without any id has a null class_id. Ids must be whole numbers. Other
    columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    every = materialise(_documents(docs, ngram, bands * rows, id_column, text_column), "shingled")
    # one row per class; a document that stands for it is found again by its id and 128 bits of its text
    classes = every.filter("cls is not null").groupBy("cls")
    classes = classes.agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "tie")).alias("first"), F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
    classes = materialise(classes, "classes")
    values = classes.select("cls", "signature")

    def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(batch.num_rows, bands * rows)
            for at in range(0, batch.num_rows, 4000):
                own = sig[at : at + 4000].astype(np.uint64)
                key = np.zeros((len(own), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = words.mixed(key * np.uint64(0x9E3779B97F4A7C15) + own[:, r::rows] + np.uint64(r + 1))
                # the band in the highest bits, so that the smallest of equal buckets is that of the first band
                key = (key >> np.uint64(8)) | (np.arange(bands, dtype=np.uint64) << np.uint64(56))
                yield pa.RecordBatch.from_pydict({"cls": batch.column("cls")[at : at + 4000].take(pa.array(np.repeat(np.arange(len(own)), bands))), "key": pa.array(key.reshape(-1).view(np.int64))})

    entries = values.mapInArrow(band_keys, "cls long, key long")
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", "cls")).alias("y")).filter("size > 1")
    # buckets of several bands with the same members are one
    buckets = buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    shared = materialise(entries.join(buckets, "key"), "bucket-members")
    prune = Pruner(bands, rows, chunk, threshold, tolerance)

    def survivors(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("p", "ascending"), ("q", "ascending"), ("cls", "ascending")])
        own = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(table), bands * rows)
        cls, keys = table.column("cls").to_numpy(), table.column("key").to_numpy()
        a_out, b_out = [], []
        for a, b in _groups(table, "key"):
            left, right = _sides(table, a, b)
            root = np.arange(a, b)
            for i, j in _pairs(left, right):
                i, j = prune(own, int(keys[a]) >> 56, i, j)
                low = roots(b - a, np.concatenate([np.arange(b - a), i - a]), np.concatenate([root - a, j - a]))
                root = low + a
            moved = np.flatnonzero(root != np.arange(a, b))
            a_out.append(cls[root[moved]])
            b_out.append(cls[a + moved])
        words.release()
        return pa.table({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(shared.count() // 20_000))
    met = _blocks(shared, "key", "size", "cls", tasks).join(values, "cls")
    candidates = components(met.groupBy("task").applyInArrow(survivors, "a long, b long"))
    clusters = candidates.join(candidates.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    clusters = materialise(clusters.withColumnsRenamed({"node": "cls", "root": "cluster"}).join(classes.drop("signature"), "cls"), "clusters")

    # exact comparison: the sets are made again for the classes that are left
    wanted = clusters.select(F.coalesce("first.doc_id", F.lit(-1)).alias("key"), F.col("first.tie").alias("tie"), "cls", "cluster", "size", "weight")
    texts = _packed(docs, bit_map(wanted, "key", "tie"), id_column, text_column)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in words.steps(batches, "packed", words.STEP_BYTES // 4):
            keys, first = shingles(words.of(pa.array([unpack.decompress(t) for t in batch.column("packed").to_pylist()], pa.large_binary())), ngram)
            raw = pa.array([keys[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("cls", "cluster", "size", "weight")], raw], names=["cls", "cluster", "size", "weight", "shingles"])

    # repeated rows would come more than once
    found = texts.join(wanted, ["key", "tie"]).dropDuplicates(["key", "tie"]).mapInArrow(sets, "cls long, cluster long, size long, weight long, shingles binary")
    part = Fraction(str(threshold))
    up, down = part.numerator, part.denominator

    def verified(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("p", "ascending"), ("q", "ascending"), ("cls", "ascending")])
        raw = table.column("shingles").to_pylist()
        cls, weight = table.column("cls").to_numpy(), table.column("weight").to_numpy()
        out: dict[str, list[np.ndarray]] = {"cls": [], "links": [], "root": []}
        for a, b in _groups(table, "cluster"):
            left, right = _sides(table, a, b)
            own = [np.frombuffer(raw[k], np.uint64) for k in range(a, b)]
            size = np.array([len(x) for x in own])
            left, right = left - a, (None if right is None else right - a)
            common = _common(own, left, right)
            other = left if right is None else right
            # similar if common / (x + y - common) >= up / down
            linked = (up + down) * common >= up * (size[left][:, None] + size[other][None, :])
            if right is None:
                np.fill_diagonal(linked, False)
            links = np.zeros(b - a, np.int64)
            links[left] += linked @ weight[a + other]
            if right is not None:
                links[right] += linked.T @ weight[a + left]
            i, j = np.nonzero(linked)
            out["cls"].append(cls[a:b])
            out["links"].append(links)
            out["root"].append(cls[a + roots(b - a, left[i], other[j])])
        words.release()
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(clusters.count() // 400))
    compared = materialise(_blocks(found, "cluster", "size", "cls", tasks).groupBy("task").applyInArrow(verified, "cls long, links long, root long"), "verified")
    joined = components(compared.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = classes.join(links, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    linked = linked.select("cls", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"), "least")
    names = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = linked.join(names, "root").select("cls", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = every.select("doc_id", "tie", "cls", "n").join(linked, "cls", "left")
    class_id = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "tie", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"))


def _common(own: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Sizes of the intersections of the sets ``own[left]`` with ``own[right]`` (or ``own[left]``), by products of 0/1 matrices."""
    size = np.array([len(x) for x in own])
    _, place, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = n > 1  # others can't be common
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(own)), size)[shared[place]]
    column = number[place[shared[place]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    other = left if right is None else right
    out = np.zeros((len(left), len(other)), np.float64)
    width = max(256, 4_000_000 // max(1, len(own)))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(own), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense[left] @ dense[other].T
    return np.rint(out).astype(np.int64)


def _packed(docs: DataFrame, wanted: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """key, tie and compressed text of the rows that the bit map lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        bitmap = shared.value
        for whole in batches:
            batch = whole.filter(pa.array(among(bitmap, whole.column("slot"))))
            texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tie"), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["key", "tie", "packed"])

    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-1)).alias("key"), text_key(text_column).alias("tie"), F.col(text_column).alias("text"))
    rows = rows.withColumn("slot", slot(bits_of(wanted), "key", "tie"))
    return rows.mapInArrow(run, "key long, tie binary, packed binary")


def keep_first(docs: DataFrame, joined: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents of which no class member has a smaller id: one of each class, and all without a class.

    Of repeated rows of that id one stays; of rows with that id and different texts in one class, the one with the smallest
    tie. Classes without any id count as one. Texts without words all stay.
    """
    no_id = F.lit(1 << 62)
    first = joined.filter(F.col("n_shingles") > 0).groupBy(F.coalesce("class_id", no_id).alias("class")).agg(F.min(F.struct(F.coalesce("doc_id", no_id).alias("id"), "tie")).alias("first"))
    chosen = first.select(F.col("first.id").alias("_id"), F.col("first.tie").alias("_tie"), F.lit(True).alias("_one"))
    blank = joined.filter(F.col("n_shingles") == 0).select(F.coalesce("doc_id", no_id).alias("_id"), F.col("tie").alias("_tie"), F.lit(False).alias("_one"))
    stay = chosen.unionByName(blank).groupBy("_id", "_tie").agg(F.max("_one").alias("_one"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_column).cast("long"), no_id).alias("_id"), text_key(text_column).alias("_tie"))
    kept = rows.join(stay, ["_id", "_tie"]).withColumn("_number", F.when(~F.col("_one"), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["_id", "_tie", "_number"]).select("_row.*")


#: The same in SQL.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS class_id, CAST(count(e.b) AS BIGINT) AS n_links,
       CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN e ON e.a = w.doc_id GROUP BY w.doc_id
"""
