"""Approximate nearest neighbours: an inverted index whose lists are scanned by blocks of dimensions.

Vectors are rotated at random, so that the first d of D dimensions hold about d / D of any squared distance. Within a
probed list the dimensions are added block by block, and a candidate is abandoned as soon as its partial distance is
so large that, under the rotation, a full distance below the current k-th best is refuted by a test with the deviation
``epsilon``. What is left gets its exact distance on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

#: Candidates of one list in one task; larger lists are dealt out in as many parts as needed.
PART = 4096
#: Queries that one task scans a part for.
ASKED = 4096


@dataclass(frozen=True)
class Index:
    """Centroids in rotated space, the rotation, and for each list how many lists around a query of it to probe."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def valid_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part.

    Null ids, null, empty and zero vectors, and those with null or non-finite components take no part. Of the others,
    those with the most frequent number of dimensions do (the larger one of equals). A repeated id counts once, with the
    smallest of its vectors.
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector_column, lambda x: x.cast("double")).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :])


def train(sample: np.ndarray, lists: int, k: int, recall: float, rounds: int = 12, seed: int = 7) -> Index:
    """Rotation, k-means centroids from ``sample``, and the number of probes that reaches ``recall`` within the sample."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))
    rotation = q * np.sign(np.diag(r))
    x = np.unique(sample @ rotation, axis=0)
    lists = max(1, min(lists, len(x)))
    centroids = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = np.concatenate([_squares(x[a : a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], x[rng.permutation(len(x))[:lists]])
    near = np.concatenate([_squares(x[a : a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)])
    # how far down the order of lists the true neighbours of some members of the sample lie
    asked = rng.permutation(len(x))[:400]
    depth = []
    for a in asked:
        d = _squares(x[a : a + 1], x)[0]
        d[a] = np.inf
        best = np.argpartition(d, min(k, len(x) - 1))[: min(k, len(x) - 1)] if len(x) > 1 else np.zeros(0, int)
        order = np.empty(lists, int)
        order[np.argsort(_squares(x[a : a + 1], centroids)[0], kind="stable")] = np.arange(lists)
        depth.extend(order[near[best]].tolist())
    probes = int(np.quantile(depth, recall, method="higher")) + 1 if depth else lists
    return Index(rotation, centroids, min(lists, probes))


class Scanner:
    """Scans candidates in blocks of rotated dimensions for one query at a time."""

    def __init__(self, rotated: np.ndarray, plain: np.ndarray, ids: np.ndarray, block: int, epsilon: float) -> None:
        self.columns = [np.ascontiguousarray(rotated[:, a : a + block]) for a in range(0, rotated.shape[1], block)]
        self.plain, self.ids, self.block, self.epsilon = plain, ids, block, epsilon
        self.width = rotated.shape[1]
        self.scanned = 0

    def best(self, query: np.ndarray, plain: np.ndarray, own_id: int | None, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact squared distances of the nearest ``k`` found; ``limit`` is a known bound on the k-th.

        After each of the first blocks the candidates that look nearest get their distances, which tightens the bound before
        the test of all others.
        """
        alive = np.arange(len(self.ids)) if own_id is None else np.flatnonzero(self.ids != own_id)
        partial = np.zeros(len(alive))
        done = 0
        for c, column in enumerate(self.columns):
            at = slice(c * self.block, c * self.block + column.shape[1])
            step = column[alive] - query[at]
            partial += np.einsum("ij,ij->i", step, step)
            done += column.shape[1]
            self.scanned += len(alive) * column.shape[1]
            if done == self.width:
                break
            # worth it where it is cheap beside what is left to scan
            if c < 3 and len(alive) > 16 * k or math.isinf(limit) and len(alive) > 2 * k:
                head = alive[np.argpartition(partial, k - 1)[:k]]
                limit = min(limit, float(self._exact(plain, head).max()))
                self.scanned += len(head) * self.width
            if math.isfinite(limit):
                # under a random rotation sqrt(partial * width / done) strays from the distance by about epsilon / sqrt(done) of it
                bound = limit * (1 + self.epsilon / math.sqrt(done)) ** 2
                stay = partial * (self.width / done) <= bound
                alive, partial = alive[stay], partial[stay]
        exact = self._exact(plain, alive)
        order = np.lexsort((self.ids[alive], exact))[:k]
        return alive[order], exact[order]

    def _exact(self, plain: np.ndarray, at: np.ndarray) -> np.ndarray:
        step = self.plain[at] - plain
        return np.einsum("ij,ij->i", step, step)


def search(
    table: DataFrame,
    every: int = 100,
    k: int = 10,
    recall: float = 0.97,
    sample_rows: int = 20_000,
    block: int = 8,
    epsilon: float = 2.1,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. The
    query itself is no candidate; with fewer candidates than ``k`` all come. See ``valid_vectors`` for the rows that take part; an
    empty table gives no rows.

    The index is learned from about ``sample_rows`` rows, drawn by a hash of the id: sqrt(rows) lists, but no more than a
    sixteenth of the sample, and as many probes as put ``recall`` of the sample's own neighbours into probed lists. Every
    row is put into the list of its nearest centroid; of equal vectors only the ``k`` + 1 smallest ids, as no other can be among
    anyone's nearest, and equal queries are searched once. A query scans its nearest list first. What it finds there bounds the scans of its
    other lists: at least as many as were learned, and more until they hold ``k`` candidates besides itself. Lists are
    dealt out in parts of about ``PART`` candidates and ``ASKED`` queries, and the best of all parts are merged.
    """
    spark = table.sparkSession
    rows = materialise(valid_vectors(table, id_column, vector_column), "vectors")
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("index")), F.lit(1_000_000)) < sample_rows * 1_000_000 // total + 1)
    sample = drawn.orderBy("vec_id").select("vector").toArrow().column("vector").combine_chunks()
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(1000).select("vector").toArrow().column("vector").combine_chunks()
    width = len(sample[0])
    index = train(_matrix(sample, width), min(math.isqrt(total), max(1, len(sample) // 16)), k, recall)
    shared = spark.sparkContext.broadcast((index.rotation, index.centroids, index.probes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _squares(_matrix(part.column("vector"), width) @ own.rotation, own.centroids).argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), pa.array(near.astype(np.int32))], names=["vec_id", "vector", "list"])

    few = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.withColumn("_rn", F.row_number().over(few)).filter(F.col("_rn") <= k + 1).drop("_rn")
    listed = materialise(kept.mapInArrow(assign, "vec_id long, vector array<double>, list int"), "listed")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    size_of = spark.sparkContext.broadcast(sizes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Index(*shared.value), size_of.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("vector"), width) @ own.rotation
                order = np.argsort(_squares(x, own.centroids), axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                # lists up to the first with enough candidates besides the query, and at least the usual number
                need = np.maximum(own.probes, (held < k + 1).sum(1) + 1)
                q, nth = np.nonzero(np.arange(order.shape[1])[None, :] < need[:, None])
                lists = order[q, nth]
                parts = -(-n[lists] // PART)
                q, nth, lists = np.repeat(q, parts), np.repeat(nth, parts), np.repeat(lists, parts)
                number = np.arange(len(q)) - np.repeat(np.cumsum(parts) - parts, parts)
                arrays = [part.column("vec_id").take(pa.array(q)), part.column("vector").take(pa.array(q))]
                arrays += [pa.array(v.astype(np.int32)) for v in (lists, number, nth)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vector", "list", "part", "nth"])

    # rows with equal vectors ask the same: the one with the smallest id asks for all
    asking = rows.filter(F.col("vec_id") % every == 0).withColumn("first", F.min("vec_id").over(Window.partitionBy("vector")))
    asking = materialise(asking, "queries")
    asked = asking.filter(F.col("vec_id") == F.col("first")).select("vec_id", "vector")
    probes = materialise(asked.mapInArrow(probe, "query_id long, vector array<double>, list int, part int, nth int"), "probes")
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // ASKED)))).cast("int")
    counts = spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(sizes), dtype=np.int32)), "parts": pa.array(np.maximum(1, -(-sizes // PART)))}))
    dealt = listed.join(F.broadcast(counts), "list")  # one row per list
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def scan(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "square": []}
        if left.num_rows and right.num_rows:
            own = Index(*shared.value)
            left = left.sort_by("vec_id")
            plain = _matrix(left.column("vector").combine_chunks(), width)
            ids = left.column("vec_id").to_numpy()
            scanner = Scanner(plain @ own.rotation, plain, ids, block, epsilon)
            vectors = _matrix(right.column("vector").combine_chunks(), width)
            turned = vectors @ own.rotation
            limits = right.column("limit").to_numpy()
            for n, q in enumerate(right.column("query_id").to_numpy()):
                at, square = scanner.best(turned[n], vectors[n], None, k + 1, limits[n])
                out["query_id"].append(np.full(len(at), q))
                out["vec_id"].append(ids[at])
                out["square"].append(square)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "square" else np.int64) for c, v in out.items()})

    def scanned(visits: DataFrame) -> DataFrame:
        visits = visits.withColumn("chunk", chunk)
        needed = visits.select(F.col("list").alias("l"), F.col("part").alias("p"), F.col("chunk").alias("c")).distinct()
        facing = dealt.join(needed, (F.col("list") == F.col("l")) & (F.col("part") == F.col("p")))
        groups = facing.groupBy("l", "p", "c").cogroup(visits.groupBy("list", "part", "chunk"))
        return groups.applyInArrow(scan, "query_id long, vec_id long, square double")

    order = Window.partitionBy("query_id").orderBy("square", "vec_id")
    near = materialise(scanned(probes.filter("nth = 0").withColumn("limit", F.lit(math.inf))), "nearest-lists")
    placed = near.withColumn("rank", F.row_number().over(order))
    # found already: the bound for all other lists, a little widened for rounding
    bounds = placed.filter(F.col("rank") == k + 1).select(F.col("query_id").alias("q"), (F.col("square") * (1 + 1e-12)).alias("bound"))
    others = probes.filter("nth > 0").join(bounds, F.col("query_id") == F.col("q"), "left").drop("q")
    others = others.withColumn("limit", F.coalesce("bound", F.lit(math.inf))).drop("bound")
    # at most k + 1 rows of each probed part of a list meet here
    found = near.unionByName(scanned(others))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    each = asking.select(F.col("vec_id").alias("own"), F.col("first").alias("f"))
    told = best.join(each, F.col("query_id") == F.col("f")).filter(F.col("vec_id") != F.col("own"))
    last = Window.partitionBy("own").orderBy("square", "vec_id")
    told = told.withColumn("nth", F.row_number().over(last)).filter(F.col("nth") <= k)
    return told.select(F.col("own").alias("query_id"), F.col("nth").cast("int").alias("rank"), "vec_id", F.sqrt("square").alias("score"))
