"""Exact nearest neighbours of every query row among train rows, without comparing all pairs.

Train rows are dealt to the cells of pivots and, inside a cell, to rings of like distance from its pivot. The triangle inequality gives
every query a distance within which its k nearest must lie, and every ring a distance below which none of its rows
can lie; a query visits its home ring first, which tightens the former, and then the rings that can still matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.arrow import matrix
from plumbline.functions.scalars import col
from plumbline.session import discard, materialise

#: Train rows that one task compares.
BLOCK_ROWS = 50_000
#: Query rows that one task compares with one block.
QUERY_ROWS = 50_000
#: Pivots, and rings of all cells together, at most. Beyond, blocks get larger, so that both stay small enough to travel with tasks.
MAX_PIVOTS = 1_024
MAX_RINGS = 65_536
CHUNK_CELLS = 4_000_000
CHUNK_PAIRS = 200_000
#: Train rows of a leaf at least, and queries that look for leaves together at most.
LEAF_ROWS = 64
GROUP_ROWS = 256
#: Leaves are given up if queries of so many leaves had to be compared with more than that share of all rows.
TRIAL_LEAVES = 8
TRIAL_SHARE = 0.25
#: Bounds are wider than computed by this share, since distances are rounded.
SLACK = 1e-9

FOUND = "array<struct<distance:double,id:bigint,label:double>>"
LISTS = f"query bigint, x array<double>, found {FOUND}"
VISITS = "query bigint, x array<double>, kth double, ring int, part int"


def closest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``x``, squared distance) of the k nearest rows of ``x`` for each row of ``q``, by exact squared distance,
    then id; farther ones than a row's ``limit`` may be left out.

    Rows of ``x`` lie in leaves of a tree with a box each. What is found in a query's own leaf bounds how far others can matter, and only rows
    in boxes within that bound are compared; where boxes leave out too little, as with many columns, all rows are. A matrix product bounds the
    distances; only pairs that can be among the k nearest are computed exactly, so rounding in the product does not decide anything.
    """
    limit = np.full(len(q), np.inf) if limit is None else limit
    whole_q, whole_x = (np.flatnonzero(np.isfinite(v).all(axis=1)) for v in (q, x))
    if len(whole_q) < len(q) or len(whole_x) < len(x):  # nothing is near to what has no place
        if not len(whole_q) or not len(whole_x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, to, exact = closest(q[whole_q], x[whole_x], ids[whole_x], k, limit[whole_q])
        return whole_q[at], whole_x[to], exact
    order, starts, groups = _leaves(x, q, max(LEAF_ROWS, k, 32 * len(x) // max(1, len(q))))
    groups = [groups[i] for i in np.random.default_rng(0).permutation(len(groups))]  # neighbouring leaves are alike
    ends = np.append(starts[1:], len(x))
    boxed = x[order]
    low, high = (f.reduceat(boxed, starts, axis=0) for f in (np.minimum, np.maximum))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = tried = compared = possible = 0
    norms = None
    step = max(1, min(GROUP_ROWS, CHUNK_CELLS // len(x)))
    while groups:
        if tried == TRIAL_LEAVES and compared > TRIAL_SHARE * possible:
            groups = [(0, np.concatenate([g[1] for g in groups]))]
            starts, ends, low, high = starts[:1], ends[-1:], low.min(axis=0)[None], high.max(axis=0)[None]
            middle = boxed.mean(axis=0)
            there = boxed - middle
            norms = (there * there).sum(axis=1)
        leaf, whole = groups.pop()
        tried += 1
        possible += len(whole) * len(x)
        own = np.arange(starts[leaf], ends[leaf])
        todo = [whole[s : s + step] for s in range(0, len(whole), step)]
        while todo:
            mine = todo.pop()
            part = q[mine]
            centre = part.mean(axis=0) if norms is None else middle
            part_there = part - centre
            rough, slack = _rough(part_there, boxed[own] - centre if norms is None else there, norms)
            reach = limit[mine] * (1 + SLACK)
            if len(own) >= k:
                reach = np.minimum(reach, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
            apart = np.maximum(np.maximum(low - part.max(axis=0), part.min(axis=0) - high), 0.0)
            near = np.flatnonzero((apart * apart).sum(axis=1) <= reach.max() * (1 + SLACK))
            if 2 * len(near) < len(starts):
                least = np.zeros((len(part), len(near)))
                for c in range(x.shape[1]):
                    gap = np.maximum(np.maximum(low[near, c] - part[:, c, None], part[:, c, None] - high[near, c]), 0.0)
                    least += gap * gap
                need = least <= reach[:, None] * (1 + SLACK)
                used = need.any(axis=0)
                if len(mine) > 8 and 4 * need.sum() < len(mine) * used.sum():  # a few queries need what the others do not
                    by_need = np.argsort(need.sum(axis=1), kind="stable")
                    todo += [mine[by_need[: len(mine) // 2]], mine[by_need[len(mine) // 2 :]]]
                    continue
                near = near[used]
            if not len(near):
                continue
            rows = own
            if near.tolist() != [leaf]:
                rows = np.concatenate([np.arange(starts[n], ends[n]) for n in near])
                rough, slack = _rough(part_there, boxed[rows] - centre)
            compared += rough.size
            bar = reach + slack
            close = rough <= bar[:, None]
            if len(rows) >= k and np.count_nonzero(close) > 8 * k * len(part):
                bar = np.minimum(bar, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
                close = rough <= bar[:, None]
            at, to = np.nonzero(close)
            held.append((mine[at], order[rows[to]]))
            n_held += len(at)
            if n_held >= CHUNK_PAIRS:
                done.append(_nearest_pairs(q, x, ids, k, held))
                held, n_held = [], 0
    done.append(_nearest_pairs(q, x, ids, k, held))
    at, to, exact = (np.concatenate([d[i] for d in done]) for i in range(3))
    by_query = np.argsort(at, kind="stable")
    return at[by_query], to[by_query], exact[by_query]


def _rough(part: np.ndarray, x: np.ndarray, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances from a matrix product, and how far off they can be for each row of ``part``."""
    norms = (x * x).sum(axis=1) if norms is None else norms
    own = (part * part).sum(axis=1)
    rough = -2.0 * part @ x.T
    rough += norms
    rough += own[:, None]
    return rough, SLACK * (own + norms.max())


def _nearest_pairs(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the pairs of each query, exactly."""
    at, to = (np.concatenate([np.zeros(0, np.int64), *[h[i] for h in held]]) for i in range(2))
    exact = np.empty(len(at))
    for c in range(0, len(at), CHUNK_PAIRS):  # many pairs remain where many rows are copies
        diff = q[at[c : c + CHUNK_PAIRS]] - x[to[c : c + CHUNK_PAIRS]]
        exact[c : c + CHUNK_PAIRS] = (diff * diff).sum(axis=1)
    order = np.lexsort((ids[to], exact, at))
    at, to, exact = at[order], to[order], exact[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[best], to[best], exact[best]


def _leaves(x: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Halves of halves of the rows of ``x``, each cut at the median of its widest column, until none has more than ``size`` rows: the rows in
    the order of the leaves, where each leaf starts, and the rows of ``q`` that fall into it. Equal values may lie in both halves."""
    order = np.arange(len(x))
    starts: list[int] = []
    groups: list[tuple[int, np.ndarray]] = []
    todo = [(0, len(x), np.arange(len(q)))]
    while todo:
        begin, end, mine = todo.pop()
        if end - begin <= size:
            if len(mine):
                groups.append((len(starts), mine))
            starts.append(begin)
            continue
        part = x[order[begin:end]]
        wide = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        middle = (end - begin) // 2
        halves = np.argpartition(part[:, wide], middle)
        order[begin:end] = order[begin:end][halves]
        right = q[mine, wide] >= part[halves[middle], wide]
        todo += [(begin + middle, end, mine[right]), (begin, begin + middle, mine[~right])]
    return order, np.array(starts), groups


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _compared(left: pa.Table, right: pa.Table, query: str, k: int) -> pa.Table:
    """A list of the nearest rows of ``right`` for each row of ``left``; of rows with a finite ``kth``, only lists that are not empty."""
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64()), ("label", pa.float64())]))]
    names = ["query", "x", "found"]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names)
    limit = _numbers(left.column("kth")) if "kth" in left.column_names else np.full(left.num_rows, np.inf)
    ids, y = _numbers(right.column("id")), _numbers(right.column("y"))
    at, to, exact = closest(matrix(left.column("x")), matrix(right.column("x")), ids, k, limit)
    begins = pa.array(np.searchsorted(at, np.arange(left.num_rows + 1)).astype(np.int32))
    parts = [pa.array(exact), pa.array(ids[to]), pa.array(y[to].astype(float), from_pandas=True)]
    lists = pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays(parts, ["distance", "id", "label"]))
    out = pa.table([left.column(query), left.column("x"), lists], names)
    kept = np.isinf(limit) | (np.diff(begins.to_numpy()) > 0)
    return out if kept.all() else out.filter(pa.array(kept))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of both, from differences, so that near rows lose no digits."""
    out = np.empty((len(a), len(b)))
    step = max(1, CHUNK_CELLS // max(1, b.size))
    for s in range(0, len(a), step):
        diff = a[s : s + step, None, :] - b[None, :, :]
        out[s : s + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


@dataclass(frozen=True)
class Rings:
    """What a query needs to know about the train side; at most MAX_PIVOTS cells and MAX_RINGS rings."""

    centres: np.ndarray
    nearest: np.ndarray  # per cell, the k least distances to its pivot
    cell: np.ndarray  # per ring
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray  # blocks that share the ring
    k: int

    def home(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the ring in which rows lie, or to which they are next, by their distances to the pivots."""
        cell = d.argmin(axis=1)
        own = d[np.arange(len(d)), cell]
        ring = np.zeros(len(d), np.int64)
        for c in np.unique(cell):
            here, of = np.flatnonzero(cell == c), np.flatnonzero(self.cell == c)
            if len(of):
                gap = np.maximum(own[here, None] - self.high[of], self.low[of] - own[here, None])
                ring[here] = of[gap.argmin(axis=1)]
        return cell, ring

    def least(self, d: np.ndarray, home_cell: np.ndarray) -> np.ndarray:
        """For each row, the least possible distance of each ring."""
        apart = _distances(self.centres, self.centres)[home_cell]
        own = d[np.arange(len(d)), home_cell][:, None]
        # a row of another cell is nearer to that pivot than to the query's: it lies beyond the plane between them
        plane = np.where(apart > 0, (d * d - own * own) / (2 * np.where(apart > 0, apart, 1.0)), 0.0)
        to = d[:, self.cell]
        return np.maximum(np.maximum(to - self.high, self.low - to), np.maximum(plane[:, self.cell], 0.0))

    def reach(self, d: np.ndarray) -> np.ndarray:
        """For each row, a distance that holds its k nearest."""
        out = np.empty(len(d))
        step = max(1, CHUNK_CELLS // self.nearest.size)
        for s in range(0, len(d), step):
            upper = (d[s : s + step, :, None] + self.nearest[None]).reshape(len(d[s : s + step]), -1)
            kth = min(self.k, upper.shape[1]) - 1
            out[s : s + step] = np.partition(upper, kth, axis=1)[:, kth]
        return out


@dataclass(frozen=True)
class TrainIndex:
    """Train rows (ring, part, id, x, y), and their rings."""

    rows: DataFrame
    rings: Rings

    @staticmethod
    def fit(train: DataFrame, k: int, n: int, block_rows: int = BLOCK_ROWS) -> TrainIndex:
        """``train`` has (id, x, y) and ``n`` rows. Of equal vectors only the k smallest ids can be among anyone's k nearest."""
        first = Window.partitionBy(F.xxhash64("x"), "x").orderBy("id")  # numbers are sorted faster than vectors
        kept = train.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k).drop("_rn")
        blocks = min(MAX_RINGS // 2, -(-n // block_rows))
        pivots = min(MAX_PIVOTS, max(1, round(4 * blocks**0.5)), n)
        drawn = train.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(pivots).collect()
        centres = np.array([r[0] for r in drawn], float)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = _distances(matrix(batch.column("x")), centres)
                    cell = d.argmin(axis=1).astype(np.int32)
                    columns = [*batch.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "x", "y", "cell", "gone"])

        dealt = materialise(kept.select("id", "x", "y").mapInArrow(assign, "id bigint, x array<double>, y double, cell int, gone double"), "cells")
        near = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("cell").orderBy("gone", "id"))).filter(F.col("_rn") <= k)
        nearest = np.full((len(centres), k), np.inf)
        for c, place, gone in near.select("cell", "_rn", "gone").collect():  # k rows of each cell
            nearest[c, place - 1] = gone
        size = max(block_rows, -(-n // (MAX_RINGS // 2)))
        counts = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        shares = {c: -(-m // size) for c, m in counts.items()}
        cuts: dict[int, list[float]] = {c: [] for c in counts}
        for pieces in sorted(set(shares.values()) - {1}):
            wide = [c for c, p in shares.items() if p == pieces]
            at = [i / pieces for i in range(1, pieces)]
            quantiles = F.percentile_approx("gone", at, 10_000).alias("cuts")  # any cuts give right results
            for r in dealt.filter(F.col("cell").isin(wide)).groupBy("cell").agg(quantiles).collect():
                cuts[r["cell"]] = sorted(set(r["cuts"]))
        begins = np.cumsum([0, *[len(cuts.get(c, [])) + 1 for c in range(len(centres))]])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, gone = _numbers(batch.column("cell")), _numbers(batch.column("gone"))
                ring = begins[cell].astype(np.int32)
                for c in np.unique(cell):
                    if cuts[c]:
                        own = cell == c
                        ring[own] += np.searchsorted(cuts[c], gone[own]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring)], ["id", "x", "y", "cell", "gone", "ring"])

        shape = "id bigint, x array<double>, y double, cell int, gone double"
        ringed = materialise(dealt.mapInArrow(place, f"{shape}, ring int"), "rings")
        discard(dealt)
        found = ringed.groupBy("ring").agg(F.min("cell"), F.min("gone"), F.max("gone"), F.count(F.lit(1))).orderBy("ring").collect()
        number = np.array([r[0] for r in found])
        cell, low, high, n_rows = (np.array([r[i] for r in found]) for i in (1, 2, 3, 4))
        # rows at one distance from a pivot can't be cut by it: such a ring has several parts
        parts = -(-n_rows // (2 * size))

        def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ring = np.searchsorted(number, _numbers(batch.column("ring"))).astype(np.int32)
                part = (_numbers(batch.column("spread")) % parts[ring]).astype(np.int32)
                columns = [pa.array(ring), pa.array(part), *[batch.column(c) for c in ("id", "x", "y")]]
                yield pa.RecordBatch.from_arrays(columns, ["ring", "part", "id", "x", "y"])

        spread = ringed.select("id", "x", "y", "ring", F.xxhash64("id").alias("spread"))
        rows = spread.mapInArrow(divide, "ring int, part int, id bigint, x array<double>, y double") if len(found) else ringed.select("ring", F.lit(0).alias("part"), "id", "x", "y")
        return TrainIndex(rows, Rings(centres, nearest, cell, low.astype(float), high.astype(float), parts, k))

    def facing(self, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Visits with a chunk, and the train rows that each chunk compares: a block comes once for each QUERY_ROWS of its own
        visits, so that copies of train rows grow with the visits paid to them and not with all queries."""
        pieces = F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("pieces")
        loads = F.broadcast(visits.groupBy("ring", "part").agg(pieces))  # a row for each block
        asked = visits.join(loads, ["ring", "part"]).withColumn("chunk", F.pmod(F.xxhash64("query"), "pieces").cast("int"))
        each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("c")
        held = self.rows.join(loads, ["ring", "part"]).select(F.col("ring").alias("r"), F.col("part").alias("p"), each, "id", "x", "y")
        return asked.drop("pieces"), held

    def search(self, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The k nearest of each of the ``n`` rows (query, x), and the visits made: (query, ring, part)."""
        lists, visits = self.lists(queries)
        return _each(lists), visits

    def lists(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query, x, found) of rows (query, x): the list of the k nearest; and the visits made: (query, ring, part)."""
        rings, k = self.rings, self.rings.k

        def visits_of(batch: pa.RecordBatch, kth: np.ndarray, at: np.ndarray, ring: np.ndarray) -> pa.RecordBatch:
            times = rings.parts[ring]
            at, ring = np.repeat(at, times), np.repeat(ring, times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            some = [batch.column(c).take(pa.array(at)) for c in ("query", "x")]
            return pa.RecordBatch.from_arrays(
                [*some, pa.array(kth[at]), pa.array(ring.astype(np.int32)), pa.array(part.astype(np.int32))], ["query", "x", "kth", "ring", "part"]
            )

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ring = rings.home(_distances(matrix(batch.column("x")), rings.centres))[1]
                    yield visits_of(batch, np.full(batch.num_rows, np.inf), np.arange(batch.num_rows), ring)

        def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, step):
                    batch = whole.slice(s, step)
                    x, kth = matrix(batch.column("x")), _numbers(batch.column("kth")).astype(float)
                    d = _distances(x, rings.centres)
                    cell, home = rings.home(d)
                    reach, few = np.sqrt(kth), np.isnan(kth)
                    reach[few] = rings.reach(d[few])
                    wide = SLACK * (1.0 + np.abs(x).max(axis=1) * x.shape[1])
                    go = rings.least(d, cell) <= (reach * (1 + SLACK) + wide)[:, None]
                    go[np.arange(len(x)), home] = False
                    at, ring = np.nonzero(go)
                    if len(at):
                        yield visits_of(batch, np.where(few, np.inf, kth), at, ring)

        step = max(1, CHUNK_CELLS // len(rings.cell))

        def visited(visits: DataFrame) -> DataFrame:
            asked, held = self.facing(visits)
            tasks = self._tasks(visits)
            left = asked.repartition(tasks, "ring", "part", "chunk").groupBy("ring", "part", "chunk")
            right = held.repartition(tasks, "r", "p", "c").groupBy("r", "p", "c")
            return left.cogroup(right).applyInArrow(lambda a, b: _compared(a, b, "query", k), LISTS)

        def merged(lists: DataFrame) -> DataFrame:
            all_found = F.sort_array(F.flatten(F.collect_list("found")))
            return lists.groupBy("query").agg(F.first("x").alias("x"), F.slice(all_found, 1, k).alias("found"))

        first = materialise(queries.select("query", "x").mapInArrow(start, VISITS), "home-visits")
        at_home = visited(first)
        at_home = materialise(merged(at_home) if rings.parts.max() > 1 else at_home, "at-home")
        bounded = at_home.select("query", "x", F.get(F.col("found.distance"), F.lit(k - 1)).alias("kth"))
        second = materialise(bounded.mapInArrow(further, VISITS), "visits")
        return merged(at_home.unionByName(visited(second))), first.unionByName(second).select("query", "ring", "part")

    def _tasks(self, visits: DataFrame) -> int:
        """Tasks for the visits: little is shuffled for each, so that sizes do not tell how many tasks their comparisons need."""
        spark = visits.sparkSession
        most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        return max(1, min(most, 2 * int(self.rings.parts.sum())))

    def pairs(self, visits: DataFrame) -> int:
        """Pairs of a query and a train row that the visits compared."""
        asked = visits.groupBy(F.col("ring").alias("r"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("q"))
        held = self.rows.groupBy("ring", "part").agg(F.count(F.lit(1)).alias("t"))
        both = asked.join(held, (F.col("ring") == F.col("r")) & (F.col("part") == F.col("p")))
        return both.agg(F.sum(F.col("q") * F.col("t"))).first()[0] or 0


def nearest(
    queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query, id, label, distance): the k nearest train rows of each query, by squared distance, then id.

    A train table of one block is compared whole, queries dealt to tasks. A larger one is indexed by pivots and rings, and
    equal queries are searched once. Neither side is broadcast or held whole anywhere. Rows without key or vector take no part.
    """
    q = _shaped(queries, key, vector)
    t, n_t = _train(train, key, vector, label)
    if n_t <= block_rows:
        return _each(_in_one_block(q, t, q.count(), k))
    asked = materialise(q.withColumn("query", F.min("id").over(Window.partitionBy(F.xxhash64("x"), "x"))), "queries")
    distinct = asked.filter(F.col("id") == F.col("query")).select("query", "x").dropDuplicates(["query"])
    found = _each(TrainIndex.fit(t, k, n_t, block_rows).lists(distinct)[0])
    names = asked.select(F.col("id").alias("_id"), F.col("query").alias("_q"))
    return found.join(names, F.col("query") == F.col("_q")).select(F.col("_id").alias("query"), "id", "label", "distance")


def nearest_lists(
    vectors: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(x, found): the distinct vectors of the column ``vector`` and, as a list of (distance, id, label), the k nearest train rows of each.
    Searched as by :func:`nearest`; no row is made for a pair."""
    distinct = vectors.filter(col(vector).isNotNull()).select(col(vector).cast("array<double>").alias("x")).distinct()
    q = materialise(distinct.withColumn("id", F.monotonically_increasing_id()), "queries")
    t, n_t = _train(train, key, vector, label)
    if n_t <= block_rows:
        return _in_one_block(q, t, q.count(), k).select("x", "found")
    return TrainIndex.fit(t, k, n_t, block_rows).lists(q.select(F.col("id").alias("query"), "x"))[0].select("x", "found")


def _shaped(df: DataFrame, key: str, vector: str, *more: Column) -> DataFrame:
    whole = col(key).isNotNull() & col(vector).isNotNull()
    return df.filter(whole).select(col(key).cast("bigint").alias("id"), col(vector).cast("array<double>").alias("x"), *more)


def _train(train: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    t = _shaped(train, key, vector, col(label).cast("double").alias("y"))
    return t, t.count()


def _each(lists: DataFrame) -> DataFrame:
    """A row (query, id, label, distance) for each one found."""
    return lists.select("query", F.inline("found")).select("query", "id", "label", "distance")


def _in_one_block(q: DataFrame, t: DataFrame, n_q: int, k: int) -> DataFrame:
    """(query, x, found) of rows (id, x)."""
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_q // BLOCK_ROWS), min(tasks, n_q // 256))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = q.withColumn("qb", block).groupBy("qb"), t.withColumn("tb", every).groupBy("tb")
    return left.cogroup(right).applyInArrow(lambda a, b: _compared(a, b, "id", k), LISTS)
