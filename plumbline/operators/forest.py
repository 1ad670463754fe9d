"""Random forests on cells: rows that no tree can tell apart are drawn, routed and counted together.

Rows are binned once, and rows of the same bins and class (or bin of the label) become one row with their number. The bootstrap
draws how often a tree sees each of n rows as independent Poisson(1) counts; their sum over the rows of a cell is Poisson(n), which
is drawn anew in each pass from the seed, the tree and the block, so that nothing is kept for a row and a tree. All trees grow
together, one pass a level: tasks count their cells by (node, feature, bin), Spark brings the counts of a node together and finds
its split there, and the driver sees one row for each node.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrow import lists, matrix
from plumbline.operators.boosting import bin_rows, feature_cuts
from plumbline.operators.features import as_array
from plumbline.session import discard, materialise

#: Bins of a feature, bins of a label that is a number, cells of a block, and numbers that a task counts in one pass.
BINS = 32
LABEL_BINS = 64
BLOCK_CELLS = 32_768
PASS_NUMBERS = 16_000_000
#: Numbers that a task keeps of the cells it has scored.
KNOWN_NUMBERS = 200_000


@dataclass(frozen=True)
class Forest:
    """All nodes in a row, tree ``t`` from node ``t``: ``left`` is the left child, the right one follows it, or -1 at a leaf.

    A row goes right if its feature exceeds ``cut``. ``value`` (nodes, outputs) has class shares, or one mean.
    """

    trees: int
    classes: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    features: str

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the values where rows end, (rows, outputs)."""
        out = np.zeros((len(x), self.value.shape[1]))
        for t in range(self.trees):
            out += self.value[places(x, t, self.feature, self.cut, self.left, self.depth)]
        return out / self.trees

    def votes_by_cell(self, tables: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
        """``votes`` of each table of rows. Rows between the same cuts end in the same leaves, so that one of them walks the trees for
        all, and its votes are kept for later tables."""
        split = self.left >= 0
        cuts = {int(f): np.unique(self.cut[split & (self.feature == f)]) for f in np.unique(self.feature[split])}
        most = KNOWN_NUMBERS // self.value.shape[1]
        known: dict[bytes | int, int] = {}
        votes = np.zeros((0, self.value.shape[1]))
        for x in tables:
            cells, first, back = np.unique(cell_keys(x, cuts), return_index=True, return_inverse=True)
            names = cells.tolist()
            new = [i for i, c in enumerate(names) if c not in known]
            if len(known) + len(new) > most:
                known, votes, new = {}, votes[:0], list(range(len(names)))
            if new:
                known |= {names[i]: len(votes) + j for j, i in enumerate(new)}
                votes = np.concatenate([votes, self.votes(x[first[new]])])
            yield votes[np.array([known[c] for c in names], np.int64)[back]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction and, for classes, probability."""

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tables = (matrix(rows) if len(rows) else np.zeros((0, len(self.feature))) for rows in batches)
            for votes in self.votes_by_cell(tables):
                yield lists(votes)

        out = df.withColumn("_v", scored(as_array(df, self.features)))
        if not self.classes:
            return out.withColumn("prediction", F.get("_v", F.lit(0))).drop("_v")
        out = out.withColumn("prediction", (F.array_position("_v", F.array_max("_v")) - 1).cast("double"))
        return out.withColumn("probability", array_to_vector("_v")).drop("_v")


def cell_keys(x: np.ndarray, cuts: Mapping[int, np.ndarray]) -> np.ndarray:
    """A key for each row, of how many cuts of each feature lie below its value: a number if there are few enough cells, else bytes. A
    missing value is above no cut."""
    bins = np.zeros((len(x), max(1, len(cuts))), np.int32)
    for i, (f, own) in enumerate(cuts.items()):
        bins[:, i] = np.searchsorted(own, np.where(np.isnan(x[:, f]), -np.inf, x[:, f]))
    sizes = [len(own) + 1 for own in cuts.values()]
    if math.prod(sizes) < 2**62:
        code = np.zeros(len(x), np.int64)
        for i, size in enumerate(sizes):
            code = code * size + bins[:, i]
        return code
    return bins.view(np.dtype((np.void, bins.shape[1] * bins.itemsize))).ravel()


def places(x: np.ndarray, root: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The nodes where rows stand in the tree of a root, after ``depth`` levels at most."""
    at = np.full(len(x), root, np.int64)
    rows = np.arange(len(x))
    for _ in range(depth):
        go = left[at]
        if (go < 0).all():
            break
        at = np.where(go >= 0, go + (x[rows, feature[at]] > cut[at]), at)
    return at


def drawn(seed: int, tree: int, block: int, n: np.ndarray, mean: np.ndarray | None, squares: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """How many rows of each cell a tree draws, and the sum of their labels.

    That sum has the mean, the variance and the covariance with the number that separate draws of the rows have: the number times the
    cell's mean, and for what the labels differ inside the cell (``squares`` around the mean) a normal number. It is exact
    where they don't differ, as in cells of one row.
    """
    rng = np.random.default_rng([seed & 0xFFFFFFFF, tree, block])
    times = rng.poisson(n).astype(float)
    if mean is None or squares is None:
        return times, None
    return times, times * mean + np.sqrt(times * squares / n) * rng.standard_normal(len(n))


def best_splits(stats: np.ndarray, least: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The best split of nodes with ``stats`` (nodes, features, bins, channels), as place feature * bins + bin, or -1 for none, and
    the channels of its left side. Channels are the number of rows, and the weight of each class or the sum of labels."""
    below = np.cumsum(stats, axis=2)
    whole = below[:, :, -1:, :]
    above = whole - below

    def purity(s: np.ndarray) -> np.ndarray:
        # what the weighted Gini index, or the squared error, falls short of a constant
        weight = s[..., 1:].sum(axis=-1) if classes else s[..., 0]
        return np.divide((s[..., 1:] ** 2).sum(axis=-1), weight, out=np.zeros(weight.shape), where=weight > 0)

    reached = purity(below) + purity(above)
    fits = (below[..., 0] >= least) & (above[..., 0] >= least)
    gain = np.where(fits, reached - purity(whole), -np.inf).reshape(len(stats), -1)
    top = gain.max(axis=1)
    # sums come in any order: what differs in the last digits is a tie, and the first feature and bin win it
    slack = 1e-9 * np.maximum(purity(whole)[:, 0, 0], np.abs(top))
    at = (gain >= np.where(np.isfinite(top), top - slack, np.inf)[:, None]).argmax(axis=1)
    splits = np.where(np.isfinite(top) & (top > 1e-3 * slack), at, -1)
    left = below.reshape(len(stats), -1, stats.shape[3])[np.arange(len(stats)), np.maximum(at, 0)]
    return splits, left


@dataclass(frozen=True)
class ForestFit:
    """``classes`` 0 is a regression. A split leaves ``min_split`` // 2 drawn rows on each side; a node looks at the root of the number of
    features, or at a third of them."""

    label: str
    features: str
    weight: str | None
    classes: int
    seed: int
    params: Mapping[str, float]

    def fit(self, table: DataFrame) -> Forest:
        p = self.params
        trees, depth, least = int(p["trees"]), int(p["depth"]), max(1, int(p["min_split"]) // 2)
        rows = table.select(
            as_array(table, self.features).alias("x"),
            F.col(self.label).cast("double").alias("y"),
            (F.col(self.weight) if self.weight else F.lit(1.0)).cast("double").alias("w"),
        )
        head = rows.select(F.size("x")).first()
        if head is None:
            raise ValueError("no rows to fit")
        width, y = head[0], F.col("y")
        known = y.isNotNull() & ~F.isnan(y)
        if self.classes:
            known &= (y >= 0) & (y < self.classes) & (y == F.floor(y))
        at = [i / LABEL_BINS for i in range(1, LABEL_BINS)]
        label = F.lit(None) if self.classes else F.percentile_approx(y, at, 10_000)
        *found, parts, centre, wrong = rows.agg(*feature_cuts(width, BINS), label, F.avg(y), F.count_if(~known)).first()
        if wrong:
            raise ValueError(f"{wrong} labels are missing" + (f", or are no whole numbers from 0 to {self.classes - 1}" if self.classes else ""))
        cuts = [np.unique(np.array(c, float)) for c in found]
        label_cuts = None if self.classes else np.unique(np.array(parts, float))
        cells = self._cells(rows, cuts, label_cuts, centre)
        blocks = self._blocks(cells)
        discard(cells)
        chosen = width if trees == 1 else int(np.ceil(np.sqrt(width) if self.classes else width / 3))
        rng = np.random.default_rng(self.seed)
        channels = 1 + (self.classes or 1)
        feature, cut, left = np.full(trees, -1), np.zeros(trees), np.full(trees, -1)
        sums = np.zeros((trees, channels))
        tree = np.arange(trees)  # of each node
        opened = np.arange(trees)
        for level in range(depth + 1):
            if not len(opened):
                break
            few = max(1, PASS_NUMBERS // (chosen * BINS * channels))
            subsets = np.sort(rng.random((len(opened), width)).argsort(axis=1)[:, :chosen], axis=1)
            found = [
                self._splits(blocks, (feature, cut, left), level, opened[s : s + few], tree, subsets[s : s + few], least)
                for s in range(0, len(opened), few)
            ]
            nodes, split, left_sums, own = (np.concatenate(c) for c in zip(*found, strict=True))
            if not level:
                sums[nodes] = own
            if level == depth:  # only a forest of depth 0 comes here, for its means
                break
            split = np.where([b < len(cuts[f]) for f, b in zip(*np.divmod(np.maximum(split, 0), BINS), strict=True)], split, -1)
            nodes, split, left_sums, own = (c[split >= 0] for c in (nodes, split, left_sums, own))
            f, b = np.divmod(split, BINS)
            feature[nodes], cut[nodes], left[nodes] = f, b, len(feature) + 2 * np.arange(len(nodes))
            below = np.stack([left_sums, own - left_sums], axis=1).reshape(-1, channels)
            first = len(feature)
            feature, left = (np.concatenate([c, np.full(len(below), -1)]) for c in (feature, left))
            cut, tree = np.concatenate([cut, np.zeros(len(below))]), np.concatenate([tree, np.repeat(tree[nodes], 2)])
            sums = np.concatenate([sums, below])
            mixed = below[:, 0] >= 2 * least
            if self.classes:
                mixed &= (below[:, 1:] > 0).sum(axis=1) > 1
            opened = first + np.flatnonzero(mixed) if level + 1 < depth else np.zeros(0, int)
            order = np.argsort(tree[opened], kind="stable")
            opened = opened[order]
        discard(blocks)
        return self._model(trees, depth, cuts, centre, feature, cut, left, sums)

    def _model(
        self, trees: int, depth: int, cuts: list[np.ndarray], centre: float, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, sums: np.ndarray
    ) -> Forest:
        weight = sums[:, 1:].sum(axis=1, keepdims=True) if self.classes else sums[:, :1]
        value = np.divide(sums[:, 1:], weight, out=np.zeros((len(sums), sums.shape[1] - 1)), where=weight > 0)
        real = cut.copy()
        for f, own in enumerate(cuts):
            here = (feature == f) & (left >= 0)
            real[here] = own[cut[here].astype(int)]
        return Forest(trees, self.classes, feature, real, left, value if self.classes else value + centre, depth, self.features)

    def _cells(self, rows: DataFrame, cuts: list[np.ndarray], label_cuts: np.ndarray | None, centre: float) -> DataFrame:
        """Rows of the same bins and class, or bin of the label, as one: (bins, y, n, w, q). Of labels that are numbers, ``y`` is the
        mean less ``centre``, and ``q`` the sum of squares around it."""
        each = bin_rows(rows, cuts, label_cuts)
        if self.classes:
            cells = each.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.lit(0.0).alias("q"))
        else:
            y = F.col("y") - F.lit(centre)
            sums = each.groupBy("bins", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
            mean = F.col("s") / F.col("n")
            cells = sums.select("bins", mean.alias("y"), "n", F.col("n").cast("double").alias("w"), F.greatest(F.col("ss") - mean * F.col("s"), F.lit(0.0)).alias("q"))
        return materialise(cells, "forest-cells")

    def _blocks(self, cells: DataFrame) -> DataFrame:
        """Cells as blocks of arrays with a number, the same ones for the same cells: (block, bins, y, n, w, q). There are tasks for
        each BLOCK_CELLS, up to as many as the session has for a shuffle."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, size, count = TaskContext.get().partitionId(), [], 0, 0
            for batch in (*batches, None):
                if batch is not None and batch.num_rows:
                    held.append(batch)
                    size += batch.num_rows
                while held and (size >= BLOCK_CELLS or batch is None and size):
                    whole = pa.Table.from_batches(held).combine_chunks()
                    some = whole.slice(0, BLOCK_CELLS)
                    held, size = whole.slice(BLOCK_CELLS).to_batches(), size - some.num_rows
                    arrays = [np.frombuffer(b"".join(some.column("bins").to_pylist()), np.uint8)]
                    arrays += [some.column(c).to_numpy().astype(float) for c in ("y", "n", "w", "q")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part + (count << 20)], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                        ["block", "bins", "y", "n", "w", "q"],
                    )
                    count += 1

        spark = cells.sparkSession
        most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        tasks = max(1, min(-(-cells.count() // BLOCK_CELLS), most))
        dealt = cells.repartition(tasks, "bins").sortWithinPartitions("bins", "y")
        return materialise(dealt.mapInArrow(pack, "block long, bins binary, y binary, n binary, w binary, q binary"), "forest-blocks")

    def _splits(
        self, blocks: DataFrame, grown: tuple[np.ndarray, np.ndarray, np.ndarray], level: int, opened: np.ndarray, tree: np.ndarray,
        subsets: np.ndarray, least: int,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of open nodes that drew a row: the node, its best split as feature * BINS + bin (-1: none), and the channels of the left
        side and of all."""
        feature, cut, left = grown[0].astype(np.int32), grown[1].astype(np.uint8), grown[2].astype(np.int32)
        classes, seed, chosen, channels = self.classes, self.seed, subsets.shape[1], 1 + (self.classes or 1)
        of, subsets, size = tree[opened], subsets.astype(np.int32), subsets.shape[1] * BINS * channels
        wanted, begins = np.unique(of, return_index=True)
        spans = list(zip(wanted.tolist(), begins.tolist(), [*begins[1:].tolist(), len(of)], strict=True))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(opened), chosen, BINS, channels))
            for batch in batches:
                for row in batch.to_pylist():
                    y, n, w, q = (np.frombuffer(row[c]) for c in ("y", "n", "w", "q"))
                    bins = np.frombuffer(row["bins"], np.uint8).reshape(len(n), -1)
                    for t, begin, end in spans:
                        times, sums = drawn(seed, t, row["block"], n, None if classes else y, None if classes else q)
                        here = np.full(len(left), -1, np.int32)
                        here[opened[begin:end]] = np.arange(end - begin)
                        at = here[places(bins, t, feature, cut, left, level)]
                        own = np.flatnonzero((at >= 0) & (times > 0))
                        slot = at[own, None] * chosen + np.arange(chosen)
                        slot = slot * BINS + np.take_along_axis(bins[own], subsets[begin + at[own]], axis=1)
                        part = total[begin:end].reshape(-1, channels)
                        part[:, 0] += np.bincount(slot.ravel(), np.repeat(times[own], chosen), len(part))
                        if sums is not None:
                            part[:, 1] += np.bincount(slot.ravel(), np.repeat(sums[own], chosen), len(part))
                        else:
                            weighed = (slot * classes + y[own, None].astype(np.int64)).ravel()
                            weights = np.repeat(times[own] * (w[own] / n[own]), chosen)
                            part[:, 1:] += np.bincount(weighed, weights, len(part) * classes).reshape(-1, classes)
            reached = np.flatnonzero(total[:, 0, :, 0].any(axis=1))
            for s in range(0, len(reached), 4096):
                some = reached[s : s + 4096]
                packed = [total[i].tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["node", "stats"])

        def best(group: pa.Table) -> pa.Table:
            node, at = np.unique(group.column("node").to_numpy(), return_inverse=True)
            stats = np.zeros((len(node), size))
            for i, s in zip(at, group.column("stats"), strict=True):
                stats[i] += np.frombuffer(s.as_buffer())
            stats = stats.reshape(-1, chosen, BINS, channels)
            split, below = best_splits(stats, least, classes)
            f, b = np.divmod(np.maximum(split, 0), BINS)
            split = np.where(split >= 0, subsets[node, f] * BINS + b, -1)
            sums = [pa.array([v.tobytes() for v in c], pa.binary()) for c in (below, stats[:, 0].sum(axis=1))]
            return pa.table([pa.array(node, pa.int32()), pa.array(split, pa.int32()), *sums], ["node", "split", "below", "own"])

        parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = blocks.mapInArrow(count, "node int, stats binary").withColumn("part", F.pmod("node", F.lit(parts)))
        found = counted.groupBy("part").applyInArrow(best, "node int, split int, below binary, own binary").toArrow().sort_by("node")
        sums = [np.frombuffer(b"".join(found.column(c).to_pylist())).reshape(-1, channels) for c in ("below", "own")]
        return opened[found.column("node").to_numpy()], found.column("split").to_numpy().astype(int), *sums
