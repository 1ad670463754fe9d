"""Boosted trees of second order: each tree is grown from sums of gradients and curvatures by node, feature and bin.

Rows are binned once, and rows that no tree can tell apart, those with the same bins, become one weighted row: however many rows
there are, there are never more than the product of the features' bins (times the classes). These are kept in blocks, so that
a pass works on matrices. A level of a tree is one pass: every task sums its rows by (class, node, feature, bin), Spark adds
these sums up, and the driver sees numbers for bins only. If all cells fit one block, its task has all sums of a tree, so that a
pass grows the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrow import lists, matrix
from plumbline.operators.features import as_array
from plumbline.session import discard, materialise

#: Bins of a feature, and rows of a block.
BINS = 64
BLOCK_ROWS = 16_384
#: Trees that a pass applies on the fly before the margins are written anew.
PENDING = 10
MAX_DEPTH = 12


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as heaps: ``feature`` (rounds, outputs, nodes) is -1 at a leaf, a row goes right if its feature exceeds ``cut``.

    ``kind`` is ``binary``, ``softmax`` or ``squared``; ``losses`` has the mean training loss before each round.
    """

    kind: str
    base: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    losses: np.ndarray
    features: str

    def margins(self, x: np.ndarray, begin: int = 0) -> np.ndarray:
        """Summed leaf values (rows, outputs) of the trees from round ``begin`` on."""
        out = np.zeros((len(x), len(self.base)))
        rows = np.arange(len(x))
        depth = (self.feature.shape[2] + 1).bit_length() - 2
        for t in range(begin, len(self.feature)):
            for k in range(len(self.base)):
                at = places(x, rows, self.feature[t, k], self.cut[t, k], depth)
                out[:, k] += self.value[t, k][at]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction and, for classes, probability."""

        @F.arrow_udf("array<double>")
        def scored(rows: pa.Array) -> pa.Array:
            return lists(self.base + self.margins(matrix(rows)) if len(rows) else np.zeros((0, 1)))

        out = df.withColumn("_m", scored(as_array(df, self.features)))
        if self.kind == "squared":
            return out.withColumn("prediction", F.get("_m", F.lit(0))).drop("_m")
        if self.kind == "binary":
            p = 1.0 / (1.0 + F.exp(-F.get("_m", F.lit(0))))
            out = out.withColumn("_p", F.array(1.0 - p, p)).withColumn("prediction", (F.get("_m", F.lit(0)) > 0).cast("double"))
        else:
            grown = F.transform("_m", lambda m: F.exp(m - F.array_max("_m")))
            whole = F.aggregate("_g", F.lit(0.0), lambda a, b: a + b)
            out = out.withColumn("_g", grown).withColumn("_p", F.transform("_g", lambda g: g / whole)).drop("_g")
            out = out.withColumn("prediction", (F.array_position("_m", F.array_max("_m")) - 1).cast("double"))
        return out.withColumn("probability", array_to_vector("_p")).drop("_m", "_p")


def places(x: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Where rows end in a tree, after ``depth`` levels at most."""
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), at)
    return at


def derivatives(kind: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """First and second derivatives of the loss by margin (rows, outputs), and the summed loss."""
    if kind == "squared":
        r = margin[:, 0] - y
        return (w * r)[:, None], w[:, None], float((w * r * r).sum() / 2)
    if kind == "binary":
        m = margin[:, 0]
        p = 1 / (1 + np.exp(-m))
        return (w * (p - y))[:, None], (w * np.maximum(p * (1 - p), 1e-16))[:, None], float((w * (np.logaddexp(0, m) - y * m)).sum())
    grown = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = grown / grown.sum(axis=1, keepdims=True)
    own = np.arange(p.shape[1])[None, :] == y[:, None]
    loss = -np.log(np.maximum(p[np.arange(len(p)), y.astype(int)], 1e-300))
    return w[:, None] * (p - own), w[:, None] * np.maximum(2 * p * (1 - p), 1e-16), float((w * loss).sum())


def best_split(g: np.ndarray, h: np.ndarray, l2: float, least: float, gamma: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a node with sums (features, bins): bins up to that one go left."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gr, hr = all_g - gl, all_h - hl
    with np.errstate(divide="ignore", invalid="ignore"):  # an empty side, which has not the least curvature
        gain = 0.5 * (gl**2 / (hl + l2) + gr**2 / (hr + l2) - all_g**2 / (all_h + l2)) - gamma
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    if not gain.size:
        return -np.inf, 0, 0
    # sums come in any order: what differs in the last digits is a tie, and the first feature and bin win it
    top = gain.max()
    f, b = np.argwhere(gain >= top - 1e-9 * abs(top))[0] if np.isfinite(top) else (0, 0)
    return float(top), int(f), int(b)


def feature_cuts(width: int, bins: int) -> list[Column]:
    """Aggregates of rows (x, y, w) that give equal-depth cuts of each feature."""
    at = [i / bins for i in range(1, bins)]
    return [F.percentile_approx(F.get("x", F.lit(i)), at, 10_000) for i in range(width)]


def bin_rows(rows: DataFrame, cuts: list[np.ndarray], label_cuts: np.ndarray | None = None) -> DataFrame:
    """(bins, part, y, w): a byte for each feature of rows (x, y, w), the number of its cuts below the value, and the same of the label."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * bins.shape[1])
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, starts.buffers()[1], pa.py_buffer(bins.tobytes())])
                y = batch.column("y")
                part = np.searchsorted(label_cuts, y.to_numpy(zero_copy_only=False)) if label_cuts is not None else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([packed, pa.array(part.astype(np.int32)), y, batch.column("w")], ["bins", "part", "y", "w"])

    return rows.mapInArrow(binned, "bins binary, part int, y double, w double")


@dataclass(frozen=True)
class BoostedFit:
    label: str
    features: str
    weight: str | None
    classes: int
    params: Mapping[str, float]

    def fit(self, table: DataFrame) -> BoostedTrees:
        p = self.params
        depth, rounds = int(p["depth"]), int(p["rounds"])
        if not 1 <= depth <= MAX_DEPTH:
            raise ValueError(f"depth is {depth}, and must be between 1 and {MAX_DEPTH}")
        kind = "squared" if not self.classes else "binary" if self.classes <= 2 else "softmax"
        outputs = self.classes if kind == "softmax" else 1
        rows = table.select(
            as_array(table, self.features).alias("x"),
            F.col(self.label).cast("double").alias("y"),
            (F.col(self.weight) if self.weight else F.lit(1.0)).cast("double").alias("w"),
        )
        y, w = F.col("y"), F.col("w")
        head = rows.select(F.size("x")).first()
        width = head[0] if head else 0
        row = rows.agg(F.sum(w), F.sum(w * y), F.sum(w * (y == 1.0).cast("double")), *feature_cuts(width, BINS)).first()
        if not row[0]:
            raise ValueError("no rows to fit")
        total = float(row[0])
        base = np.zeros(outputs)
        if kind == "squared":
            base[0] = row[1] / total
        elif kind == "binary":
            share = min(max(row[2] / total, 1e-6), 1 - 1e-6)
            base[0] = np.log(share / (1 - share))
        cuts = [np.unique(np.array(c, float)) for c in row[3:]]
        n_nodes = 2 ** (depth + 1) - 1
        empty = np.zeros((0, outputs, n_nodes))
        model = BoostedTrees(kind, base, empty.astype(np.int64), empty, empty, np.zeros(0), self.features)
        cells = self._cells(rows, cuts, base, kind)
        n_cells, within = cells.agg(F.count(F.lit(1)), F.sum("within")).first()
        blocks = self._blocks(cells, n_cells, base)
        discard(cells)
        written = 0  # rounds that the blocks' margins contain
        for r in range(rounds):
            if r - written >= PENDING:
                before, blocks, written = blocks, self._applied(blocks, _binned(model, cuts), written), r
                discard(before)
            grown, loss = self._grow(blocks, n_cells <= BLOCK_ROWS, _binned(model, cuts), written, cuts, depth, p)
            model = replace(
                model, feature=np.concatenate([model.feature, grown[0][None]]), cut=np.concatenate([model.cut, grown[1][None]]),
                value=np.concatenate([model.value, grown[2][None]]), losses=np.append(model.losses, (loss + within / 2) / total),
            )
            if not (grown[0] >= 0).any():  # no split helps any more
                break
        discard(blocks)
        return model

    def _cells(self, rows: DataFrame, cuts: list[np.ndarray], base: np.ndarray, kind: str) -> DataFrame:
        """Rows of the same bins as one: (bins, y, w, within). Classes stay apart; of other labels, the sums of derivatives
        need the weighted mean only, and the loss the squares around it, ``within``."""

        each = bin_rows(rows, cuts)
        if kind == "squared":
            e = F.col("y") - F.lit(float(base[0]))
            sums = each.groupBy("bins").agg(F.sum("w").alias("w"), F.sum(F.col("w") * e).alias("s"), F.sum(F.col("w") * e * e).alias("q"))
            mean = F.col("s") / F.col("w")
            cells = sums.select("bins", (mean + F.lit(float(base[0]))).alias("y"), "w", F.greatest(F.col("q") - mean * F.col("s"), F.lit(0.0)).alias("within"))
        else:
            cells = each.groupBy("bins", "y").agg(F.sum("w").alias("w")).select("*", F.lit(0.0).alias("within"))
        return materialise(cells, "boosting-cells")

    def _blocks(self, cells: DataFrame, n_cells: int, base: np.ndarray) -> DataFrame:
        """Cells as blocks of matrices: bins (one byte each), label, weight, margin. There are tasks for each BLOCK_ROWS, up to
        as many as the session has for a shuffle."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(s, BLOCK_ROWS)
                    bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    margin = np.tile(base, (len(bins), 1))
                    yield _block(bins, part.column("y").to_numpy(zero_copy_only=False), part.column("w").to_numpy(zero_copy_only=False), margin)

        spark = cells.sparkSession
        most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        tasks = max(1, min(-(-n_cells // BLOCK_ROWS), most))
        return materialise(cells.repartition(tasks).mapInArrow(pack, BLOCK), "boosting-blocks")

    def _applied(self, blocks: DataFrame, model: BoostedTrees, begin: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bins, y, w, margin in _matrices(batches, model):
                yield _block(bins.astype(np.uint8), y, w, margin + model.margins(bins, begin))

        return materialise(blocks.mapInArrow(run, BLOCK), "boosting-blocks")

    def _grow(
        self, blocks: DataFrame, alone: bool, model: BoostedTrees, begin: int, cuts: list[np.ndarray], depth: int, p: Mapping[str, float]
    ) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
        """One tree per output, and the loss before them. ``model`` has bins for cuts. ``alone`` says that one task has all cells."""
        outputs, width = len(model.base), len(cuts)
        if not alone:
            return grow(lambda feature, cut, level: self._sums(blocks, model, begin, feature, cut, level, width), outputs, cuts, depth, p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(_derived(batches, model, begin))

            def sums(feature: np.ndarray, cut: np.ndarray, level: int) -> Sums:
                total, loss = _totals(held, feature, cut, level, width)
                parts = total.reshape(outputs, 2, 2**level, width, BINS)
                found = {(k, 2**level - 1 + i): (parts[k, 0, i], parts[k, 1, i]) for k in range(outputs) for i in range(2**level)}
                return found | {(-1, 0): (np.full((1, 1), loss), np.zeros((1, 1)))}

            trees, loss = grow(sums, outputs, cuts, depth, p)
            yield pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in trees], pa.array([loss])], ["feature", "cut", "value", "loss"])

        (row,) = blocks.coalesce(1).mapInArrow(run, "feature binary, cut binary, value binary, loss double").collect()
        kinds = {"feature": np.int64, "cut": np.float64, "value": np.float64}
        feature, cut, value = (np.frombuffer(row[c], kind).reshape(outputs, -1) for c, kind in kinds.items())
        return (feature, cut, value), row["loss"]

    def _sums(self, blocks: DataFrame, model: BoostedTrees, begin: int, feature: np.ndarray, cut: np.ndarray, level: int, width: int) -> Sums:
        """Sums of derivatives by (output, node) of a level as (features, bins); at the first level also the loss, as output -1."""
        first = 2**level - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = _totals(_derived(batches, model, begin), feature, cut, level, width)
            k, cell = np.nonzero(total[:, 1])
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(np.append(k, -1), pa.int32()), "cell": pa.array(np.append(cell, 0), pa.int32()),
                "g": np.append(total[k, 0, cell], loss), "h": np.append(total[k, 1, cell], 0.0),
            })

        found = blocks.mapInArrow(run, "k int, cell int, g double, h double").groupBy("k", "cell").agg(F.sum("g"), F.sum("h")).collect()
        out: Sums = {}
        for k, cell, g, h in found:
            node, rest = (0, 0) if k < 0 else divmod(cell, width * BINS)
            key = (k, 0 if k < 0 else first + node)
            if key not in out:
                out[key] = np.zeros((width, BINS)), np.zeros((width, BINS))
            f, b = divmod(rest, BINS)
            out[key][0][f, b], out[key][1][f, b] = g, h
        return out


Sums = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def grow(
    sums_of: Callable[[np.ndarray, np.ndarray, int], Sums], outputs: int, cuts: list[np.ndarray], depth: int, p: Mapping[str, float]
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """One tree per output, level by level, from the sums of derivatives of each level, and the loss before them."""
    n_nodes = 2 ** (depth + 1) - 1
    feature = np.full((outputs, n_nodes), -1, np.int64)
    cut, value = np.zeros((outputs, n_nodes)), np.zeros((outputs, n_nodes))
    bin_cut = np.zeros((outputs, n_nodes))
    open_nodes = [(k, 0) for k in range(outputs)]
    loss = 0.0
    for level in range(depth):
        if not open_nodes:
            break
        sums = sums_of(feature, bin_cut, level)
        if level == 0:
            loss = float(sums.pop((-1, 0))[0][0, 0])
        nxt = []
        for k, node in open_nodes:
            g, h = sums[k, node]
            if not level:
                value[k, node] = -p["rate"] * g[0].sum() / (h[0].sum() + p["l2"])
            gain, f, b = best_split(g, h, p["l2"], p["min_child"], p["gamma"])
            if gain > 1e-12 and b < len(cuts[f]):
                feature[k, node], cut[k, node], bin_cut[k, node] = f, cuts[f][b], b
                for child, own in ((2 * node + 1, slice(None, b + 1)), (2 * node + 2, slice(b + 1, None))):
                    value[k, child] = -p["rate"] * g[f, own].sum() / (h[f, own].sum() + p["l2"])
                    nxt.append((k, child))
        open_nodes = nxt
    return (feature, cut, value), loss


def _derived(batches: Iterator[pa.RecordBatch], model: BoostedTrees, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """(bins, g, h, summed loss) of each block."""
    for bins, y, w, margin in _matrices(batches, model):
        yield bins, *derivatives(model.kind, margin + model.margins(bins, begin), y, w)


def _totals(
    derived: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, float]], feature: np.ndarray, cut: np.ndarray, level: int, width: int
) -> tuple[np.ndarray, float]:
    """Sums of derivatives (outputs, 2, nodes * features * bins) of a level, and the loss."""
    first, size = 2**level - 1, 2**level * width * BINS
    total, loss = np.zeros((len(feature), 2, size)), 0.0
    for bins, g, h, own in derived:
        loss += own
        rows = np.arange(len(bins))
        for k in range(len(feature)):
            at = places(bins, rows, feature[k], cut[k], level) - first
            here = np.flatnonzero(at >= 0)
            cell = (at[here, None] * width + np.arange(width)[None, :]) * BINS + bins[here]
            for j, d in enumerate((g, h)):
                total[k, j] += np.bincount(cell.ravel(), np.repeat(d[here, k], width), size)
    return total, loss


BLOCK = "n int, bins binary, y binary, w binary, margin binary"


def _block(bins: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    parts = {"bins": bins, "y": y.astype(float), "w": w.astype(float), "margin": margin}
    return pa.RecordBatch.from_pydict({"n": pa.array([len(bins)], pa.int32())} | {c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in parts.items()})


def _matrices(batches: Iterator[pa.RecordBatch], model: BoostedTrees) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins, y, w, margin) of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            y, w = (np.frombuffer(row[c]) for c in ("y", "w"))
            yield np.frombuffer(row["bins"], np.uint8).reshape(n, -1).astype(np.int64), y, w, np.frombuffer(row["margin"]).reshape(n, -1)


def _binned(model: BoostedTrees, cuts: list[np.ndarray]) -> BoostedTrees:
    """The same trees with the places of cuts for cuts, to walk over bins."""
    cut = np.zeros_like(model.cut)
    for f, own in enumerate(cuts):
        here = model.feature == f
        cut[here] = np.searchsorted(own, model.cut[here])
    return replace(model, cut=cut)
