"""Data envelopment: the efficiency of each alternative under its own best weights, at any size.

Only undominated alternatives constrain the weights. The strongest ones travel to every task as a bounded set, the
others stay in a table of blocks with bounding boxes. Many small linear programs are solved at once on stacked arrays; what
a block could add to a solved program is bounded by its box, so most programs never meet most blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip, col, total
from plumbline.session import materialise

MIN_WEIGHT = 1e-4
#: Alternatives that every task holds.
STRONG = 1_000
#: Rows of one block of the rest, and blocks at most: beyond, blocks get larger, so that the boxes stay small enough to broadcast.
BLOCK_ROWS = 4_000
MAX_BLOCKS = 4_096
#: Programs solved at once, and programs that one task prices against a block.
STACK = 256
PRICED = 20_000
#: Rows of violated constraints that one round adds to a program.
ADDED = 8
#: Steps after which the first improving column enters instead of the best one, which can't cycle.
PATIENCE = 300
GAP = 1e-9


# --------------------------------------------------------------------------- linear programs


def solve_stacked(
    x: np.ndarray, y: np.ndarray, shared: np.ndarray, extra: np.ndarray, weight: float = MIN_WEIGHT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Efficiencies of n alternatives, with their output and input weights.

    ``x`` (n, inputs), ``y`` (n, outputs); ``shared`` (rows, outputs + inputs) holds compared alternatives as (outputs,
    -inputs), and ``extra`` (n, rows, outputs + inputs) more for each program, zero rows where it has fewer. The envelopment
    form is solved by a primal simplex whose basis inverses are stacked; the programs step together until each is
    done. A program without a bound means that no weights are feasible: efficiency 0.
    """
    n, s, m = len(x), y.shape[1], x.shape[1]
    r = s + m
    own = np.hstack([y, -x])
    theta = np.hstack([np.zeros_like(y), x])
    extra = np.concatenate([own[:, None, :], extra], axis=1)
    target = np.hstack([y, np.zeros_like(x)])
    efficiency, weights = np.zeros(n), np.zeros((n, r))
    # columns by number: slacks, the free one, own and extra ones, shared ones
    free, first_extra, first_shared = r, r + 1, r + 1 + extra.shape[1]
    ids = np.tile(np.arange(r), (n, 1))
    basis = np.tile(-np.eye(r), (n, 1, 1))
    cost = np.full((n, r), -weight)
    rows, at_y, at_x = np.arange(n), y.argmax(axis=1), s + x.argmax(axis=1)
    ids[rows, at_y], ids[rows, at_x] = first_extra, free
    basis[rows, :, at_y], basis[rows, :, at_x] = own, theta
    cost[rows, at_y], cost[rows, at_x] = 0.0, 1.0
    live = np.flatnonzero((y.max(axis=1) > 0) & (x.max(axis=1) > 0))
    step = 0
    while len(live):
        inverse = np.linalg.inv(basis[live])
        value = np.einsum("kij,kj->ki", inverse, target[live])
        price = np.einsum("ki,kij->kj", cost[live], inverse)
        reduced = np.concatenate(
            [price - weight, np.zeros((len(live), 1)), -np.einsum("kcr,kr->kc", extra[live], price), -price @ shared.T], axis=1
        )
        np.put_along_axis(reduced, ids[live], 0.0, axis=1)
        bad = reduced < -1e-10
        enter = reduced.argmin(axis=1) if step <= PATIENCE else bad.argmax(axis=1)
        finished = ~bad.any(axis=1)
        efficiency[live[finished]] = np.einsum("ki,ki->k", cost[live], value)[finished]
        weights[live[finished]] = price[finished]
        go = ~finished
        live, inverse, value, enter = live[go], inverse[go], value[go], enter[go]
        column = np.zeros((len(live), r))
        slack = np.flatnonzero(enter < r)
        column[slack, enter[slack]] = -1.0
        is_shared = enter >= first_shared
        column[is_shared] = shared[enter[is_shared] - first_shared]
        is_extra = (enter >= first_extra) & ~is_shared
        column[is_extra] = extra[live[is_extra], enter[is_extra] - first_extra]
        direction = np.einsum("kij,kj->ki", inverse, column)
        can_leave = (direction > 1e-11) & (ids[live] != free)
        bounded = can_leave.any(axis=1)  # the others keep efficiency 0
        live, value, enter, column, direction, can_leave = (v[bounded] for v in (live, value, enter, column, direction, can_leave))
        ratio = np.where(can_leave, np.maximum(value, 0.0) / np.where(can_leave, direction, 1.0), np.inf)
        tied = ratio <= ratio.min(axis=1, keepdims=True) + 1e-13
        leave = np.where(tied, ids[live], np.iinfo(ids.dtype).max).argmin(axis=1)
        ids[live, leave] = enter
        basis[live, :, leave] = column
        cost[live, leave] = np.where(enter < r, -weight, 0.0)
        step += 1
    return efficiency, weights[:, :s], weights[:, s:]


# --------------------------------------------------------------------------- frontier


def undominated(points: np.ndarray) -> np.ndarray:
    """Indices of the rows that no other row matches or undercuts everywhere; equal rows are kept once."""
    order = np.lexsort(points.T[::-1])
    points = points[order]
    kept: list[int] = []
    front = np.empty_like(points)
    for i, p in enumerate(points):  # in lexicographic order a row can only be dominated by an earlier one
        n = len(kept)
        if not (front[:n] <= p).all(axis=1).any():
            front[n] = p
            kept.append(i)
    return order[kept]


def _costs(pdf: pd.DataFrame) -> np.ndarray:
    """Inputs and negated outputs: less is better everywhere."""
    return np.hstack([np.stack(pdf["x"].to_numpy()), -np.stack(pdf["y"].to_numpy())]).astype(float)


def _beaten(points: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Which rows some row of ``strong`` matches or undercuts everywhere."""
    out = np.zeros(len(points), bool)
    for p in strong:
        left = np.flatnonzero(~out)
        out[left] = (points[left] >= p).all(axis=1)
    return out


@dataclass(frozen=True)
class Frontier:
    """All undominated alternatives and few others: ``strong`` rows of costs, and the rest as a table (x, y, block)."""

    strong: np.ndarray
    rest: DataFrame
    n_rest: int
    boxes: np.ndarray  # per block its number and its best corner
    n_inputs: int

    @property
    def shared(self) -> np.ndarray:
        return np.hstack([-self.strong[:, self.n_inputs :], -self.strong[:, : self.n_inputs]])


def frontier(points: DataFrame, widths: tuple[int, int], strong_rows: int = STRONG, block_rows: int = BLOCK_ROWS) -> Frontier:
    """The frontier of (x, y), which have ``widths`` entries.

    The ``strong_rows`` rows with the least sum of relative inputs less relative outputs are held apart, a bounded number.
    Each partition drops what they beat, whole batches by their best corner, and then what its own rows beat. What is left is dealt
    by ranges of that sum and thinned again as long as that halves it. A dominated row that stays does no harm, as its
    constraint is implied, so no task has to see everything.
    """
    m, s = widths
    places = [F.col("x")[i] for i in range(m)] + [F.col("y")[i] for i in range(s)]
    top = points.agg(*[F.max(F.abs(p)) for p in places]).first()
    share = [p / F.lit(float(v or 1.0)) for p, v in zip(places, top, strict=True)]
    keyed = points.select("x", "y", (total(share[:m]) - total(share[m:])).alias("rank"))
    held = pd.DataFrame([r.asDict() for r in keyed.orderBy("rank", "x", "y").limit(strong_rows).collect()], columns=["x", "y", "rank"])
    strong = _costs(held)
    strong = strong[undominated(strong)]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            costs = _costs(pdf)
            if (strong <= costs.min(axis=0)).all(axis=1).any():  # beats the best corner, and so the whole batch
                continue
            pdf, costs = pdf[~(b := _beaten(costs, strong))], costs[~b]
            if len(pdf):
                waiting.append(pdf.iloc[undominated(costs)])
            if sum(map(len, waiting)) >= 4 * block_rows:
                both = pd.concat(waiting, ignore_index=True)
                left = both.iloc[undominated(_costs(both))]
                waiting = [left]
                if len(left) >= 2 * block_rows:
                    yield left
                    waiting = []
        if waiting:
            both = pd.concat(waiting, ignore_index=True)
            yield both.iloc[undominated(_costs(both))]

    schema = "x array<double>, y array<double>, rank double"
    rest = materialise(keyed.mapInPandas(thin, schema), "frontier")
    n = rest.count()
    while n > block_rows:
        again = materialise(rest.repartitionByRange(-(-n // (4 * block_rows)), "rank").mapInPandas(thin, schema), "frontier")
        before, n, rest = n, again.count(), again
        if n > before / 2:
            break
    blocked, boxes = _blocks(rest, n, widths, block_rows)
    return Frontier(strong, blocked, n, boxes, m)


def _blocks(rest: DataFrame, n: int, widths: tuple[int, int], block_rows: int) -> tuple[DataFrame, np.ndarray]:
    """The rest in blocks of neighbours, and each block's best corner: least inputs and negated outputs.

    Neighbours by Z order: the bits of all scaled coordinates in turn.
    """
    if not n:
        return rest.select("x", "y", F.lit(0).alias("block")), np.zeros((0, 1))
    places = [F.col("x")[i] for i in range(widths[0])] + [-F.col("y")[i] for i in range(widths[1])]
    found = rest.agg(*[f(p) for p in places for f in (F.min, F.max)]).first()
    bits = max(1, min(16, 62 // len(places)))
    parts = []
    for k, p in enumerate(places):
        low, high = found[2 * k], found[2 * k + 1]
        scaled = F.floor((p - F.lit(low)) / F.lit((high - low) or 1.0) * F.lit((1 << bits) - 1)).cast("long")
        parts.extend(F.shiftleft(F.shiftright(scaled, b).bitwiseAND(F.lit(1)), b * len(places) + k) for b in range(bits))
    size = max(block_rows, -(-n // MAX_BLOCKS))
    count = -(-n // size)
    ordered = rest.withColumn("z", total(parts)).repartitionByRange(count, "z", "x", "y").withColumn("block", F.spark_partition_id())
    blocked = materialise(ordered.select("x", "y", "block"), "frontier-blocks")
    corners = blocked.groupBy("block").agg(*[F.min(p) for p in places]).collect()  # at most MAX_BLOCKS rows
    return blocked, np.array([list(c) for c in corners], float)


# --------------------------------------------------------------------------- efficiencies


def efficiencies(points: DataFrame, front: Frontier, stack: int = STACK) -> DataFrame:
    """(uid, efficiency) of (uid, x, y): solve against the strong rows, price the blocks, add what is violated, and again.

    A round is over when no constraint is violated; each one adds constraints that a program lacked, so rounds end.
    """
    shared, boxes, m = front.shared, front.boxes, front.n_inputs
    state = "uid long, x array<double>, y array<double>, extra array<array<double>>"
    solved_schema = f"{state}, w array<double>, efficiency double"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), stack):
                part = pdf.iloc[a : a + stack].copy()
                x, y = (np.stack(part[c].to_numpy()).astype(float) for c in ("x", "y"))
                more = np.zeros((len(part), max(len(e) for e in part["extra"]), shared.shape[1]))
                for k, e in enumerate(part["extra"]):
                    if len(e):
                        more[k, : len(e)] = np.stack([np.asarray(c, float) for c in e])
                part["efficiency"], u, v = solve_stacked(x, y, shared, more)
                part["w"] = list(np.hstack([v, u]))
                part["extra"] = [[list(c) for c in e] for e in part["extra"]]
                yield part

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            excess = -np.stack(pdf["w"].to_numpy()) @ boxes[:, 1:].T
            k, b = np.nonzero(excess > GAP)
            yield pd.DataFrame({"uid": pdf["uid"].to_numpy()[k], "w": pdf["w"].iloc[k].to_numpy(), "block": boxes[b, 0].astype(np.int64)})

    def violated(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"uid": [], "excess": [], "row": pd.Series(dtype=object)})
        costs = _costs(right)
        excess = -np.stack(left["w"].to_numpy()) @ costs.T
        best = excess.argmax(axis=1)
        hit = np.flatnonzero(excess[np.arange(len(left)), best] > GAP)
        rows = np.hstack([-costs[best[hit], m:], -costs[best[hit], :m]])
        return pd.DataFrame({"uid": left["uid"].to_numpy()[hit], "excess": excess[hit, best[hit]], "row": pd.Series(list(rows), dtype=object)})

    open_rows = points.select("uid", "x", "y", F.array().cast("array<array<double>>").alias("extra"))
    done: DataFrame | None = None
    while True:
        solved = materialise(open_rows.mapInPandas(solve, solved_schema), "dea-solved")
        here = solved.select("uid", clip(F.col("efficiency"), 0.0, 1.0).alias("efficiency"))
        if not front.n_rest:
            return here if done is None else done.unionByName(here)
        chunks = -(-solved.count() // PRICED)
        asked = solved.select("uid", "w").mapInPandas(reachable, "uid long, w array<double>, block long")
        asked = materialise(asked.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int")), "dea-asked")
        wanted = asked.select("block", F.col("chunk").alias("piece")).distinct()
        facing = front.rest.join(wanted, "block")
        found = asked.groupBy("block", "chunk").cogroup(facing.groupBy("block", "piece")).applyInPandas(
            violated, "uid long, excess double, row array<double>"
        )
        # one row per block at most, of which the worst few are taken
        worst = F.slice(F.sort_array(F.collect_list(F.struct("excess", "row")), asc=False), 1, ADDED)
        added = materialise(found.groupBy("uid").agg(F.transform(worst, lambda r: r["row"]).alias("more")), "dea-added")
        settled = here.join(added, "uid", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if added.isEmpty():
            return done
        open_rows = solved.join(added, "uid").select("uid", "x", "y", F.concat("extra", "more").alias("extra"))


def dea_ccr(
    df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], key: str = "dmu", scale: bool = False, strong_rows: int = STRONG
) -> DataFrame:
    """(key, efficiency): CCR multiplier efficiency with all weights at least 1e-4, clipped to [0, 1].

    ``scale`` divides every column by its maximum first. Keys may repeat or be null; each row is an alternative of its own. A
    row with a missing number has no efficiency (null) and constrains nobody.
    """
    numbers = {c: col(c).cast("double") for c in (*inputs, *outputs)}
    if scale:
        top: Row = df.agg(*[F.max(v).alias(c) for c, v in numbers.items()]).first()
        numbers = {c: v / F.lit(top[c] or 1.0) for c, v in numbers.items()}
    points = materialise(
        df.select(
            col(key).alias("key"),
            F.monotonically_increasing_id().alias("uid"),
            F.array(*[numbers[c] for c in inputs]).alias("x"),
            F.array(*[numbers[c] for c in outputs]).alias("y"),
        ),
        "dea-points",
    )
    whole = F.forall(F.concat("x", "y"), lambda v: v.isNotNull() & ~F.isnan(v))
    known = points.filter(whole)
    if known.isEmpty():
        return points.select(F.col("key").alias(key), F.lit(None).cast("double").alias("efficiency"))
    found = efficiencies(known, frontier(known, (len(inputs), len(outputs)), strong_rows))
    return points.join(found, "uid", "left").select(F.col("key").alias(key), "efficiency")
