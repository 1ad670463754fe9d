"""Support vector machines with a Gaussian kernel, trained on Spark.

Random Fourier features stand for the kernel: an inner product of two rows' features is about exp(-gamma * squared distance). On
them the machine is linear, and a few Newton steps find it: each step is one pass in which every task adds up the
normal equations of its rows that violate the margin, numbers for each pair of features and nothing for each row. After the
first pass only rows that begin or cease to violate it are added to or taken from the sums of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import total
from plumbline.session import materialise

#: Passes of one fit at most; the finite Newton method needs about ten.
MAX_PASSES = 40
#: The steps on all rows begin where those on one row in so many end, if that are so many rows at least.
START_SHARE, START_ROWS = 16, 10_000
#: Rows whose features are held at a time.
MAPPED_ROWS = 2_048
#: One row in so many is kept out of the machine whose decisions the probabilities are fitted to.
HELD_OUT = 5


@dataclass(frozen=True)
class KernelMachine:
    """Frequencies (d, D) and phases (D) of the feature map, and the weights (D + 1, K) of one machine per class (K = 1 for two
    classes and for regression). ``slopes`` and ``offsets`` turn decisions into probabilities; regression has none."""

    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    slopes: np.ndarray
    offsets: np.ndarray
    features: str

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Features of rows, and a constant."""
        out = np.ones((len(x), len(self.phases) + 1))
        z = x @ self.frequencies
        z += self.phases
        np.cos(z, out=z)
        np.multiply(z, np.sqrt(2.0 / len(self.phases)), out=out[:, :-1])
        return out

    def decisions(self) -> Column:
        """Distance from each class's border as an array, by one matrix product for each Arrow batch."""

        @F.pandas_udf("array<double>")
        def decide(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list(self.mapped(np.stack(rows.to_numpy()).astype(float)) @ self.weights))

        return decide(vector_to_array(F.col(self.features)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction and, for classes, probability."""
        out = df.withColumn("_decisions", self.decisions())
        if not len(self.slopes):
            return out.withColumn("prediction", F.get("_decisions", F.lit(0))).drop("_decisions")
        own = [1.0 / (1.0 + F.exp(F.lit(float(a)) * F.get("_decisions", F.lit(k)) + F.lit(float(b)))) for k, (a, b) in enumerate(zip(self.slopes, self.offsets, strict=True))]
        if len(own) == 1:
            shares = F.array(1.0 - own[0], own[0])
            prediction = (F.get("_decisions", F.lit(0)) > 0).cast("double")
        else:
            shares = F.array(*[p / F.greatest(total(own), F.lit(1e-300)) for p in own])
            prediction = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        out = out.withColumn("_shares", shares).withColumn("prediction", prediction)
        return out.withColumn("probability", array_to_vector("_shares")).drop("_decisions", "_shares")


def _sums(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of the vector that ``run`` gives for a task's batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = run(batches)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(found)), pa.int32()), "value": pa.array(found)})

    summed = rows.mapInArrow(each, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(summed))
    for i, value in summed:
        out[i] = value
    return out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return x.reshape(batch.num_rows, -1), batch.column("y").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)


def fit_weights(
    rows: DataFrame, machine: KernelMachine, cost: float, target: float | None, epsilon: float | None, passes: int = MAX_PASSES, start: np.ndarray | None = None
) -> np.ndarray:
    """Weights that minimise half their square plus ``cost`` times the weighted squared losses of (x, y, w).

    For classes, ``target`` is the class that the machine tells from the others and the loss what the margin lacks; for
    regression it is what the residual exceeds ``epsilon`` by. The constant is not penalised. The minimum is one, wherever
    the steps ``start``; near it they are few.
    """
    d = len(machine.phases) + 1
    ridge = np.ones(d)
    ridge[-1] = 1e-9

    def one_pass(v: np.ndarray, before: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, right side, and sums of pairs of features of the rows that violate the margin; with ``before``, less those sums there."""

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            gram, side, loss = np.zeros((d, d)), np.zeros(d), 0.0

            def lacks(y: np.ndarray, found: np.ndarray) -> np.ndarray:
                return 1.0 - y * found if epsilon is None else np.abs(y - found) - epsilon

            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, w = _columns(batch)
                if epsilon is None:
                    y = np.where(y == target, 1.0, -1.0)
                for s in range(0, len(x), MAPPED_ROWS):
                    z, own_y, own_w = machine.mapped(x[s : s + MAPPED_ROWS]), y[s : s + MAPPED_ROWS], w[s : s + MAPPED_ROWS]
                    found = z @ v
                    lack = lacks(own_y, found)
                    active = lack > 0
                    wanted = own_y if epsilon is None else own_y - np.sign(own_y - found) * epsilon
                    side += z.T @ np.where(active, own_w * wanted, 0.0)
                    loss += float((own_w[active] * lack[active] ** 2).sum())
                    change = active.astype(float) if before is None else active.astype(float) - (lacks(own_y, z @ before) > 0)
                    here = np.flatnonzero(change)
                    part = z[here]
                    gram += (part * (own_w * change)[here, None]).T @ part
            return np.concatenate([[loss], side, gram.ravel()])

        total_ = _sums(rows, run)
        return float(total_[0]), total_[1 : d + 1], total_[d + 1 :].reshape(d, d)

    def objective(v: np.ndarray, loss: float) -> float:
        return 0.5 * float((ridge * v * v).sum()) + cost * loss

    v = np.zeros(d) if start is None else start
    loss, side, gram = one_pass(v)
    value = objective(v, loss)
    for _ in range(passes):
        step = np.linalg.solve(np.diag(ridge) + 2 * cost * gram, 2 * cost * side) - v
        if np.abs(step).max() <= 1e-7 * (1.0 + np.abs(v).max()):
            break
        share = 1.0
        while True:  # a step that overshoots is halved
            loss, own_side, change = one_pass(v + share * step, v)
            new = objective(v + share * step, loss)
            if new <= value or share < 1e-3:
                break
            share /= 2
        if new >= value * (1 - 1e-9):
            if new <= value:
                v = v + share * step
            break
        v, value, side, gram = v + share * step, new, own_side, gram + change
    return v


def fit_sigmoid(rows: DataFrame, decision: Column, positive: Column) -> tuple[float, float]:
    """Platt's (slope, offset) with p = 1 / (1 + exp(slope * decision + offset)) and his targets, which keep p from 0 and 1."""
    told = rows.select(decision.alias("d"), positive.cast("double").alias("y"))
    counts = told.agg(F.sum("y"), F.sum(1.0 - F.col("y"))).first()
    up, down = (float(c or 0.0) for c in counts)
    if not up or not down:  # one class alone has nothing to be told from
        return (-1.0, 0.0)
    t = F.when(F.col("y") == 1.0, (up + 1) / (up + 2)).otherwise(1 / (down + 2))
    sides = F.array(F.struct(F.lit(1.0).alias("label"), t.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1.0 - t).alias("weight")))
    table = told.select(array_to_vector(F.array("d")).alias("features"), F.explode(sides).alias("s")).select("features", "s.*")
    model = LogisticRegression(weightCol="weight", maxIter=50, standardization=False).fit(table)
    return -float(model.coefficients[0]), -float(model.intercept)


@dataclass(frozen=True)
class KernelFit:
    """``gamma`` 0 stands for 1 / (number of features * variance of all entries); ``size`` is the number of Fourier features."""

    label: str
    features: str
    weight: str | None
    classes: int
    seed: int
    params: Mapping[str, float]

    def fit(self, table: DataFrame) -> KernelMachine:
        assert isinstance(table.schema[self.features].dataType, VectorUDT)
        drawn = F.xxhash64(F.col("x"), F.col("y"))
        key = F.pmod(drawn, F.lit(HELD_OUT)).alias("part")
        few = (F.pmod(F.shiftright(drawn, 20), F.lit(START_SHARE)) == 0).alias("few")
        rows = table.select(
            vector_to_array(F.col(self.features)).alias("x"),
            F.col(self.label).cast("double").alias("y"),
            (F.col(self.weight) if self.weight else F.lit(1.0)).cast("double").alias("w"),
        )
        rows = materialise(rows.select("*", key, few), "kernel-rows")
        machine, n = self._map(rows)

        def whole_fit(target: float | None, epsilon: float | None) -> np.ndarray:
            start = fit_weights(rows.filter("few"), machine, cost * START_SHARE, target, epsilon) if n >= START_SHARE * START_ROWS else None
            return fit_weights(rows, machine, cost, target, epsilon, start=start)

        cost, epsilon = self.params["C"], self.params.get("epsilon")
        if epsilon is not None:
            weights = whole_fit(None, epsilon)[:, None]
            return KernelMachine(machine.frequencies, machine.phases, weights, np.zeros(0), np.zeros(0), self.features)
        targets: Sequence[float] = [1.0] if self.classes <= 2 else [float(c) for c in range(self.classes)]
        whole = np.stack([whole_fit(t, None) for t in targets], axis=1)
        # decisions on rows that a machine has not seen tell how sure they are
        seen, unseen = rows.filter(F.col("part") > 0), rows.filter(F.col("part") == 0)
        blind = np.stack([fit_weights(seen, machine, cost, t, None, start=whole[:, k]) for k, t in enumerate(targets)], axis=1)
        judge = KernelMachine(machine.frequencies, machine.phases, blind, np.zeros(0), np.zeros(0), "features")
        judged = unseen.select(array_to_vector("x").alias("features"), "y").select(judge.decisions().alias("d"), "y")
        judged = materialise(judged, "kernel-decisions")
        found = [fit_sigmoid(judged, F.get("d", F.lit(k)), F.col("y") == t) for k, t in enumerate(targets)]
        slopes, offsets = (np.array(c) for c in zip(*found, strict=True))
        return KernelMachine(machine.frequencies, machine.phases, whole, slopes, offsets, self.features)

    def _map(self, rows: DataFrame) -> tuple[KernelMachine, int]:
        """The feature map, and the number of rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(4)
            for batch in batches:
                if batch.num_rows:
                    x = _columns(batch)[0]
                    out += [x.size, x.sum(), (x * x).sum(), len(x)]
            return out

        size, plain, squares, n = _sums(rows, run)
        if not n:
            raise ValueError("no rows to fit")
        width = int(size // n)
        variance = squares / size - (plain / size) ** 2
        gamma = self.params.get("gamma") or 1.0 / (width * (variance or 1.0))
        rng = np.random.default_rng(self.seed)
        count = int(self.params["size"])
        frequencies = rng.normal(size=(width, count)) * np.sqrt(2 * gamma)
        return KernelMachine(frequencies, rng.uniform(0, 2 * np.pi, count), np.zeros((count + 1, 1)), np.zeros(0), np.zeros(0), self.features), int(n)
