"""Whitening of integer-scaled embeddings, with a covariance that bit planes give exactly.

Each vector becomes whole numbers. Over the distinct vectors every dimension is shifted to begin at zero and cut into bit
planes: plane b of a dimension holds bit b of all rows of a block, 64 rows to a word. The sum of products of two dimensions
is then the sum over all pairs of their planes of a power of two times the number of bits in the AND of both. Nothing is
rounded before the centred sums meet in the driver as Python's integers, one number for each pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise

#: Rows of one block of bit planes; a multiple of 64.
BLOCK_ROWS = 8192

#: Sums are carried in parts of so many bits, so that a long holds each part for up to 2**40 rows.
LIMB = 16

#: Scaled entries beyond this count as this.
LARGEST = float(1 << 61)

#: Fields of the partial sums: pair of dimensions (second -1: plain sum of the first), part of the number, value.
SUMS = "i int, j int, limb int, value long"


def as_integers(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * entry) + shift of each entry; null where the vector is null or holds a null or non-finite entry."""
    entries = vector.cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * F.lit(scale), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(shift))
    return F.when(fine, bounded)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def planes_of(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """One row of 64-bit words for each bit of each column, lowest bit first; ``bits`` says how many each column has."""
    n = -(-len(shifted) // 64) * 64
    padded = np.zeros((n, shifted.shape[1]), np.uint64)
    padded[: len(shifted)] = shifted
    out = np.zeros((int(bits.sum()), n // 64), np.uint64)
    first = np.cumsum(bits) - bits
    for b in range(int(bits.max(initial=0))):
        own = np.flatnonzero(bits > b)
        packed = np.packbits(((padded[:, own] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        out[first[own] + b] = np.ascontiguousarray(packed.T).view(np.uint64)
    return out


def products(planes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of a block in parts of ``LIMB`` bits: (parts, columns, columns) of products, (parts, columns) of entries."""
    p = len(planes)
    counts = np.zeros((p, p), np.int64)
    for k in range(p):
        counts[k, k:] = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
    counts = np.triu(counts, 1).T + counts
    weight = np.concatenate([np.arange(b) for b in bits])
    first = np.cumsum(bits) - bits
    two = weight[:, None] + weight[None, :]
    parts = int(two.max()) // LIMB + 1
    both = np.zeros((parts, len(bits), len(bits)), np.int64)
    single = np.zeros((parts, len(bits)), np.int64)
    for q in range(parts):
        here = np.where(two // LIMB == q, counts << (two % LIMB), 0)
        both[q] = np.add.reduceat(np.add.reduceat(here, first, axis=0), first, axis=1)
        single[q] = np.add.reduceat(np.where(weight // LIMB == q, np.diag(counts) << (weight % LIMB), 0), first)
    return both, single


@dataclass(frozen=True)
class Whitening:
    """What was fitted; ``axes`` has a column for each component, and components without variance are not ``sound``."""

    width: int
    n: int
    least: np.ndarray  # per dimension, what was taken off
    span: np.ndarray  # per dimension, greatest entry after that
    sums: list[int]  # per dimension, over the fit list, after that
    values: np.ndarray
    axes: np.ndarray
    explained: list[float | None]

    @property
    def sound(self) -> np.ndarray:
        return self.values > 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times each entry less the sum of its dimension: exact, as 64-bit numbers if they surely fit, else as objects."""
        shifted = x - self.least
        # rows that were not fitted can't occur, so entries lie between 0 and span
        if self.n * int(self.span.max(initial=0)) < 1 << 62:
            return shifted * np.int64(self.n) - np.array(self.sums, np.int64)
        return shifted.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> pa.Array:
        bound = (self.n * int(self.span.max(initial=0))) ** 2 * self.width
        if bound < 1 << 63:
            return pa.array((centred * centred).sum(axis=1).astype(np.int64))
        wide = centred.astype(object)
        return pa.array([v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()], pa.int64())

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates of the sound components; NaN in the others' columns."""
        out = np.full((len(centred), len(self.values)), np.nan)
        ok = self.sound
        out[:, ok] = (centred / self.n).astype(np.float64) @ self.axes[:, ok] / np.sqrt(self.values[ok])
        return out


def _extent(fit: DataFrame, width: int) -> tuple[int, list[int], list[int]]:
    """Rows, and least and greatest entry of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, width)
                n += len(x)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "n": pa.array([n] * width), "low": low, "high": high})

    found = fit.mapInArrow(run, "i int, n long, low long, high long").groupBy("i").agg(F.sum("n"), F.min("low"), F.max("high")).orderBy("i").collect()
    if not found:
        return 0, [], []
    return found[0][1], [r[2] for r in found], [r[3] for r in found]


def _sums(fit: DataFrame, width: int, least: np.ndarray, bits: np.ndarray) -> DataFrame:
    """(i, j, limb, value): parts of the sums of shifted entries and of their products, for dimensions that vary."""
    vary = np.flatnonzero(bits > 0)
    own = bits[vary]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = single = None
        waiting: list[np.ndarray] = []
        rows = 0

        def add(block: np.ndarray) -> None:
            nonlocal both, single
            found = products(planes_of(block, own), own)
            both, single = found if both is None else (both + found[0], single + found[1])

        for batch in batches:
            x = (_matrix(batch, width)[:, vary] - least[vary]).astype(np.uint64)
            waiting.append(x)
            rows += len(x)
            if rows >= BLOCK_ROWS:
                block = np.concatenate(waiting)
                upto = rows - rows % BLOCK_ROWS
                for at in range(0, upto, BLOCK_ROWS):
                    add(block[at : at + BLOCK_ROWS])
                waiting, rows = [block[upto:]], rows - upto
        if rows:
            add(np.concatenate(waiting))
        if both is not None:
            a, b = np.triu_indices(len(vary))
            for q in range(len(both)):
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array(np.concatenate([vary[a], vary]), pa.int32()),
                    "j": pa.array(np.concatenate([vary[b], np.full(len(vary), -1)]), pa.int32()),
                    "limb": pa.array(np.full(len(a) + len(vary), q), pa.int32()),
                    "value": pa.array(np.concatenate([both[q][a, b], single[q]]), pa.int64()),
                })

    return fit.mapInArrow(run, SUMS)


def solve(n: int, sums: list[int], squares: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, list[float | None]]:
    """Largest eigenvalues, unit eigenvectors and shares of the trace of the covariance of n rows, from exact sums."""
    d = len(sums)
    centred = [[n * squares[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    total = sum(centred[i][i] for i in range(d))
    values, axes = np.linalg.eigh(np.array([[c / (n * n) for c in row] for row in centred]).reshape(d, d))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    # below what rounding leaves of a zero
    values = np.where(values > d * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    return values, axes, [float(v) / (total / (n * n)) if total else None for v in values]


def fit(x: DataFrame, width: int, components: int) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors in ``x``, which all have ``width`` entries, and these vectors as a written table."""
    distinct = materialise(x.select("x").distinct(), "distinct-vectors")
    n, low, high = _extent(distinct, width)
    if not n:
        return None, distinct
    bits = np.array([(h - a).bit_length() for a, h in zip(low, high, strict=True)], np.int64)
    sums, squares = [0] * width, [[0] * width for _ in range(width)]
    if bits.any():
        for i, j, limb, value in _sums(distinct, width, np.array(low, np.int64), bits).groupBy("i", "j", "limb").agg(F.sum("value")).collect():
            if j < 0:
                sums[i] += value << (LIMB * limb)
            else:
                squares[i][j] += value << (LIMB * limb)
                squares[j][i] = squares[i][j]
    span = np.array([h - a for a, h in zip(low, high, strict=True)], np.int64)
    return Whitening(width, n, np.array(low, np.int64), span, sums, *solve(n, sums, squares, components)), distinct


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, over components with variance."""
    k = int(model.sound.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = model.project(model.centred(_matrix(batch, model.width)))[:, :k]
            total[:, :k] += w.T @ w
            total[:, k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "value": total.ravel()})

    total = np.zeros((k, k + 1))
    for i, j, value in distinct.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = value
    mean = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    rows: DataFrame,
    components: int = 16,
    scale: float = 64.0,
    shift: int = 1_000_000,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and each component, from 1.

    Rows whose vector is null or holds null or non-finite entries take no part. Of vectors of several lengths, those of the
    most frequent length (the longest on ties) take part. Repeated vectors count once in the fit and each gets its rows; ids may
    repeat or be null. Scaled entries beyond 2**61 count as that. There are as many components as dimensions, ``components`` at most;
    where one has no variance, ``explained`` is 0 and ``whitened`` null; with no variance at all, ``explained`` and
    ``identity_error`` are null. ``deviation`` is null where it doesn't fit a long. Other columns are not read, whatever their
    names; an empty table gives no rows. Only numbers for each pair of dimensions reach the driver.
    """
    x = as_integers(F.col(vector_column), scale, shift)
    table = materialise(rows.select(F.col(id_column).alias("id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0)), "integer-vectors")
    widths = table.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    id_type = rows.schema[id_column].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if widths is None:
        return rows.sparkSession.createDataFrame([], schema)
    width = widths["width"]
    table = table.filter(F.size("x") == width)
    model, distinct = fit(table, width, components)
    error = identity_error(distinct, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = model.centred(_matrix(batch, width))
            found = model.project(centred)
            flat = pa.array(found.ravel(), mask=np.isnan(found).ravel())
            at = pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), model.deviations(centred), pa.ListArray.from_arrays(at, flat)], ["id", "deviation", "w"])

    scored = table.mapInArrow(run, f"id {id_type}, deviation long, w array<double>")
    return scored.select("id", "deviation", F.posexplode("w").alias("pos", "whitened")).select(
        F.col("id").alias("vec_id"),
        (F.col("pos") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(e).cast("double") for e in model.explained]), F.col("pos") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
