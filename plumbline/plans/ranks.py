"""Order statistics and cumulative tables that do not sort a whole column in one task.

All rank-based operators (quantiles, KS, Wasserstein, PSI, AUC, PR curve, thresholds) share one plan:

1. split points: approximate quantiles of a sample cut each column's range into buckets. They only
   steer the load; results are exact whatever they are.
2. value counts: rows are aggregated to distinct (feature, bucket, value) before anything is sorted,
   so a value that holds a third of the rows is combined on the map side. The aggregated table is
   written once, and everything below reads it, not the rows.
3. cumulation: a window inside each bucket plus the offset of the bucket, which comes from the bucket
   totals (#features x #buckets numbers).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import col, order_hash, present
from plumbline.session import materialise, small_table

MIN_BUCKETS = 64
MAX_CELLS = 200_000
RANKED_ROWS = 1_000_000
SAMPLE_FRACTION = 0.1
SKETCH_GROUPS = 64


def bucket_count(spark: SparkSession, features: int = 1) -> int:
    """As many buckets as shuffle partitions, which a cluster sets by its data, as far as the totals of all
    features fit the driver."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_CELLS // max(1, features), max(MIN_BUCKETS, wanted)))


def split_points(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> list[list[float]]:
    """Approximately equal-depth inner cut points per column, from a sample.

    Sketches are built in ``SKETCH_GROUPS`` independent groups and then sketched again, so that no
    single task merges one sketch per input split.
    """
    buckets = buckets or bucket_count(df.sparkSession, len(cols))
    probs = [i / buckets for i in range(1, buckets)]
    values = [present(col(c)).alias(f"v{i}") for i, c in enumerate(cols)]
    grouped = (
        df.select(*values)
        .sample(fraction=SAMPLE_FRACTION, seed=7)
        .groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("g"))
        .agg(*[F.percentile_approx(f"v{i}", probs, 4 * buckets).alias(f"v{i}") for i in range(len(cols))])
        .select([F.explode_outer(F.arrays_zip(*[F.col(f"v{i}") for i in range(len(cols))])).alias("z")])
        .select("z.*")
    )
    row = grouped.agg(
        *[F.percentile_approx(f"v{i}", probs, 4 * buckets).alias(f"v{i}") for i in range(len(cols))]
    ).first()
    return [sorted({float(x) for x in (row[i] or []) if math.isfinite(x)}) for i in range(len(cols))]


def long_values(
    df: DataFrame,
    cols: Sequence[str],
    splits: Sequence[Sequence[float]],
    carry: Mapping[str, Column | Sequence[Column]] | None = None,
) -> DataFrame:
    """Rows (f, bucket, value, carried columns), one per non-missing cell; f is the column's position,
    as a number is a cheaper grouping key than a name.

    A carried column is one expression for all features, or a list with one per feature.
    """
    carry = carry or {}
    flat = [present(col(c)).alias(f"v{i}") for i, c in enumerate(cols)]
    flat += [
        e.alias(f"{name}{i}")
        for name, exprs in carry.items()
        for i, e in enumerate(exprs if isinstance(exprs, (list, tuple)) else [exprs])
    ]
    wide = Bucketizer(
        splitsArray=[[-math.inf, *(s or [0.0]), math.inf] for s in splits],
        inputCols=[f"v{i}" for i in range(len(cols))],
        outputCols=[f"b{i}" for i in range(len(cols))],
        handleInvalid="keep",
    ).transform(df.select(*flat))
    cells = [
        F.struct(
            F.lit(i).alias("f"),
            F.col(f"b{i}").cast("int").alias("bucket"),
            F.col(f"v{i}").alias("value"),
            *[
                F.col(f"{name}{i if isinstance(exprs, (list, tuple)) else 0}").alias(name)
                for name, exprs in carry.items()
            ],
        )
        for i in range(len(cols))
    ]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("value").isNotNull())


@dataclass(frozen=True)
class RankTable:
    """Distinct values per feature with summed weights, and the totals of each bucket.

    ``counts`` is a written table (f, bucket, value, weights) where f is the position of the feature in
    ``names``; ``totals`` has one entry per feature with values: its buckets in order as (bucket, lowest
    value, highest value, {weight: sum}).
    """

    counts: DataFrame
    names: tuple[str, ...]
    weights: tuple[str, ...]
    totals: dict[str, list[tuple[int, float, float, dict[str, int]]]]

    @staticmethod
    def build(
        df: DataFrame,
        cols: Sequence[str],
        weights: Mapping[str, Column | Sequence[Column]],
        names: Sequence[str] | None = None,
        splits: Sequence[Sequence[float]] | None = None,
    ) -> RankTable:
        splits = splits if splits is not None else split_points(df, cols)
        return RankTable.of_cells(long_values(df, cols, splits, weights), tuple(weights), tuple(names or cols))

    def plus(self, cells: DataFrame) -> RankTable:
        """This table with further cells (f, bucket, value, weights) counted in; their buckets must be its own."""
        columns = ["f", "bucket", "value", *self.weights]
        return RankTable.of_cells(self.counts.select(*columns).unionByName(cells.select(*columns)), self.weights, self.names)

    @staticmethod
    def of_cells(cells: DataFrame, weights: Sequence[str], names: tuple[str, ...]) -> RankTable:
        """Count cells and write the counts."""
        counts = materialise(
            cells.groupBy("f", "bucket", "value").agg(*[F.sum(w).alias(w) for w in weights]), "values"
        )
        rows = (
            counts.groupBy("f", "bucket")
            .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), *[F.sum(w).alias(w) for w in weights])
            .collect()
        )
        totals: dict[str, list[tuple[int, float, float, dict[str, int]]]] = {}
        for r in sorted(rows, key=lambda r: (r["f"], r["bucket"])):
            sums = {w: r[w] or 0 for w in weights}
            totals.setdefault(names[r["f"]], []).append((r["bucket"], r["lo"], r["hi"], sums))
        return RankTable(counts, names, tuple(weights), totals)

    def total(self, feature: str, weight: str) -> int:
        return sum(sums[weight] for *_, sums in self.totals.get(feature, []))

    def only(self, features: Sequence[str]) -> RankTable:
        """The same table for some of the features."""
        return RankTable(
            self.counts, self.names, self.weights, {f: t for f, t in self.totals.items() if f in set(features)}
        )

    def cumulated(self, descending: bool = False) -> DataFrame:
        """Adds, per weight w: ``cum_w`` (running sum including the row) and ``all_w`` (feature total),
        and ``next_value`` (the following distinct value of the feature, null at the end)."""
        rows = []
        for feature, buckets in self.totals.items():
            along = buckets[::-1] if descending else buckets
            seen = dict.fromkeys(self.weights, 0)
            for k, (bucket, _, _, sums) in enumerate(along):
                following = along[k + 1][2 if descending else 1] if k + 1 < len(along) else None
                rows.append((self.names.index(feature), feature, bucket, following, *seen.values(), *[self.total(feature, w) for w in self.weights]))
                seen = {w: seen[w] + sums[w] for w in self.weights}
        longs = [f"{kind}_{w} bigint" for kind in ("o", "all") for w in self.weights]
        schema = ", ".join(["f int", "feature string", "bucket int", "o_next double", *longs])
        offsets = small_table(self.counts.sparkSession, rows, schema)  # at most MAX_CELLS rows
        order = F.desc("value") if descending else F.asc("value")
        inside = Window.partitionBy("f", "bucket").orderBy(order)
        running = inside.rowsBetween(Window.unboundedPreceding, 0)
        return (
            self.counts.select(
                "*",
                *[F.sum(w).over(running).alias(f"c_{w}") for w in self.weights],
                F.lead("value").over(inside).alias("c_next"),
            )
            .join(F.broadcast(offsets), ["f", "bucket"])
            .select(
                "feature",
                "bucket",
                "value",
                *self.weights,
                *[(F.col(f"c_{w}") + F.col(f"o_{w}")).alias(f"cum_{w}") for w in self.weights],
                *[f"all_{w}" for w in self.weights],
                F.coalesce("c_next", "o_next").alias("next_value"),
            )
        )

    def quantiles(self, probs: Sequence[float], weight: str) -> dict[str, list[float | None]]:
        """Exact interpolated quantiles per feature of the rows counted by ``weight``."""
        sizes = {self.names.index(f): {b: sums[weight] for b, _, _, sums in t} for f, t in self.totals.items()}
        cells = self.counts.filter(F.col(weight) > 0).select("f", "bucket", "value", F.col(weight).alias("n"))
        found = _quantiles(cells, sizes, probs)
        return {self.names[f]: qs for f, qs in found.items()}


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    splits: Sequence[Sequence[float]] | None = None,
) -> list[list[float | None]]:
    """Exact linearly interpolated quantiles per column, null-free; ``None`` for an empty column.

    Bucket sizes locate the buckets that hold the wanted ranks; only rows of those buckets are
    shuffled. The result is (#columns x #probs) numbers.
    """
    splits = splits if splits is not None else split_points(df, cols)
    cells = long_values(df, cols, splits, {"n": F.lit(1).cast("bigint")})
    sizes: dict[int, dict[int, int]] = {i: {} for i in range(len(cols))}
    for r in cells.groupBy("f", "bucket").agg(F.sum("n").alias("n")).collect():
        sizes[r["f"]][r["bucket"]] = r["n"]
    found = _quantiles(cells, sizes, probs, distinct=False)
    return [found[i] for i in range(len(cols))]


def _quantiles(
    cells: DataFrame, sizes: Mapping[int, Mapping[int, int]], probs: Sequence[float], distinct: bool = True
) -> dict[int, list[float | None]]:
    """Quantiles from counted cells (f, bucket, value, n) whose bucket sizes are known. ``distinct`` says
    that each value occurs once."""
    wanted: dict[tuple[int, int], set[int]] = {}
    place: dict[tuple[int, int], tuple[int, int]] = {}
    for f, buckets in sizes.items():
        n = sum(buckets.values())
        for rank in sorted({r for p in probs for r in _ranks(p, n)[:2]}) if n else []:
            seen = 0
            for b in sorted(buckets):
                if rank < seen + buckets[b]:
                    wanted.setdefault((f, b), set()).add(rank - seen)
                    place[f, rank] = (b, rank - seen)
                    break
                seen += buckets[b]
    found: dict[tuple[int, int, int], float] = {}
    if wanted:
        # one row per (feature, wanted bucket): at most 2 * #features * #probs rows
        targets = small_table(
            cells.sparkSession,
            [(f, b, sorted(rs)) for (f, b), rs in wanted.items()], "f int, bucket int, ranks array<bigint>"
        )
        running = Window.partitionBy("f", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        near = cells.join(F.broadcast(targets.select("f", "bucket")), ["f", "bucket"], "left_semi")
        if not distinct:
            near = near.groupBy("f", "bucket", "value").agg(F.sum("n").alias("n"))
        hits = (
            near.withColumn("upto", F.sum("n").over(running))
            .join(F.broadcast(targets), ["f", "bucket"])
            .withColumn("hit", F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
            .filter(F.size("hit") > 0)
        )
        for r in hits.select("f", "bucket", "value", "hit").collect():
            found.update({(r["f"], r["bucket"], rank): r["value"] for rank in r["hit"]})
    out: dict[int, list[float | None]] = {}
    for f, buckets in sizes.items():
        n = sum(buckets.values())
        out[f] = []
        for p in probs:
            if n == 0:
                out[f].append(None)
                continue
            lo, hi, part = _ranks(p, n)
            a, b = (found[(f, *place[f, k])] for k in (lo, hi))
            out[f].append(a if lo == hi else (1.0 - part) * a + part * b)
    return out


def _ranks(p: float, n: int) -> tuple[int, int, float]:
    pos = p * (n - 1)
    lo = math.floor(pos)
    return lo, min(math.ceil(pos), n - 1), pos - lo


def single_agg_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[list[float | None]]:
    """Same numbers from one ``percentile`` aggregate; for small tables and for cross-checks."""
    row = df.agg(
        *[F.percentile(present(col(c)), F.array(*[F.lit(p) for p in probs])).alias(f"q{i}") for i, c in enumerate(cols)]
    ).first()
    return [list(row[i]) if row[i] is not None else [None] * len(probs) for i in range(len(cols))]


def ranged_row_number(df: DataFrame, order: Sequence[str], name: str, part: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """1-based ``row_number() over (partition by part order by order)`` as column ``name``.

    Rows are dealt out by ranges of (part, order) from a sample, sorted there, and written once with their
    place in their range; one row for each part of a range shifts the places. So neither one large
    part nor a common prefix of the values puts many rows into one task, whatever the table's size, and the
    rows are not dealt out by part again. Columns in ``drop`` order the rows only: they are neither written nor in the result.
    """
    by = [*part, *order]
    rows = df.repartitionByRange(*[col(c) for c in by]).sortWithinPartitions(*[col(c) for c in by])
    # the lower 33 bits of the id count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    kept = [c for c in df.columns if c not in drop]
    placed = materialise(rows.select(*[col(c) for c in kept], F.spark_partition_id().alias("_range"), place.alias("_place")), "numbered")
    sizes = placed.groupBy(F.col("_range").alias("_r"), *[col(c).alias(f"_k{i}") for i, c in enumerate(part)]).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")
    )
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(part))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    shifts = materialise(sizes.withColumn("_shift", shift).drop("_n", "_first"), "shifts")
    if shifts.count() <= MAX_CELLS:
        shifts = F.broadcast(shifts)
    same = [F.col("_range") == F.col("_r"), *[col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(part)]]
    return placed.join(shifts, same).select(*[col(c) for c in kept], (F.col("_place") + F.col("_shift")).alias(name))


def hash_cuts(
    df: DataFrame, klass: str | None, keys: Sequence[str], seed: int, ranks: Mapping[object, Sequence[int]]
) -> dict[object, list[tuple[str, str] | None]]:
    """Per class, the (hash, key) of the rows at the given 1-based ranks in ``order_hash`` order.

    Rank 0 gives ``None`` (nothing is at or below it). Counts per (class, hash prefix) find the prefix that
    holds each rank. As long as a wanted prefix holds more than ``RANKED_ROWS`` rows, its rows are counted by
    a longer prefix; then only the rows of the wanted prefixes are ranked. The result is #classes x #ranks
    rows.
    """
    spark = df.sparkSession
    base = df.select(
        (col(klass) if klass else F.lit(0)).alias("k"),
        order_hash(keys, seed).alias("h"),
        F.concat_ws("\u0001", *[col(x).cast("string") for x in keys]).alias("key"),
    )
    kind = base.schema["k"].dataType.simpleString()
    step = 3 if len(ranks) <= 50 else 2 if len(ranks) <= 1000 else 1  # few counts per class where classes are many

    def wanted(table: DataFrame, prefixes: DataFrame, width: int) -> DataFrame:
        few = F.broadcast(prefixes) if len(open_ranks) <= MAX_CELLS else prefixes
        return table.withColumn("b", F.left("h", F.lit(width))).join(few, ["k", "b"], "left_semi")

    # (class, wanted rank, prefix, rank inside the prefix)
    open_ranks = [(k, r, "", r) for k, rs in ranks.items() for r in sorted(set(rs) - {0})]
    width = 0
    near = base
    while open_ranks:
        width += step
        sizes: dict[tuple[object, str], dict[str, int]] = {}
        for r in near.groupBy("k", F.left("h", F.lit(width)).alias("b")).count().collect():
            sizes.setdefault((r["k"], r["b"][: width - step]), {})[r["b"]] = r["count"]
        found_in: list[tuple[object, int, str, int]] = []
        largest = 0
        for k, rank, prefix, local in open_ranks:
            buckets = sizes[k, prefix]
            for b in sorted(buckets):
                if local <= buckets[b]:
                    found_in.append((k, rank, b, local))
                    largest = max(largest, buckets[b])
                    break
                local -= buckets[b]
        open_ranks = found_in
        prefixes = small_table(spark, sorted({(k, b) for k, _, b, _ in open_ranks}, key=str), f"k {kind}, b string")
        near = wanted(base, prefixes, width)
        if largest <= RANKED_ROWS or width >= 30:
            break
    found: dict[tuple[object, int], tuple[str, str]] = {}
    if open_ranks:
        rows = [(k, b, local, rank) for k, rank, b, local in open_ranks]
        targets = small_table(spark, rows, f"k {kind}, b string, local bigint, rank bigint")
        if len(rows) <= MAX_CELLS:
            targets = F.broadcast(targets)
        order = Window.partitionBy("k", "b").orderBy("h", "key")
        inside = near.withColumn("local", F.row_number().over(order).cast("bigint"))
        for r in inside.join(targets, ["k", "b", "local"]).select("k", "rank", "h", "key").collect():
            found[(r["k"], r["rank"])] = (r["h"], r["key"])
    return {k: [found[(k, r)] if r else None for r in wanted_ranks] for k, wanted_ranks in ranks.items()}
