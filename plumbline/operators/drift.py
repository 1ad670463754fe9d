"""Feature drift between a reference and a current table: KS, Wasserstein, PSI."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import pairwise

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip, col, ks_exact, ks_is_small, ks_lambda, ks_pvalue, present, total
from plumbline.plans.ranks import RankTable, long_values, split_points
from plumbline.session import small_table

EDGE = 1e-4
SHARE = 1e-4
ROWS = -1  # stands for a feature where whole rows are counted


def both_sides(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The shared features of the two tables with a boolean ``_ref``; a feature missing from the
    current table is left out."""
    shared = [c for c in cols if c in current.columns]
    return (
        reference.select(*[present(col(c)).alias(c) for c in shared])
        .withColumn("_ref", F.lit(True))
        .unionByName(current.select(*[present(col(c)).alias(c) for c in shared]).withColumn("_ref", F.lit(False)))
    )


def _rank_table(df: DataFrame, cols: Sequence[str], is_ref: Column) -> RankTable:
    """Value counts per side."""
    weights = {
        "ref": F.when(is_ref, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        "cur": F.when(is_ref, F.lit(0)).otherwise(F.lit(1)).cast("bigint"),
    }
    return RankTable.build(df, cols, weights)


def _with_both(ranks: RankTable, cols: Sequence[str]) -> RankTable:
    """The features that have values on both sides."""
    return ranks.only([c for c in cols if ranks.total(c, "ref") and ranks.total(c, "cur")])


def _ranks(df: DataFrame, cols: Sequence[str], is_ref: Column) -> RankTable:
    return _with_both(_rank_table(df, cols, is_ref), cols)


def _gap() -> Column:
    return F.abs(F.col("cum_ref") / F.col("all_ref") - F.col("cum_cur") / F.col("all_cur"))


def _ks() -> list[Column]:
    return [F.max("all_ref").alias("n_ref"), F.max("all_cur").alias("n_cur"), F.max(_gap()).alias("ks_statistic")]


def _wasserstein() -> Column:
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return F.sum(_gap() * width).alias("wasserstein_distance")


def ks_statistic(df: DataFrame, cols: Sequence[str], is_ref: Column) -> DataFrame:
    """(feature, n_ref, n_cur, ks_statistic)."""
    return _ranks(df, cols, is_ref).cumulated().groupBy("feature").agg(*_ks())


def ks_test(df: DataFrame, cols: Sequence[str], is_ref: Column) -> DataFrame:
    """(feature, n_ref, n_cur, ks_statistic, p_value)."""
    return _with_pvalue(ks_statistic(df, cols, is_ref))


def _with_pvalue(found: DataFrame) -> DataFrame:
    """The p-value by the exact law for small samples (``ks_is_small``), else by the limit law."""
    found_by = [F.col(c) for c in ("ks_statistic", "n_ref", "n_cur")]
    lam = ks_lambda(*found_by)
    p = F.when(ks_is_small(*found_by[1:]), ks_exact(*found_by)).otherwise(ks_pvalue(F.col("_lam")))
    return found.withColumn("_lam", lam).withColumn("p_value", p).drop("_lam")


def wasserstein(df: DataFrame, cols: Sequence[str], is_ref: Column) -> DataFrame:
    """(feature, wasserstein_distance)."""
    return _ranks(df, cols, is_ref).cumulated().groupBy("feature").agg(_wasserstein())


def _bin(bins: int) -> Column:
    """Index of the half-open bin that holds the value, the last one closed; null outside."""
    v = F.col("value")
    index = total([F.when(v >= F.col(f"e{i}"), 1).otherwise(0) for i in range(bins)]) - 1
    return F.when((v >= F.col("e0")) & (v <= F.col(f"e{bins}")), index)


def _binned(ranks: RankTable, bins: int, digits: int | None) -> DataFrame:
    """The cumulative table with the bin of each value. Edges are interpolated quantiles of the
    reference, the outer two moved out a little."""
    rows = []
    for feature, edges in ranks.quantiles([i / bins for i in range(bins + 1)], "ref").items():
        edges = [edges[0] - EDGE, *edges[1:-1], edges[-1] + EDGE]
        rows.append((feature, *[e if digits is None else round(e, digits) for e in edges]))
    schema = ", ".join(["feature string", *[f"e{i} double" for i in range(bins + 1)]])
    table = small_table(ranks.counts.sparkSession, rows, schema)  # one row per feature
    return ranks.cumulated().join(F.broadcast(table), "feature").withColumn("bin", _bin(bins))


def _psi() -> Column:
    """PSI from rows (bin, ref, cur, n_ref, n_cur) of one feature. Bins without rows add nothing, as
    their shares are equal on both sides; values outside every bin are left out."""
    r = F.col("ref") / F.greatest(F.col("n_ref"), F.lit(1)) + SHARE
    c = F.col("cur") / F.greatest(F.col("n_cur"), F.lit(1)) + SHARE
    term = F.when(F.col("bin").isNotNull(), (c - r) * F.log(c / r)).otherwise(0.0)
    return clip(F.sum(term), 0.0, 10.0).alias("psi")


def _per_bin(binned: DataFrame) -> DataFrame:
    return binned.groupBy("feature", "bin").agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"), *_ks(), _wasserstein()
    )


def psi(df: DataFrame, cols: Sequence[str], is_ref: Column, bins: int = 10, edge_digits: int | None = None) -> DataFrame:
    """(feature, psi) over quantile bins of the reference. Current values outside the bins are not
    counted in a bin but stay in the denominator."""
    return _per_bin(_binned(_ranks(df, cols, is_ref), bins, edge_digits)).groupBy("feature").agg(_psi())


def drift_features(
    df: DataFrame,
    cols: Sequence[str],
    is_ref: Column,
    alpha: float = 0.05,
    psi_limit: float = 0.2,
    bins: int = 10,
    edge_digits: int | None = None,
) -> DataFrame:
    """(feature, ks_statistic, p_value, wasserstein_distance, psi, is_drifted).

    All four come from one cumulative table, which is one scan of the rows. A feature without values on
    either side is skipped.
    """
    return _judged(_ranks(df, cols, is_ref), alpha, psi_limit, bins, edge_digits)


def _judged(ranks: RankTable, alpha: float, psi_limit: float, bins: int, edge_digits: int | None) -> DataFrame:
    out = (
        _per_bin(_binned(ranks, bins, edge_digits))
        .groupBy("feature")
        .agg(
            F.max("n_ref").alias("n_ref"),
            F.max("n_cur").alias("n_cur"),
            F.max("ks_statistic").alias("ks_statistic"),
            F.sum("wasserstein_distance").alias("wasserstein_distance"),
            _psi(),
        )
    )
    return _with_pvalue(out).select(
        "feature",
        "ks_statistic",
        "p_value",
        "wasserstein_distance",
        "psi",
        ((F.col("p_value") < alpha) | (F.col("psi") > psi_limit)).alias("is_drifted"),
    )


@dataclass(frozen=True)
class FittedReference:
    """Value counts of a reference, made once, against which any number of tables is judged."""

    cols: tuple[str, ...]
    splits: list[list[float]]
    ranks: RankTable

    @staticmethod
    def fit(reference: DataFrame, cols: Sequence[str]) -> FittedReference:
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        rows = reference.select(*[present(col(c)).alias(c) for c in cols])
        splits = split_points(rows, cols)
        return FittedReference(tuple(cols), splits, RankTable.build(rows, cols, {"ref": one, "cur": none}, splits=splits))

    def features(
        self, current: DataFrame, alpha: float = 0.05, psi_limit: float = 0.2, bins: int = 10, edge_digits: int | None = None
    ) -> DataFrame:
        """``drift_features`` of a table; only that table's rows are read and counted."""
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        # a feature that the table lacks has no values there, so it is skipped
        shared = [present(col(c)) if c in current.columns else F.lit(None).cast("double") for c in self.cols]
        rows = current.select(*[v.alias(c) for v, c in zip(shared, self.cols, strict=True)])
        both = self.ranks.plus(long_values(rows, self.cols, self.splits, {"ref": none, "cur": one}))
        return _judged(_with_both(both, self.cols), alpha, psi_limit, bins, edge_digits)


@dataclass(frozen=True)
class EdgeReference:
    """A reference as counts between fixed edges, against which counts from anywhere can be judged.

    The edges of a feature are quantiles of the reference, ``cells`` of them, and those of the PSI bins. Values that equal an
    edge have a cell of their own. Counts of cells add up over batches, partitions and windows, and their number depends on
    neither table's size. PSI is that of ``drift_features``; KS is taken at the cells' bounds, at most the
    share of one cell below; Wasserstein puts what lies between two edges at its mean.
    """

    cols: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    bin_edges: tuple[tuple[int, ...], ...]  # places of the PSI edges among them
    counts: DataFrame  # (f, cell, n, total) of the reference, at most 2 * edges + 1 rows a feature
    seen: tuple[int, ...]

    @staticmethod
    def fit(reference: DataFrame, cols: Sequence[str], cells: int = 500, bins: int = 10, edge_digits: int | None = None) -> EdgeReference:
        ranks = RankTable.build(reference.select(*[present(col(c)).alias(c) for c in cols]), cols, {"ref": F.lit(1).cast("bigint")})
        seen = tuple(ranks.total(c, "ref") for c in cols)
        probs = sorted({*[i / cells for i in range(cells + 1)], *[i / bins for i in range(bins + 1)]})
        found = ranks.quantiles(probs, "ref")
        edges, places = [], []
        for c in cols:
            at = dict(zip(probs, found.get(c) or [], strict=False)) if found.get(c) else {}
            psi = [at[i / bins] for i in range(bins + 1)] if at else []
            if at:
                psi = [psi[0] - EDGE, *psi[1:-1], psi[-1] + EDGE]
                psi = psi if edge_digits is None else [round(e, edge_digits) for e in psi]
            psi = [e + 0.0 for e in psi]
            own = sorted({*[e + 0.0 for e in at.values()], *psi})
            edges.append(tuple(own))
            places.append(tuple(own.index(e) for e in psi))
        bare = EdgeReference(tuple(cols), tuple(edges), tuple(places), reference, seen)
        counted = bare.cells(reference).groupBy("f", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        rows = [tuple(r) for r in counted.collect()]
        return replace(bare, counts=small_table(reference.sparkSession, rows, "f int, cell int, n bigint, total double"))

    def cells(self, rows: DataFrame, carry: Sequence[str] = (), count_rows: bool = False) -> DataFrame:
        """(f, cell, value, carried columns) of every non-missing value; a feature that the table lacks has none.

        ``count_rows`` adds one cell of the feature ``ROWS`` for each row.
        """
        # adding zero makes one of both zeros, which the bucketizer tells apart
        shared = [present(col(c)) + F.lit(0.0) if c in rows.columns else F.lit(None).cast("double") for c in self.cols]
        flat = [v.alias(f"_v{i}") for i, v in enumerate(shared)]
        wide = Bucketizer(
            splitsArray=[[-math.inf, *(e or (0.0,)), math.inf] for e in self.edges],
            inputCols=[f"_v{i}" for i in range(len(self.cols))],
            outputCols=[f"_b{i}" for i in range(len(self.cols))],
            handleInvalid="keep",
        ).transform(rows.select(*[col(c) for c in carry], *flat))
        parts = []
        for i, edges in enumerate(self.edges):
            v, upto = F.col(f"_v{i}"), F.col(f"_b{i}").cast("int")  # edges at or below the value
            on_edge = F.coalesce(F.get(F.array(*[F.lit(e) for e in edges or (0.0,)]), upto - 1) == v, F.lit(False))
            cell = 2 * upto - F.when(on_edge, 1).otherwise(0)
            parts.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("f"), cell.cast("int").alias("cell"), v.alias("value"))))
        if count_rows:
            parts.append(F.struct(F.lit(ROWS).alias("f"), F.lit(0).alias("cell"), F.lit(0.0).alias("value")))
        told = wide.select(*[col(c) for c in carry], F.explode(F.array_compact(F.array(*parts))).alias("_c"))
        return told.select("_c.*", *[col(c) for c in carry])

    def judge(
        self, current: DataFrame, by: Sequence[str] = (), alpha: float = 0.05, psi_limit: float = 0.2
    ) -> DataFrame:
        """The columns of ``drift_features``, for each group of the counts (f, cell, n, total, grouping columns)."""
        keys = [col(c) for c in by]
        one = F.lit(1).alias("_g")
        groups = current.select(*keys, one).distinct() if by else current.sparkSession.range(1).select(one)
        ref = groups.join(F.broadcast(self.counts.withColumnsRenamed({"n": "ref", "total": "sum"}).withColumn("_g", F.lit(1))), "_g")
        names = ["_g", *by, "f", "cell", "sum", "ref", "cur"]
        own = current.withColumnsRenamed({"n": "cur", "total": "sum"}).withColumns({"ref": F.lit(0).cast("bigint"), "_g": F.lit(1)})
        points = ref.withColumn("cur", F.lit(0).cast("bigint")).select(*names).unionByName(own.select(*names))
        points = points.withColumn("value", F.col("sum") / (F.col("ref") + F.col("cur")))
        group = [*keys, F.col("f")]
        run = Window.partitionBy(*group).orderBy("cell", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = Window.partitionBy(*group).orderBy("cell", "value")
        whole = Window.partitionBy(*group)
        placed = points.select(
            "*",
            F.sum("ref").over(run).alias("cum_ref"),
            F.sum("cur").over(run).alias("cum_cur"),
            F.sum("ref").over(whole).alias("all_ref"),
            F.sum("cur").over(whole).alias("all_cur"),
            F.lead("value").over(ahead).alias("next_value"),
            F.lead("cell").over(ahead).alias("next_cell"),
        ).filter((F.col("all_ref") > 0) & (F.col("all_cur") > 0))
        bins = [(i, b, 2 * lo + 1, 2 * hi + (1 if b < len(p) - 2 else 2)) for i, p in enumerate(self.bin_edges) for b, (lo, hi) in enumerate(pairwise(p))]
        table = small_table(current.sparkSession, bins, "_f int, bin int, lo int, hi int")  # ``bins`` rows a feature
        inside = (F.col("f") == F.col("_f")) & (F.col("cell") >= F.col("lo")) & (F.col("cell") < F.col("hi"))
        binned = placed.join(F.broadcast(table), inside, "left")
        last = F.coalesce(F.col("next_cell") != F.col("cell"), F.lit(True))
        per_bin = binned.groupBy(*group, "bin").agg(
            F.sum("ref").alias("ref"),
            F.sum("cur").alias("cur"),
            F.max("all_ref").alias("n_ref"),
            F.max("all_cur").alias("n_cur"),
            F.max(F.when(last, _gap())).alias("ks_statistic"),
            _wasserstein(),
        )
        out = per_bin.groupBy(*group).agg(
            F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max("ks_statistic").alias("ks_statistic"),
            F.sum("wasserstein_distance").alias("wasserstein_distance"), _psi(),
        )
        verdict = (F.col("p_value") < alpha) | (F.col("psi") > psi_limit)
        named = F.element_at(F.array(*[F.lit(c) for c in self.cols]), F.col("f") + 1).alias("feature")
        return _with_pvalue(out).select(*keys, named, "ks_statistic", "p_value", "wasserstein_distance", "psi", verdict.alias("is_drifted"))

    def features(self, current: DataFrame, alpha: float = 0.05, psi_limit: float = 0.2) -> DataFrame:
        """``drift_features`` of a whole table; only that table's rows are read."""
        counted = self.cells(current).groupBy("f", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        return self.judge(counted, (), alpha, psi_limit)


def feature_health(
    df: DataFrame,
    cols: Sequence[str],
    is_ref: Column,
    alpha: float = 0.05,
    psi_limit: float = 0.2,
    bins: int = 10,
    edge_digits: int | None = None,
) -> DataFrame:
    """``drift_features`` with the missing values of every feature, also of those that were skipped.

    What is missing is what the rank table did not count, so it costs a row count and no further scan.
    """
    n = df.count()
    ranks = _rank_table(df, cols, is_ref)
    missing = [(c, n - ranks.total(c, "ref") - ranks.total(c, "cur")) for c in cols]
    found = _judged(_with_both(ranks, cols), alpha, psi_limit, bins, edge_digits)
    table = small_table(df.sparkSession, missing, "feature string, missing bigint")
    return table.join(found, "feature", "left")


def drift_report(features: DataFrame, n_features: int, limit: float = 0.3) -> DataFrame:
    """One row: total_features (skipped ones included), drift_score, is_drifted, drifted_features."""
    score = F.count_if("is_drifted") / F.lit(float(max(1, n_features)))
    return features.agg(
        F.lit(n_features).cast("bigint").alias("total_features"),
        score.alias("drift_score"),
        (score >= limit).alias("is_drifted"),
        F.array_sort(F.collect_list(F.when(F.col("is_drifted"), F.col("feature")))).alias("drifted_features"),
    )
