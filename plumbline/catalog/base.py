"""Query registration: one Spark function and, where SQL can say it, the same as one SQL statement."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query '{name}' is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Views over the given tables. The same text is valid in Spark SQL and in DuckDB.
VIEWS: dict[str, tuple[str, str]] = {
    "feat": (
        "lineitem",
        "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, "
        "l_quantity AS f_qty, l_extendedprice AS f_price, nullif(l_discount, 0.0) AS f_disc, l_tax AS f_tax, "
        "l_returnflag AS c_flag, l_linestatus AS c_status, "
        "CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 'ref' ELSE 'cur' END AS side, "
        "CASE WHEN l_quantity + 200 * l_discount > 35 THEN 1 ELSE 0 END AS target FROM lineitem",
    ),
    "dirty": (
        "feat",
        "SELECT row_key, f_qty, CASE WHEN f_qty = 50 THEN CAST('Infinity' AS DOUBLE) "
        "WHEN f_qty = 49 THEN CAST(1000000 AS DOUBLE) ELSE f_qty END AS f_bad, "
        "CASE WHEN f_qty <= 5 THEN f_tax END AS f_sparse, c_flag, "
        "CASE WHEN f_qty = 1 THEN NULL ELSE target END AS target FROM feat",
    ),
    "scored": (
        "lineitem",
        "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, "
        "CASE WHEN l_quantity + 200 * l_discount > 35 THEN 1 ELSE 0 END AS label, "
        "round(l_quantity / 50.0, 4) AS score, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS prediction, "
        "l_extendedprice AS y_true, l_quantity * 2000.0 AS y_pred, l_returnflag AS flag, "
        "CASE WHEN l_quantity > 33 THEN 'A' WHEN l_quantity > 16 THEN 'N' ELSE 'R' END AS guess, "
        "l_tax AS s_a, l_discount AS s_n, round(l_quantity / 50.0, 4) AS s_r FROM lineitem",
    ),
    "reqlog": (
        "events",
        "SELECT event_id AS request_id, ts, value AS latency_ms, "
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'anomaly_mitigated' ELSE 'success' END AS status, "
        "concat('v', CAST(user_id % 3 AS STRING)) AS model_version, CASE WHEN value > 35 THEN 1 ELSE 0 END AS prediction, "
        "least(CAST(1 AS DOUBLE), value / CAST(400 AS DOUBLE)) AS anomaly_score FROM events",
    ),
    "truth": (
        "events",
        "SELECT event_id AS request_id, CASE WHEN value > 30 THEN 1 ELSE 0 END AS y_true FROM events "
        "WHERE event_type IN ('purchase', 'error')",
    ),
    "dmu": (
        "lineitem",
        "SELECT l_suppkey AS dmu, sum(l_quantity) / CAST(1000 AS DOUBLE) AS in_qty, "
        "CAST(count(*) AS DOUBLE) / 100 AS in_lines, "
        "sum(l_extendedprice * (1 - l_discount)) / CAST(1000000 AS DOUBLE) AS out_rev, "
        "avg(CASE WHEN l_returnflag <> 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS out_keep "
        "FROM lineitem GROUP BY l_suppkey",
    ),
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    source, text = VIEWS[name]
    below = view(spark, sf, source) if source in VIEWS else table(spark, sf, source)
    text = text.replace(f"FROM {source}", "FROM {src}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    return spark.sql(text, src=below)


def ctes(names: Sequence[str], body: str) -> str:
    """``body`` below WITH clauses for the views it uses and the views those use."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            need(VIEWS[name][0])
            order.append(name)

    for n in names:
        need(n)
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


FEATURES = ["f_qty", "f_price", "f_disc", "f_tax"]
