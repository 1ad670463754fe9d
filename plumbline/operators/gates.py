"""Pass/fail gates: label and feature integrity, robustness, file checksums, findings, roll-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import any_of, clip, col, js_term, order_hash, present
from plumbline.operators.prep import continuous_columns, numeric_columns
from plumbline.session import materialise
from plumbline.sources import digests, readers, writers

# The fields of a gate record. The gates' names and detail keys below are fixed as well,
# since stored records are read by them.
GATE_COLUMNS = ("gate", "passed", "score", "details", "error")


def gate_row(
    one: DataFrame, gate: str, passed: Column, score: Column, details: Mapping[str, Column], error: Column | None = None
) -> DataFrame:
    """One gate record: gate, passed, score, details (string map), error."""
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return one.select(
        F.lit(gate).alias("gate"),
        passed.cast("boolean").alias("passed"),
        score.cast("double").alias("score"),
        F.create_map(*pairs).alias("details"),
        (error if error is not None else F.lit(None)).cast("string").alias("error"),
    )


# --------------------------------------------------------------------------- integrity


def label_shares(df: DataFrame, label: str, is_ref: Column) -> DataFrame:
    """(class, n_ref, n_cur); a class that one side lacks has 0 there."""
    return df.groupBy(col(label).alias("class")).agg(
        F.count_if(is_ref).alias("n_ref"), F.count_if(~is_ref).alias("n_cur")
    )


def _js(cells: DataFrame, eps_n: float) -> DataFrame:
    """One row (js_divergence, n_ref, n_cur) from counted cells."""
    totals = cells.agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur")).withColumn("_j", F.lit(1))
    shares = cells.withColumn("_j", F.lit(1)).join(F.broadcast(totals), "_j")  # one row on the right
    p = F.try_divide(F.col("n_ref"), F.col("t_ref") + eps_n)
    q = F.try_divide(F.col("n_cur"), F.col("t_cur") + eps_n)
    return shares.agg(
        clip(F.sum(js_term(p, q)), 0.0, 1.0).alias("js_divergence"),
        F.max("t_ref").alias("n_ref"),
        F.max("t_cur").alias("n_cur"),
    )


def label_js_divergence(df: DataFrame, label: str, is_ref: Column) -> DataFrame:
    """One row (js_divergence, n_ref, n_cur) over class shares; the sides may have different classes."""
    return _js(label_shares(df.filter(col(label).isNotNull()), label, is_ref), 0.0)


def equal_width_bins(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of equal width over [low, high], the last one closed; +-0.5 where low = high."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1


def value_js_divergence(df: DataFrame, value: str, is_ref: Column, bins: int = 20) -> DataFrame:
    """The same over equal-width bins of the joint range, for a continuous value."""
    v = present(col(value))
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        raise ValueError(f"column '{value}' has no values")
    cells = (
        df.filter(v.isNotNull())
        .groupBy(equal_width_bins(v, lo, hi, bins).alias("bin"))
        .agg(F.count_if(is_ref).alias("n_ref"), F.count_if(~is_ref).alias("n_cur"))
    )
    return _js(cells, 1e-10)


def zscore_anomaly_rate(
    df: DataFrame, cols: Sequence[str], is_ref: Column, limit: float = 5.0
) -> DataFrame:
    """One row (n, anomalies, anomaly_rate): current rows with any |x - mean| / (std + 1e-10) above the
    limit; mean and population std are those of the reference rows."""
    stats = reference_moments(df, cols, is_ref)
    far = any_of(
        [
            F.coalesce(F.abs((present(col(c)) - F.lit(m)) / F.lit(s + 1e-10)) > limit, F.lit(False))
            for c, (m, s) in stats.items()
        ]
    )
    return df.filter(~is_ref).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(far).alias("anomalies"),
        F.coalesce(F.avg(far.cast("double")), F.lit(0.0)).alias("anomaly_rate"),
    )


def reference_moments(df: DataFrame, cols: Sequence[str], is_ref: Column) -> dict[str, tuple[float, float]]:
    row = (
        df.filter(is_ref)
        .agg(
            *[F.avg(present(col(c))).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(present(col(c))).alias(f"s{i}") for i, c in enumerate(cols)],
        )
        .first()
    )
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols) if row[f"m{i}"] is not None}


def label_is_continuous(df: DataFrame, label: str) -> bool:
    """Whether a label is a measured number: numeric, and with many values or with fractions."""
    if label not in numeric_columns(df, [label]):
        return False
    return any(continuous_columns(df, [label])[label])


def data_integrity_gate(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    is_ref: Column,
    threshold: float = 0.05,
    continuous: bool | None = None,
) -> DataFrame:
    """Gate row: divergence <= threshold and anomaly rate <= 2 * threshold; score 1 - divergence - rate / 2.

    Whether the label is compared by classes or by value bins is found from the data, unless given.
    """
    continuous = label_is_continuous(df, label) if continuous is None else continuous
    js = value_js_divergence(df, label, is_ref) if continuous else label_js_divergence(df, label, is_ref)
    rate = zscore_anomaly_rate(df, cols, is_ref)
    # one row on each side
    one = js.withColumn("_j", F.lit(1)).join(F.broadcast(rate.withColumn("_j", F.lit(1))), "_j")
    d, r = F.col("js_divergence"), F.col("anomaly_rate")
    return gate_row(
        one,
        "data_integrity",
        (d <= threshold) & (r <= 2 * threshold),
        clip(1.0 - d - 0.5 * r, 0.0, 1.0),
        {"js_divergence": d, "feature_anomaly_rate": r, "threshold": F.lit(threshold)},
    )


# --------------------------------------------------------------------------- robustness


def first_by_hash(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A sample of ``n`` rows: the first in hash order.

    Rows whose hash cannot be among the first ``n`` are filtered out before the top-n, so that its
    input does not grow with the table. If the filter leaves too few, the whole table is used.
    """
    total = df.count()
    tagged = df.withColumn("_h", order_hash(keys, seed))
    if total > 64 * n:
        bar = f"{int(16**8 * (4.0 * n / total)):08x}"
        near = tagged.filter(F.left("_h", F.lit(8)) <= F.lit(bar))
        if near.limit(n).count() >= n:
            tagged = near
    return tagged.orderBy("_h", *keys).limit(n).drop("_h")


def model_score(scored: DataFrame, regression: bool) -> Column:
    """The number whose direction of change is probed: raw margin, else probability of class 1."""
    if regression:
        return F.col("prediction")
    if "rawPrediction" in scored.columns:
        raw = vector_to_array(F.col("rawPrediction"))
        return F.when(F.size(raw) == 2, raw[1] - raw[0])
    return vector_to_array(F.col("probability"))[1]


def adversarial_gate(
    df: DataFrame,
    model: Transformer,
    cols: Sequence[str],
    label: str,
    keys: Sequence[str],
    epsilon: float = 0.1,
    delta: float = 1e-4,
    n: int | None = None,
    min_score: float = 0.70,
    regression: bool | None = None,
    seed: int = 42,
    vector: str = "features",
) -> DataFrame:
    """Gate row: accuracy after moving each feature by epsilon in the direction that changes the score.

    All rows are judged, or the first ``n`` in hash order. Each becomes one row per feature plus itself,
    all scored in one pass, and a second pass scores the moved rows. For regression, which is found from
    the label unless given, the score is 1 - mean shift / prediction range. Where the model gives no
    score (more than two classes) the direction is a hash bit.
    """
    d = len(cols)
    regression = label_is_continuous(df, label) if regression is None else regression
    rows = df.select(*keys, label, *cols)
    sample = rows if n is None else first_by_hash(rows, keys, n, seed)
    base = sample.select(
        *[col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        col(label).cast("double").alias("y"),
        F.array(*[col(c).cast("double") for c in cols]).alias("x"),
    )
    ids = [f"k{i}" for i in range(len(keys))]

    def assemble(table: DataFrame) -> DataFrame:
        wide = table.select("*", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
        return VectorAssembler(inputCols=[f"x{i}" for i in range(d)], outputCol=vector).transform(wide)

    variants = base.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumn(
        "x", F.transform("x", lambda a, i: F.when(F.col("v") == i + 1, a + delta).otherwise(a))
    )
    scored = model.transform(assemble(variants))
    probed = (
        scored.withColumn("s", model_score(scored, regression))
        .groupBy(*ids)
        .agg(
            F.max("y").alias("y"),
            F.max_by("x", -F.col("v")).alias("x"),
            F.max(F.when(F.col("v") == 0, F.col("prediction"))).alias("clean"),
            F.max(F.when(F.col("v") == 0, F.col("s"))).alias("s0"),
            F.map_from_entries(F.collect_list(F.struct("v", "s"))).alias("s"),
        )
    )
    bit = F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))

    def direction(i: Column) -> Column:
        random = F.when(F.substr(bit, i % 32 + 1, F.lit(1)) < "8", -1.0).otherwise(1.0)
        return F.when(F.col("s0").isNull(), random).otherwise(F.signum(F.col("s")[i + 1] - F.col("s0")))

    moved = probed.withColumn("g", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), direction)).withColumn(
        "x", F.zip_with("x", "g", lambda a, g: a + epsilon * g)
    )
    final = model.transform(assemble(moved.select(*ids, "y", "clean", "x", "g")))
    flat = F.size(F.filter("g", lambda g: g == 0.0))
    one = final.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"),
        F.avg((F.col("clean") == F.col("y")).cast("double")).alias("clean_accuracy"),
        (F.avg(F.abs(F.col("prediction") - F.col("clean"))) / (F.max("clean") - F.min("clean") + 1e-10)).alias("shift"),
        F.avg(flat / F.lit(float(d))).alias("flat_share"),
    )
    score = F.greatest(F.lit(0.0), 1.0 - F.col("shift")) if regression else F.col("accuracy")
    return gate_row(
        one,
        "adversarial_robustness",
        score >= min_score,
        score,
        {
            "epsilon": F.lit(epsilon),
            "n_samples": F.col("n"),
            "adv_accuracy": score,
            "clean_accuracy": F.col("clean_accuracy"),
            "flat_share": F.col("flat_share"),
            "min_required": F.lit(min_score),
        },
    )


# --------------------------------------------------------------------------- checksums


def checksum_scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, file, name, bytes, sha256), one row per file below ``path``, ``file`` relative to it.

    Files are read in pieces by a Python data source, so that neither their size nor their number meets a limit; an empty file has
    the digest of nothing. Folders in a store that only Spark can open are read by its binary reader, which leaves out
    empty files and files above 2 GB fail there.
    """
    try:
        digests.open_store(path)
    except ValueError:
        return _binary_scan(spark, path, pattern)
    spark.dataSource.register(digests.DigestSource)
    reader = spark.read.format("file_digests").option("tasks", spark.conf.get("spark.sql.shuffle.partitions"))
    return (reader.option("pattern", pattern) if pattern else reader).load(path)


def _binary_scan(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.resolvePath(where).toUri().getPath().rstrip("/")
    inside = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    file = F.when(F.startswith(inside, F.lit(f"{root}/")), F.substr(inside, F.lit(len(root) + 2))).otherwise(inside)
    return reader.load(path).select(
        "path",
        file.alias("file"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def checksum_compare(found: DataFrame, manifest: DataFrame, on: str = "file") -> DataFrame:
    """(file, sha256, expected, status): matched, changed, missing or new.

    Files are told apart by their path below the root, as one name may stand in several folders.
    """
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("expected").isNull(), "new")
        .when(F.col("sha256") == F.col("expected"), "matched")
        .otherwise("changed")
    )
    expected = manifest.select(on, F.col("sha256").alias("expected"))
    return found.select(on, "sha256").join(expected, on, "full_outer").withColumn("status", status)


def verify_files(spark: SparkSession, path: str, manifest: str, pattern: str | None = None) -> DataFrame:
    """Judge the files below ``path`` by the manifest stored at ``manifest``, and store the new ones in it.

    The first call, without a manifest, stores all files. A changed or missing file keeps its stored
    checksum, so it is found again by the next call.
    """
    found = materialise(checksum_scan(spark, path, pattern).select("file", "sha256"), "checksums")
    known = readers.read_checksums(spark, manifest) if readers.exists(spark, manifest) else found.limit(0)
    compared = materialise(checksum_compare(found, known), "checksums")
    if not compared.filter("status = 'new'").isEmpty():
        writers.write_checksums(compared.select("file", F.coalesce("expected", "sha256").alias("sha256")), manifest)
    return checksum_gate(compared)


def checksum_gate(compared: DataFrame) -> DataFrame:
    """Gate row: no file changed or missing; a new file is not judged."""
    bad = F.count_if(F.col("status").isin("changed", "missing"))
    one = compared.agg(
        bad.alias("bad"), *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "changed", "missing", "new")]
    )
    return gate_row(
        one,
        "model_integrity",
        F.col("bad") == 0,
        F.when(F.col("bad") == 0, 1.0).otherwise(0.0),
        {s: F.col(s) for s in ("matched", "changed", "missing", "new")},
        F.when(F.col("missing") > 0, "file not found"),
    )


# --------------------------------------------------------------------------- findings

# Credential patterns searched in text, with their severity.
SECRET_PATTERNS = (
    ("hex_token", "HIGH", r'token = "([0-9a-f]{40})"'),
    ("cloud_key", "HIGH", r"(AKIA[0-9A-Z]{16})"),
    ("private_key", "HIGH", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    ("password", "MEDIUM", r"""[Pp]assword = ["']([^"']+)["']"""),
)


def secret_findings(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, rule, severity, secret), one row per hit in the whole text.

    Texts without any hit are dropped by one match of all patterns before the hits are extracted.
    """
    t = col(text)
    per_rule = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(severity).alias("severity"),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("secrets"),
        )
        for rule, severity, pattern in SECRET_PATTERNS
    ]
    candidate = F.rlike(t, F.lit("|".join(f"(?:{p})" for _, _, p in SECRET_PATTERNS)))
    kept = [col(k) for k in keys]
    hits = df.filter(candidate).select(*kept, F.explode(F.array(*per_rule)).alias("h"))
    return hits.select(*kept, "h.rule", "h.severity", F.explode("h.secrets").alias("secret"))


def top_findings(findings: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` HIGH findings."""
    return findings.filter("severity = 'HIGH'").orderBy(*order).limit(n)


def secrets_scan(findings: DataFrame) -> DataFrame:
    """Gate row: no HIGH finding; score 1 - 0.2 high - 0.05 medium."""
    one = findings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium"),
    )
    high, medium = F.col("high"), F.col("medium")
    return gate_row(
        one,
        "secrets_scan",
        high == 0,
        clip(1.0 - 0.2 * high - 0.05 * medium, 0.0, 1.0),
        {"high_severity": high, "medium_severity": medium, "total_issues": F.col("total")},
    )


def findings_gate(
    findings: DataFrame, severity: str = "severity", max_critical: int = 0, max_high: int = 2
) -> DataFrame:
    """Gate row over a findings table: critical and high counts within limits; score 1 - 0.5 c - 0.1 h."""
    one = findings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.upper(col(severity)) == "CRITICAL").alias("critical"),
        F.count_if(F.upper(col(severity)) == "HIGH").alias("high"),
    )
    c, h = F.col("critical"), F.col("high")
    return gate_row(
        one,
        "dependency_audit",
        (c <= max_critical) & (h <= max_high),
        clip(1.0 - 0.5 * c - 0.1 * h, 0.0, 1.0),
        {
            "total_vulnerabilities": F.col("total"),
            "critical": c,
            "high": h,
            "max_critical_allowed": F.lit(max_critical),
            "max_high_allowed": F.lit(max_high),
        },
    )


def run_gates(gates: Sequence[DataFrame]) -> DataFrame:
    """The gate rows of the enabled gates as one table."""
    return reduce(lambda a, b: a.unionByName(b), [g.select(*GATE_COLUMNS) for g in gates])


def gate_rollup(gates: DataFrame) -> DataFrame:
    """One row: gates, passed, overall_passed, mean score (a missing score counts as 0)."""
    n = F.count(F.lit(1))
    return gates.agg(
        n.alias("gates"),
        F.count_if("passed").alias("passed"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("overall_passed"),
        F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("overall_score"),
    )

