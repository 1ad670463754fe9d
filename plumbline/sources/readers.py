"""Readers for feature tables, splits, logs and experiment documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import col
from plumbline.operators.experiments import EXPERIMENT_SCHEMA
from plumbline.sources.quoted_csv import read_quoted

# The texts of a CSV field that mean a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SUPPORTED = ("csv", "json", "parquet")
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?([iI]nf(inity)?)\s*$"
_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
_BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def _open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a quoted field runs on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).agg(F.bool_or(quotes % 2 == 1)).first()[0])


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Header CSV with inferred types: whole numbers without gaps are long, other numbers double,
    True/False without gaps boolean, the rest string. Missing tokens are null.

    Inference is one aggregate over all columns and rows. Quoted fields may hold line breaks if
    ``multiline``; then a file is read by many tasks that agree on its quotes (``quoted_csv``), or by one where that can't be.
    By default one pass over the lines finds out whether that is needed. With ``multiline=False`` a line that leaves a quote open is an error.
    """
    if not multiline:
        unbalanced = _open_quotes(spark, path)
        if unbalanced and multiline is False:
            raise ValueError(f"a quoted field runs over a line break in {path}; read it with multiline")
        multiline = unbalanced
    raw = read_quoted(spark, path) if multiline else None
    if raw is None:
        raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline)
    text = raw.select(*[F.when(~col(c).isin(*MISSING_TOKENS), col(c)).alias(c) for c in raw.columns])
    checks = {"whole": _WHOLE, "number": _NUMBER}
    row = text.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"present{i}") for i, c in enumerate(raw.columns)],
        *[
            F.count_if(F.rlike(col(c), F.lit(pattern))).alias(f"{name}{i}")
            for i, c in enumerate(raw.columns)
            for name, pattern in checks.items()
        ],
        *[F.count_if(col(c).isin(*_BOOLEAN)).alias(f"boolean{i}") for i, c in enumerate(raw.columns)],
    ).first()

    def typed(i: int, c: str) -> Column:
        present, full = row[f"present{i}"], row[f"present{i}"] == row["n"]
        if present == 0:
            return F.lit(None).cast("double")
        if row[f"whole{i}"] == present:
            return F.trim(col(c)).try_cast("bigint" if full else "double")
        if row[f"number{i}"] == present:
            return F.trim(col(c)).try_cast("double")
        if row[f"boolean{i}"] == present and full:
            return F.lower(col(c)).try_cast("boolean")
        return col(c)

    return text.select(*[typed(i, c).alias(c) for i, c in enumerate(raw.columns)])


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON records, one per line or (``multiline``) one array per file."""
    return spark.read.option("multiLine", str(multiline).lower()).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Read by file extension. An unknown extension or a missing file is an error."""
    ext = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ext not in SUPPORTED:
        raise ValueError(f"unsupported file format '{ext}'; supported formats: {', '.join(SUPPORTED)}")
    if not exists(spark, path):
        raise FileNotFoundError(f"dataset file not found: {path}")
    return {"csv": read_csv, "json": read_json, "parquet": read_parquet}[ext](spark, path, **options)


def read_splits(spark: SparkSession, path: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Rows of the wanted splits; the others' folders are not read."""
    return spark.read.parquet(path).filter(F.col("split").isin(*splits))


def read_experiments(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Experiment documents with the file's modification time; an unreadable document is skipped."""
    schema = f"{EXPERIMENT_SCHEMA}, _broken string"
    docs = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .option("multiLine", str(multiline).lower())
        .json(path)
    )
    return (
        docs.withColumn("modified", F.col("_metadata.file_modification_time"))
        .filter(F.col("experiment_id").isNotNull() & F.col("_broken").isNull())
        .drop("_broken")
    )


def read_experiment(docs: DataFrame, experiment_id: str) -> DataFrame:
    """One document by id, or the newest for ``latest``."""
    if experiment_id != "latest":
        return docs.filter(F.col("experiment_id") == experiment_id)
    return docs.orderBy(F.desc("created_at"), F.desc("experiment_id")).limit(1)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """The stored manifest (file, sha256)."""
    return spark.read.schema("file string, sha256 string").parquet(path)


def event_stream(spark: SparkSession, path: str, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, file or folder, as a stream with its event time as a session-zone timestamp.

    The last path element is written as a glob, so that a single file is a valid source too.
    """
    head, _, last = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(f"{head}/[{last[0]}]{last[1:]}")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts in stream.columns else stream
