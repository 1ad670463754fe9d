"""Session defaults and the shared scratch folder used for reliable intermediate tables."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Found = TypeVar("Found")


def local_session(
    cpus: int | str = "*", app: str = "plumbline", memory: str = "8g", folder: str | None = None
) -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own.

    ``folder`` takes the intermediate tables, if the configuration names none.
    """
    cores = 8 if cpus == "*" else int(cpus)
    builder = SparkSession.builder if folder is None else SparkSession.builder.config("spark.checkpoint.dir", folder)
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir`` or set as the context's checkpoint folder.

    Without either, a session whose only machine is this one gets a folder of its own; a cluster could not
    see it, so there it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = os.path.join(tempfile.gettempdir(), f"plumbline-{context.applicationId}")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the scratch tables that were written inside it.

    For callers that finish their result within the scope, such as one micro-batch of an endless stream.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for p in paths:
            remove(spark, p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The copy survives lost executors, and later jobs over it do not repeat the work above it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`materialise` gave, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def at_once(spark: SparkSession, calls: Sequence[Callable[[], Found]], most: int) -> list[Found]:
    """What the calls return, in their order; up to ``most`` of them run at a time, so that the jobs of one use the cores that
    the short jobs of another leave idle. The first call that fails raises its error here, after all have ended."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, most)) as pool:
        running = [pool.submit(contextvars.copy_context().run, inherit(c)) for c in calls]
    return [r.result() for r in running]


def small_table(spark: SparkSession, rows: Iterable[Sequence[object]], schema: str | T.StructType) -> DataFrame:
    """A table of a few driver-held rows (fitted numbers, targets) that is part of the plan itself."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows, strict=True)) or [()] * len(struct)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)
