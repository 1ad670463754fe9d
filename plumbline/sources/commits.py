"""Numbered commits to a folder: each number is taken once, whoever else writes at the same time."""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections.abc import Callable, Mapping
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBERED = re.compile(r"(\d{10})\.json")


def _name(number: int) -> str:
    return f"{number:010d}.json"


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return (unquote(parts.path) if parts.scheme else folder) if parts.scheme in ("", "file") else None


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Writes a file unless there is one of this name; False if there is. Readers see the file whole or not at all.

    On a file system of this machine the finished file is linked to its name, which fails if the name is taken. Elsewhere
    the store's own exclusive creation decides.
    """
    if (own := _local(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        draft = f"{os.path.dirname(own)}/.{uuid.uuid4().hex}"
        with open(draft, "xb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, own)
        except FileExistsError:
            return False
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(draft)
        return True
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = system.create(where, False)
    except Py4JJavaError as why:
        if "AlreadyExists" in str(why.java_exception.getClass().getName()) or system.exists(where):
            return False
        raise
    out.write(content)
    out.close()
    return True


def last_number(spark: SparkSession, folder: str) -> int:
    """The highest number in the folder, 0 if there is none."""
    if (own := _local(folder)) is not None:
        names = os.listdir(own) if os.path.isdir(own) else []
    else:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return max((int(m[1]) for n in names if (m := _NUMBERED.fullmatch(n))), default=0)


def commit(spark: SparkSession, folder: str, record: Callable[[int], Mapping[str, object]]) -> int:
    """Stores ``record(number)`` as one line of JSON under the next free number, which it returns.

    Whoever comes second to a number tries the next one, so two writers never get the same, and none is left out.
    """
    number = last_number(spark, folder) + 1
    while not put_if_absent(spark, f"{folder.rstrip('/')}/{_name(number)}", (json.dumps(record(number)) + "\n").encode()):
        number += 1
    return number


def commit_experiment(document: DataFrame, path: str) -> str:
    """Gives the one document of the table the next version and stores it; returns the version.

    The version is claimed below ``path``/_versions first, so that writers at the same time get different ones. A document
    that fails to be written leaves its version unused.
    """
    spark = document.sparkSession
    key = document.first()["experiment_id"]
    version = f"v{commit(spark, f'{path.rstrip('/')}/_versions', lambda n: {'model_version': f'v{n}', 'experiment_id': key})}"
    numbered = document.withColumn("model_version", F.lit(version))
    if "deployment" in document.columns:
        numbered = numbered.withColumn("deployment", F.col("deployment").withField("model_version", F.lit(version)))
    numbered.write.mode("append").json(path)
    return version


EVENTS = "model string, version int, stage string, event_time timestamp, event_id bigint"


def commit_transition(spark: SparkSession, folder: str, model: str, version: int, stage: str, event_time: str) -> int:
    """Adds a stage transition to a registry's events; its number orders events of the same time."""
    return commit(spark, folder, lambda n: {"model": model, "version": version, "stage": stage, "event_time": event_time, "event_id": n})


def register_version(spark: SparkSession, folder: str, model: str, event_time: str) -> int:
    """Takes the next version number of a model, and adds its first event, with the stage ``None``."""
    names = re.sub(r"[^A-Za-z0-9_.-]", lambda m: f"%{ord(m[0]):x}", model)
    version = commit(spark, f"{folder.rstrip('/')}/_models/{names}", lambda n: {"model": model, "version": n})
    commit_transition(spark, folder, model, version, "None", event_time)
    return version


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The registry's events, for ``experiments.registry_current``."""
    return spark.read.schema(EVENTS).json(folder)
