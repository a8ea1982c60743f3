"""Session settings, small lookup frames and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that suit a large cluster as well as one machine; partition counts stay with the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints are dropped once no DataFrame refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("bitledger")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        if "'" in value or "\\" in value:
            raise ValueError(f"lookup text must not hold quotes or backslashes: {value!r}")
        return f"'{value}'"
    return repr(value)


def lookup(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant lookup frame. Its rows are written in the code, so broadcasting it is safe."""
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})"))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where none is named, one machine uses a temporary folder; several would not share it, so
    there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and not context.getCheckpointDir() and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bitledger-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, readable by every executor.

    What is left there when the program ends is removed; results read from it are used before.
    """
    if not _SCRATCH:
        atexit.register(remove_scratch)
    _SCRATCH.append((spark, f"{shared_folder(spark)}/bitledger-{name}-{uuid.uuid4().hex}"))
    return _SCRATCH[-1][1]


def remove_scratch() -> None:
    """Deletes all scratch paths of this program; those of a stopped session are left."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        if spark.sparkContext._jsc is None:
            continue
        try:
            remove_path(spark, path)
        except Py4JError:  # the driver's JVM is gone already
            return


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``scratch_path`` gave, wherever the shared folder is."""
    if "/bitledger-" not in path:
        raise ValueError(f"not a scratch path: {path}")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
