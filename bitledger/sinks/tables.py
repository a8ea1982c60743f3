"""Result tables to CSV and JSON. Every sink writes in parallel, one file per task."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_results_csv(df: DataFrame, path: str) -> None:
    """Rewrite a result table as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_summary_csv(df: DataFrame, path: str) -> None:
    """Add rows to a CSV table. Each file carries the header, so all read back as one table."""
    df.write.mode("append").option("header", True).csv(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(place, name)


def append_once(df: DataFrame, path: str, run: str) -> bool:
    """Add the rows of a run to a CSV table, once however often the run is repeated.

    Rows are staged in a folder of this attempt, which no reader looks at; then a record with
    the run's name is written that names the folder. So a crash before the record adds nothing,
    and a repeated run adds nothing and says so by ``False``. Of two attempts at the same time
    the record names one, and the other's folder stays unread.
    """
    store, place = _file_system(df.sparkSession, path)
    record = place(f"_runs/{hashlib.sha256(run.encode()).hexdigest()}")

    def recorded() -> bool:
        # A crash between creating and writing leaves an empty record, which is none.
        return store.exists(record) and store.getFileStatus(record).getLen() > 0

    if recorded():
        return False
    attempt = f"_staged/{uuid.uuid4().hex}"
    df.write.option("header", True).csv(f"{path.rstrip('/')}/{attempt}")
    if recorded():
        store.delete(place(attempt), True)
        return False
    store.delete(record, False)
    out = store.create(record, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    return True


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the runs that :func:`append_once` has recorded; none where nothing is there."""
    store, place = _file_system(spark, path)
    if not store.exists(place("_runs")):
        return spark.createDataFrame([], schema)
    # One line a run: as many as there were appends.
    records = [f"{path.rstrip('/')}/_runs/{f.getPath().getName()}" for f in store.listStatus(place("_runs")) if f.getLen()]
    if not records:
        return spark.createDataFrame([], schema)
    attempts = [row.value for row in spark.read.text(records).collect()]
    return spark.read.schema(schema).option("header", True).csv([f"{path.rstrip('/')}/{a}" for a in attempts])


def write_results_json(df: DataFrame, path: str) -> None:
    """All rows as JSON, one object per line; null fields are written out.

    Names repeat in every line, so the files are written by gzip; readers see that by their names.
    """
    df.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip").json(path)


def ordered_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns in order: unknown ones are dropped, absent ones are null."""
    have = set(df.columns)
    return df.select(
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    )


def write_table_csv(df: DataFrame, columns: list[str], path: str, one_file: bool = False) -> None:
    """A report table with fixed column order; ``one_file`` is for tables of a few rows."""
    table = ordered_columns(df, columns)
    write_results_csv(table.coalesce(1) if one_file else table, path)
