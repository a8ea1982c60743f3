"""Telemetry summaries kept current while samples arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bitledger.operators.engine import telemetry_summary
from bitledger.sources.engine import parse_telemetry


def stream_telemetry(
    spark: SparkSession, path: str, label_pattern: str = r"([^/]+)/[^/]+$"
) -> DataFrame:
    """Telemetry lines of log files as they arrive, as ``(label, seq, line)``.

    A logger that rotates its file gives many short files, and each is read when it is
    complete. ``seq`` sorts by the file's time, files of one time by a hash of
    their path, and then by line.
    """
    millis = F.unix_millis("_metadata.file_modification_time").cast("decimal(15,0)")
    files = spark.readStream.option("wholetext", True).text(path)
    lines = files.select(
        F.regexp_extract(F.col("_metadata.file_path"), label_pattern, 1).alias("label"),
        millis.alias("millis"),
        F.crc32("_metadata.file_path").cast("decimal(10,0)").alias("file"),
        F.posexplode(F.split("value", "\r?\n")).alias("i", "line"),
    )
    within = F.col("file") * F.lit(10**9).cast("decimal(10,0)") + F.col("i").cast("decimal(10,0)")
    seq = F.col("millis") * F.lit(str(10**19)).cast("decimal(20,0)") + within
    return lines.select("label", seq.cast("decimal(38,0)").alias("seq"), "line")


def telemetry_stream_summary(lines: DataFrame) -> DataFrame:
    """The batch summary over a stream of ``(label, seq, line)``.

    The state is one row per label and the first sample is found by ``seq``, so neither a
    watermark nor ordered arrival is needed. Write it in complete mode.
    """
    return telemetry_summary(parse_telemetry(lines))


def write_summary(
    summary: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write the summary after every batch, each batch to a folder of its own under ``path``.

    A reader always finds the last complete batch (:func:`read_summary`); a crash leaves the ones
    before untouched. A restarted query goes on at its checkpoint.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = summary.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(add).start()


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of the last batch that was written."""
    batches = spark.read.parquet(path)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).scalar()).drop("batch")
