"""Engine benchmark JSON and device telemetry logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.schemas import ENGINE_TESTS


def parse_engine_bench(df_json: DataFrame, json_col: str = "json") -> DataFrame:
    """Unfold engine output (a JSON array of tests per row) in array order.

    Other columns are kept; ``pos`` numbers the tests of one array.
    """
    kept = [c for c in df_json.columns if c != json_col]
    tests = df_json.select(
        *kept, F.posexplode(F.from_json(json_col, ENGINE_TESTS)).alias("pos", "t")
    )
    return tests.select(*kept, "pos", "t.*")


def read_engine_bench(tests: DataFrame) -> DataFrame:
    """One row per label and test name: the last values under the name, at its first position.

    The name is the first non-empty one of ``test_name``, ``test`` and ``n_prompt``, else
    ``?``. A name taken from ``n_prompt`` is a number and never equals a text name. ``pos``
    numbers the tests of a label. All picks are hash aggregates over numbers, which combine
    before the shuffle and need no sort.
    """
    columns = set(tests.columns)
    text_names = [
        F.nullif(F.col(c), F.lit("")) for c in ("test_name", "test") if c in columns
    ]
    text_name = F.coalesce(*text_names, F.lit(None).cast("string"))
    number_name = F.nullif(F.col("n_prompt"), F.lit(0))
    defaults = {"avg_ts": 0.0, "stddev_ts": 0.0, "n_prompt": 0, "n_gen": 0}
    return (
        tests.select(
            "label",
            F.coalesce(text_name, number_name.cast("string"), F.lit("?")).alias("name"),
            (text_name.isNull() & number_name.isNotNull()).alias("name_is_number"),
            "pos",
            *[F.coalesce(c, F.lit(default)).alias(c) for c, default in defaults.items()],
        )
        .groupBy("label", "name", "name_is_number")
        .agg(
            F.min("pos").alias("first_pos"),
            *[F.max_by(c, "pos").alias(c) for c in defaults],
        )
    )


def read_telemetry(
    spark: SparkSession, path: str | list[str], label_pattern: str = r"([^/]+)/[^/]+$"
) -> DataFrame:
    """Telemetry logs as ``(label, seq, line)``; the label is read from the file's path.

    ``seq`` sorts the lines of a file: offset of the block, then row within it, in one number
    because numbers aggregate by hash. Long logs are read in blocks and never as one value.
    """
    block = F.col("_metadata.file_block_start").cast("decimal(16,0)")
    row = F.monotonically_increasing_id().cast("decimal(20,0)")
    return spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), label_pattern, 1).alias("label"),
        (block * F.lit(str(10**20)).cast("decimal(21,0)") + row).cast("decimal(38,0)").alias("seq"),
        F.col("value").alias("line"),
    )


def parse_telemetry(lines: DataFrame) -> DataFrame:
    """Power, memory and GPU load of each line; a reading that a line lacks is null."""

    def reading(pattern: str):
        return F.regexp_extract("line", pattern, 1).try_cast("int")

    return lines.select(
        "label",
        "seq",
        reading(fixed.POWER_PATTERN).alias("power_mw"),
        reading(fixed.RAM_PATTERN).alias("ram_mb"),
        reading(fixed.GPU_PATTERN).alias("gpu_pct"),
    )
