"""Task-accuracy tables from result files in long form.

Metric rows are ``(label, part, file_name, file_mtime, task, metric_key, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import metric_key_parts, round_half_up
from bitledger.session import lookup

FILE_KEYS = ["label", "part", "file_mtime", "file_name"]


def method_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(fixed.METHOD_ROWS)]
    return lookup(spark, ["ord", "label", "method", "bits"], rows)


def scheme_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, s, fixed.SCHEME_ENGINE) for i, s in enumerate(fixed.SCHEME_ROWS)]
    return lookup(spark, ["ord", "label", "engine"], rows)


def with_method_bits(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Readable method and bit width of a label."""
    return df.join(dim.select("label", "method", "bits"), "label", "left")


def with_expected(df: DataFrame, dim: DataFrame, key: str = "label") -> DataFrame:
    """Every expected label once, with its results where there are any and nulls elsewhere."""
    return dim.join(df, key, "left")


def latest_result_file(files: DataFrame) -> DataFrame:
    """The newest file of each (label, part); with equal times the name without suffix wins.

    Takes one row per file or many: rows are reduced to distinct files by hash first, so a
    label with most of the rows does not matter and only file names are compared.
    ``file_mtime`` is a timestamp or a number.
    """
    name = F.col("file_name")
    mtime = F.col("file_mtime")
    if files.schema["file_mtime"].dataType.typeName() == "timestamp":
        age = -F.unix_micros(mtime)
    else:
        age = -mtime
    has_suffix = name.rlike(f"_({'|'.join(fixed.PARTS)})_[^/]*$")
    newest = F.min_by(F.struct("file_name", "file_mtime"), F.struct(age, has_suffix, name))
    return (
        files.select(*FILE_KEYS)
        .distinct()
        .groupBy("label", "part")
        .agg(newest.alias("newest"))
        .select("label", "part", "newest.file_name", "newest.file_mtime")
    )


def part_order(part: Column) -> Column:
    names = F.array(*[F.lit(p) for p in fixed.PARTS])
    return F.array_position(names, part)


def merge_parts(metrics: DataFrame) -> DataFrame:
    """Merge the parts of a label: a later part's rows of a task replace all earlier ones."""
    ranked = metrics.withColumn("_order", part_order(F.col("part")))
    last = ranked.groupBy("label", "task").agg(F.max("_order").alias("_order"))
    return ranked.join(last, ["label", "task", "_order"]).drop("_order")


def metric_candidates(spark: SparkSession) -> DataFrame:
    """Wanted metric keys and the keys of their standard errors: (task, metric_key, rank, role)."""
    rows = []
    for task, keys in fixed.TASK_METRICS:
        for rank, key in enumerate(keys):
            base, _, name = key.partition(",")
            rows.append((task, key, rank, "value"))
            rows.append((task, f"{base}_stderr,{name}", rank, "stderr"))
    return lookup(spark, ["task", "metric_key", "rank", "role"], rows)


_N_RANKS = max(len(keys) for _, keys in fixed.TASK_METRICS)
_STDERRS = [f"_stderr_{r}" for r in range(_N_RANKS)]


def _first_present(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best rank of a present value key, its value, and the standard error at each rank."""
    value_rank = F.when(F.col("role") == "value", F.col("rank"))
    at_rank = [(F.col("role") == "stderr") & (F.col("rank") == r) for r in range(_N_RANKS)]
    return rows.groupBy(*keys).agg(
        F.min(value_rank).alias("rank"),
        F.min_by("value", value_rank).alias("value"),
        *[F.max(F.when(hit, F.col("value"))).alias(c) for hit, c in zip(at_rank, _STDERRS)],
    )


def _stderr_at_rank() -> Column:
    return F.coalesce(*[F.when(F.col("rank") == r, F.col(c)) for r, c in enumerate(_STDERRS)])


def pick_task_metric(metrics: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Per label and task the first candidate key that is present, and its standard error.

    Presence decides, so a key with a null value still wins over the next key. One
    aggregate over the rows of candidate keys.
    """
    candidates = candidates or metric_candidates(metrics.sparkSession)
    picked = _first_present(metrics.join(candidates, ["task", "metric_key"]), ["label", "task"])
    keys = candidates.where(F.col("role") == "value").drop("role")
    return picked.join(keys, ["task", "rank"]).select(
        "label", "task", "metric_key", "value", _stderr_at_rank().alias("stderr")
    )


def merge_and_pick(metrics: DataFrame) -> DataFrame:
    """:func:`merge_parts` and :func:`pick_task_metric` in one pass over the rows.

    Metrics are picked within each part, and the last part that has the task at all decides,
    even if it holds none of the wanted keys.
    """
    rows = metrics.withColumn("_order", part_order(F.col("part"))).join(
        metric_candidates(metrics.sparkSession), ["task", "metric_key"], "left"
    )
    per_part = _first_present(rows, ["label", "task", "_order"])
    last = [F.max_by(c, "_order").alias(c) for c in ["rank", "value", *_STDERRS]]
    merged = per_part.groupBy("label", "task").agg(*last)
    return merged.where(F.col("rank").isNotNull()).select(
        "label", "task", "value", _stderr_at_rank().alias("stderr")
    )


def with_stderr_rows(metrics: DataFrame) -> DataFrame:
    """Turn rows that carry value and ``stderr`` side by side into one row per metric key."""
    key = metric_key_parts(F.col("metric_key"))["stderr_key"]
    pairs = F.array(
        F.struct(F.col("metric_key"), F.col("value")),
        F.struct(key.alias("metric_key"), F.col("stderr").alias("value")),
    )
    kept = [c for c in metrics.columns if c not in {"metric_key", "value", "stderr"}]
    return metrics.select(*kept, F.inline(pairs))


def delta_vs_baseline(
    df: DataFrame, label_col: str, baseline: str, value_col: str, out_col: str = "delta"
) -> DataFrame:
    """Difference to the baseline row in percentage points, 2 digits.

    The baseline is a scalar subquery over rounded values: null, not "no rows", when the
    baseline is missing.
    """
    base = df.agg(F.max(F.when(F.col(label_col) == baseline, F.col(value_col)))).scalar()
    return df.withColumn(out_col, _points(F.col(value_col), base))


def _points(value: Column, base: Column) -> Column:
    return round_half_up((value - base) * 100.0, 2)


def accuracy_table(
    metrics: DataFrame,
    expected: DataFrame,
    labels: list[str],
    baseline: str,
    delta_col: str,
    model: str = fixed.ACCURACY_MODEL,
) -> DataFrame:
    """One row per expected label: scores, average, completeness, audit columns, delta.

    Only the newest file of each expected label and part counts. There are at most
    ``labels x parts`` such files, so their names are broadcast to the metric rows.
    """
    tasks = fixed.TASKS
    wanted = metrics.where(F.col("label").isin(labels) & F.col("part").isin(fixed.PARTS))
    newest = latest_result_file(wanted)
    rows = wanted.join(F.broadcast(newest), FILE_KEYS)
    picked = merge_and_pick(rows.where(F.col("task").isNotNull()))
    scores = picked.groupBy("label").agg(
        *[F.max(F.when(F.col("task") == t, F.col("value"))).alias(f"_{t}") for t in tasks],
        *[F.max(F.when(F.col("task") == t, F.col("stderr"))).alias(f"_{t}_se") for t in tasks],
    )
    audit = newest.groupBy("label").agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("part") == part, F.col("file_name"))), F.lit("MISSING")
            ).alias(column)
            for part, column in fixed.PART_AUDIT_COLUMNS.items()
        ]
    )
    table = with_expected(audit.join(scores, "label", "left"), expected)
    found = F.col(fixed.PART_AUDIT_COLUMNS["likelihood"]).isNotNull()
    n_present = sum(
        (F.when(F.col(f"_{t}").isNotNull(), 1).otherwise(0) for t in tasks), F.lit(0)
    )
    total = sum((F.coalesce(f"_{t}", F.lit(0.0)) for t in tasks), F.lit(0.0))
    table = table.withColumns(
        {
            "model": F.lit(model),
            "n_tasks_completed": F.when(found, n_present),
            "avg": round_half_up(total / F.nullif(n_present, F.lit(0)), 4),
            **{t: round_half_up(F.col(f"_{t}"), 4) for t in tasks},
            **{f"{t}_stderr": round_half_up(F.col(f"_{t}_se"), 4) for t in tasks},
        }
    )
    done = F.col("n_tasks_completed")
    status = (
        F.when(~found, F.lit("MISSING"))
        .when(done == len(tasks), F.lit("OK"))
        .otherwise(F.concat(F.lit("PARTIAL ("), done.cast("string"), F.lit(f"/{len(tasks)})")))
    )
    table = table.withColumn("_status", status)
    table = table.drop(*[f"_{t}" for t in tasks], *[f"_{t}_se" for t in tasks])
    # One row per expected label: a window over them avoids computing the table twice.
    base = F.max(F.when(F.col("label") == baseline, F.col("avg"))).over(
        Window.partitionBy(F.lit(0))
    )
    return table.withColumn(delta_col, _points(F.col("avg"), base))


def accuracy_vs_performance(accuracy: DataFrame, performance: DataFrame) -> DataFrame:
    """Accuracy and engine performance of a scheme side by side."""
    return accuracy.withColumnRenamed("label", "scheme").join(
        performance.withColumnRenamed("label", "scheme"), "scheme"
    )
