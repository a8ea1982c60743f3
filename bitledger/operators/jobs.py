"""Planning and accounting of evaluation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import job_spec_parts


def parse_job_spec(df: DataFrame, col: str = "spec") -> DataFrame:
    return df.withColumns(job_spec_parts(F.col(col)))


def resolve_task_preset(df: DataFrame, col: str = "tasks") -> DataFrame:
    """One row per task of a preset; any other text is itself a comma-separated list."""
    pairs = [F.lit(x) for pair in fixed.TASK_PRESETS.items() for x in pair]
    resolved = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.col(col))
    return df.withColumn("task", F.explode(F.split(resolved, ",")))


def pending_jobs(
    models: DataFrame,
    valid: DataFrame,
    parts: list[str] = fixed.PARTS,
    force: bool = False,
    key: str = "label",
) -> DataFrame:
    """Model parts that have no valid result yet; all of them when forced."""
    jobs = models.withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts])))
    if force:
        return jobs
    return jobs.join(valid.select(key, "part").distinct(), [key, "part"], "left_anti")


def completed_groups(
    valid: DataFrame, parts: list[str] = fixed.PARTS, key: str = "label"
) -> DataFrame:
    """Groups whose parts are all done. One flag per part is enough, so no set is built."""
    flags = [F.max(F.when(F.col("part") == p, 1).otherwise(0)) for p in parts]
    done = sum(flags[1:], flags[0])
    return valid.groupBy(key).agg(done.alias("_done")).where(F.col("_done") == len(parts)).select(key)


def job_statuses(
    models: DataFrame,
    valid: DataFrame,
    parts: list[str] = fixed.PARTS,
    key: str = "label",
    present: str = "model_present",
) -> DataFrame:
    """Status of each model part: ``ok`` with a result, ``skipped`` where the model itself is
    not there (column ``present`` of ``models`` is not true), else ``failed``."""
    results = valid.select(key, "part").distinct().withColumn("_has", F.lit(True))
    there = F.coalesce(F.col(present), F.lit(False))
    return (
        pending_jobs(models, valid, parts, force=True, key=key)
        .join(results, [key, "part"], "left")
        .withColumn("status", F.when(F.col("_has"), "ok").when(there, "failed").otherwise("skipped"))
        .drop("_has")
    )


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))
