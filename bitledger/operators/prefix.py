"""Running totals, row numbers and ranks over an order too large for one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Copies of one row are written out in blocks of this size, so no task writes them all.
COPIES_PER_BLOCK = 64
# About as many rows are sampled to cut the order into ranges; a power of two.
SAMPLED_ROWS = 4096
# Distinct values up to which their ranks are a table from the driver.
SMALL_VALUES = 10_000


def _with_range(df: DataFrame, groups: list[str], order_cols: list[str]) -> DataFrame:
    """Rows with ``_range``, their place among bounds that cut the order of groups and rows.

    Bounds are the rows, by group and all order columns, whose hash is a multiple of a number that
    follows from the number of rows: they depend on the data alone, so every evaluation of the plan
    finds the same ones, and few distinct values of the first column do not make few ranges. One
    sorted array holds those of all groups, and a row finds its place there by halving: it is not
    sent to the task of its group and carries no bounds along.
    """
    lead = F.struct(*groups, *order_cols)
    one_in = F.greatest(F.floor(F.count("*") / F.lit(SAMPLED_ROWS)), F.lit(1)).cast("bigint")
    drawn = df.select(lead.alias("_lead")).withColumn("_m", df.agg(one_in.alias("m")).scalar())
    drawn = drawn.where(F.pmod(F.xxhash64("_lead"), F.col("_m")) == 0)
    bounds = drawn.agg(F.array_sort(F.collect_set("_lead")).alias("_b")).scalar()
    placed = df.withColumns({"_lead": lead, "_range": F.lit(0)})
    # Fewer than 2 * SAMPLED_ROWS bounds are expected, so these steps reach them all.
    step = 2 * SAMPLED_ROWS
    while step:
        passed = F.get(bounds, F.col("_range") + F.lit(step - 1)) < F.col("_lead")
        placed = placed.withColumn("_range", F.col("_range") + F.when(passed, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return placed.drop("_lead")


def running_total(
    df: DataFrame,
    order_cols: list[str],
    value_col: str,
    out_col: str,
    partition_cols: list[str] | None = None,
) -> DataFrame:
    """Sum of ``value_col`` over all earlier rows of the group (the row itself excluded).

    A window over a whole group would put it into one task. Here the order columns cut each
    group into ranges; each range is summed on its own and the sums of the earlier ranges are
    added. Nothing runs before the result is read. ``(partition_cols, order_cols)`` should be
    unique; rows that agree in all of them share a range.
    """
    groups = partition_cols or []
    ranged = _with_range(df, groups, order_cols)
    # At most (ranges + groups) rows: small next to the data, one window per group.
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    range_starts = ranged.groupBy(*groups, "_range").agg(F.sum(value_col).alias("_sum"))
    range_starts = range_starts.select(
        *groups, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_add"), F.lit(True).alias("_head")
    )
    # The start of a range is a row ahead of it: a join by groups that may be null would move all rows once more.
    rows = ranged.withColumns({"_add": F.col(value_col), "_head": F.lit(False)})
    within = (
        Window.partitionBy("_range", *groups)
        .orderBy(F.desc("_head"), *order_cols)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.unionByName(range_starts, allowMissingColumns=True)
        .withColumn(out_col, F.sum("_add").over(within))
        .where(~F.col("_head"))
        .drop("_add", "_head", "_range")
    )


def number_rows(
    df: DataFrame, partition_cols: list[str], order_cols: list[str], out_col: str
) -> DataFrame:
    """Exact ``row_number`` within groups of any size, starting at 1.

    Equal rows are counted before the shuffle and written out again at the end, so neither
    a hot group nor a hot value lands in one task. Rows that tie on ``order_cols`` are
    ordered by the remaining columns.
    """
    rest = [c for c in df.columns if c not in {*partition_cols, *order_cols}]
    step = F.lit(COPIES_PER_BLOCK).cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    blocks = (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("_copies"))
        .withColumn("_block", F.explode(F.sequence(zero, F.col("_copies") - one, step)))
        .withColumn("_size", F.least(step, F.col("_copies") - F.col("_block")))
        .drop("_copies")
    )
    started = running_total(blocks, [*order_cols, *rest, "_block"], "_size", "_first", partition_cols)
    return started.withColumn(
        out_col, F.explode(F.sequence(F.col("_first") + one, F.col("_first") + F.col("_size"), one))
    ).drop("_first", "_size", "_block")


def rank_of_values(df: DataFrame, col: str, out_col: str, known: DataFrame | None = None) -> DataFrame:
    """Position of a row's value among the distinct values in sorted order, from 0.

    ``known`` may give a table with the column that has just the values of ``df``, where those
    are found more cheaply than from its rows.

    Up to ``SMALL_VALUES`` distinct values are read and ranked at once, when the plan is made,
    and broadcast. More are ranked in ranges, so no task sees all of them, and joined; hot values
    are then split by the planner.
    """
    values = (df if known is None else known).select(col).where(F.col(col).isNotNull()).distinct()
    first = [row[0] for row in values.orderBy(col).limit(SMALL_VALUES + 1).collect()]
    if len(first) <= SMALL_VALUES:
        kind = values.schema[col]
        ranked = pa.table({"value": pa.array(first), "rank": pa.array(range(len(first)), pa.int64())})
        spark = df.sparkSession
        ranks = spark.createDataFrame(ranked) if first else spark.createDataFrame([], "value string, rank bigint")
        ranks = ranks.select(F.col("value").cast(kind.dataType).alias(col), F.col("rank").alias(out_col))
        return df.join(F.broadcast(ranks), col)
    one = values.withColumn("_one", F.lit(1).cast("bigint"))
    ranks = running_total(one, [col], "_one", out_col).drop("_one")
    return df.join(ranks, col)
