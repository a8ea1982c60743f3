"""Clipped calibration: per channel a range that loses least when values are coded in few bits.

Histograms of absolute values have bins that grow by a fixed ratio, so they need no range beforehand
and those of different samples, days or machines add up. A bin keeps the number, the sum and the
sum of squares of its values, so what a clip at a bin's upper end cuts off is known exactly. So is
what rounding loses where a bin's values have one code, which is that of their mean; bins wider
than a step count a uniform error, a twelfth of the squared step.

Rows are ``(layer, row_id, vec)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitledger.functions.columns import clamp, rint

# Bins in which values double.
STEPS = 16
BITS = 8


def channel_histograms(rows: DataFrame, keys: tuple[str, ...] = ("layer",), steps: int = STEPS) -> DataFrame:
    """``(layer, channel, bin, n, total, squares)``: sums of the absolute values of a bin.

    Bin ``b`` holds values above ``2^((b - 1) / steps)`` up to ``2^(b / steps)``; zeros have a null
    bin. Missing values are left out. Tasks add up before the shuffle; a channel has at most some
    thousand bins.
    """
    values = rows.select(*keys, F.posexplode(F.col("vec").cast("array<double>")).alias("channel", "x")).where(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    size = F.abs("x")
    place = F.when(size > 0, F.ceil(F.log2(size) * F.lit(float(steps)))).cast("int")
    return values.groupBy(*keys, "channel", place.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(size).alias("total"), F.sum(size * size).alias("squares")
    )


def merge_histograms(histograms: list[DataFrame]) -> DataFrame:
    """Histograms of the same keys and steps added up."""
    every = histograms[0]
    for other in histograms[1:]:
        every = every.unionByName(other)
    keys = [c for c in every.columns if c not in {"n", "total", "squares"}]
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def clip_ranges(histograms: DataFrame, bits: int = BITS, steps: int = STEPS) -> DataFrame:
    """``(layer, channel, clip, loss, unclipped_loss)``: of the bins' upper ends the one with the
    least mean squared loss, the larger in a tie.

    The largest candidate holds all values, so ``loss`` is never above ``unclipped_loss``. A
    channel of zeros has clip 0 and loses nothing. A channel's bins, some thousand at most
    whatever the number of rows, meet in one array.
    """
    keys = [c for c in histograms.columns if c not in {"bin", "n", "total", "squares"}]
    top = F.lit(float(2 ** (bits - 1) - 1))
    bins = histograms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "total", "squares"))).alias("_bins"))

    def end(place: Column) -> Column:
        return F.pow(F.lit(2.0), place / F.lit(float(steps)))

    def loss_of(candidate: Column) -> Column:
        clip = end(candidate)
        step = clip / top

        def about(b: Column, code: Column) -> Column:
            return F.greatest(b["squares"] - 2 * code * b["total"] + b["n"] * code * code, F.lit(0.0))

        def lost(b: Column) -> Column:
            one_code = about(b, F.least(rint(b["total"] / b["n"] / step), top) * step)
            inside = F.when(end(b["bin"]) - end(b["bin"] - 1) < step, one_code).otherwise(b["n"] * step * step / 12.0)
            return F.when(b["bin"].isNull(), 0.0).when(b["bin"] > candidate, about(b, clip)).otherwise(inside)

        total = F.aggregate("_bins", F.lit(0.0), lambda a, b: a + lost(b))
        return F.struct((total / F.col("_all")).alias("loss"), (-clip).alias("minus_clip"))

    places = F.filter(F.transform("_bins", lambda b: b["bin"]), lambda p: p.isNotNull())
    scored = bins.withColumn("_all", F.aggregate("_bins", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])).withColumn(
        "_losses", F.transform(places, loss_of)
    )
    best = F.array_min("_losses")
    widest = F.get(F.filter("_losses", lambda x: x["minus_clip"] == F.array_min(F.transform("_losses", lambda y: y["minus_clip"]))), F.lit(0))
    return scored.select(
        *keys,
        F.coalesce(-best["minus_clip"], F.lit(0.0)).alias("clip"),
        F.coalesce(best["loss"], F.lit(0.0)).alias("loss"),
        F.coalesce(widest["loss"], F.lit(0.0)).alias("unclipped_loss"),
    )


def quantize_clipped(rows: DataFrame, ranges: DataFrame, bits: int = BITS, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """One row per element: ``pos, value, q, dequantized`` under its channel's clip. An element
    without a clip has no code; a clip of 0 codes all as 0."""
    top = float(2 ** (bits - 1) - 1)
    rest = [c for c in rows.columns if c != "vec"]
    placed = ranges.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("channel").cast("int"), "clip"))).alias("_clips"))
    elements = rows.join(placed, list(keys), "left").select(
        *rest, "_clips", F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "value")
    )
    step = F.try_element_at("_clips", F.col("pos")) / F.lit(top)
    code = F.when(F.col("_step") > 0, clamp(rint(F.col("value") / F.col("_step")), -top, top)).when(F.col("_step") == 0, 0.0)
    coded = elements.withColumn("_step", step).withColumn("q", code.cast("int"))
    return coded.withColumn("dequantized", F.col("q") * F.col("_step")).drop("_clips", "_step")
