"""Activation-aware scales: per layer the exponent whose scaled weights quantize with least error.

A channel's scale is its mean absolute activation to the power of an exponent, normalized by the
middle of the layer's largest and smallest. Weights are multiplied by it, quantized with zero
points in groups, and divided by it again; the error of a weight counts by the mean square of
its channel's activations. All exponents of the grid are scored in one aggregate over the
weights, row by row; only one array a layer and exponent meets them.

Rows are ``(layer, row_id, vec)``: activation samples, and weight rows over input channels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitledger.functions.columns import clamp, rint

# Exponents 0, 1 / STEPS, ..; a channel's activation is at least FLOOR.
STEPS = 20
FLOOR = 1e-4


def activation_profile(activations: DataFrame, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Per layer and channel the mean absolute and the mean squared activation."""
    values = activations.select(*keys, F.posexplode(F.col("vec").cast("array<double>")).alias("channel", "x"))
    return values.groupBy(*keys, "channel").agg(
        F.avg(F.abs("x")).alias("mean_abs"), F.avg(F.col("x") * F.col("x")).alias("mean_square")
    )


def scale_grid(profile: DataFrame, steps: int = STEPS, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Per layer and exponent ``step / steps`` the arrays ``scales`` and ``squares`` by channel.

    A channel without activations has scale 1 and counts as never active.
    """
    raised = profile.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(
        "raw", F.pow(F.greatest("mean_abs", F.lit(FLOOR)), F.col("step") / F.lit(float(steps)))
    )
    group = Window.partitionBy(*keys, "step")
    middle = F.sqrt(F.max("raw").over(group) * F.min("raw").over(group))
    found = (
        raised.withColumn("scale", F.col("raw") / middle)
        .groupBy(*keys, "step")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("channel", F.struct("scale", "mean_square")))).alias("_by"),
            F.max("channel").alias("_last"),
        )
    )
    places = F.sequence(F.lit(0), F.col("_last"))

    def dense(field: str, missing: float) -> Column:
        return F.transform(places, lambda c: F.coalesce(F.try_element_at("_by", c)[field], F.lit(missing)))

    return found.select(*keys, "step", dense("scale", 1.0).alias("scales"), dense("mean_square", 0.0).alias("squares"))


def _scaled_groups(weights: DataFrame, grid: DataFrame, group_size: int, keys: tuple[str, ...]) -> DataFrame:
    """One row per weight row, exponent and group: ``cells`` of (v, s, m), scaled value, scale, square."""
    held = weights.join(grid, list(keys)).withColumn("vec", F.col("vec").cast("array<double>"))
    cells = F.transform(
        "vec",
        lambda w, i: F.struct(
            (w * F.coalesce(F.get("scales", i), F.lit(1.0))).alias("v"),
            F.coalesce(F.get("scales", i), F.lit(1.0)).alias("s"),
            F.coalesce(F.get("squares", i), F.lit(0.0)).alias("m"),
        ),
    )
    last = F.floor((F.size("vec") - 1) / F.lit(group_size)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(F.col("cells"), g * group_size + 1, group_size))
    rest = [c for c in weights.columns if c != "vec"]
    return (
        held.where(F.size("vec") > 0)
        .withColumn("cells", cells)
        .select(*rest, "step", F.posexplode(groups).alias("group", "cells"))
    )


def _with_zero_point(groups: DataFrame, bits: int) -> DataFrame:
    top = F.lit(2.0**bits - 1)
    values = F.transform("cells", lambda c: c["v"])
    low, high = F.array_min(values), F.array_max(values)
    return groups.withColumn("scale", F.greatest(high - low, F.lit(1e-5)) / top).withColumn(
        "zero", clamp(-rint(low / F.col("scale")), 0.0, 2.0**bits - 1)
    )


def _code(cell: Column, bits: int) -> Column:
    return clamp(rint(cell["v"] / F.col("scale")) + F.col("zero"), 0.0, 2.0**bits - 1)


def scale_errors(
    weights: DataFrame,
    activations: DataFrame,
    bits: int = 4,
    group_size: int = 128,
    steps: int = STEPS,
    keys: tuple[str, ...] = ("layer",),
) -> DataFrame:
    """``(layer, step, alpha, error, best)`` for each exponent of the grid.

    ``error`` is the mean over the weights of the squared error times the channel's mean square;
    ``best`` marks the smallest of a layer, the smaller exponent in a tie. Exponent 0 is the
    quantizer without scales. A layer without activations is left out.
    """
    grid = scale_grid(activation_profile(activations, keys), steps, keys)
    groups = _with_zero_point(_scaled_groups(weights, grid, group_size, keys), bits)

    def lost(cell: Column) -> Column:
        off = ((_code(cell, bits) - F.col("zero")) * F.col("scale") - cell["v"]) / cell["s"]
        return off * off * cell["m"]

    sums = groups.select(
        *keys, "step", F.size("cells").alias("n"), F.aggregate(F.transform("cells", lost), F.lit(0.0), lambda a, x: a + x).alias("lost")
    )
    errors = sums.groupBy(*keys, "step").agg((F.sum("lost") / F.sum("n")).alias("error"))
    # At most ``steps`` rows a layer.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("error", "step"))
    return errors.select(*keys, "step", (F.col("step") / F.lit(float(steps))).alias("alpha"), "error", (first == 1).alias("best"))


def quantize_scaled(
    weights: DataFrame,
    activations: DataFrame,
    bits: int = 4,
    group_size: int = 128,
    steps: int = STEPS,
    keys: tuple[str, ...] = ("layer",),
) -> DataFrame:
    """Weights quantized under their layer's best exponent, one row per element: ``pos, value, q,
    scale, zero, channel_scale, dequantized``, the last in the units of the weights."""
    grid = scale_grid(activation_profile(activations, keys), steps, keys)
    best = scale_errors(weights, activations, bits, group_size, steps, keys).where("best").select(*keys, "step")
    groups = _with_zero_point(_scaled_groups(weights, grid.join(best, [*keys, "step"]), group_size, keys), bits)
    rest = [c for c in weights.columns if c != "vec"]
    elements = groups.select(
        *rest, "step", "scale", "zero", "group", F.posexplode("cells").alias("_i", "cell")
    ).withColumn("q", _code(F.col("cell"), bits))
    return elements.select(
        *rest,
        "step",
        (F.col("group") * F.lit(group_size) + F.col("_i")).alias("pos"),
        (F.col("cell.v") / F.col("cell.s")).alias("value"),
        F.col("q").cast("int").alias("q"),
        "scale",
        F.col("zero").cast("int").alias("zero"),
        F.col("cell.s").alias("channel_scale"),
        ((F.col("q") - F.col("zero")) * F.col("scale") / F.col("cell.s")).alias("dequantized"),
    )
