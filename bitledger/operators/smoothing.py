"""Per-channel scales and the smoothing of weights by them.

Rows are ``(layer, row_id, vec)``: activation samples or weight rows over input channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.session import lookup


def _channel_max(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Largest absolute value per channel; each task sends one row per key and channel."""
    values = rows.select(*keys, F.posexplode("vec").alias("channel", "x"))
    return values.groupBy(*keys, "channel").agg(
        F.max(F.abs(F.col("x").cast("double"))).alias("scale")
    )


def activation_scales(rows: DataFrame, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Per group and input channel the largest absolute activation over all samples."""
    return _channel_max(rows, list(keys))


def weight_scales(weights: DataFrame, floor: float = 1e-5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per input channel the largest absolute weight, at least ``floor``, over all matrices that
    a norm feeds. ``keys`` tells apart the groups (a norm and its matrices) of one model."""
    scales = _channel_max(weights, list(keys))
    return scales.withColumn("scale", F.greatest("scale", F.lit(floor)))


def smoothing_factors(
    act: DataFrame, weight: DataFrame, alpha: float = 0.5, floor: float = 1e-5, keys: tuple[str, ...] = ()
) -> DataFrame:
    """``act^alpha / weight^(1 - alpha)`` per group and channel, at least ``floor``."""
    a = act.select(*keys, "channel", F.col("scale").alias("act_scale"))
    w = weight.select(*keys, "channel", F.col("scale").alias("weight_scale"))
    raw = F.pow("act_scale", F.lit(alpha)) / F.pow("weight_scale", F.lit(1.0 - alpha))
    joined = a.join(w, [*keys, "channel"])
    return joined.select(*keys, "channel", F.greatest(raw, F.lit(floor)).alias("factor"))


def _factor_arrays(factors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per group one array with the factor of each channel at its place, 1 where there is none."""
    placed = factors.withColumn("channel", F.col("channel").cast("int"))
    found = placed.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "factor"))).alias("_by"), F.max("channel").alias("_last")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.col("_last")),
        lambda c: F.coalesce(F.try_element_at("_by", c), F.lit(1.0)),
    )
    return found.select(*keys, dense.alias("_factors"))


def apply_smoothing(
    weights: DataFrame, norm: DataFrame, factors: DataFrame, keys: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Divide the norm's weight and bias by the factors and multiply the weight columns by them.

    Factors are found by channel; a channel without a factor keeps its values. With ``keys``
    each group uses its own factors. A group's factors are one array, no longer than a weight
    row; without keys it reaches the rows as a scalar subquery and the weights do not move.
    """
    arrays = _factor_arrays(factors, keys)
    held = weights.join(arrays, list(keys), "left") if keys else weights.withColumn("_factors", arrays.scalar())
    scaled = F.transform(
        F.col("vec").cast("array<double>"), lambda w, i: w * F.coalesce(F.get("_factors", i), F.lit(1.0))
    )
    by = F.coalesce("factor", F.lit(1.0))
    scaled_norm = norm.join(factors, [*keys, "channel"], "left").withColumns(
        {"weight": F.col("weight") / by, "bias": F.col("bias") / by}
    )
    return held.withColumn("vec", scaled).drop("_factors"), scaled_norm.drop("factor")


def pair_norms(modules: DataFrame, readers: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(norm, linear)``: the linear layers that read each norm's output, by their names.

    ``modules`` has the column ``name``, such as ``model.layers.3.self_attn.q_proj``. ``readers``
    lists the ends of the names (one part for a norm, two for a linear layer); a norm and a
    linear layer pair where what stands before is the same block. Norms without a reader in the
    list, and linear layers that read no norm, are in no pair.
    """
    ends = lookup(modules.sparkSession, ["norm_end", "linear_end"], fixed.NORM_READERS if readers is None else readers)
    names = modules.select("name").where(F.col("name").isNotNull()).distinct()

    def cut(parts: int, end: str, whole: str) -> DataFrame:
        found = F.substring_index("name", ".", -parts)
        block = F.substring(F.col("name"), F.lit(1), F.length("name") - F.length(found))
        return names.select(F.col("name").alias(whole), found.alias(end), block.alias("block"))

    norms = cut(1, "norm_end", "norm").join(ends, "norm_end")
    return norms.join(cut(2, "linear_end", "linear"), ["block", "linear_end"]).select("norm", "linear")


def smooth_paired(
    weights: DataFrame, activations: DataFrame, norms: DataFrame, pairs: DataFrame, alpha: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Smooth every norm of a model with the linear layers that read it.

    ``weights``: layer (a linear layer's name), row_id, vec; ``activations``: layer (a norm's
    name), row_id, vec, the norm's outputs; ``norms``: norm, channel, weight, bias. A norm's
    factors come from its outputs and from the weights of all its readers together. Returns the
    weights and the norms; linear layers and norms in no pair keep their values.
    """
    named = pairs.select("norm", F.col("linear").alias("layer"))
    placed = weights.join(named, "layer", "left")
    act = activation_scales(activations.withColumnRenamed("layer", "norm"), keys=("norm",))
    weight = weight_scales(placed.where(F.col("norm").isNotNull()), keys=("norm",))
    smoothed, scaled = apply_smoothing(placed, norms, smoothing_factors(act, weight, alpha, keys=("norm",)), keys=("norm",))
    return smoothed.drop("norm"), scaled
