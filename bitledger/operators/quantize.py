"""Quantization of vectors in groups along each row.

Rows are ``(row_id, vec)`` plus any keys. A row's groups are cut and scaled inside the row,
so no quantizer shuffles. Results are one row per element with its ``value``, stored code
and ``dequantized`` value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import abs_max, clamp, rint

NF4_MIDPOINTS = [(a + b) / 2 for a, b in zip(fixed.NF4_LEVELS, fixed.NF4_LEVELS[1:])]


def _grouped(rows: DataFrame, group_size: Column) -> DataFrame:
    """One row per group: its number, its first position and its values as doubles."""
    kept = [c for c in rows.columns if c != "vec"]
    vec = F.col("vec").cast("array<double>")
    last = F.floor((F.size("vec") - 1) / group_size).cast("int")
    groups = F.transform(
        F.sequence(F.lit(0), last), lambda g: F.slice(vec, g * group_size + 1, group_size)
    )
    return rows.where(F.size("vec") > 0).select(
        *kept, F.posexplode(groups).alias("group", "values")
    )


def _elements(groups: DataFrame, group_size: Column) -> DataFrame:
    """One row per element; every other column of the group is kept."""
    kept = [c for c in groups.columns if c not in {"values", "group"}]
    return groups.select(
        *kept, "group", F.posexplode("values").alias("_i", "value")
    ).withColumn("pos", F.col("group") * group_size + F.col("_i")).drop("_i")


def _size_or_row(group_size: int | None) -> Column:
    return F.size("vec") if group_size is None else F.lit(group_size)


def _ratio(value: Column, scale: Column) -> Column:
    return F.when(scale > 0, value / scale).otherwise(0.0)


def _rtn_code(value: Column, scale: Column, bits: int) -> Column:
    return clamp(rint(_ratio(value, scale)), -(2.0 ** (bits - 1)), 2.0 ** (bits - 1) - 1)


def _rtn_scale(largest: Column, bits: int) -> Column:
    return largest / F.lit((2.0**bits - 1) / 2)


def _zero_point_scale(low: Column, high: Column, bits: int) -> Column:
    return F.greatest(high - low, F.lit(1e-5)) / F.lit(2.0**bits - 1)


def _zero_point(low: Column, scale: Column, bits: int) -> Column:
    return clamp(-rint(low / scale), 0.0, 2.0**bits - 1)


def _zero_point_code(value: Column, scale: Column, zero: Column, bits: int) -> Column:
    return clamp(rint(value / scale) + zero, 0.0, 2.0**bits - 1)


def _nf4_code(normal: Column) -> Column:
    """Number of the nearest level: comparisons against the midpoints between levels."""
    last = len(NF4_MIDPOINTS)
    return reduce(
        lambda chain, i: chain.when(normal <= NF4_MIDPOINTS[i], F.lit(i)),
        range(1, last),
        F.when(normal <= NF4_MIDPOINTS[0], F.lit(0)),
    ).otherwise(F.lit(last))


def _nf4_level(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in fixed.NF4_LEVELS]), code + 1)


def _quantized_groups(rows: DataFrame, group_size: int | None) -> DataFrame:
    """Groups with the size of their group as a column, for rows of differing length."""
    sized = rows.withColumn("_size", _size_or_row(group_size))
    return _grouped(sized, F.col("_size"))


def quantize_rtn(rows: DataFrame, bits: int = 4, group_size: int | None = 128) -> DataFrame:
    """Round to nearest, symmetric; one scale per group (per row without a group size)."""
    groups = _quantized_groups(rows, group_size).withColumn(
        "scale", _rtn_scale(abs_max(F.col("values")), bits)
    )
    elements = _elements(groups, F.col("_size")).drop("_size", "group")
    return elements.withColumn(
        "q", _rtn_code(F.col("value"), F.col("scale"), bits).cast("int")
    ).withColumn("dequantized", F.col("q") * F.col("scale"))


def quantize_zero_point(rows: DataFrame, bits: int = 4, group_size: int | None = 128) -> DataFrame:
    """Asymmetric: each group maps its smallest to largest value onto the codes from 0."""
    low, high = F.array_min("values"), F.array_max("values")
    groups = (
        _quantized_groups(rows, group_size)
        .withColumn("scale", _zero_point_scale(low, high, bits))
        .withColumn("zero", _zero_point(low, F.col("scale"), bits).cast("int"))
    )
    elements = _elements(groups, F.col("_size")).drop("_size", "group")
    code = _zero_point_code(F.col("value"), F.col("scale"), F.col("zero"), bits)
    return elements.withColumn("q", code.cast("int")).withColumn(
        "dequantized", (F.col("q") - F.col("zero")) * F.col("scale")
    )


def _nf4_blocks(rows: DataFrame, block_size: int) -> DataFrame:
    return _quantized_groups(rows, block_size).withColumn("absmax", abs_max(F.col("values")))


def quantize_nf4(rows: DataFrame, block_size: int = 64) -> DataFrame:
    """Nearest of the 16 NormalFloat levels after dividing by the block's largest value."""
    elements = _elements(_nf4_blocks(rows, block_size), F.col("_size")).drop("_size", "group")
    return elements.withColumn(
        "code", _nf4_code(_ratio(F.col("value"), F.col("absmax")))
    ).withColumn("dequantized", _nf4_level(F.col("code")) * F.col("absmax"))


def double_quantize_scales(
    rows: DataFrame, block_size: int = 64, scales_per_block: int = 256, bits: int = 8
) -> DataFrame:
    """Quantize the NF4 block scales themselves: mean removed, then symmetric per 256 scales.

    Needs rows numbered from 0 within their layer and equally long. Only the scales are
    shuffled, one per block of elements, and each group holds at most ``scales_per_block``.
    """
    per_row = F.ceil(F.size("vec") / F.lit(block_size))
    blocks = _nf4_blocks(rows.withColumn("_row_blocks", per_row), block_size)
    index = F.col("row_id") * F.col("_row_blocks") + F.col("group")
    scales = blocks.select(
        "layer", "row_id", F.col("group").alias("block"), "absmax",
        F.floor(index / F.lit(scales_per_block)).alias("scale_block"),
    )
    means = scales.groupBy("layer").agg(F.avg("absmax").alias("mean"))
    centred = scales.join(means, "layer").withColumn("_centred", F.col("absmax") - F.col("mean"))
    within = Window.partitionBy("layer", "scale_block")
    top = F.lit(2.0 ** (bits - 1) - 1)
    return (
        centred.withColumn("scale", F.max(F.abs("_centred")).over(within) / top)
        .withColumn("q", rint(_ratio(F.col("_centred"), F.col("scale"))).cast("int"))
        .withColumn("dequantized", F.col("q") * F.col("scale") + F.col("mean"))
        .drop("_centred")
    )


def quantize_int8_rows(rows: DataFrame) -> DataFrame:
    """Symmetric 8 bit with one scale per row; the row stays an array."""
    vec = F.col("vec").cast("array<double>")
    scaled = rows.withColumn("vec", vec).withColumn("scale", abs_max(F.col("vec")) / F.lit(127.0))
    codes = F.transform("vec", lambda x: rint(_ratio(x, F.col("scale"))).cast("int"))
    return scaled.withColumn("q", codes).drop("vec")


# (scheme, kind, bits, group size; None groups by row)
SCHEMES = [
    ("W4A16", "rtn", 4, 128),
    ("W8A16", "rtn", 8, None),
    ("AWQ-W4", "zero_point", 4, 128),
    ("NF4", "nf4", 4, 64),
]


def quantize_all_schemes(rows: DataFrame, schemes: list[tuple] = SCHEMES) -> DataFrame:
    """Elements as (scheme, value, dequantized) for several schemes in one scan of the rows."""
    specs = F.array(
        *[F.struct(F.lit(s[0]).alias("scheme"), F.lit(s[3] or 0).alias("_g")) for s in schemes]
    )
    sized = rows.select("*", F.inline(specs)).withColumn(
        "_size", F.when(F.col("_g") > 0, F.col("_g")).otherwise(F.size("vec"))
    )
    low, high = F.array_min("values"), F.array_max("values")
    value, scale, zero = F.col("value"), F.col("scale"), F.col("zero")
    # kind -> scale of a group, zero point of a group, value of an element after the round trip
    formulas = {
        "rtn": lambda b: (
            _rtn_scale(abs_max(F.col("values")), b), F.lit(0.0), _rtn_code(value, scale, b) * scale,
        ),
        "zero_point": lambda b: (
            _zero_point_scale(low, high, b), _zero_point(low, _zero_point_scale(low, high, b), b),
            (_zero_point_code(value, scale, zero, b) - zero) * scale,
        ),
        "nf4": lambda b: (
            abs_max(F.col("values")), F.lit(0.0), _nf4_level(_nf4_code(_ratio(value, scale))) * scale,
        ),
    }
    chosen = [(name, *formulas[kind](bits)) for name, kind, bits, _ in schemes]

    def by_scheme(index: int) -> Column:
        return F.coalesce(*[F.when(F.col("scheme") == c[0], c[index]) for c in chosen])

    groups = _grouped(sized, F.col("_size")).withColumns({"scale": by_scheme(1), "zero": by_scheme(2)})
    elements = _elements(groups, F.col("_size"))
    return elements.select("scheme", "value", by_scheme(3).alias("dequantized"))


def quantization_error(quantized: DataFrame) -> DataFrame:
    """Mean squared and largest error per scheme, from rows (scheme, value, dequantized)."""
    error = F.col("value") - F.col("dequantized")
    return quantized.groupBy("scheme").agg(
        F.avg(error * error).alias("mse"),
        F.max(F.abs(error)).alias("max_err"),
        F.count("*").alias("n"),
    )


def count_parameters(rows: DataFrame) -> DataFrame:
    """Elements per layer, and over all layers in the row whose layer is ``total``."""
    counts = rows.select("layer", F.size("vec").cast("bigint").alias("n"))
    return (
        counts.rollup("layer")
        .agg(F.sum("n").alias("n"), F.grouping("layer").alias("_total"))
        .select(F.when(F.col("_total") == 1, "total").otherwise(F.col("layer")).alias("layer"), "n")
    )
