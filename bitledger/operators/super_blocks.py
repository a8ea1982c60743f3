"""Quantization with nested scales: blocks of a row share a scale for their scales and minima.

A value is ``scale * q - minimum`` with a code ``q`` from 0; the scales and minima of a
super-block are themselves codes of six bits under one factor each. A block's scale and minimum
start from its range and are refined by least squares on the codes where that loses less. All
of it happens inside the row, in SQL functions, without a shuffle.

Rows are ``(row_id, vec)`` plus any keys, as in :mod:`bitledger.operators.quantize`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitledger.functions.columns import clamp, rint

BLOCK = 32
BLOCKS = 8
# Largest code of a scale or minimum.
SCALE_TOP = 63
# Name and bits of a code.
SCHEMES = {"Q4_K": 4, "Q5_K": 5}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _ratio(value: Column, scale: Column) -> Column:
    return F.when(scale > 0, value / scale).otherwise(0.0)


def _codes(x: Column, scale: Column, minimum: Column, top: int) -> Column:
    return F.transform(x, lambda v: clamp(rint(_ratio(v + minimum, scale)), 0.0, float(top)))


def _loss(x: Column, q: Column, scale: Column, minimum: Column) -> Column:
    return _total(F.zip_with(x, q, lambda v, c: (v - (scale * c - minimum)) * (v - (scale * c - minimum))))


def _fitted(x: Column, q: Column) -> Column:
    """Scale and minimum that lose least with these codes; the minimum is not below 0."""
    sums = F.struct(
        F.size(x).cast("double").alias("n"),
        _total(q).alias("q"),
        _total(x).alias("x"),
        _total(F.transform(q, lambda c: c * c)).alias("qq"),
        _total(F.zip_with(x, q, lambda v, c: v * c)).alias("qx"),
    )

    def solve(s: Column) -> Column:
        spread = s["n"] * s["qq"] - s["q"] * s["q"]
        slope = (s["n"] * s["qx"] - s["q"] * s["x"]) / spread
        minimum = (slope * s["q"] - s["x"]) / s["n"]
        whole = F.struct(slope.alias("scale"), minimum.alias("minimum"))
        through_zero = F.struct(_ratio(s["qx"], s["qq"]).alias("scale"), F.lit(0.0).alias("minimum"))
        return F.when((spread > 0) & (minimum >= 0), whole).otherwise(through_zero)

    return _let(sums, solve)


def _block(x: Column, top: int) -> Column:
    """Scale and minimum of one block, before they are coded."""
    low = F.least(F.array_min(x), F.lit(0.0))
    start = F.struct(((F.array_max(x) - low) / float(top)).alias("scale"), (-low).alias("minimum"))

    def refine(first: Column) -> Column:
        def choose(q: Column) -> Column:
            return _let(
                _fitted(x, q),
                lambda fit: F.when(
                    (fit["scale"] > 0) & (_loss(x, q, fit["scale"], fit["minimum"]) < _loss(x, q, first["scale"], first["minimum"])), fit
                ).otherwise(first),
            )

        return _let(_codes(x, first["scale"], first["minimum"], top), choose)

    return _let(start, refine)


def quantize_super_blocks(rows: DataFrame, bits: int = 4, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """One row per element: ``pos, value, q, scale_code, min_code, scale, minimum, dequantized``.

    ``scale`` and ``minimum`` are the factors of the super-block, ``blocks`` blocks of ``block``
    values (a row's last one may be shorter). ``dequantized = scale * scale_code * q - minimum *
    min_code``. Null and empty vectors have no elements.
    """
    top = 2**bits - 1
    kept = [c for c in rows.columns if c != "vec"]
    vec = F.col("vec").cast("array<double>")
    wide = block * blocks

    def cut(values: Column, size: int) -> Column:
        last = F.floor((F.size(values) - 1) / F.lit(size)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(values, g * size + 1, size))

    supers = rows.where(F.size("vec") > 0).select(*kept, F.posexplode(cut(vec, wide)).alias("_super", "_values"))
    fitted = supers.withColumn("_parts", cut(F.col("_values"), block)).withColumn(
        "_fits", F.transform("_parts", lambda x: _block(x, top))
    )
    factors = fitted.withColumns(
        {
            "scale": F.array_max(F.transform("_fits", lambda f: f["scale"])) / float(SCALE_TOP),
            "minimum": F.array_max(F.transform("_fits", lambda f: f["minimum"])) / float(SCALE_TOP),
        }
    )
    placed = factors.select(*kept, "_super", "scale", "minimum", F.posexplode(F.arrays_zip("_parts", "_fits")).alias("_block", "_b"))
    coded = placed.withColumns(
        {
            "scale_code": rint(_ratio(F.col("_b._fits.scale"), F.col("scale"))).cast("int"),
            "min_code": rint(_ratio(F.col("_b._fits.minimum"), F.col("minimum"))).cast("int"),
        }
    )
    elements = coded.select(
        *kept, "_super", "_block", "scale", "minimum", "scale_code", "min_code", F.posexplode("_b._parts").alias("_i", "value")
    )
    step, shift = F.col("scale") * F.col("scale_code"), F.col("minimum") * F.col("min_code")
    quantized = elements.withColumn("q", clamp(rint(_ratio(F.col("value") + shift, step)), 0.0, float(top)).cast("int"))
    return quantized.select(
        *kept,
        (F.col("_super") * F.lit(wide) + F.col("_block") * F.lit(block) + F.col("_i")).alias("pos"),
        "value",
        "q",
        "scale_code",
        "min_code",
        "scale",
        "minimum",
        (step * F.col("q") - shift).alias("dequantized"),
    )
