"""Registered queries: smoothing and quantization of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.catalog.bindings import bind, cte, table
from bitledger.catalog.common import Query, r, rounded
from bitledger.functions import fixed_values as fixed
from bitledger.operators import calibration, error_feedback, quantize, scale_search, smoothing, super_blocks
from bitledger.operators.prefix import number_rows

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "vectors")


_V = (
    cte("vectors")
    + ", e AS (SELECT layer, row_id, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS pos, CAST(unnest(vec) AS DOUBLE) AS x FROM vectors) "
)
_WGT = "wgt AS (SELECT pos AS channel, GREATEST(MAX(ABS(x)), 1.0e-5) AS weight_scale FROM e GROUP BY pos)"


def _channels(df: DataFrame) -> DataFrame:
    return df.withColumn("channel", F.col("channel").cast("bigint"))


QUERIES["activation_scales"] = lambda spark, sf: _channels(
    smoothing.activation_scales(_vectors(spark, sf))
)
ORACLE["activation_scales"] = _V + "SELECT layer, pos AS channel, MAX(ABS(x)) AS scale FROM e GROUP BY layer, pos"
QUERIES["weight_scales"] = lambda spark, sf: _channels(smoothing.weight_scales(_vectors(spark, sf)))
ORACLE["weight_scales"] = _V + f", {_WGT} SELECT channel, weight_scale AS scale FROM wgt"


def _factors(spark: SparkSession, sf: str) -> DataFrame:
    """Each layer is a group: even rows are its activation samples, odd rows its weights."""
    vectors = _vectors(spark, sf)
    act = smoothing.activation_scales(vectors.where(F.col("row_id") % 2 == 0))
    weight = smoothing.weight_scales(vectors.where(F.col("row_id") % 2 == 1), keys=("layer",))
    return smoothing.smoothing_factors(act, weight, keys=("layer",))


_F = (
    _V
    + ", act AS (SELECT layer, pos AS channel, MAX(ABS(x)) AS act_scale FROM e WHERE row_id % 2 = 0 GROUP BY layer, pos), "
    + "wgt AS (SELECT layer, pos AS channel, GREATEST(MAX(ABS(x)), 1.0e-5) AS weight_scale FROM e WHERE row_id % 2 = 1 GROUP BY layer, pos), "
    + "f AS (SELECT layer, channel, GREATEST(pow(act_scale, 0.5e0) / pow(weight_scale, 0.5e0), 1.0e-5) AS factor FROM act JOIN wgt USING (layer, channel)), "
    + "u AS (SELECT * FROM f WHERE layer = 'fc0' OR channel % 7 <> 3) "
)
QUERIES["smoothing_factors"] = lambda spark, sf: rounded(_channels(_factors(spark, sf)), 6, "factor")
ORACLE["smoothing_factors"] = _F + f"SELECT layer, channel, {r('factor', 6)} AS factor FROM f"


def _smoothed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Norm and weights of both layers; some channels of one have no factor."""
    vectors = _vectors(spark, sf)
    norm = smoothing.activation_scales(vectors).select(
        "layer", "channel", F.col("scale").alias("weight"), (F.col("scale") / 2.0).alias("bias")
    )
    factors = _factors(spark, sf).where((F.col("layer") == "fc0") | (F.col("channel") % 7 != 3))
    return smoothing.apply_smoothing(vectors, norm, factors, keys=("layer",))


def _smoothed_weights(spark, sf):
    weights, _ = _smoothed(spark, sf)
    long = weights.select("layer", "row_id", F.posexplode("vec").alias("pos", "w"))
    return rounded(long.withColumn("pos", F.col("pos").cast("bigint")), 6, "w")


QUERIES["apply_smoothing"] = _smoothed_weights
ORACLE["apply_smoothing"] = (
    _F + f"SELECT layer, row_id, pos, {r('x * COALESCE(factor, 1.0e0)', 6)} AS w FROM e LEFT JOIN (SELECT layer, channel AS pos, factor FROM u) USING (layer, pos)"
)
QUERIES["apply_smoothing_norm"] = lambda spark, sf: rounded(
    _channels(_smoothed(spark, sf)[1]), 6, "weight", "bias"
)
ORACLE["apply_smoothing_norm"] = (
    _F + f", n AS (SELECT layer, pos AS channel, MAX(ABS(x)) AS s FROM e GROUP BY layer, pos) SELECT layer, channel, {r('s / COALESCE(factor, 1.0e0)', 6)} AS weight, {r('s / 2.0e0 / COALESCE(factor, 1.0e0)', 6)} AS bias FROM n LEFT JOIN u USING (layer, channel)"
)


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("row_id", F.col("pos").cast("bigint").alias("pos"), *cols)


def _grouped(size: str) -> str:
    return f"g AS (SELECT *, MAX(ABS(x)) OVER (PARTITION BY row_id, FLOOR(pos / {size})) AS top, MAX(x) OVER (PARTITION BY row_id, FLOOR(pos / {size})) AS hi, MIN(x) OVER (PARTITION BY row_id, FLOOR(pos / {size})) AS lo FROM e)"


def _rtn(bits: int, size: str) -> str:
    half = f"{(2**bits - 1) / 2}e0"
    return f", {_grouped(size)}, q0 AS (SELECT *, top / {half} AS scale FROM g), q AS (SELECT *, GREATEST(LEAST(CASE WHEN scale > 0 THEN round_even(x / scale, 0) ELSE 0.0e0 END, {2 ** (bits - 1) - 1}.0e0), -{2 ** (bits - 1)}.0e0) AS c FROM q0) "


def _zp(bits: int, size: str) -> str:
    top = f"{2**bits - 1}.0e0"
    return (
        f", {_grouped(size)}, q0 AS (SELECT *, GREATEST(hi - lo, 1.0e-5) / {top} AS scale FROM g), "
        f"q1 AS (SELECT *, GREATEST(LEAST(-round_even(lo / scale, 0), {top}), 0.0e0) AS zero FROM q0), "
        f"q AS (SELECT *, GREATEST(LEAST(round_even(x / scale, 0) + zero, {top}), 0.0e0) AS c FROM q1) "
    )


_LEVELS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in fixed.NF4_LEVELS) + "]"
_NF4 = (
    f", {_grouped('64')}, q0 AS (SELECT *, CASE WHEN top > 0 THEN x / top ELSE 0.0e0 END AS u FROM g), "
    f"q AS (SELECT *, {' + '.join(f'CASE WHEN u > {m!r}::DOUBLE THEN 1 ELSE 0 END' for m in quantize.NF4_MIDPOINTS)} AS c FROM q0) "
)

for _name, _bits, _size in [("quantize_rtn", 4, 16), ("quantize_rtn_w4a16", 4, 128), ("quantize_rtn_w8a16", 8, None)]:
    QUERIES[_name] = lambda spark, sf, b=_bits, s=_size: rounded(
        _long(quantize.quantize_rtn(_vectors(spark, sf), b, s), "q", "scale"), 9, "scale"
    )
    ORACLE[_name] = (
        _V + _rtn(_bits, str(_size or 1_000_000)) + f"SELECT row_id, pos, CAST(c AS INTEGER) AS q, {r('scale', 9)} AS scale FROM q"
    )
for _bits in (4, 3):
    _name = "quantize_zero_point" if _bits == 4 else "quantize_zero_point_3bit"
    QUERIES[_name] = lambda spark, sf, b=_bits: rounded(
        _long(quantize.quantize_zero_point(_vectors(spark, sf), b, 32), "q", "scale", "zero"), 9, "scale"
    )
    ORACLE[_name] = (
        _V + _zp(_bits, "32") + f"SELECT row_id, pos, CAST(c AS INTEGER) AS q, {r('scale', 9)} AS scale, CAST(zero AS INTEGER) AS zero FROM q"
    )
QUERIES["quantize_nf4"] = lambda spark, sf: _long(
    quantize.quantize_nf4(_vectors(spark, sf)), "code", "absmax"
)
ORACLE["quantize_nf4"] = _V + _NF4 + "SELECT row_id, pos, CAST(c AS INTEGER) AS code, top AS absmax FROM q"


def _double_quantized(spark, sf):
    # Scale blocks of 256 are cut by row number, so rows are numbered within their layer.
    numbered = number_rows(_vectors(spark, sf).select("layer", "row_id"), ["layer"], ["row_id"], "_n")
    vectors = (
        _vectors(spark, sf)
        .join(numbered, ["layer", "row_id"])
        .select("layer", (F.col("_n") - 1).alias("row_id"), "vec")
    )
    scales = quantize.double_quantize_scales(vectors, block_size=16)
    kept = scales.select(
        "layer", "row_id", F.col("block").cast("bigint").alias("block"), "q", "dequantized"
    )
    return rounded(kept, 6, "dequantized")


QUERIES["quantize_nf4_scales"] = _double_quantized
ORACLE["quantize_nf4_scales"] = (
    _V
    + ", b AS (SELECT layer, DENSE_RANK() OVER (PARTITION BY layer ORDER BY row_id) - 1 AS row_id, block, top FROM (SELECT layer, row_id, CAST(FLOOR(pos / 16) AS BIGINT) AS block, MAX(ABS(x)) AS top FROM e GROUP BY ALL)), "
    + "c AS (SELECT b.*, top - mean AS d, mean, FLOOR((row_id * 4 + block) / 256) AS sb FROM b JOIN (SELECT layer, AVG(top) AS mean FROM b GROUP BY layer) USING (layer)), "
    + "s AS (SELECT *, MAX(ABS(d)) OVER (PARTITION BY layer, sb) / 127.0e0 AS scale FROM c), "
    + "q AS (SELECT *, CASE WHEN scale > 0 THEN round_even(d / scale, 0) ELSE 0.0e0 END AS q FROM s) "
    + f"SELECT layer, row_id, block, CAST(q AS INTEGER) AS q, {r('CAST(q AS INTEGER) * scale + mean', 6)} AS dequantized FROM q"
)


def _int8(spark, sf):
    coded = quantize.quantize_int8_rows(_vectors(spark, sf).withColumnRenamed("vec", "vec"))
    long = coded.select("row_id", "scale", F.posexplode("q").alias("pos", "q"))
    return rounded(_long(long, "q", "scale"), 9, "scale")


QUERIES["quantize_int8_activations"] = _int8
ORACLE["quantize_int8_activations"] = (
    _V
    + ", g AS (SELECT *, MAX(ABS(x)) OVER (PARTITION BY row_id) / 127.0e0 AS scale FROM e) "
    + f"SELECT row_id, pos, CAST(CASE WHEN scale > 0 THEN round_even(x / scale, 0) ELSE 0.0e0 END AS INTEGER) AS q, {r('scale', 9)} AS scale FROM g"
)


def _error(spark, sf):
    return rounded(
        quantize.quantization_error(quantize.quantize_all_schemes(_vectors(spark, sf))),
        9, "mse", "max_err",
    )


def _error_branch(scheme: str, body: str, value: str) -> str:
    return f"SELECT '{scheme}' AS scheme, x, {value} AS y FROM (WITH {body[2:]} SELECT * FROM {'nq' if 'nq AS' in body else 'q'})"


QUERIES["quantization_error"] = _error
ORACLE["quantization_error"] = (
    _V
    + ", d AS ("
    + " UNION ALL ".join(
        [
            _error_branch("W4A16", _rtn(4, "128"), "c * scale"),
            _error_branch("W8A16", _rtn(8, "1000000"), "c * scale"),
            _error_branch("AWQ-W4", _zp(4, "128"), "(c - zero) * scale"),
            _error_branch("NF4", _NF4, f"({_LEVELS})[c + 1] * top"),
        ]
    )
    + f") SELECT scheme, {r('AVG((x - y) * (x - y))', 9)} AS mse, {r('MAX(ABS(x - y))', 9)} AS max_err, COUNT(*) AS n FROM d GROUP BY scheme"
)
QUERIES["count_parameters"] = lambda spark, sf: quantize.count_parameters(_vectors(spark, sf))
ORACLE["count_parameters"] = (
    cte("vectors") + "SELECT layer, CAST(SUM(len(vec)) AS BIGINT) AS n FROM vectors GROUP BY layer UNION ALL SELECT 'total', CAST(SUM(len(vec)) AS BIGINT) FROM vectors"
)


# --- scales chosen by activations, rounding with feedback ------------------------------
def _samples_and_weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each layer's even rows are its activation samples, its odd rows its weights."""
    vectors = _vectors(spark, sf)
    return vectors.where(F.col("row_id") % 2 == 0), vectors.where(F.col("row_id") % 2 == 1)


_GROUP = 32
_SEARCH = (
    _V
    + ", a AS (SELECT layer, pos, AVG(ABS(x)) AS a, AVG(x * x) AS m FROM e WHERE row_id % 2 = 0 GROUP BY layer, pos), "
    + f"s0 AS (SELECT *, pow(GREATEST(a, {scale_search.FLOOR!r}::DOUBLE), k / {scale_search.STEPS}.0e0) AS f FROM a, range({scale_search.STEPS}) AS g(k)), "
    + "s AS (SELECT layer, pos, k, m, f / sqrt(MAX(f) OVER (PARTITION BY layer, k) * MIN(f) OVER (PARTITION BY layer, k)) AS s FROM s0), "
    + f"w AS (SELECT e.layer, row_id, e.pos, k, s, m, x, x * s AS v, CAST(FLOOR(e.pos / {_GROUP}) AS BIGINT) AS g FROM e JOIN s ON e.layer = s.layer AND e.pos = s.pos WHERE row_id % 2 = 1), "
    + "z0 AS (SELECT *, MIN(v) OVER (PARTITION BY layer, row_id, k, g) AS lo, MAX(v) OVER (PARTITION BY layer, row_id, k, g) AS hi FROM w), "
    + "z1 AS (SELECT *, GREATEST(hi - lo, 1.0e-5) / 15.0e0 AS scale FROM z0), "
    + "z AS (SELECT *, GREATEST(LEAST(-round_even(lo / scale, 0), 15.0e0), 0.0e0) AS zero FROM z1), "
    + "q AS (SELECT *, GREATEST(LEAST(round_even(v / scale, 0) + zero, 15.0e0), 0.0e0) AS c FROM z), "
    + "err AS (SELECT layer, k AS step, AVG(((c - zero) * scale - v) / s * (((c - zero) * scale - v) / s) * m) AS error FROM q GROUP BY layer, k), "
    + "best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY layer ORDER BY error, step) = 1 AS best FROM err) "
)


def _scale_search(spark, sf):
    samples, weights = _samples_and_weights(spark, sf)
    return rounded(scale_search.scale_errors(weights, samples, group_size=_GROUP), 9, "error")


QUERIES["scale_search"] = _scale_search
ORACLE["scale_search"] = (
    _SEARCH + f"SELECT layer, CAST(step AS INTEGER) AS step, step / {scale_search.STEPS}.0e0 AS alpha, {r('error', 9)} AS error, best FROM best"
)


def _scaled_weights(spark, sf):
    samples, weights = _samples_and_weights(spark, sf)
    found = scale_search.quantize_scaled(weights, samples, group_size=_GROUP)
    return rounded(found.select("layer", "row_id", F.col("pos").cast("bigint").alias("pos"), "step", "q", "zero", "dequantized"), 6, "dequantized")


QUERIES["quantize_scaled"] = _scaled_weights
ORACLE["quantize_scaled"] = (
    _SEARCH
    + f"SELECT layer, row_id, pos, CAST(k AS INTEGER) AS step, CAST(c AS INTEGER) AS q, CAST(zero AS INTEGER) AS zero, {r('(c - zero) * scale / s', 6)} AS dequantized FROM q JOIN best USING (layer) WHERE best AND k = step"
)


def _with_feedback(spark, sf):
    samples, weights = _samples_and_weights(spark, sf)
    found = error_feedback.quantize_with_feedback(weights, samples, group_size=_GROUP)
    return rounded(_long(found, "layer", "q", "scale"), 9, "scale")


def _output_error(spark, sf):
    """Mean squared change of the layers' outputs by scheme, all of four bits and groups of 32."""
    samples, weights = _samples_and_weights(spark, sf)
    columns = ["layer", "row_id", "pos", "value", "dequantized"]
    schemes = {
        "W4-RTN": quantize.quantize_rtn(weights, 4, _GROUP),
        "W4-feedback": error_feedback.quantize_with_feedback(weights, samples, group_size=_GROUP),
        "W4-zero-point": quantize.quantize_zero_point(weights, 4, _GROUP),
        "W4-scaled": scale_search.quantize_scaled(weights, samples, group_size=_GROUP),
    }
    parts = [df.select(F.lit(name).alias("scheme"), *columns) for name, df in schemes.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return rounded(error_feedback.output_error(every, samples), 9, "output_mse")


# A matrix inverse is beyond SQL; tests compare with the inverse taken anew for every column.
QUERIES["quantize_with_feedback"] = _with_feedback
QUERIES["quantization_output_error"] = _output_error


# --- nested scales ---------------------------------------------------------------------
# Vectors of 64 values: blocks of 8 and super-blocks of 4 blocks, so that a row holds two.
def _nested(bits: int) -> str:
    top = f"{2**bits - 1}.0e0"
    key = "layer, row_id, b"
    return (
        ", nb AS (SELECT layer, row_id, pos, x, pos // 8 AS b, pos // 32 AS s FROM e), "
        f"n0 AS (SELECT *, (MAX(x) OVER w - LEAST(MIN(x) OVER w, 0.0e0)) / {top} AS sc0, -LEAST(MIN(x) OVER w, 0.0e0) AS mn0 FROM nb WINDOW w AS (PARTITION BY {key})), "
        f"n1 AS (SELECT *, GREATEST(LEAST(CASE WHEN sc0 > 0 THEN round_even((x + mn0) / sc0, 0) ELSE 0.0e0 END, {top}), 0.0e0) AS c FROM n0), "
        "n2 AS (SELECT layer, row_id, s, b, ANY_VALUE(sc0) AS sc0, ANY_VALUE(mn0) AS mn0, CAST(COUNT(*) AS DOUBLE) AS n, SUM(c) AS sq, SUM(x) AS sx, SUM(c * c) AS qq, SUM(c * x) AS qx FROM n1 GROUP BY layer, row_id, s, b), "
        "n3 AS (SELECT *, n * qq - sq * sq AS spread, CASE WHEN n * qq - sq * sq > 0 THEN (n * qx - sq * sx) / (n * qq - sq * sq) END AS slope FROM n2), "
        "n4 AS (SELECT *, COALESCE(slope * sq - sx >= 0, FALSE) AS pair FROM n3), "
        "n5 AS (SELECT *, CASE WHEN pair THEN slope WHEN qq > 0 THEN qx / qq ELSE 0.0e0 END AS sc1, CASE WHEN pair THEN (slope * sq - sx) / n ELSE 0.0e0 END AS mn1 FROM n4), "
        f"n6 AS (SELECT n5.*, l.better FROM n5 JOIN (SELECT layer, row_id, b, SUM(pow(x - (sc1 * c - mn1), 2)) < SUM(pow(x - (n1.sc0 * c - n1.mn0), 2)) AS better FROM n1 JOIN n5 USING (layer, row_id, s, b) GROUP BY {key}) l USING (layer, row_id, b)), "
        "n7 AS (SELECT *, CASE WHEN sc1 > 0 AND better THEN sc1 ELSE sc0 END AS sc, CASE WHEN sc1 > 0 AND better THEN mn1 ELSE mn0 END AS mn FROM n6), "
        "n8 AS (SELECT *, MAX(sc) OVER w / 63.0e0 AS scale, MAX(mn) OVER w / 63.0e0 AS minimum FROM n7 WINDOW w AS (PARTITION BY layer, row_id, s)), "
        "n9 AS (SELECT *, CASE WHEN scale > 0 THEN round_even(sc / scale, 0) ELSE 0.0e0 END AS scale_code, CASE WHEN minimum > 0 THEN round_even(mn / minimum, 0) ELSE 0.0e0 END AS min_code FROM n8), "
        f"nq AS (SELECT nb.*, scale, minimum, scale_code, min_code, GREATEST(LEAST(CASE WHEN scale * scale_code > 0 THEN round_even((x + minimum * min_code) / (scale * scale_code), 0) ELSE 0.0e0 END, {top}), 0.0e0) AS q FROM nb JOIN n9 USING (layer, row_id, s, b)) "
    )


for _scheme, _bits in super_blocks.SCHEMES.items():
    _name = f"quantize_{_scheme.lower()}"
    QUERIES[_name] = lambda spark, sf, b=_bits: rounded(
        _long(super_blocks.quantize_super_blocks(_vectors(spark, sf), b, 8, 4), "layer", "q", "scale_code", "min_code", "dequantized"), 6, "dequantized"
    )
    ORACLE[_name] = (
        _V + _nested(_bits) + "SELECT row_id, pos, layer, CAST(q AS INTEGER) AS q, CAST(scale_code AS INTEGER) AS scale_code, CAST(min_code AS INTEGER) AS min_code, "
        + r("scale * scale_code * q - minimum * min_code", 6) + " AS dequantized FROM nq"
    )


def _nested_error(spark, sf):
    """Errors of the nested schemes beside those of plain groups of the same size."""
    vectors = _vectors(spark, sf)
    parts = [
        super_blocks.quantize_super_blocks(vectors, bits, 8, 4).select(F.lit(name).alias("scheme"), "value", "dequantized")
        for name, bits in super_blocks.SCHEMES.items()
    ]
    parts.append(quantize.quantize_rtn(vectors, 4, 8).select(F.lit("W4-RTN").alias("scheme"), "value", "dequantized"))
    return rounded(quantize.quantization_error(parts[0].union(parts[1]).union(parts[2])), 9, "mse", "max_err")


QUERIES["super_block_error"] = _nested_error
ORACLE["super_block_error"] = (
    _V
    + ", d AS ("
    + " UNION ALL ".join(
        [
            *[_error_branch(name, _nested(bits), "scale * scale_code * q - minimum * min_code") for name, bits in super_blocks.SCHEMES.items()],
            _error_branch("W4-RTN", _rtn(4, "8"), "c * scale"),
        ]
    )
    + f") SELECT scheme, {r('AVG((x - y) * (x - y))', 9)} AS mse, {r('MAX(ABS(x - y))', 9)} AS max_err, COUNT(*) AS n FROM d GROUP BY scheme"
)


# --- a model's norms and the layers that read them -----------------------------------
_ENDS = ["self_attn.q_proj", "self_attn.k_proj", "self_attn.v_proj", "mlp.gate_proj", "mlp.down_proj"]


def _named_layers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels as the layers of two blocks: odd rows are weights, even rows outputs of the norms."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")
    block = F.concat(F.lit("model.layers."), F.floor(F.col("label") / 5).cast("string"), F.lit("."))
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (F.col("label") % 5 + 1).cast("int"))
    norm = F.when(F.col("label") % 5 < 3, "input_layernorm").otherwise("post_attention_layernorm")
    weights = vectors.where(F.col("row_id") % 2 == 1).select(F.concat(block, end).alias("layer"), "row_id", "vec")
    outputs = vectors.where(F.col("row_id") % 2 == 0).select(F.concat(block, norm).alias("layer"), "row_id", "vec")
    modules = weights.select(F.col("layer").alias("name")).union(outputs.select(F.col("layer").alias("name")))
    return weights, outputs, modules


_NAMED = (
    "WITH v AS (SELECT vec_id AS row_id, label, embedding FROM embeddings), "
    "e AS (SELECT row_id, 'model.layers.' || CAST(label // 5 AS VARCHAR) || '.' AS block, label % 5 AS k, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM v), "
    f"w AS (SELECT block || {_ENDS!r}[k + 1] AS layer, block, row_id, pos, x, CASE WHEN k < 3 THEN block || 'input_layernorm' WHEN k = 3 THEN block || 'post_attention_layernorm' END AS norm FROM e WHERE row_id % 2 = 1), "
    "o AS (SELECT block || CASE WHEN k < 3 THEN 'input_layernorm' ELSE 'post_attention_layernorm' END AS norm, pos, x FROM e WHERE row_id % 2 = 0), "
    "f AS (SELECT norm, pos, GREATEST(pow(a, 0.5e0) / pow(b, 0.5e0), 1.0e-5) AS factor FROM (SELECT norm, pos, MAX(ABS(x)) AS a FROM o GROUP BY norm, pos) JOIN (SELECT norm, pos, GREATEST(MAX(ABS(x)), 1.0e-5) AS b FROM w WHERE norm IS NOT NULL GROUP BY norm, pos) USING (norm, pos)) "
)
QUERIES["pair_norms"] = lambda spark, sf: smoothing.pair_norms(_named_layers(spark, sf)[2])
ORACLE["pair_norms"] = _NAMED + "SELECT DISTINCT w.norm, layer AS linear FROM w JOIN o ON o.norm = w.norm"


def _smooth_paired(spark, sf):
    weights, outputs, modules = _named_layers(spark, sf)
    norms = smoothing.activation_scales(outputs).select(
        F.col("layer").alias("norm"), "channel", F.col("scale").alias("weight"), (F.col("scale") / 2.0).alias("bias")
    )
    smoothed, _ = smoothing.smooth_paired(weights, outputs, norms, smoothing.pair_norms(modules))
    long = smoothed.select("layer", "row_id", F.posexplode("vec").alias("pos", "w"))
    return rounded(long.withColumn("pos", F.col("pos").cast("bigint")), 6, "w")


QUERIES["smooth_paired"] = _smooth_paired
ORACLE["smooth_paired"] = _NAMED + f"SELECT layer, row_id, pos, {r('x * COALESCE(factor, 1.0e0)', 6)} AS w FROM w LEFT JOIN f USING (norm, pos)"


# --- clipped calibration ---------------------------------------------------------------
def _clips(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges from two histograms, of even and of odd rows, added up."""
    vectors = _vectors(spark, sf)
    parts = [calibration.channel_histograms(vectors.where(F.col("row_id") % 2 == k)) for k in (0, 1)]
    return calibration.clip_ranges(calibration.merge_histograms(parts), bits=4)


_CLIP = (
    _V
    + f", h AS (SELECT layer, pos, CASE WHEN x <> 0 THEN CAST(CEIL(log2(ABS(x)) * {calibration.STEPS}.0e0) AS INTEGER) END AS bin, ABS(x) AS a FROM e), "
    + "hb AS (SELECT layer, pos, bin, COUNT(*) AS n, SUM(a) AS total, SUM(a * a) AS squares FROM h GROUP BY layer, pos, bin), "
    + f"cand AS (SELECT layer, pos, bin, pow(2.0e0, bin / {calibration.STEPS}.0e0) AS clip, pow(2.0e0, bin / {calibration.STEPS}.0e0) / 7.0e0 AS step FROM hb WHERE bin IS NOT NULL), "
    + f"lc AS (SELECT c.layer, c.pos, c.clip, c.step, n, total, squares, hb.bin AS b, hb.bin > c.bin AS outside, pow(2.0e0, hb.bin / {calibration.STEPS}.0e0) - pow(2.0e0, (hb.bin - 1) / {calibration.STEPS}.0e0) AS width, "
    + "LEAST(round_even(total / n / c.step, 0), 7.0e0) * c.step AS code FROM cand c JOIN hb ON c.layer = hb.layer AND c.pos = hb.pos), "
    + "l AS (SELECT layer, pos, clip, SUM(CASE WHEN b IS NULL THEN 0.0e0 WHEN outside THEN GREATEST(squares - 2 * clip * total + n * clip * clip, 0.0e0) "
    + "WHEN width < step THEN GREATEST(squares - 2 * code * total + n * code * code, 0.0e0) ELSE n * step * step / 12.0e0 END) / SUM(n) AS loss FROM lc GROUP BY layer, pos, clip) "
)
QUERIES["clip_ranges"] = lambda spark, sf: rounded(_channels(_clips(spark, sf)), 9, "clip", "loss", "unclipped_loss")
ORACLE["clip_ranges"] = (
    _CLIP
    + f"SELECT layer, pos AS channel, {r('ARG_MIN(clip, loss)', 9)} AS clip, {r('MIN(loss)', 9)} AS loss, {r('ARG_MAX(loss, clip)', 9)} AS unclipped_loss FROM l GROUP BY layer, pos"
)


def _clipped(spark, sf):
    coded = calibration.quantize_clipped(_vectors(spark, sf), _clips(spark, sf), bits=4)
    return rounded(coded.select("layer", "row_id", F.col("pos").cast("bigint").alias("pos"), "q", "dequantized"), 6, "dequantized")


QUERIES["quantize_clipped"] = _clipped
ORACLE["quantize_clipped"] = (
    _CLIP
    + ", k AS (SELECT layer, pos, ARG_MIN(clip, loss) / 7.0e0 AS step FROM l GROUP BY layer, pos), "
    + "q AS (SELECT layer, row_id, pos, step, GREATEST(LEAST(round_even(x / step, 0), 7.0e0), -7.0e0) AS c FROM e JOIN k USING (layer, pos)) "
    + f"SELECT layer, row_id, pos, CAST(c AS INTEGER) AS q, {r('c * step', 6)} AS dequantized FROM q"
)
