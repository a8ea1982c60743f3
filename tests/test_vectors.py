import numpy as np
import pytest

from bitledger.functions import fixed_values as fixed
from bitledger.operators import quantize, smoothing

ROWS = "layer string, row_id long, vec array<float>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(40, 96)).astype(np.float32)
    matrix[3] = 0.0
    return matrix


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(
        [(f"fc{i % 2}", i, v.tolist()) for i, v in enumerate(data)], ROWS
    ).cache()


def matrix_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row_id", "pos", column).collect():
        out[r.row_id, r.pos] = r[column]
    return out


@pytest.mark.parametrize("bits, group", [(4, 32), (8, None), (4, 40), (4, 128)])
def test_rtn(rows, data, bits, group):
    df = quantize.quantize_rtn(rows, bits, group)
    codes, back = matrix_of(df, "q", data.shape), matrix_of(df, "dequantized", data.shape)
    size = group or data.shape[1]
    for begin in range(0, data.shape[1], size):
        block = data[:, begin : begin + size].astype(float)
        scale = np.abs(block).max(axis=1, keepdims=True) / ((2**bits - 1) / 2)
        want = np.clip(np.rint(np.divide(block, scale, out=np.zeros_like(block), where=scale > 0)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
        assert np.array_equal(codes[:, begin : begin + size], want)
        assert np.all(np.abs(back[:, begin : begin + size] - block) <= scale / 2 + 1e-12)


@pytest.mark.parametrize("bits", [3, 4])
def test_zero_point(rows, data, bits):
    back = matrix_of(quantize.quantize_zero_point(rows, bits, 48), "dequantized", data.shape)
    top = 2**bits - 1
    for begin in (0, 48):
        block = data[:, begin : begin + 48].astype(float)
        low, high = block.min(axis=1, keepdims=True), block.max(axis=1, keepdims=True)
        scale = np.maximum(high - low, 1e-5) / top
        zero = np.clip(-np.rint(low / scale), 0, top)
        want = (np.clip(np.rint(block / scale) + zero, 0, top) - zero) * scale
        assert np.allclose(back[:, begin : begin + 48], want)


def test_nf4(rows, data):
    df = quantize.quantize_nf4(rows, 32)
    codes, back = matrix_of(df, "code", data.shape), matrix_of(df, "dequantized", data.shape)
    levels = np.array(fixed.NF4_LEVELS)
    for begin in (0, 32, 64):
        block = data[:, begin : begin + 32].astype(float)
        top = np.abs(block).max(axis=1, keepdims=True)
        unit = np.divide(block, top, out=np.zeros_like(block), where=top > 0)
        want = np.abs(unit[..., None] - levels).argmin(axis=-1)
        assert np.array_equal(codes[:, begin : begin + 32], want)
        assert np.allclose(back[:, begin : begin + 32], levels[want] * top)


def test_double_quantized_scales_stay_close(rows):
    scales = quantize.double_quantize_scales(rows, 32, scales_per_block=16).collect()
    assert len(scales) == 120
    for r in scales:
        assert abs(r.dequantized - r.absmax) <= r.scale / 2 + 1e-12 and -128 < r.q < 128


def test_int8_rows(rows, data):
    for r in quantize.quantize_int8_rows(rows).collect():
        assert np.all(np.abs(np.array(r.q) * r.scale - data[r.row_id]) <= r.scale / 2 + 1e-9)
        assert max(map(abs, r.q)) == (127 if r.scale > 0 else 0)


def test_errors_of_all_schemes_match_the_single_ones(rows):
    errors = {r.scheme: r for r in quantize.quantization_error(quantize.quantize_all_schemes(rows)).collect()}
    single = {
        "W4A16": quantize.quantize_rtn(rows, 4, 128),
        "W8A16": quantize.quantize_rtn(rows, 8, None),
        "AWQ-W4": quantize.quantize_zero_point(rows, 4, 128),
        "NF4": quantize.quantize_nf4(rows, 64),
    }
    for name, df in single.items():
        back = df.selectExpr("avg((value - dequantized) * (value - dequantized)) m", "max(abs(value - dequantized)) e").first()
        assert errors[name].mse == pytest.approx(back.m) and errors[name].max_err == pytest.approx(back.e)
    assert errors["W8A16"].mse < errors["W4A16"].mse


def test_smoothing_keeps_the_product(spark, rows, data):
    act = smoothing.activation_scales(rows.where("layer = 'fc0'"))
    factors = smoothing.smoothing_factors(act, smoothing.weight_scales(rows)).cache()
    s = np.array([r.factor for r in factors.orderBy("channel").collect()])
    even = np.abs(data[::2]).max(axis=0).astype(float)
    want = np.maximum(np.sqrt(even) / np.sqrt(np.maximum(np.abs(data).max(axis=0), 1e-5)), 1e-5)
    assert np.allclose(s, want)
    norm = spark.createDataFrame([(i, 1.0, 0.5) for i in range(96)], "channel int, weight double, bias double")
    weights, scaled = smoothing.apply_smoothing(rows, norm, factors)
    gains = np.array([r.weight for r in scaled.orderBy("channel").collect()])
    for r in weights.collect():
        assert np.allclose(np.array(r.vec) * gains, data[r.row_id])


def test_smoothing_by_group_and_by_channel(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 2.0, 4.0]), ("b", 0, [4.0, 9.0, 16.0])], ROWS)
    factors = spark.createDataFrame(
        [("a", 0, 2.0), ("a", 2, 10.0), ("b", 1, 3.0)], "layer string, channel int, factor double"
    )
    norm = spark.createDataFrame(
        [(g, c, 60.0, 30.0) for g in "ab" for c in range(3)], "layer string, channel int, weight double, bias double"
    )
    weights, scaled = smoothing.apply_smoothing(rows, norm, factors, keys=("layer",))
    assert {r.layer: r.vec for r in weights.collect()} == {"a": [2.0, 2.0, 40.0], "b": [4.0, 27.0, 16.0]}
    got = {(r.layer, r.channel): (r.weight, r.bias) for r in scaled.collect()}
    assert got["a", 0] == (30.0, 15.0) and got["a", 1] == (60.0, 30.0) and got["b", 1] == (20.0, 10.0)
    alone, _ = smoothing.apply_smoothing(rows, norm, factors.where("layer = 'a'").drop("layer"))
    assert {r.layer: r.vec for r in alone.collect()} == {"a": [2.0, 2.0, 40.0], "b": [8.0, 9.0, 160.0]}
    scales = smoothing.weight_scales(rows, keys=("layer",))
    assert {(r.layer, r.channel): r.scale for r in scales.collect()}["b", 2] == 16.0


def test_count_parameters(rows):
    counts = {r.layer: r.n for r in quantize.count_parameters(rows).collect()}
    assert counts == {"fc0": 20 * 96, "fc1": 20 * 96, "total": 40 * 96}


def test_empty_vectors_and_uneven_rows(spark):
    df = spark.createDataFrame([("a", 0, []), ("a", 1, [1.0]), ("a", 2, [2.0, -4.0, 1.0])], ROWS)
    got = {(r.row_id, r.pos): r.q for r in quantize.quantize_rtn(df, 4, 2).collect()}
    assert got == {(1, 0): 7, (2, 0): 4, (2, 1): -8, (2, 2): 7}
