"""Clipped calibration against an exact search, nested scales and norm pairs against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitledger.operators import calibration as cal
from bitledger.operators import quantize, smoothing, super_blocks

SCHEMA = "layer string, row_id bigint, vec array<double>"


def rows_of(spark, x, layer="a"):
    return spark.createDataFrame([(layer, k, v.tolist()) for k, v in enumerate(x)], SCHEMA)


def exact(values, bits):
    """The same search over the values themselves: what each clip really loses."""
    size, top = np.abs(values), 2 ** (bits - 1) - 1
    places = np.ceil(np.log2(size[size > 0]) * cal.STEPS)
    losses = {}
    for clip in sorted(2 ** (p / cal.STEPS) for p in set(places)):
        step = clip / top
        losses[clip] = ((size - np.minimum(np.rint(size / step), top) * step) ** 2).mean()
    return losses


@pytest.mark.parametrize("bits", [3, 4, 8])
def test_clips_equal_the_exact_search(spark, bits):
    """Few distinct values, so that the values of a bin have one code."""
    rng = np.random.default_rng(2)
    grid = np.exp(np.linspace(-4, 4, 60))
    x = rng.choice(grid, size=(300, 5), p=(w := grid**-0.7) / w.sum()) * rng.choice([-1, 1], size=(300, 5)) * [1, 10, 1e-3, 0, 1]
    x[::7, 4] = 0
    whole = {r.channel: r for r in cal.clip_ranges(cal.channel_histograms(rows_of(spark, x)), bits).collect()}
    parts = [cal.channel_histograms(rows_of(spark, part)) for part in (x[:100], x[100:101], x[101:])]
    merged = {r.channel: r for r in cal.clip_ranges(cal.merge_histograms(parts), bits).collect()}
    for c in range(5):
        if c == 3:
            assert (whole[c].clip, whole[c].loss, whole[c].unclipped_loss) == (0, 0, 0)
            continue
        losses = exact(x[:, c], bits)
        best = min(losses, key=lambda k: (losses[k], -k))
        assert merged[c].clip == pytest.approx(whole[c].clip) and merged[c].loss == pytest.approx(whole[c].loss)
        chosen = min(losses, key=lambda k: abs(k - whole[c].clip))
        # With eight bits, steps are finer than the widest bins.
        assert losses[chosen] <= losses[best] * (1.05 if bits == 8 else 1 + 1e-9)
        if bits < 8:
            assert whole[c].clip == pytest.approx(best) and whole[c].loss == pytest.approx(losses[best])
            assert whole[c].unclipped_loss == pytest.approx(losses[max(losses)])


def test_clipped_codes_lose_less_than_the_full_range(spark):
    x = np.random.default_rng(3).uniform(-1, 1, size=(3000, 3))
    x[7], x[5, 1] = 3, np.nan
    rows = rows_of(spark, x)
    ranges = cal.clip_ranges(cal.channel_histograms(rows), 4)
    coded = cal.quantize_clipped(rows, ranges, 4).where(~F.isnan("value"))
    clipped = coded.agg(F.avg(F.pow(F.col("value") - F.col("dequantized"), 2))).first()[0]
    steps = np.nanmax(np.abs(x), axis=0) / 7
    full = np.nanmean((x - np.rint(x / steps) * steps) ** 2)
    assert clipped < 0.5 * full
    none = cal.quantize_clipped(rows, ranges.where("channel <> 2"), 4).where("pos = 2").select("q").distinct().collect()
    assert [r.q for r in none] == [None]
    assert cal.clip_ranges(cal.channel_histograms(rows.limit(0))).count() == 0


def nested(x, bits, block, blocks):
    top, out = 2**bits - 1, np.zeros(len(x))
    for s in range(0, len(x), block * blocks):
        part = x[s : s + block * blocks]
        fits = []
        for k in range(0, len(part), block):
            v = part[k : k + block]
            low = min(v.min(), 0.0)
            scale, minimum = (v.max() - low) / top, -low
            q = np.clip(np.rint((v + minimum) / scale), 0, top) if scale > 0 else np.zeros(len(v))
            n, sq, sx, qq, qx = len(v), q.sum(), v.sum(), (q * q).sum(), (q * v).sum()
            a, b = 0.0, 0.0
            if n * qq - sq * sq > 0 and (slope := (n * qx - sq * sx) / (n * qq - sq * sq)) * sq - sx >= 0:
                a, b = slope, (slope * sq - sx) / n
            elif qq > 0:
                a = qx / qq
            if a > 0 and ((v - (a * q - b)) ** 2).sum() < ((v - (scale * q - minimum)) ** 2).sum():
                scale, minimum = a, b
            fits.append((scale, minimum))
        d, m = max(f[0] for f in fits) / 63, max(f[1] for f in fits) / 63
        for k, (scale, minimum) in enumerate(fits):
            step = d * (np.rint(scale / d) if d > 0 else 0)
            shift = m * (np.rint(minimum / m) if m > 0 else 0)
            v = part[k * block : (k + 1) * block]
            q = np.clip(np.rint((v + shift) / step), 0, top) if step > 0 else 0 * v
            out[s + k * block : s + k * block + len(v)] = step * q - shift
    return out


@pytest.mark.parametrize("bits", [4, 5])
def test_nested_scales_equal_numpy_and_lose_less_than_one_scale(spark, bits):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=n) * np.exp(rng.normal()) for n in (64, 70, 5, 300, 33)] + [np.zeros(40), np.full(40, 2.5), -np.arange(40.0)]
    rows = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(x)] + [("a", 90, None), ("a", 91, [])], SCHEMA)
    found = {}
    for r in super_blocks.quantize_super_blocks(rows, bits, 8, 4).collect():
        found.setdefault(r.row_id, {})[r.pos] = (r.value, r.dequantized)
    assert set(found) == set(range(len(x)))
    for k, v in enumerate(x):
        got = [found[k][p] for p in range(len(v))]
        assert [a for a, _ in got] == v.tolist()
        assert [b for _, b in got] == pytest.approx(nested(v, bits, 8, 4).tolist(), abs=1e-9)
    big = rows.where("row_id = 3")
    fine = super_blocks.quantize_super_blocks(big, bits, 32, 8).select(F.lit("nested").alias("scheme"), "value", "dequantized")
    plain = quantize.quantize_rtn(big, bits, 256).select(F.lit("plain").alias("scheme"), "value", "dequantized")
    mse = {r.scheme: r.mse for r in quantize.quantization_error(fine.union(plain)).collect()}
    assert mse["nested"] < 0.7 * mse["plain"]


def test_norm_pairs_and_smoothing_keep_the_outputs(spark):
    names = ["model.layers.0.input_layernorm", "model.layers.0.post_attention_layernorm", "model.layers.1.input_layernorm", "model.norm", None]
    names += [f"model.layers.{b}.{e}" for b in (0, 1) for e in ("self_attn.q_proj", "self_attn.v_proj", "mlp.up_proj", "mlp.down_proj")]
    names += ["h.3.ln_1", "h.3.attn.c_attn", "h.4.attn.c_attn"]
    modules = spark.createDataFrame([(n,) for n in names * 2], "name string")
    pairs = smoothing.pair_norms(modules)
    assert sorted(map(tuple, pairs.collect())) == [
        ("h.3.ln_1", "h.3.attn.c_attn"),
        ("model.layers.0.input_layernorm", "model.layers.0.self_attn.q_proj"),
        ("model.layers.0.input_layernorm", "model.layers.0.self_attn.v_proj"),
        ("model.layers.0.post_attention_layernorm", "model.layers.0.mlp.up_proj"),
        ("model.layers.1.input_layernorm", "model.layers.1.self_attn.q_proj"),
        ("model.layers.1.input_layernorm", "model.layers.1.self_attn.v_proj"),
    ]
    rng = np.random.default_rng(5)
    layers = ["model.layers.0.self_attn.q_proj", "model.layers.0.self_attn.v_proj", "model.layers.0.mlp.down_proj"]
    w = {n: rng.normal(size=(4, 6)) for n in layers}
    norm, y = "model.layers.0.input_layernorm", rng.normal(size=(20, 6)) * [1, 5, 0.1, 1, 1, 30]
    weights = spark.createDataFrame([(n, k, v.tolist()) for n, m in w.items() for k, v in enumerate(m)], SCHEMA)
    norms = spark.createDataFrame([(norm, c, 1.0 + c, 0.5) for c in range(6)] + [("model.norm", 0, 2.0, 3.0)], "norm string, channel int, weight double, bias double")
    smoothed, scaled = smoothing.smooth_paired(weights, rows_of(spark, y, norm), norms, pairs)
    by_channel = {(r.norm, r.channel): r for r in scaled.collect()}
    factors = np.array([(1.0 + c) / by_channel[norm, c].weight for c in range(6)])
    top = np.maximum(np.abs(w[layers[0]]).max(0), np.abs(w[layers[1]]).max(0))
    assert factors == pytest.approx(np.sqrt(np.abs(y).max(0) / top))
    assert (by_channel["model.norm", 0].weight, by_channel["model.norm", 0].bias) == (2.0, 3.0)
    for r in smoothed.collect():
        want = w[r.layer][r.row_id]
        assert r.vec == pytest.approx(want if r.layer.endswith("down_proj") else want * factors)
    assert by_channel[norm, 3].bias == pytest.approx(0.5 / factors[3])
