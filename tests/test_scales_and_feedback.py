"""Scale search and rounding with error feedback against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitledger.operators import error_feedback as ef
from bitledger.operators import quantize, scale_search

SCHEMA = "layer string, row_id bigint, vec array<float>"


def tables(spark, seed=0, rows=12, samples=40, width=24):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(width, width)) * np.exp(rng.normal(size=width))
    x = {name: (rng.normal(size=(samples, width)) @ mixing).astype(np.float32) for name in ("a", "b")}
    w = {name: rng.normal(size=(rows, width)).astype(np.float32) for name in ("a", "b")}
    frames = [
        spark.createDataFrame([(n, k, v.tolist()) for n, m in part.items() for k, v in enumerate(m)], SCHEMA) for part in (x, w)
    ]
    return x, w, *frames


def zero_point(v, bits=4):
    scale = max(v.max() - v.min(), 1e-5) / (2**bits - 1)
    zero = np.clip(-np.rint(v.min() / scale), 0, 2**bits - 1)
    return (np.clip(np.rint(v / scale) + zero, 0, 2**bits - 1) - zero) * scale


def test_scale_search_equals_numpy(spark):
    x, w, samples, weights = tables(spark)
    found = {(r.layer, r.step): r for r in scale_search.scale_errors(weights, samples, group_size=7).collect()}
    elements = scale_search.quantize_scaled(weights, samples, group_size=7).collect()
    for name in x:
        mean, square = np.abs(x[name].astype(float)).mean(0), (x[name].astype(float) ** 2).mean(0)
        errors, results = [], []
        for step in range(scale_search.STEPS):
            s = np.maximum(mean, 1e-4) ** (step / scale_search.STEPS)
            s = s / np.sqrt(s.max() * s.min())
            v = w[name].astype(float) * s
            back = np.array([np.concatenate([zero_point(r[k : k + 7]) for k in range(0, 24, 7)]) for r in v]) / s
            errors.append((((back - w[name]) ** 2) * square).mean())
            results.append(back)
            assert found[name, step].error == pytest.approx(errors[-1])
        best = int(np.argmin(errors))
        assert [k for k in range(scale_search.STEPS) if found[name, k].best] == [best] and best > 0
        got = np.zeros_like(results[best])
        for r in elements:
            if r.layer == name:
                got[r.row_id, r.pos] = r.dequantized
        assert np.allclose(got, results[best])


def test_layers_without_samples_and_channels_without_values(spark):
    _, _, samples, weights = tables(spark)
    short = samples.where("layer = 'a'").withColumn("vec", F.slice("vec", 1, 20))
    errors = scale_search.scale_errors(weights, short, group_size=8)
    assert {r.layer for r in errors.collect()} == {"a"}
    assert scale_search.quantize_scaled(weights, short, group_size=8).where("layer = 'a'").count() == 12 * 24
    assert scale_search.scale_errors(weights, samples.limit(0)).count() == 0


def plain_feedback(w, x, bits, size, damping=ef.DAMPING):
    """One row and one column at a time, with the inverse of what is left taken anew."""
    gram = x.T @ x
    np.fill_diagonal(gram, np.where(gram.diagonal() == 0, 1, gram.diagonal()))
    gram += damping * gram.diagonal().mean() * np.eye(len(gram))
    out, ties = np.zeros(w.shape, int), np.zeros(len(w), bool)
    for r, row in enumerate(w.astype(float).copy()):
        for k in range(len(row)):
            if k % size == 0:
                scale = np.abs(row[k : k + size]).max() / ((2**bits - 1) / 2)
            ratio = row[k] / scale if scale else 0
            ties[r] |= abs(abs(ratio) % 1 - 0.5) < 1e-6
            q = np.clip(np.rint(ratio), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
            inverse = np.linalg.inv(gram[k:, k:])
            row[k:] -= (row[k] - q * scale) / inverse[0, 0] * inverse[0]
            out[r, k] = q
    return out, ties


@pytest.mark.parametrize("bits, size", [(4, 8), (3, 24), (4, 5)])
def test_feedback_equals_brute_force(spark, bits, size):
    x, w, samples, weights = tables(spark, 3)
    rows = ef.quantize_with_feedback(weights, samples, bits, size).collect()
    for name in x:
        # A group's largest weight stands on a tie, where the last bit of a product decides.
        want, ties = plain_feedback(w[name].astype(float), x[name].astype(float), bits, size)
        got = np.zeros_like(want)
        for r in rows:
            if r.layer == name:
                got[r.row_id, r.pos] = r.q
                assert r.dequantized == r.q * r.scale and r.value == w[name][r.row_id, r.pos]
        assert (got == want)[~ties].all() and (~ties).sum() >= 3
        assert (got == want)[:, 0].all()


def test_feedback_loses_less_than_rounding(spark, monkeypatch):
    monkeypatch.setattr(ef, "BLOCK_ROWS", 5)
    x, w, samples, weights = tables(spark, 5, width=150, samples=200)
    columns = ["layer", "row_id", "pos", "value", "dequantized"]
    plain = quantize.quantize_rtn(weights, 4, 8).select(F.lit("plain").alias("scheme"), *columns)
    moved = ef.quantize_with_feedback(weights, samples, 4, 8).select(F.lit("moved").alias("scheme"), *columns)
    found = {(r.layer, r.scheme): r.output_mse for r in ef.output_error(plain.union(moved), samples).collect()}
    for name in x:
        assert found[name, "moved"] < 0.7 * found[name, "plain"]
        e = np.zeros(w[name].shape)
        for r in plain.where(F.col("layer") == name).collect():
            e[r.row_id, r.pos] = r.value - r.dequantized
        assert found[name, "plain"] == pytest.approx(((x[name].astype(float) @ e.T) ** 2).mean())


def test_odd_rows(spark):
    _, _, samples, weights = tables(spark)
    odd = spark.createDataFrame(
        [("a", 90, None), ("a", 91, []), ("a", 92, [1.0, -2.0]), ("c", 93, [1.0] * 24), (None, 94, [0.5] * 24), ("a", 0, [0.0] * 24), ("a", 0, [0.0] * 24)],
        SCHEMA,
    )
    rows = ef.quantize_with_feedback(weights.union(odd), samples, 4, 8).groupBy("layer", "row_id").count().collect()
    held = {(r.layer, r.row_id): r["count"] for r in rows}
    assert held["a", 92] == 2 and held["c", 93] == 24 and held[None, 94] == 24 and held["a", 0] == 72
    assert ("a", 90) not in held and ("a", 91) not in held
    alone = ef.quantize_with_feedback(odd.where("row_id = 92"), samples, 4, 8).orderBy("pos").collect()
    assert [r.q for r in alone] == [4, -8] and ef.quantize_with_feedback(weights.limit(0), samples).count() == 0
