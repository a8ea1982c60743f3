"""Engine performance per label from engine tests and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import round_half_up


def telemetry_summary(samples: DataFrame) -> DataFrame:
    """Mean power, peak memory, memory growth since the first sample and mean GPU load.

    Plain aggregates only: they combine before the shuffle and run on streams as well.
    """
    first_ram = F.min_by("ram_mb", F.when(F.col("ram_mb").isNotNull(), F.col("seq")))
    peak = F.coalesce(F.max("ram_mb"), F.lit(0))
    return samples.groupBy("label").agg(
        F.coalesce(F.avg("power_mw"), F.lit(0.0)).alias("avg_power_mw"),
        peak.alias("peak_ram_mb"),
        (peak - F.coalesce(first_ram, F.lit(0))).alias("ram_delta_mb"),
        F.coalesce(F.avg("gpu_pct"), F.lit(0.0)).alias("avg_gpu_util_pct"),
        F.count("power_mw").alias("n_samples"),
    )


def pick_engine_test(tests: DataFrame, prefix: str) -> DataFrame:
    """First test of a kind per label: by name (``pp``, ``tg``) or by what it processes."""
    done, other = ("n_prompt", "n_gen") if prefix == "pp" else ("n_gen", "n_prompt")
    by_name = ~F.col("name_is_number") & F.col("name").startswith(prefix)
    by_shape = (F.col(done) > 0) & (F.col(other) == 0)
    position = F.when(by_name | by_shape, F.col("first_pos"))
    return tests.groupBy("label").agg(
        F.coalesce(F.min_by("avg_ts", position), F.lit(0.0)).alias(f"{prefix}_tok_s"),
        F.coalesce(F.min_by("stddev_ts", position), F.lit(0.0)).alias(f"{prefix}_std"),
    )


def engine_metrics(
    df: DataFrame,
    prompt_tokens: int = fixed.PROMPT_TOKENS,
    gen_tokens: int = fixed.GENERATE_TOKENS,
    baseline_tok_s: float = fixed.BASELINE_TOKENS_PER_SECOND,
) -> DataFrame:
    """Latency, throughput, energy per token and speed-up; all 0.0 unless both rates are known."""
    pp, tg = F.col("pp_tok_s"), F.col("tg_tok_s")
    known = (pp != 0) & (tg != 0)
    latency = (F.lit(float(prompt_tokens)) / pp + F.lit(float(gen_tokens)) / tg) * 1000.0
    gen = F.lit(float(gen_tokens))
    derived = df.withColumn("latency_total_ms", F.when(known, latency).otherwise(0.0))
    lat = F.col("latency_total_ms")
    derived = derived.withColumns(
        {
            "throughput_overall_tok_s": F.when(known, gen / (lat / 1000.0)).otherwise(0.0),
            "energy_per_token_mj": F.when(
                lat != 0, F.col("avg_power_mw") * lat / gen / 1000.0
            ).otherwise(0.0),
        }
    )
    speedup = (
        F.col("throughput_overall_tok_s") / F.lit(float(baseline_tok_s))
        if baseline_tok_s
        else F.lit(0.0)
    )
    return derived.withColumn("speedup_vs_hf_fp16", speedup)


def engine_rates(tests: DataFrame, samples: DataFrame) -> DataFrame:
    """Picked test rates and telemetry of each label; a label without telemetry reads 0."""
    rates = pick_engine_test(tests, "pp").join(pick_engine_test(tests, "tg"), "label")
    zeros = {
        "avg_power_mw": 0.0,
        "peak_ram_mb": 0,
        "ram_delta_mb": 0,
        "avg_gpu_util_pct": 0.0,
        "n_samples": 0,
    }
    return rates.join(telemetry_summary(samples), "label", "left").na.fill(zeros)


def engine_performance_table(
    tests: DataFrame,
    samples: DataFrame,
    prompt_tokens: int = fixed.PROMPT_TOKENS,
    gen_tokens: int = fixed.GENERATE_TOKENS,
    baseline_tok_s: float = fixed.BASELINE_TOKENS_PER_SECOND,
) -> DataFrame:
    """One rounded row per label, with ``n_samples`` for the report."""
    metrics = engine_metrics(
        engine_rates(tests, samples), prompt_tokens, gen_tokens, baseline_tok_s
    )

    def rounded(column: str, digits: int, name: str | None = None):
        return round_half_up(F.col(column), digits).alias(name or column)

    return metrics.select(
        "label",
        rounded("pp_tok_s", 2, "prompt_eval_tok_s"),
        rounded("pp_std", 2, "prompt_eval_std"),
        rounded("tg_tok_s", 2, "generation_tok_s"),
        rounded("tg_std", 2, "generation_std"),
        rounded("latency_total_ms", 1),
        rounded("throughput_overall_tok_s", 2),
        "peak_ram_mb",
        "ram_delta_mb",
        rounded("avg_power_mw", 0),
        rounded("energy_per_token_mj", 2),
        rounded("avg_gpu_util_pct", 1),
        rounded("speedup_vs_hf_fp16", 2),
        "n_samples",
    )
