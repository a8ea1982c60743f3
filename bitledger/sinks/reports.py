"""Result tables as fixed-width text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.functions.columns import round_half_up


def _left(text: Column, width: int) -> Column:
    """Pad on the right; longer text is kept whole."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def _right(text: Column, width: int) -> Column:
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def number_text(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals; null stays null."""
    shown = F.format_string(f"%.{digits}f", round_half_up(value.cast("double"), digits))
    return F.when(value.isNotNull(), shown)


def _signed_text(value: Column, digits: int) -> Column:
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), number_text(value, digits))


def accuracy_lines(
    table: DataFrame, name_widths: dict[str, int], delta_col: str, tasks: list[str] = fixed.TASKS
) -> DataFrame:
    """Accuracy table as ``(ord, line)``: scores with 4 decimals, ``-`` where missing."""
    missing = F.lit("-")
    cells = [_left(F.col(name), width) for name, width in name_widths.items()]
    cells += [_right(F.coalesce(number_text(F.col(t), 4), missing), fixed.SCORE_WIDTH) for t in [*tasks, "avg"]]
    delta = F.col(delta_col)
    cells.append(
        F.when(delta.isNull(), F.lpad(missing, fixed.DELTA_WIDTH, " ")).otherwise(
            F.concat(_right(_signed_text(delta, 2), fixed.DELTA_WIDTH - 1), F.lit("pp"))
        )
    )
    cells.append(_right(F.coalesce("_status", F.lit("?")), fixed.STATUS_WIDTH))
    return table.select("ord", F.concat(*cells).alias("line"))


def heading(columns: list[tuple[str, int, str]], gap: str = "") -> str:
    """One line of titles from (title, width, side), side being ``<`` or ``>``."""
    return gap.join(f"{title:{side}{width or ''}}" for title, width, side in columns)


def accuracy_header(name_titles: dict[str, int], delta_title: str) -> str:
    """The heading that goes with :func:`accuracy_lines`."""
    scores = [*(fixed.SHORT_TASK_NAMES[t] for t in fixed.TASKS), "Avg"]
    return heading(
        [(title, width, "<") for title, width in name_titles.items()]
        + [(title, fixed.SCORE_WIDTH, ">") for title in scores]
        + [(delta_title, fixed.DELTA_WIDTH, ">"), ("Status", fixed.STATUS_WIDTH, ">")]
    )


def run_header() -> list[str]:
    """The two lines ahead of :func:`run_lines`."""
    titles = heading([(title, width, "<") for title, width in fixed.RUN_REPORT_COLUMNS], " ")
    return [titles, "-" * fixed.RUN_REPORT_RULE]


def run_lines(runs: DataFrame, order_cols: list[str]) -> DataFrame:
    """Benchmark runs as text lines; a missing or zero perplexity prints as ``N/A``, any other
    missing value as ``-``.

    Lines keep their order columns and are not numbered, which would need a global order.
    """
    ppl = F.col("perplexity")
    shown = F.when(ppl.isNull() | (ppl == 0), F.lit("N/A")).otherwise(number_text(ppl, 2))

    def cell(value: Column, width: int) -> Column:
        return _left(F.coalesce(value, F.lit("-")), width)

    cells = [
        F.col("method"),
        number_text(F.col("latency_ms"), 1),
        number_text(F.col("throughput_tok_per_sec"), 1),
        number_text(F.col("peak_memory_mb"), 1),
    ]
    widths = [width for _, width in fixed.RUN_REPORT_COLUMNS]
    line = F.concat_ws(" ", *[cell(value, width) for value, width in zip(cells, widths)], shown)
    return runs.select(*order_cols, line.alias("line"))


def engine_lines(
    table: DataFrame, baseline: float = fixed.BASELINE_TOKENS_PER_SECOND
) -> DataFrame:
    """Engine results as ``(label, ord, line)``: a block of ten lines per label."""

    def num(name: str, digits: int) -> Column:
        return number_text(F.col(name), digits)

    texts = [
        F.col("label"),
        F.concat(num("prompt_eval_tok_s", 2), F.lit(" ± "), num("prompt_eval_std", 2), F.lit(" tok/s")),
        F.concat(num("generation_tok_s", 2), F.lit(" ± "), num("generation_std", 2), F.lit(" tok/s")),
        F.concat(num("latency_total_ms", 1), F.lit(" ms")),
        F.concat(num("throughput_overall_tok_s", 2), F.lit(" tok/s")),
        F.concat(
            F.col("peak_ram_mb").cast("string"), F.lit(" MB  (Δ "), F.col("ram_delta_mb").cast("string"), F.lit(" MB)")
        ),
        F.concat(num("avg_power_mw", 0), F.lit(" mW  ("), F.col("n_samples").cast("string"), F.lit(" samples)")),
        F.concat(num("avg_gpu_util_pct", 1), F.lit(" %")),
        F.concat(num("energy_per_token_mj", 2), F.lit(" mJ")),
        F.concat(num("speedup_vs_hf_fp16", 2), F.lit(f"x  (HF baseline = {baseline} tok/s)")),
    ]
    width = fixed.ENGINE_REPORT_WIDTH
    lines = F.array(
        *[F.concat(F.lit(f"  {title:<{width}}: "), text) for title, text in zip(fixed.ENGINE_REPORT_TITLES, texts)]
    )
    return table.select("label", F.posexplode(lines).alias("ord", "line"))
