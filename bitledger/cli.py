"""Command line: ``python -m bitledger.cli <command> ...``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed
from bitledger.operators import pivots
from bitledger.operators.merge import with_labels
from bitledger.plans import accuracy_tables, engine_tables, perplexity_run, results
from bitledger.schemas import BENCHMARK_RUN
from bitledger.session import build_session
from bitledger.sinks import reports, tables
from bitledger.sources.runs import read_benchmark_csv


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="bitledger")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_text: str, **options: dict) -> None:
        sub = commands.add_parser(name, help=help_text)
        for option, settings in options.items():
            sub.add_argument("--" + option.replace("_", "-"), **settings)

    command(
        "analyze", "merge runs and perplexities and write the tables behind the charts",
        benchmark_glob={"default": "./results/benchmark_*.csv"},
        ppl_glob={"default": "./results/eval/*__ppl_*.json"},
        output_dir={"required": True},
    )
    for name, prefix in [
        ("accuracy-by-method", fixed.METHOD_FILE_PREFIX),
        ("accuracy-by-scheme", fixed.SCHEME_FILE_PREFIX),
    ]:
        command(
            name, "accuracy table from result files",
            results={"required": True, "help": "path or glob of the result files"},
            prefix={"default": prefix},
            output={"required": True},
        )
    command(
        "engine-summary", "engine performance of all labels, appended to a CSV table",
        bench_json={"required": True}, telemetry_log={"required": True}, csv={"default": None},
    )
    command(
        "perplexity", "perplexity of a corpus under the add-one unigram model",
        model_path={"required": True}, method={"default": "fp16"},
        dataset={"default": "wikitext2"}, corpus={"required": True, "help": "Parquet path or table"},
        output={"default": None},
    )
    command(
        "run-report", "benchmark runs as text lines in order of their time",
        runs={"default": "./results/benchmark_*.csv"},
    )
    return parser


def _show(lines: DataFrame) -> None:
    """Print a report; its lines come to the driver part by part."""
    order = [c for c in lines.columns if c != "line"] or ["line"]
    for row in lines.orderBy(*order).toLocalIterator():
        print(row.line)


def _analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    merged = with_labels(results.load_results(spark, args.benchmark_glob, args.ppl_glob))
    tables.write_results_csv(merged, f"{args.output_dir}/merged")
    # The charts read the written table, so the merge runs once.
    merged = spark.read.schema(merged.schema).option("header", True).csv(f"{args.output_dir}/merged")
    for metric, column in [
        ("latency_ms", "method_label"),
        ("throughput_tok_per_sec", "method_label"),
        ("perplexity", "method_scheme"),
    ]:
        if metric in merged.columns:
            table = pivots.pivot_metric(merged, metric, "model_family", column)
            tables.write_results_csv(table, f"{args.output_dir}/{metric}")
    if {"peak_memory_mb", "perplexity"} <= set(merged.columns):
        points = pivots.memory_perplexity_points(merged)
        tables.write_results_csv(points, f"{args.output_dir}/memory_perplexity")


def _accuracy(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "accuracy-by-method":
        table = accuracy_tables.accuracy_by_method_files(spark, args.results, args.prefix)
        columns, delta = accuracy_tables.METHOD_TABLE_COLUMNS, "delta_vs_fp16_pp"
        names, titles, title = {"method": 14, "bits": 8}, {"Method": 14, "Bits": 8}, "Δ vs FP16"
    else:
        table = accuracy_tables.accuracy_by_scheme_files(spark, args.results, args.prefix)
        columns, delta = accuracy_tables.SCHEME_TABLE_COLUMNS, "delta_vs_f16_gguf_pp"
        names, titles, title = {"scheme": 10}, {"Scheme": 10}, "Δ vs F16"
    table = table.cache()  # a row per label, printed and written
    print(reports.accuracy_header(titles, title))
    _show(reports.accuracy_lines(table, names, delta))
    tables.write_table_csv(table, columns, args.output, one_file=True)


def _engine(spark: SparkSession, args: argparse.Namespace) -> None:
    table = engine_tables.engine_summary(spark, args.bench_json, args.telemetry_log).cache()
    if args.csv:
        engine_tables.append_engine_summary(table, args.csv)
    _show(reports.engine_lines(table))


def _perplexity(spark: SparkSession, args: argparse.Namespace) -> None:
    start = time.perf_counter()
    row = perplexity_run.perplexity_result(
        spark, args.model_path, args.method, args.dataset, {args.dataset: args.corpus}
    ).cache()  # one row, printed and written
    row.count()
    row = row.withColumn("eval_time_s", F.lit(round(time.perf_counter() - start, 2)))
    if args.output:
        tables.write_results_json(row, args.output)
    _show(row.select(F.to_json(F.struct("*")).alias("line")))


def _run_report(spark: SparkSession, args: argparse.Namespace) -> None:
    runs = read_benchmark_csv(spark, args.runs)
    lacking = [f for f in BENCHMARK_RUN if f.name not in runs.columns]
    runs = runs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking})
    for line in reports.run_header():
        print(line)
    _show(reports.run_lines(runs, ["timestamp", "model_name"]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    run = {
        "analyze": _analyze,
        "accuracy-by-method": _accuracy,
        "accuracy-by-scheme": _accuracy,
        "engine-summary": _engine,
        "perplexity": _perplexity,
        "run-report": _run_report,
    }[args.command]
    run(spark or build_session(), args)


if __name__ == "__main__":
    main()
