"""The shapes of experiment data, derived from whole generic tables.

Each binding is a SELECT that Spark and DuckDB read alike: ``{table}`` stands for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MODEL = """'./results/' || CASE {a} WHEN 0 THEN 'qwen2.5_0.5b_instruct' WHEN 1 THEN 'qwen2.5-1.5b' WHEN 2 THEN 'qwen2.5_1.5b_instruct' WHEN 3 THEN 'qwen2.5-3b' ELSE 'ppl-only-7b' END"""

BINDINGS: dict[str, tuple[str, str]] = {
    # name: (table, SELECT)
    "bench_runs": (
        "lineitem",
        f"""SELECT {_MODEL.format(a="l_suppkey % 4")}
        || '_' || CASE l_partkey % 6 WHEN 0 THEN 'fp16' WHEN 1 THEN 'awq' WHEN 2 THEN 'gptq' WHEN 3 THEN 'rtn' WHEN 4 THEN 'smooth' ELSE CASE WHEN l_partkey % 4 = 1 THEN 'base' ELSE 'bnb' END END
        || CASE l_linenumber % 5 WHEN 0 THEN '_w4a16' WHEN 1 THEN '-int8' WHEN 2 THEN '_w8a8' WHEN 3 THEN '_w3a16' ELSE '' END AS model_name,
        CASE l_partkey % 6 WHEN 0 THEN 'fp16' WHEN 1 THEN 'awq' WHEN 2 THEN 'gptq' WHEN 3 THEN 'rtn' WHEN 4 THEN 'smooth' ELSE 'bnb4' END AS method,
        CASE l_returnflag WHEN 'A' THEN 'Jetson' WHEN 'N' THEN 'RTX 3090' ELSE 'CPU' END AS hardware,
        256 AS input_length, 64 AS output_length, 1 AS batch_size,
        l_extendedprice AS latency_ms,
        CASE WHEN l_extendedprice > 0 THEN 64.0e0 / (l_extendedprice / 1000.0e0) END AS throughput_tok_per_sec,
        CASE WHEN l_linestatus = 'F' THEN l_quantity * 100.0e0 END AS peak_memory_mb,
        CASE WHEN l_linenumber % 4 <> 0 THEN 5.0e0 + l_quantity / 10.0e0 END AS perplexity,
        substr(CAST(l_shipdate AS STRING), 1, 19) AS run_ts
        FROM {{lineitem}}""",
    ),
    # One to three results per model, one a dataset, from all parts. 'ppl-only-7b' has no run, 'bnb' no result.
    "ppl_results": (
        "part",
        f"""SELECT model, dataset, 8.0e0 + CAST(SUM(p_size) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) / 10.0e0 AS perplexity FROM (
        SELECT {_MODEL.format(a="p_partkey % 5")}
        || '_' || CASE CAST(FLOOR(p_partkey / 5) AS BIGINT) % 5 WHEN 0 THEN 'fp16' WHEN 1 THEN 'awq' WHEN 2 THEN 'gptq' WHEN 3 THEN 'rtn' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'base' ELSE 'smooth' END END
        || CASE CAST(FLOOR(p_partkey / 25) AS BIGINT) % 5 WHEN 0 THEN '_w4a16' WHEN 1 THEN '-int8' WHEN 2 THEN '_w8a8' WHEN 3 THEN '_w3a16' ELSE '' END AS model,
        CASE WHEN p_partkey % 5 = 0 THEN 'wikitext2' WHEN p_size % 2 = 0 THEN 'wikitext2' WHEN p_partkey % 5 = 2 AND p_size % 3 = 0 THEN 'c4' ELSE 'ptb' END AS dataset, p_size
        FROM {{part}}) t GROUP BY model, dataset""",
    ),
    # Metric rows of result files. 'rtnW8A16' has no file, 'smoothW8A8' none for ifeval.
    "eval_files": (
        "orders",
        """SELECT label, part, task, file_mtime, label || '_' || part || '_' || CAST(file_mtime AS STRING) || '.json' AS file_name, metric_key,
        MAX(o_totalprice) / 1000000.0e0 AS value, MAX(o_totalprice) / 50000000.0e0 AS stderr FROM (
        SELECT CASE CASE WHEN o_orderkey % 8 = 7 THEN o_custkey % 4 ELSE o_custkey % 5 END WHEN 0 THEN 'fp16' WHEN 1 THEN 'awqW4A16' WHEN 2 THEN 'gptqW4A16' WHEN 3 THEN 'rtnW4A16' ELSE 'smoothW8A8' END AS label,
        CASE WHEN o_orderkey % 8 < 6 THEN 'likelihood' WHEN o_orderkey % 8 = 6 THEN 'gsm8k' ELSE 'ifeval' END AS part,
        CASE o_orderkey % 8 WHEN 0 THEN 'arc_easy' WHEN 1 THEN 'arc_challenge' WHEN 2 THEN 'hellaswag' WHEN 3 THEN 'winogrande' WHEN 4 THEN 'mmlu' WHEN 5 THEN 'truthfulqa_mc2' WHEN 6 THEN 'gsm8k' ELSE 'ifeval' END AS task,
        CAST(year(o_orderdate) AS BIGINT) AS file_mtime,
        CASE WHEN o_orderkey % 8 < 3 THEN 'acc_norm,none' WHEN o_orderkey % 8 < 6 THEN 'acc,none'
             WHEN o_orderkey % 8 = 6 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'exact_match,strict-match' ELSE 'exact_match,flexible-extract' END
             ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'inst_level_strict_acc,none' ELSE 'prompt_level_strict_acc,none' END END AS metric_key,
        o_totalprice FROM {orders}) t GROUP BY label, part, task, file_mtime, metric_key""",
    ),
    # The same by file scheme; no file of 'Q4_0' holds ifeval.
    "scheme_files": (
        "orders",
        """SELECT label, part, task, file_mtime, label || '_' || part || '_' || CAST(file_mtime AS STRING) || '.json' AS file_name, metric_key,
        MAX(o_totalprice) / 1000000.0e0 AS value, MAX(o_totalprice) / 50000000.0e0 AS stderr FROM (
        SELECT CASE CASE WHEN o_orderkey % 8 = 7 THEN o_custkey % 4 ELSE o_custkey % 5 END WHEN 0 THEN 'F16' WHEN 1 THEN 'Q8_0' WHEN 2 THEN 'Q5_K_M' WHEN 3 THEN 'Q4_K_M' ELSE 'Q4_0' END AS label,
        CASE WHEN o_orderkey % 8 < 6 THEN 'likelihood' WHEN o_orderkey % 8 = 6 THEN 'gsm8k' ELSE 'ifeval' END AS part,
        CASE o_orderkey % 8 WHEN 0 THEN 'arc_easy' WHEN 1 THEN 'arc_challenge' WHEN 2 THEN 'hellaswag' WHEN 3 THEN 'winogrande' WHEN 4 THEN 'mmlu' WHEN 5 THEN 'truthfulqa_mc2' WHEN 6 THEN 'gsm8k' ELSE 'ifeval' END AS task,
        CAST(year(o_orderdate) AS BIGINT) AS file_mtime,
        CASE WHEN o_orderkey % 8 < 3 THEN 'acc_norm,none' WHEN o_orderkey % 8 < 6 THEN 'acc,none'
             WHEN o_orderkey % 8 = 6 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'exact_match,strict-match' ELSE 'exact_match,flexible-extract' END
             ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'inst_level_strict_acc,none' ELSE 'prompt_level_strict_acc,none' END END AS metric_key,
        o_totalprice FROM {orders}) t GROUP BY label, part, task, file_mtime, metric_key""",
    ),
    # Engine tests; ord is the array order, every fifth test has no name.
    "engine_tests": (
        "orders",
        """SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'F16' WHEN '2' THEN 'Q8_0' WHEN '3' THEN 'Q5_K_M' WHEN '4' THEN 'Q4_K_M' ELSE 'Q4_0' END AS label,
        o_orderkey AS ord,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'pp256' ELSE 'tg64' END AS test_name,
        CASE WHEN o_orderkey % 2 = 0 THEN 256 ELSE 0 END AS n_prompt,
        CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 64 END AS n_gen,
        o_totalprice / 1000.0e0 AS avg_ts, o_totalprice / 100000.0e0 AS stddev_ts
        FROM {orders}""",
    ),
    # Telemetry lines; 'view' lines lack the GPU load, 'error' lines the power.
    "telemetry": (
        "events",
        """SELECT CASE user_id % 5 WHEN 0 THEN 'F16' WHEN 1 THEN 'Q8_0' WHEN 2 THEN 'Q5_K_M' WHEN 3 THEN 'Q4_K_M' ELSE 'Q4_0' END AS label,
        event_id AS seq,
        'RAM ' || CAST(2000 + CAST(FLOOR(value * 10) AS BIGINT) AS STRING) || '/7620MB (lfb 4x1MB)'
        || CASE WHEN event_type = 'view' THEN '' ELSE ' GR3D_FREQ ' || CAST(user_id % 100 AS STRING) || '%' END
        || CASE WHEN event_type = 'error' THEN '' ELSE ' VDD_IN ' || CAST(4000 + event_id % 5000 AS STRING) || 'mW/4000mW' END AS line
        FROM {events}""",
    ),
    "timing": (
        "events",
        "SELECT user_id AS run_group, event_id, value AS latency_ms, value * 1048576.0e0 AS memory_bytes FROM {events}",
    ),
    "corpus": ("documents", "SELECT doc_id, text FROM {documents}"),
    # Two linear layers over the same input channels.
    "vectors": (
        "embeddings",
        "SELECT 'fc' || CAST(label % 2 AS STRING) AS layer, vec_id AS row_id, embedding AS vec FROM {embeddings}",
    ),
    # Answer choices of multiple-choice documents; a choice that occurs twice is one choice.
    "choices": (
        "lineitem",
        """SELECT task, doc_id, choice, loglik, choice_len, choice = gold AS is_gold FROM (
        SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'winogrande' WHEN l_orderkey % 3 = 1 THEN 'mmlu' ELSE 'hellaswag' END AS task,
        l_orderkey AS doc_id, l_linenumber AS choice, -MAX(l_extendedprice) / 20000.0e0 AS loglik,
        CAST(MAX(l_quantity) AS BIGINT) + 1 AS choice_len, 1 + l_orderkey % 7 AS gold
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber) t""",
    ),
    # Free-text answers: half of them close with '#### n', some are wrong, some use separators.
    "answers": (
        "orders",
        """SELECT 'gsm8k' AS task, o_orderkey AS doc_id, CAST(1000 + o_custkey AS STRING) AS gold,
        'He had ' || CAST(o_custkey % 50 AS STRING) || ' and then the total is $'
        || CASE WHEN o_orderkey % 4 = 0 THEN substr(CAST(1000 + o_custkey AS STRING), 1, 1) || ',' || substr(CAST(1000 + o_custkey AS STRING), 2) ELSE CAST(1000 + o_custkey + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS STRING) END || '.'
        || CASE WHEN o_orderkey % 2 = 0 THEN ' #### ' || CAST(1000 + o_custkey AS STRING) ELSE '' END AS answer
        FROM {orders}""",
    ),
    # Instructions of prompts and whether the answer met them.
    "instructions": (
        "lineitem",
        "SELECT 'ifeval' AS task, l_orderkey AS prompt_id, l_discount < 0.08e0 AS followed FROM {lineitem}",
    ),
    "outcomes": (
        "labels",
        "SELECT 'quality' AS task, CAST(quality AS DOUBLE) AS outcome FROM {labels} UNION ALL SELECT 'toxic', CAST(toxic AS DOUBLE) FROM {labels}",
    ),
    # Job specs, one per order; the path itself holds a colon.
    "job_specs": (
        "orders",
        """SELECT o_orderkey AS job_id, CASE o_custkey % 3 WHEN 0 THEN 'fp16' WHEN 1 THEN 'awqW4A16' ELSE 'rtnW8A16' END || ':'
        || CASE o_custkey % 3 WHEN 0 THEN 'fp16' WHEN 1 THEN 'awq' ELSE 'rtn' END || ':hub:org/model-' || CAST(o_custkey AS STRING) AS spec
        FROM {orders}""",
    ),
    # Model names outside the usual pattern: leading method, other spellings, other bit widths.
    "odd_names": (
        "part",
        """SELECT CASE p_size % 8 WHEN 0 THEN 'AWQ_' || p_brand WHEN 1 THEN 'm-bnb4' WHEN 2 THEN p_brand || '__SmoothQ-w8a8'
        WHEN 3 THEN 'Qwen2.5-1.5B' WHEN 4 THEN 'qwen2.5-1.5b-awq-int4-sym' WHEN 5 THEN p_type || '-rtn-INT8' WHEN 6 THEN 'x_smoothquant_W3A16_gptq' ELSE 'rtnx-' || p_type || '-bnb' END AS model_dir
        FROM {part}""",
    ),
    "task_requests": (
        "part",
        "SELECT p_partkey AS job_id, CASE p_size % 4 WHEN 0 THEN 'quick' WHEN 1 THEN 'standard' WHEN 2 THEN 'full' ELSE 'gsm8k,ifeval' END AS tasks FROM {part}",
    ),
    "scheme_requests": (
        "part",
        "SELECT p_partkey AS job_id, CASE p_size % 5 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'Q9_X' WHEN 2 THEN 'IQ2_XXS' WHEN 3 THEN 'F64' ELSE 'BF16' END AS scheme FROM {part}",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    source, select = BINDINGS[name]
    return spark.sql(select, **{source: table(spark, sf_dir, source)})


def cte(*names: str) -> str:
    """The same bindings as the WITH clause of a SQL query."""
    parts = []
    for name in names:
        source, select = BINDINGS[name]
        parts.append(f"{name} AS ({select.replace('{' + source + '}', source)})")
    return "WITH " + ",\n".join(parts) + "\n"
