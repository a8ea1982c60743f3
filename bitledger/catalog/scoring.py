"""Registered queries: scores of logged evaluation samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitledger.catalog.bindings import bind, cte
from bitledger.catalog.common import Query, r, rounded
from bitledger.operators import scoring

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

QUERIES["mc_accuracy"] = lambda spark, sf: rounded(
    scoring.mc_accuracy(bind(spark, sf, "choices")), 6, "acc"
)
QUERIES["mc_accuracy_norm"] = lambda spark, sf: rounded(
    scoring.mc_accuracy_norm(bind(spark, sf, "choices")), 6, "acc_norm"
)
for _name, _score, _out in [
    ("mc_accuracy", "loglik", "acc"),
    ("mc_accuracy_norm", "loglik / choice_len", "acc_norm"),
]:
    ORACLE[_name] = (
        cte("choices")
        + f", best AS (SELECT task, doc_id, is_gold FROM choices QUALIFY ROW_NUMBER() OVER (PARTITION BY task, doc_id ORDER BY {_score} DESC, choice) = 1) "
        + f"SELECT task, {r('AVG(CASE WHEN is_gold THEN 1.0e0 ELSE 0.0e0 END)', 6)} AS {_out}, COUNT(*) AS n FROM best GROUP BY task"
    )
QUERIES["mc2_score"] = lambda spark, sf: rounded(
    scoring.mc2_score(bind(spark, sf, "choices")), 6, "acc"
)
ORACLE["mc2_score"] = (
    cte("choices")
    + ", d AS (SELECT task, doc_id, COALESCE(SUM(exp(loglik)) FILTER (is_gold), 0.0e0) / SUM(exp(loglik)) AS share FROM choices GROUP BY task, doc_id) "
    + f"SELECT task, {r('AVG(share)', 6)} AS acc, COUNT(*) AS n FROM d GROUP BY task"
)
QUERIES["exact_match"] = lambda spark, sf: rounded(
    scoring.exact_match(bind(spark, sf, "answers")), 6, "strict", "flexible"
)
_PLAIN = "lower(regexp_replace(replace(replace({0}, ',', ''), '$', ''), '\\.$', ''))"
ORACLE["exact_match"] = (
    cte("answers")
    + ", f AS (SELECT task, gold, COALESCE(NULLIF(regexp_extract(answer, '#### (-?[0-9.,]+)', 1), ''), '[invalid]') AS strict, "
    + "COALESCE(list_last(regexp_extract_all(answer, '-?[$0-9.,]{2,}|-?[0-9]+')), '[invalid]') AS flexible FROM answers) "
    + f"SELECT task, {r('AVG(CASE WHEN ' + _PLAIN.format('strict') + ' = gold THEN 1.0e0 ELSE 0.0e0 END)', 6)} AS strict, "
    + f"{r('AVG(CASE WHEN ' + _PLAIN.format('flexible') + ' = gold THEN 1.0e0 ELSE 0.0e0 END)', 6)} AS flexible, COUNT(*) AS n FROM f GROUP BY task"
)
QUERIES["instruction_accuracy"] = lambda spark, sf: rounded(
    scoring.instruction_accuracy(bind(spark, sf, "instructions")), 6, "prompt_level", "inst_level"
)
ORACLE["instruction_accuracy"] = (
    cte("instructions")
    + f"SELECT p.task, {r('AVG(CASE WHEN met THEN 1.0e0 ELSE 0.0e0 END)', 6)} AS prompt_level, ANY_VALUE(inst) AS inst_level, COUNT(*) AS n_prompts "
    + "FROM (SELECT task, prompt_id, BOOL_AND(followed) AS met FROM instructions GROUP BY task, prompt_id) p "
    + f"JOIN (SELECT task, {r('AVG(CASE WHEN followed THEN 1.0e0 ELSE 0.0e0 END)', 6)} AS inst FROM instructions GROUP BY task) i ON p.task = i.task GROUP BY p.task"
)
QUERIES["accuracy_stderr"] = lambda spark, sf: rounded(
    scoring.accuracy_stderr(bind(spark, sf, "outcomes")), 6, "mean", "stderr"
)
ORACLE["accuracy_stderr"] = (
    cte("outcomes")
    + f"SELECT task, {r('AVG(outcome)', 6)} AS mean, {r('STDDEV_SAMP(outcome) / sqrt(COUNT(outcome))', 6)} AS stderr, COUNT(outcome) AS n FROM outcomes GROUP BY task"
)


def _bootstrap(spark, sf):
    """Standard errors of a ratio of sums, the share of instructions that were followed."""
    rows = bind(spark, sf, "instructions").groupBy("task", "prompt_id").agg(
        F.count_if("followed").alias("met"), F.count("*").alias("asked")
    )
    found = scoring.bootstrap_stderr(
        rows, {"met": F.col("met"), "asked": F.col("asked")}, lambda s: s("met") / s("asked"),
        F.concat_ws("/", "task", "prompt_id"), replicates=40,
    )
    return rounded(found, 6, "metric", "stderr")


_ENDS = "[" + ", ".join(map(str, scoring._POISSON_ENDS)) + "]"
QUERIES["bootstrap_stderr"] = _bootstrap
ORACLE["bootstrap_stderr"] = (
    cte("instructions")
    + ", rw AS (SELECT task, prompt_id, COUNT(*) FILTER (followed) AS met, COUNT(*) AS asked FROM instructions GROUP BY task, prompt_id), "
    + "d AS (SELECT *, CAST('0x' || substr(md5('42:' || (k // 4) || ':' || concat_ws('/', task, prompt_id)), 1 + 8 * (k % 4), 8) AS BIGINT) AS draw, k + 1 AS rep FROM rw, range(40) AS g(k)), "
    + f"w AS (SELECT task, rep, met, asked, len([e FOR e IN {_ENDS} IF draw >= e]) AS w FROM d UNION ALL SELECT task, 0, met, asked, 1 FROM rw), "
    + "t AS (SELECT task, rep, SUM(met * w) / CAST(SUM(asked * w) AS DOUBLE) AS m, COUNT(*) AS n FROM w WHERE w > 0 GROUP BY task, rep) "
    + f"SELECT task, {r('MAX(m) FILTER (rep = 0)', 6)} AS metric, {r('STDDEV_SAMP(m) FILTER (rep > 0)', 6)} AS stderr, MAX(n) FILTER (rep = 0) AS n, COUNT(m) FILTER (rep > 0) AS replicates FROM t GROUP BY task"
)
