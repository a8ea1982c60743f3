import random

from pyspark.sql import functions as F

from bitledger.operators import prefix
from bitledger.operators.prefix import number_rows, rank_of_values, running_total


def test_running_total_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randint(0, 9)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    got = {(r.g, r.k): r.start for r in running_total(df, ["k"], "v", "start", ["g"]).collect()}
    seen, want = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        want[(g, k)] = seen.get(g, 0)
        seen[g] = want[(g, k)] + v
    assert got == want


def test_running_total_over_everything(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(2).cast("bigint").alias("v"))
    rows = running_total(df, ["k"], "v", "start").collect()
    assert all(r.start == 2 * r.k for r in rows) and len(rows) == 1000


def test_number_rows_with_copies(spark):
    rows = [("a", 1.0, "x")] * 500 + [("a", float(i % 5), "y") for i in range(300)] + [("b", 2.0, "z")]
    got = number_rows(spark.createDataFrame(rows, "g string, v double, w string"), ["g"], ["v"], "n")
    want = []
    for g in ("a", "b"):
        ordered = sorted(r for r in rows if r[0] == g)
        want += [(*r, i + 1) for i, r in enumerate(ordered)]
    assert sorted(tuple(r) for r in got.select("g", "v", "w", "n").collect()) == sorted(want)


def test_rank_of_values(spark):
    df = spark.createDataFrame([("c",), ("a",), ("c",), ("b",)], "v string")
    assert sorted((r.v, r.n) for r in rank_of_values(df, "v", "n").collect()) == [
        ("a", 0), ("b", 1), ("c", 2), ("c", 2),
    ]


def test_ranks_of_many_values_equal_those_of_few(spark, monkeypatch):
    df = spark.createDataFrame([(f"v{k % 97}",) for k in range(400)] + [(None,)], "v string")
    few = sorted(map(tuple, rank_of_values(df, "v", "n").collect()))
    monkeypatch.setattr(prefix, "SMALL_VALUES", 5)
    assert sorted(map(tuple, rank_of_values(df, "v", "n").collect())) == few
    assert rank_of_values(df.limit(0), "v", "n").columns == ["v", "n"]


def test_few_distinct_values_and_a_hot_one_make_many_ranges(spark):
    """A value that holds half of a group, nulls and copies: no range has more than a few hundredths."""
    rng = random.Random(3)
    rows = [("h", rng.choice([1.5, 1.5, 1.5, 2.0, None]), rng.choice("ab"), k) for k in range(40_000)]
    df = spark.createDataFrame(rows, "g string, v double, w string, k bigint")
    ranged = prefix._with_range(df, ["g"], ["v", "w", "k"]).groupBy("_range").count().collect()
    assert len(ranged) > 1000 and max(r["count"] for r in ranged) < 400
    got = sorted((r.n, r.v is not None, r.v or 0, r.w, r.k) for r in number_rows(df, ["g"], ["v"], "n").collect())
    want = sorted((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows)
    assert [r[0] for r in got] == list(range(1, 40_001)) and [r[1:] for r in got] == want


def test_long_common_prefixes_are_cut(spark):
    df = spark.createDataFrame([(f"a common prefix of names {k:05}", 1) for k in range(9000)], "k string, v bigint")
    assert prefix._with_range(df, [], ["k"]).select("_range").distinct().count() > 1000
    rows = sorted((r.k, r.s) for r in running_total(df, ["k"], "v", "s").collect())
    assert [s for _, s in rows] == list(range(9000))


def test_rows_of_one_group_are_not_sent_to_one_task(spark):
    """Ranges are found where the rows are; range sums reach them without a join that moves them again."""
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 1).alias("g"), F.xxhash64("id").alias("v"), "id")
    ranged = prefix._with_range(df, ["g"], ["v"])
    parts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("_range")).collect()
    assert [r.n for r in parts] == [5000] * 8
    assert "Join" not in number_rows(df, ["g"], ["v"], "n")._jdf.queryExecution().executedPlan().toString()


def test_running_total_of_missing_groups_and_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, float("nan"), None, -2.0]), k, rng.choice([None, 1, 2])) for k in range(9000)]
    df = spark.createDataFrame(rows, "g string, v double, k bigint, n int")
    got = running_total(df, ["v", "k"], "n", "s", ["g"])
    assert got.columns == ["g", "v", "k", "n", "s"] and dict(got.dtypes)["n"] == "int"
    want, seen = {}, {}
    for g, v, k, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] != r[1], r[1] if r[1] == r[1] and r[1] else 0, r[2])):
        want[k] = (g, n, seen.get(g, 0))
        seen[g] = seen.get(g, 0) + (n or 0)
    assert {r.k: (r.g, r.n, r.s) for r in got.collect()} == want
