import math

import pytest

from bitledger.llm import url_filter as uf

CASES = {
    "https://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://a.example.com/de/?x=/en/": ("a.example.com", "/de/", "com/", "allow"),
    "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
    "http://x.net/es/1#top": ("x.net", "/es/1", "net/es/", "block"),
    "http://x.net/fr/": ("x.net", "/fr/", "net/fr/", "block"),
    "http://com/a": ("com", "/a", "com/", "allow"),
    "http://a.com": ("a.com", "", None, None),
    "http://a.com?q=/b": ("a.com", "", None, None),
    "http://h#f/en/": ("h", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    "no scheme.com/en/": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def pages(spark, urls):
    return spark.createDataFrame(
        [(k, u, "<p>", "mine") for k, u in enumerate(urls)], "page_id bigint, url string, html string, url_score string"
    )


def test_hosts_paths_and_rules(spark):
    found = uf.url_filter(pages(spark, list(CASES))).orderBy("page_id").collect()
    for row, (host, path, rule, verdict) in zip(found, CASES.values()):
        assert (row.url_host, row.url_path, row.url_rule) == (host, path, rule)
        assert row.url_verdict == verdict if verdict else row.url_verdict in ("allow", "block")
        assert 0 <= row.url_score <= 1


# Kinds of hosts as block lists and directories have them; no word of either is in the training table.
UNSEEN = {
    "block": "best-casino free-bets cheap-pills adult-x spam-farm ads-track win-cash hot-dates fake-watch easy-credit".split(),
    "allow": "thehistorian tionsh ththor erheat onlinger thering ndere gardenhouse tionble cookery sailing astronomy".split(),
}


def test_training_shares_no_word_with_the_hosts_it_is_tested_on(spark):
    trained = {w for r in uf.default_labelled(spark).collect() for w in r.url.split("//")[1].split("/")[0].replace("-", ".").split(".")}
    tested = {w for hosts in UNSEEN.values() for h in hosts for w in h.split("-")}
    assert not trained & tested
    assert not {"example.com", "example.net", "example.org"} & {".".join(r.url.split("/")[2].split(".")[-2:]) for r in uf.default_labelled(spark).collect()}


def test_hosts_of_unseen_words(spark):
    hosts = [(h, verdict) for verdict, names in UNSEEN.items() for h in names]
    urls = [f"https://{prefix}{h}.example.org/en/{k}" for k, (h, _) in enumerate(hosts) for prefix in ("", "www.", "m.")]
    rows = uf.url_filter(pages(spark, urls)).orderBy("page_id").collect()
    right = {v: [r.url_verdict == v for r in rows if UNSEEN[v].count(r.url_host.removeprefix("www.").removeprefix("m.").split(".")[0])] for v in UNSEEN}
    assert sum(right["block"]) / len(right["block"]) >= 0.8 and sum(right["allow"]) / len(right["allow"]) >= 0.9


def test_columns_named_like_helpers_stay(spark):
    odd = pages(spark, ["http://a.org/x"]).selectExpr("*", "1 AS _rule", "2 AS _weights", "3 AS _grams", "4 AS url_host")
    row = uf.url_filter(odd).first()
    assert (row._rule, row._weights, row._grams, row.url_host) == (1, 2, 3, "a.org")


def test_training_equals_plain_gradient_descent(spark):
    buckets, steps = 64, 5
    labelled = uf.default_labelled(spark)
    got = uf.fit(labelled, buckets, steps).first()[0]
    grams = labelled.select(
        "label", uf.hashed_grams(uf.host_of(uf.F.col("url")), uf.path_of(uf.F.col("url")), buckets).alias("f")
    ).collect()
    weights = [0.0] * buckets
    for _ in range(steps):
        residual = [
            (1 / (1 + math.exp(-sum(weights[f] for f in r.f) / math.sqrt(len(r.f)))) - r.label) / math.sqrt(len(r.f))
            for r in grams
        ]
        gradient = [0.0] * buckets
        for g, row in zip(residual, grams):
            for f in row.f:
                gradient[f] += g
        weights = [w * (1 - uf.SHRINK) - uf.RATE / len(grams) * g for w, g in zip(weights, gradient)]
    assert got == pytest.approx(weights, abs=1e-9)


def test_empty_tables(spark):
    assert uf.url_filter(pages(spark, []).limit(0)).count() == 0
    none = spark.createDataFrame([], "url string, label int")
    row = uf.url_filter(pages(spark, ["http://a.org/x"] * 2), none).collect()
    assert [r.url_score for r in row] == [0.5, 0.5]


def test_repeated_rows_stay(spark):
    assert uf.url_filter(pages(spark, ["http://a.org/x"] * 7)).count() == 7
