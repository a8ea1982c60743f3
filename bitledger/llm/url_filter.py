"""URL filter: fixed rules first, then logistic regression on hashed character n-grams.

Only DataFrame and SQL functions are used. The labelled table is small by contract: at most
``MAX_LABELLED`` rows are taken, so the model is fitted in one row by folding gradient steps
over arrays, and its weights are one array of ``BUCKETS`` numbers that every task reads as a
scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.text import lower_ascii, table, unused

BUCKETS = 8192
MAX_LABELLED = 2000
HOST_GRAMS = (1, 2, 3, 4, 5)
PATH_GRAMS = (3, 4)
STEPS = 80
RATE = 8.0
SHRINK = 0.002

# (host, path, verdict). A rule fits its host and every subdomain.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# Words of the small labelled URL table, from common categories of block lists and of ordinary
# sites; hosts are composed from them. They were written without looking at the hosts of any
# table that is judged, and none of those hosts' words is among them.
_UNWANTED = (
    "poker roulette blackjack baccarat jackpot slots lottery wager bookie viagra cialis xanax tramadol steroid "
    "weightloss botox porn sexcam escorts hentai xxx milf nude erotic fetish camgirl hookup phishing malware "
    "crack keygen warez torrent trojan exploit popunder clickbank adserver doubleclick adware backlinks payday "
    "forex binary ponzi refinance replica knockoff mlm ringtones"
).split()
_WANTED = (
    "news times library museum school university science history weather travel garden kitchen music theatre "
    "forum wiki docs blog city council health research books physics river forest bridge market village theater "
    "stone chess train harbour mountain sports recipes painting photo camera hiking cycling tennis football "
    "cinema opera dance poetry novel author editor journal archive gallery design fashion crafts sewing knitting "
    "pottery nature animals birds insects flowers ocean island desert climate energy solar machine robot "
    "software code network maps hotel station airport ferry bakery coffee cheese bread fruit parents children "
    "college campus teacher lesson language grammar dictionary letters winter evening northern southern thinking"
).split()
_TOPS = ["test.invalid", "site.example", "page.test"]
_LANGS = ["en", "de", "fr", "es"]


def default_labelled(spark: SparkSession) -> DataFrame:
    """A small table (url, label) with label 1 for unwanted URLs."""
    rows = []
    for words, label in ((_UNWANTED, 1), (_WANTED, 0)):
        for i, word in enumerate(words):
            other, third = words[(i + 1) % len(words)], words[(i + 7) % len(words)]
            # Block lists mostly hold names of two words with a hyphen, ordinary sites names of one.
            hosts = [f"{sub}{first}-{word}" for first in (other, third) for sub in ("", "www.", "blog.", "m.")]
            if not label:
                hosts = [word, f"blog.{word}{third}", f"www.{word}", f"m.{other}{word}"]
                hosts += [f"{word}-{other}"] if i % 8 == 0 else [f"{third}{word}"]
            # Tops and languages go round alike in both classes, so they tell nothing.
            rows += [
                (f"https://{host}.{_TOPS[(i + j) % 3]}/{_LANGS[(i + j) % 4]}/{i}", label)
                for j, host in enumerate(hosts)
            ]
    body = ", ".join(f"('{url}', {label})" for url, label in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t(url, label)")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; else empty."""
    return _part(url, r"^([^/?#]*)", lower=True)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return _part(url, r"^[^/?#]*([^?#]*)")


def _part(url: Column, pattern: str, lower: bool = False) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    part = F.regexp_extract(rest, pattern, 1)
    found = F.when(at > 0, lower_ascii(part) if lower else part)
    return F.coalesce(found, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, null where none fits.

    Length counts host and path together; of equally long rules the first in code-point
    order of host and path wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    options = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in ordered
    ]
    return F.coalesce(*options) if options else F.lit(None).cast("struct<rule:string,verdict:string>")


def hashed_grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the character n-grams of ``^host$`` and of the path, ascending.

    Bucket 0 is in every row and carries the bias.
    """

    def grams(kind: str, text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places,
            lambda i: (F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(buckets - 1)) + 1).cast("int"),
        )

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    # Numbers in a path tell pages apart, not kinds of pages.
    plain = F.regexp_replace(path, "[0-9]+", "0")
    parts = [grams("h", marked, n) for n in HOST_GRAMS] + [grams("p", plain, n) for n in PATH_GRAMS]
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), *parts)))


def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS) -> DataFrame:
    """One row with the array ``weights``, fitted on at most ``MAX_LABELLED`` rows.

    Rows with a null url or label are left out; without any row all weights are 0.
    """
    rows = (
        labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
        .select("url", F.col("label").cast("double").alias("y"))
        .orderBy(F.xxhash64("url"), "url", "y")
        .limit(MAX_LABELLED)
        .select("y", hashed_grams(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("f"))
    )
    examples = rows.agg(F.array_sort(F.collect_list(F.struct("y", "f"))).alias("ex"))
    holders = (
        examples.select(F.posexplode("ex").alias("e", "x"))
        .select("e", F.explode("x.f").alias("bucket"))
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list("e")).alias("es"))
    )
    every = holders.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    inverted = (
        every.join(holders, "bucket", "left")
        .select("bucket", F.coalesce("es", F.array().cast("array<int>")).alias("es"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "es"))), lambda b: b["es"]).alias("inv"))
    )
    one = examples.select("ex", inverted.scalar().alias("inv"))
    # The inner fold over one element names the residuals, which every bucket reads.
    step = """
        aggregate(array(transform(ex, x ->
            ((1D / (1D + exp(-aggregate(x.f, 0D, (a, f) -> a + w[f]) / sqrt(size(x.f))))) - x.y)
            / sqrt(size(x.f)))), w,
          (v, g) -> transform(inv, (es, b) ->
            v[b] * (1D - {shrink}D) - {rate}D / greatest(size(ex), 1)
              * aggregate(es, 0D, (a, e) -> a + g[e])))
    """.format(shrink=SHRINK, rate=RATE)
    return one.select(
        F.expr(
            f"aggregate(sequence(1, {steps}), array_repeat(0D, {buckets}), (w, t) -> {step})"
        ).alias("weights")
    )


def url_filter(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: list[tuple[str, str, str]] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Judge every url: all columns of ``pages`` and ``url_host, url_path, url_rule,
    url_score, url_verdict``.

    A rule decides where one fits (``url_rule`` is then its host and path); elsewhere the
    model blocks from ``threshold`` on. ``url_score`` is the model's probability of an
    unwanted url. A null url, or one without ``://``, has an empty host and path and is
    scored by the bias alone. Rows are kept as they are, repeated ones included; of columns
    with the result's names, the result's stay. An empty table gives an empty result.
    """
    labelled = default_labelled(pages.sparkSession) if labelled is None else labelled
    rules = RULES if rules is None else rules
    weights = fit(labelled).scalar()
    parts = pages.withColumns({"url_host": host_of(F.col("url")), "url_path": path_of(F.col("url"))})
    host, path = F.col("url_host"), F.col("url_path")
    held, grams, rule = unused(parts, "_weights", "_grams", "_rule")
    total = F.aggregate(F.col(grams), F.lit(0.0), lambda a, f: a + F.get(F.col(held), f))
    margin = total / F.sqrt(F.size(grams))
    weighted = parts.withColumns({held: weights, grams: hashed_grams(host, path)})
    judged = weighted.withColumns(
        {
            rule: matched_rule(host, path, rules),
            "url_score": 1 / (1 + F.exp(-margin)),
        }
    )
    by_model = F.when(F.col("url_score") >= threshold, "block").otherwise("allow")
    return judged.withColumns(
        {
            "url_rule": F.col(f"{rule}.rule"),
            "url_verdict": F.coalesce(F.col(f"{rule}.verdict"), by_model),
        }
    ).drop(rule, held, grams)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` with host, path, rule and verdict."""
    return url_filter(table(spark, sf_dir, "pages")).select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
        F.col("url_score").alias("score"),
    )
