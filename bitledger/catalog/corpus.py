"""Registered queries: calibration samples, windows, perplexity and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.catalog.bindings import bind, cte, table
from bitledger.catalog.common import Query, r, rounded
from bitledger.functions import fixed_values as fixed
from bitledger.operators import context_model, corpus, filters, prompts, subword
from bitledger.operators.perplexity import corpus_perplexity
from bitledger.sources.corpus import read_corpus

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_CHARS = " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)
_RUN = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
_CORPUS = cte("corpus") + f", s AS (SELECT doc_id, text, trim(text, {_CHARS}) AS body FROM corpus) "
_TOKENS = _CORPUS + f", t AS (SELECT doc_id, CASE WHEN body = '' THEN [] ELSE regexp_split_to_array(body, '{_RUN}') END AS tokens FROM s) "


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "corpus")


def _with_length(df: DataFrame) -> DataFrame:
    """Texts by their id, length and digest, to keep results small."""
    return df.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


_DIGEST = "doc_id, length(text) AS n_chars, md5(text) AS digest"


def _read_corpus(spark, sf):
    catalog = {"wikitext2": table(spark, sf, "documents"), "ptb": table(spark, sf, "benchmark")}
    return _with_length(read_corpus(spark, "no such corpus", catalog))


QUERIES["read_corpus"] = _read_corpus
ORACLE["read_corpus"] = cte("corpus") + f"SELECT {_DIGEST} FROM corpus"
QUERIES["filter_blank_text"] = lambda spark, sf: _with_length(
    filters.filter_blank_text(_documents(spark, sf))
)
ORACLE["filter_blank_text"] = _CORPUS + f"SELECT {_DIGEST} FROM s WHERE body <> ''"
QUERIES["filter_min_length"] = lambda spark, sf: _with_length(
    filters.filter_min_length(_documents(spark, sf))
)
ORACLE["filter_min_length"] = _CORPUS + f"SELECT {_DIGEST} FROM s WHERE length(body) > 50"
QUERIES["head_filter_head"] = lambda spark, sf: _with_length(
    corpus.head_filter_head(_documents(spark, sf))
)
ORACLE["head_filter_head"] = (
    _CORPUS + f"SELECT {_DIGEST} FROM (SELECT * FROM s ORDER BY doc_id LIMIT 256) WHERE length(body) > 50 ORDER BY doc_id LIMIT 128"
)
QUERIES["filter_head"] = lambda spark, sf: _with_length(corpus.filter_head(_documents(spark, sf)))
ORACLE["filter_head"] = _CORPUS + f"SELECT {_DIGEST} FROM s WHERE length(body) > 50 ORDER BY doc_id LIMIT 128"
QUERIES["seeded_sample"] = lambda spark, sf: _with_length(
    corpus.seeded_sample(_documents(spark, sf), strict=False)
)
ORACLE["seeded_sample"] = (
    _CORPUS + f"SELECT {_DIGEST} FROM s WHERE body <> '' ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 512"
)


def _calibration_tokens(spark, sf):
    tokens = corpus.calibration_tokens(_documents(spark, sf))
    return tokens.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


QUERIES["calibration_tokens"] = _calibration_tokens
ORACLE["calibration_tokens"] = (
    _TOKENS + "SELECT doc_id, len(tokens[1:512]) AS n_tokens, md5(array_to_string(tokens[1:512], ' ')) AS digest FROM t"
)


def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.concat_corpus(corpus.with_tokens(_documents(spark, sf)))


_OFFSETS = (
    _TOKENS + ", o AS (SELECT doc_id, tokens, len(tokens) AS n_tokens, CAST(SUM(len(tokens)) OVER (ORDER BY doc_id) - len(tokens) AS BIGINT) AS start_offset FROM t) "
)
QUERIES["concat_corpus"] = _offsets
ORACLE["concat_corpus"] = _OFFSETS + "SELECT doc_id, start_offset, n_tokens FROM o"


def _windows_sql(lengths: str, keys: str) -> str:
    return (
        f"w AS (SELECT {keys}, k * 512 AS begin_, LEAST(k * 512 + 1024, n_tokens) AS end_ FROM (SELECT {keys}, n_tokens, unnest(range(CAST(1 + CEIL(GREATEST(n_tokens - 1024, 0) / 512.0) AS BIGINT))) AS k FROM {lengths} WHERE n_tokens > 0)), "
        f"v AS (SELECT {keys}, begin_ AS \"begin\", end_ AS \"end\", end_ - COALESCE(LAG(end_) OVER (PARTITION BY {keys} ORDER BY begin_), 0) AS target_len FROM w) "
    )


def _document_windows(spark, sf):
    counts = corpus.with_tokens(_documents(spark, sf)).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens")
    )
    return corpus.strided_windows(counts, "n_tokens").drop("n_tokens")


QUERIES["strided_windows"] = _document_windows
ORACLE["strided_windows"] = _OFFSETS + ", " + _windows_sql("o", "doc_id") + 'SELECT doc_id, "begin", "end", target_len FROM v'
QUERIES["corpus_windows"] = lambda spark, sf: corpus.corpus_windows(_offsets(spark, sf))
_STREAM = (
    _OFFSETS + ", l AS (SELECT 0 AS g, CAST(SUM(n_tokens) AS BIGINT) AS n_tokens FROM o), " + _windows_sql("l", "g")
)
ORACLE["corpus_windows"] = _STREAM + 'SELECT "begin", "end", target_len FROM v'


def _window_tokens(spark, sf):
    windows = corpus.window_tokens(corpus.with_tokens(_documents(spark, sf)))
    return windows.select(
        "begin", "target_len", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


QUERIES["window_tokens"] = _window_tokens
_POSITIONS = (
    ", x AS (SELECT start_offset + generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token FROM o) "
)
ORACLE["window_tokens"] = (
    _STREAM
    + _POSITIONS
    + ", y AS (SELECT CAST(FLOOR(pos / 512) AS BIGINT) * 512 AS b, pos, token FROM x UNION ALL SELECT CAST(FLOOR(pos / 512) AS BIGINT) * 512 - 512, pos, token FROM x) "
    + "SELECT \"begin\", target_len, COUNT(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM v JOIN y ON v.\"begin\" = y.b GROUP BY \"begin\", target_len"
)
QUERIES["corpus_perplexity"] = lambda spark, sf: corpus_perplexity(
    corpus.with_tokens(_documents(spark, sf))
)
# Loss of every target token, averaged within its window, weighted by the window's new tokens.
ORACLE["corpus_perplexity"] = (
    _STREAM
    + _POSITIONS
    + ", c AS (SELECT token, COUNT(*) AS c FROM x GROUP BY token), z AS (SELECT SUM(c) + COUNT(*) AS nv, SUM(c) AS n FROM c), "
    + "q AS (SELECT pos, -ln((c + 1.0e0) / (SELECT nv FROM z)) AS nll, CASE WHEN pos < 1024 THEN 0 ELSE CAST(FLOOR((pos - 512) / 512) AS BIGINT) * 512 END AS b FROM x JOIN c USING (token)), "
    + "m AS (SELECT b, AVG(nll) AS loss FROM q WHERE pos > 0 GROUP BY b) "
    + f"SELECT {r('exp(SUM(loss * target_len) / (SELECT n FROM z))', 4)} AS perplexity, CAST((SELECT n FROM z) AS BIGINT) AS n_tokens FROM v JOIN m ON v.\"begin\" = m.b"
)


# --- a model that sees the token before ---------------------------------------------
# The vocabulary is a parameter of the operators; these queries take one of the public files.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_D = f"{context_model.DISCOUNT!r}e0"


def _stream_sql(name: str, tokens: str) -> str:
    """Positions ``(pos, token, prev)`` of a token stream."""
    return (
        f"{name} AS (SELECT pos, token, LAG(token) OVER (ORDER BY pos) AS prev FROM (SELECT start_offset + generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token "
        f"FROM (SELECT tokens, SUM(len(tokens)) OVER (ORDER BY id) - len(tokens) AS start_offset FROM {tokens})))"
    )


def _tokens_sql(name: str, table: str, key: str) -> str:
    body = f"trim(text, {_CHARS})"
    return f"{name} AS (SELECT {key} AS id, CASE WHEN {body} = '' THEN [] ELSE regexp_split_to_array({body}, '{_RUN}') END AS tokens FROM {table} WHERE text IS NOT NULL)"


def _bigram_sql(model: str) -> str:
    """Tables of the model of a stream, and the loss of each position of the stream ``e``."""
    return (
        f"mp AS (SELECT prev, token, COUNT(*) AS n FROM {model} WHERE prev IS NOT NULL GROUP BY prev, token), "
        "mc AS (SELECT prev, SUM(n) AS ofn, COUNT(*) AS f FROM mp GROUP BY prev), "
        f"mu AS (SELECT token, COUNT(*) AS c FROM {model} GROUP BY token), "
        "mt AS (SELECT SUM(c) + COUNT(*) + 1.0e0 AS total FROM mu), "
        "h AS (SELECT e.pos, COALESCE(mp.n, 0) AS n, mc.ofn, mc.f, (COALESCE(mu.c, 0) + 1) / (SELECT total FROM mt) AS single "
        "FROM e LEFT JOIN mp USING (prev, token) LEFT JOIN mc USING (prev) LEFT JOIN mu ON mu.token = e.token WHERE e.prev IS NOT NULL), "
        f"nll AS (SELECT pos, -ln(CASE WHEN ofn IS NULL THEN single ELSE GREATEST(n - {_D}, 0.0e0) / ofn + {_D} * f / ofn * single END) AS nll FROM h)"
    )


def _windowed_sql(stride: int, length: int) -> str:
    """Mean losses of the windows' new tokens, weighted by these."""
    first = f"CASE WHEN pos < {length} THEN 0 ELSE 1 + CAST(FLOOR((pos - {length}) / {stride}) AS BIGINT) END"
    scored = f"pos % {length} <> 0" if stride == length else "TRUE"
    # Windows beyond the first that do not overlap are weighted only where they have a loss.
    return (
        f", k AS (SELECT {first} AS k, COUNT(*) AS target_len FROM e GROUP BY 1), m AS (SELECT {first} AS k, AVG(nll) AS loss FROM nll WHERE {scored} GROUP BY 1) "
        f"SELECT {r('exp(SUM(loss * target_len) / SUM(target_len))', 4)} AS perplexity, (SELECT COUNT(*) FROM e) AS n_tokens FROM k JOIN m USING (k)"
    )


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as a corpus of their own, which no model here is fitted on."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text").where(F.col("text").isNotNull())


_DOCS_SQL = _tokens_sql("td", "documents", "doc_id")
_ITEMS_SQL = _tokens_sql("ti", "benchmark", "item_id")
for _name, _stride in (("context_perplexity", 512), ("context_perplexity_disjoint", 1024)):
    QUERIES[_name] = lambda spark, sf, s=_stride: context_model.context_perplexity(
        corpus.with_tokens(_documents(spark, sf)), stride=s
    )
    ORACLE[_name] = (
        f"WITH {_DOCS_SQL}, {_stream_sql('e', 'td')}, {_bigram_sql('e')}" + _windowed_sql(_stride, 1024)
    )
QUERIES["context_perplexity_heldout"] = lambda spark, sf: context_model.context_perplexity(
    corpus.with_tokens(_items(spark, sf)), context_model.fit_bigrams(corpus.with_tokens(_documents(spark, sf))), 128, 256
)
ORACLE["context_perplexity_heldout"] = (
    f"WITH {_DOCS_SQL}, {_ITEMS_SQL}, {_stream_sql('s', 'td')}, {_stream_sql('e', 'ti')}, {_bigram_sql('s')}" + _windowed_sql(128, 256)
)
QUERIES["document_losses"] = lambda spark, sf: rounded(
    context_model.document_losses(
        corpus.with_tokens(_items(spark, sf)), context_model.fit_bigrams(corpus.with_tokens(_documents(spark, sf)))
    ), 6, "loss",
)
ORACLE["document_losses"] = (
    f"WITH {_DOCS_SQL}, {_ITEMS_SQL}, {_stream_sql('s', 'td')}, "
    "x AS (SELECT id, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM ti), "
    "e AS (SELECT row_number() OVER () AS pos, id, token, LAG(token) OVER (PARTITION BY id ORDER BY pos) AS prev FROM x), "
    f"{_bigram_sql('s')} SELECT ti.id AS doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, COALESCE(loss, 0.0e0) AS loss FROM ti "
    f"LEFT JOIN (SELECT id, {r('SUM(nll)', 6)} AS loss FROM nll JOIN e USING (pos) GROUP BY id) USING (id)"
)


def _subword_sample(spark, sf):
    ids = subword.token_ids(_documents(spark, sf), VOCABULARY, 512)
    digest = F.md5(F.array_join(F.col("ids").cast("array<string>"), " "))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("digest"))


def _subword_windows(spark, sf):
    windows = corpus.window_tokens(subword.stored_tokens(_documents(spark, sf), VOCABULARY, as_text=False))
    return windows.select(
        "begin", "target_len", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ")).alias("digest"),
    )


# Vocabularies are beyond SQL; tests compare with the corpus encoded as one string.
QUERIES["calibration_token_ids"] = _subword_sample
QUERIES["subword_window_tokens"] = _subword_windows
QUERIES["subword_perplexity"] = lambda spark, sf: context_model.context_perplexity(
    subword.stored_tokens(_documents(spark, sf), VOCABULARY)
)


# --- prompts -----------------------------------------------------------------------
def _build_prompt(spark, sf):
    items = table(spark, sf, "benchmark").withColumn("text", F.concat("text", F.lit(" ")))
    built = prompts.build_prompt(items, input_len=256, batch_size=4)
    return built.select(
        "item_id", F.col("batch_slot").cast("bigint").alias("batch_slot"),
        F.array_join("tokens", " ").alias("prompt"),
    )


QUERIES["build_prompt"] = _build_prompt
ORACLE["build_prompt"] = f"""WITH s AS (SELECT item_id, regexp_split_to_array(trim(text, {_CHARS}), '{_RUN}') AS w FROM benchmark WHERE trim(text, {_CHARS}) <> ''),
p AS (SELECT item_id, array_to_string(list_transform(range(256), lambda i: w[1 + i % len(w)]), ' ') AS prompt FROM s)
SELECT item_id, CAST(b AS BIGINT) AS batch_slot, prompt FROM p, range(1, 5) AS r(b)"""
QUERIES["render_chat"] = lambda spark, sf: prompts.render_chat(table(spark, sf, "conversations"))
ORACLE["render_chat"] = (
    "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id"
)


def _fewshot(spark, sf):
    items = table(spark, sf, "benchmark")
    return prompts.fewshot_prompts(items, items, k=3).select("item_id", "prompt")


QUERIES["fewshot_prompts"] = _fewshot
ORACLE["fewshot_prompts"] = """WITH pairs AS (SELECT i.item_id, i.text, p.text AS example, md5('42:' || CAST(p.item_id AS VARCHAR)) AS o, p.item_id AS pid,
ROW_NUMBER() OVER (PARTITION BY i.item_id ORDER BY md5('42:' || CAST(p.item_id AS VARCHAR)), p.item_id) AS k FROM benchmark i JOIN benchmark p ON i.item_id <> p.item_id)
SELECT item_id, string_agg(example, chr(10) || chr(10) ORDER BY k) || chr(10) || chr(10) || ANY_VALUE(text) AS prompt FROM pairs WHERE k <= 3 GROUP BY item_id"""
