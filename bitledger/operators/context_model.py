"""A bigram model with back-off: counts by context, and perplexity that sees the token before.

The model is three tables: ``pairs`` (prev, token, n), ``contexts`` (prev, n, followers) and
``unigrams`` (token, c). A token's probability takes ``discount`` off its pair's count and gives
what that leaves to the single counts, which leave one share to tokens never seen:

    p(w | v) = max(n(v, w) - d, 0) / n(v) + d followers(v) / n(v) p(w),   p(w) = (c(w) + 1) / (N + V + 1)

and p(w) alone after a context never seen. Losses depend on (prev, token) only, so windows are
not put together: pairs are counted once, written to the shared folder and joined with the tables by
context and by token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitledger.functions.columns import round_half_up
from bitledger.operators.prefix import running_total
from bitledger.session import scratch_path

DISCOUNT = 0.75


@dataclass(frozen=True)
class BigramModel:
    pairs: DataFrame
    contexts: DataFrame
    unigrams: DataFrame
    discount: float = DISCOUNT


@dataclass(frozen=True)
class _Stream:
    """What is read from the texts once: the documents' ends, and the pairs that span two."""

    ends: DataFrame
    across: DataFrame
    n_tokens: Column


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several steps use, written to the shared folder so that none computes it again."""
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def _stream(tokens: DataFrame) -> _Stream:
    """Per document with tokens its place in the stream, its first and its last token."""
    read = tokens.select(
        "doc_id",
        F.greatest(F.size("tokens"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.try_element_at("tokens", F.lit(1)).alias("first"),
        F.try_element_at("tokens", F.lit(-1)).alias("last"),
    )
    # A filter ahead of the table would split each text twice.
    held = _stored(read, "ends").where("n_tokens > 0")
    ends = _stored(running_total(held, ["doc_id"], "n_tokens", "start"), "places")
    after = ends.select(F.col("start").alias("at"), F.col("first").alias("token"))
    across = ends.select((F.col("start") + F.col("n_tokens")).alias("at"), F.col("last").alias("prev")).join(after, "at")
    n_tokens = ends.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint")).scalar()
    return _Stream(ends, across, n_tokens)


def _pairs_of(tokens: Column) -> Column:
    """Neighbours in a list as structs of two."""
    left, right = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.size(tokens))
    return F.arrays_zip(left.alias("prev"), right.alias("token"))


def _exploded(tokens: DataFrame, *kept: str) -> DataFrame:
    """``(*kept, prev, token)``. An inner explode would split each text once more, to test for empty lists."""
    pairs = tokens.select(*kept, F.inline_outer(_pairs_of(F.col("tokens"))).alias("prev", "token"))
    return pairs.where(F.col("token").isNotNull())


def _counted(tokens: DataFrame, stream: _Stream) -> DataFrame:
    pairs = _exploded(tokens).union(stream.across.select("prev", "token"))
    return _stored(pairs.groupBy("prev", "token").agg(F.count("*").alias("n")), "pairs")


def stream_pairs(tokens: DataFrame) -> DataFrame:
    """``(prev, token, n)`` of the token stream: documents in ``doc_id`` order, one after another.

    Pairs inside documents are added up as they are read; those that span two documents come
    from the documents' ends. ``doc_id`` is unique; null and empty lists hold no token. The pairs
    are written to the shared folder once.
    """
    return _counted(tokens, _stream(tokens))


def _first_tokens(tokens: DataFrame, max_length: int) -> DataFrame:
    """One row ``tokens``, the first ``max_length`` of the stream; those many documents hold them."""
    cut = tokens.select("doc_id", F.slice("tokens", 1, max_length).alias("t"))
    head = cut.where(F.size("t") > 0).orderBy("doc_id").limit(max_length)
    return head.agg(F.slice(_joined(), 1, max_length).alias("tokens"))


def _last_tokens(tokens: DataFrame, max_length: int, size: Column) -> DataFrame:
    """One row ``tokens``, the last ``size`` of the stream, at most ``max_length``."""
    cut = tokens.select("doc_id", F.slice("tokens", F.greatest(F.size("tokens") - (max_length - 1), F.lit(1)), max_length).alias("t"))
    tail = cut.where(F.size("t") > 0).orderBy(F.desc("doc_id")).limit(max_length)
    row = tail.agg(_joined().alias("t")).withColumn("_m", size.cast("int"))
    return row.select(F.slice("t", F.greatest(F.size("t") - F.col("_m") + 1, F.lit(1)), max_length).alias("tokens"))


def _joined() -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda d: d["t"]))


def fit_bigrams(tokens: DataFrame, discount: float = DISCOUNT) -> BigramModel:
    """The model of a token stream ``(doc_id, tokens)``.

    Single counts follow from the pairs and the stream's first token, so the texts are read
    for the pairs and for the documents' ends only.
    """
    return _fit(tokens, _stream(tokens), discount)


def _fit(tokens: DataFrame, stream: _Stream, discount: float = DISCOUNT) -> BigramModel:
    if not 0 < discount < 1:
        raise ValueError("discount must lie between 0 and 1")
    pairs = _counted(tokens, stream)
    first = stream.ends.where(F.col("start") == 0).select(F.col("first").alias("token"))
    singles = pairs.select("token", "n").union(first.select("token", F.lit(1).cast("bigint")))
    unigrams = singles.groupBy("token").agg(F.sum("n").alias("c"))
    contexts = pairs.groupBy("prev").agg(F.sum("n").alias("n"), F.count("*").alias("followers"))
    return BigramModel(pairs, contexts, unigrams, discount)


def pair_losses(pairs: DataFrame, model: BigramModel) -> DataFrame:
    """``pairs`` (any columns beside prev and token) with ``loss``, the negative log of the token
    after its context. Each table is joined by its own key; none is broadcast by hand."""
    totals = model.unigrams.agg((F.coalesce(F.sum("c"), F.lit(0)) + F.count("*") + 1).cast("double"))
    if pairs is model.pairs:
        known = pairs.withColumn("_n", F.col("n"))
    else:
        known = pairs.join(model.pairs.select("prev", "token", F.col("n").alias("_n")), ["prev", "token"], "left")
    contexts = model.contexts.select("prev", F.col("n").alias("_of"), F.col("followers").alias("_f"))
    held = (
        known.join(contexts, "prev", "left")
        .join(model.unigrams.select("token", F.col("c").alias("_c")), "token", "left")
        .withColumn("_total", totals.scalar())
    )
    single = (F.coalesce("_c", F.lit(0)) + 1) / F.col("_total")
    taken = F.greatest(F.coalesce("_n", F.lit(0)) - F.lit(model.discount), F.lit(0.0)) / F.col("_of")
    left = F.lit(model.discount) * F.col("_f") / F.col("_of") * single
    return held.withColumn("loss", -F.log(F.when(F.col("_of").isNull(), single).otherwise(taken + left))).drop(
        "_n", "_of", "_f", "_c", "_total"
    )


def context_perplexity(
    tokens: DataFrame, model: BigramModel | None = None, stride: int = 512, max_length: int = 1024
) -> DataFrame:
    """``exp`` of the windows' mean losses weighted by their new tokens; one row.

    Without a model that of the stream itself is taken. As in a window the token before a new
    token is always there, except for the stream's first, the windows after the first one add
    up to the sum over all pairs; the first weighs its mean by all its tokens. With a stride of
    ``max_length`` no window knows the one before: its first token has no loss, and a last
    window of one token no weight. An empty stream, or one of a single token, gives null.
    """
    if not 0 < stride <= max_length:
        raise ValueError("stride must be positive and at most max_length")
    stream = _stream(tokens)
    if model is None:
        model = _fit(tokens, stream)
        losses = pair_losses(model.pairs, model)
    else:
        losses = pair_losses(_counted(tokens, stream), model)
    if stride == max_length:
        return _disjoint(tokens, stream, losses, max_length)
    # At most max_length pairs.
    first = _exploded(_first_tokens(tokens, max_length)).groupBy("prev", "token").agg(F.count("*").alias("n_first"))
    sums = (
        losses.join(F.broadcast(first), ["prev", "token"], "left")
        .agg(
            F.sum(F.col("n") * F.col("loss")).alias("whole"),
            F.sum(F.col("n_first") * F.col("loss")).alias("first"),
            F.sum("n_first").alias("scored"),
        )
        .withColumn("n_tokens", stream.n_tokens)
    )
    begin = F.least(F.col("n_tokens"), F.lit(max_length))
    loss = (F.col("whole") - F.col("first") + begin * F.col("first") / F.col("scored")) / F.col("n_tokens")
    return sums.select(round_half_up(F.exp(loss), 4).alias("perplexity"), "n_tokens")


def _cut_pairs(tokens: DataFrame, stream: _Stream, max_length: int) -> DataFrame:
    """``(prev, token, n_cut)``: the pairs that the windows cut, one a window."""
    size = F.lit(max_length).cast("bigint")
    start, n = F.col("start"), F.col("n_tokens")
    first, last = F.floor(start / size) + 1, F.floor((start + n - 1) / size)
    places = stream.ends.where(last >= first).select("doc_id", "start", F.sequence(first, last).alias("_k"))
    # The places are hashed; the texts are neither sorted nor kept.
    placed = tokens.join(places.hint("shuffle_hash"), "doc_id")

    def cut(k: Column) -> Column:
        at = (k * size - F.col("start")).cast("int")
        return F.struct(F.get("tokens", at - 1).alias("prev"), F.get("tokens", at).alias("token"))

    inside = placed.select(F.inline(F.transform("_k", cut)))
    between = stream.across.where(F.col("at") % size == 0).select("prev", "token")
    return inside.union(between).groupBy("prev", "token").agg(F.count("*").alias("n_cut"))


def _disjoint(tokens: DataFrame, stream: _Stream, losses: DataFrame, max_length: int) -> DataFrame:
    """All windows but the last one have equal sizes, so their means add up like all their pairs:
    those of the stream without the cut ones and those of the last window."""
    # Tokens of the last window; none in an empty stream.
    rest = F.when(stream.n_tokens > 0, (stream.n_tokens - 1) % max_length + 1).otherwise(0)
    last = _exploded(_last_tokens(tokens, max_length, rest)).groupBy("prev", "token").agg(F.count("*").alias("n_last"))
    sums = (
        losses.join(_cut_pairs(tokens, stream, max_length), ["prev", "token"], "left")
        .join(F.broadcast(last), ["prev", "token"], "left")
        .agg(
            F.sum((F.col("n") - F.coalesce("n_cut", F.lit(0)) - F.coalesce("n_last", F.lit(0))) * F.col("loss")).alias("full"),
            F.coalesce(F.sum(F.col("n_last") * F.col("loss")), F.lit(0.0)).alias("last"),
        )
        .withColumn("n_tokens", stream.n_tokens)
        .withColumn("_m", rest)
    )
    # A window of one token has no loss and no weight.
    scored = F.when(F.col("_m") > 1, F.col("_m")).otherwise(0)
    weight = scored + (F.col("n_tokens") - F.col("_m") if max_length > 1 else F.lit(0))
    share = F.coalesce(F.try_divide(scored, F.col("_m") - 1), F.lit(0.0))
    loss = F.col("full") * F.lit(max_length / max(max_length - 1, 1)) + F.col("last") * share
    return sums.select(round_half_up(F.exp(F.try_divide(loss, weight)), 4).alias("perplexity"), "n_tokens")


def document_losses(tokens: DataFrame, model: BigramModel) -> DataFrame:
    """Per document ``(doc_id, n_tokens, loss)``: the summed loss of its tokens after the first.

    The documents' pairs are counted before they meet the model. A document of one token or
    none has a loss of 0; a null list counts as empty.
    """
    sizes = tokens.select("doc_id", F.greatest(F.size("tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
    counted = _exploded(tokens, "doc_id").groupBy("doc_id", "prev", "token").agg(F.count("*").alias("n"))
    losses = pair_losses(counted, model).groupBy("doc_id").agg(F.sum(F.col("n") * F.col("loss")).alias("loss"))
    return sizes.join(losses, "doc_id", "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
