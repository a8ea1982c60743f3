"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model reads characters in threes and is counted on trusted text, of which every character is a
class of its own, however many there are. Counts are kept in shards by the middle character, so
that a shard knows all trigrams of its contexts and all pairs that these back off to; a document
is turned into its distinct trigrams with their counts, dealt out to the same shards, and each
shard joins them with its counts and returns partial log probabilities, which add up to the
document's perplexity, and how many characters are rare after their context. A mean hides a few foreign words in a long
text; the share of rare characters does not. Quantiles of the trusted text of a language are
the limits of both, of the perplexity also downwards, where easy words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.text import partitions, table, unused, utf8
from bitledger.session import shared_folder

# Character classes: 0 any character that no trusted text has, 1 the edge of a text, then those of the
# trusted texts, the most frequent first. There are so many classes, or more if the texts have more.
CLASSES = 128
SHARDS = 32
_CODES = CLASSES * CLASSES * CLASSES // SHARDS  # trigrams of one shard, of so many classes
# A language's limits: these quantiles of its trusted text.
LOWER_QUANTILE, UPPER_QUANTILE = 0.005, 0.99
# So many documents show the quantiles. With fewer, n, the perplexity's way to them from the
# median is longer by ALLOWANCE * (1 / n - 1 / ENOUGH) of itself.
ENOUGH, ALLOWANCE = 100, 10.0
# A character of a lower log10 probability is rare.
RARE = -3.5
# Short texts vary more; each language has one limit per band of length.
BANDS = (50, 150, 500)
_CHUNK_CHARS = 4_000_000
# A task that counts holds so many trigrams at once (16 bytes each).
_HELD_CODES = 1_000_000
# Up to so many ids of trusted documents are broadcast (eight bytes each), and no text is shuffled
# for the model; more are joined.
MAX_BROADCAST_IDS = 2_000_000
# Up to so many languages and bands the limits are broadcast; beyond, they are joined.
MAX_BROADCAST_LIMITS = 20_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as of good quality and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    return good.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The trusted documents, all of which the model is counted on."""
    ids = trusted_ids(labels)
    if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    else:
        # The ids are hashed; no text is sorted.
        ids = ids.hint("shuffle_hash")
    return docs.join(ids, "doc_id", "left_semi")


class Alphabet(NamedTuple):
    """Class of each code point up to 0x10FFFF, and how many classes there are."""

    classes: np.ndarray
    size: int

    @property
    def width(self) -> int:
        """Factor of a code's places: classes up to a multiple of the shards; its cube has 61 bits at most."""
        return -(-self.size // SHARDS) * SHARDS


def alphabet(texts: DataFrame) -> Alphabet:
    """Every character of the texts has its own class; the driver gets one number for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                points = np.frombuffer((text or b"").decode().encode("utf-32-le"), np.uint32)
                if len(points):
                    found = np.bincount(points)
                    total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["point", "n"])

    counted = texts.select("text").mapInArrow(count, "point bigint, n bigint").groupBy("point").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    points, n = found.column("point").to_numpy(), found.column("n").to_numpy()
    classes = np.zeros(0x110000, np.int32)
    classes[points[np.lexsort((points, -n))]] = np.arange(2, len(points) + 2)
    return Alphabet(classes, max(CLASSES, len(points) + 2))


def trigrams(text: bytes, letters: Alphabet) -> np.ndarray:
    """Trigram codes of a text with its edges: one per character and one for the end."""
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    width = letters.width
    # The short ones sort faster.
    ids = np.empty(len(points) + 3, np.int32 if width**3 < 1 << 31 else np.int64)
    ids[:2] = ids[-1] = 1
    ids[2:-1] = letters.classes[points]
    return (ids[:-2] * width + ids[1:-1]) * width + ids[2:]


def _shards(codes: np.ndarray, width: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Shard and code within the shard, both from the context spread by its remainder: as the
    width is a multiple of the shards, that of the middle character."""
    context, last = np.divmod(codes, width)
    return context % SHARDS, (context // SHARDS) * width + last


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, each with its counts added up."""
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    return codes, total


def count_trigrams(texts: DataFrame, shared) -> DataFrame:
    """``(shard, code, n)`` of all trigrams of all texts; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = shared.value

        def done(codes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            shard, code = _shards(codes, letters.width)
            arrays = [pa.array(x, pa.int64()) for x in (shard, code, times)]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "code", "n"])

        parts, held = [], 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                if not text:
                    continue
                parts.append(np.unique(trigrams(text, letters), return_counts=True))
                held += len(parts[-1][0])
                if held >= _HELD_CODES:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    # Where adding up does not help, the sums go out.
                    if held > _HELD_CODES // 2:
                        yield done(*parts[0])
                        parts, held = [], 0
        if parts:
            yield done(*_summed(parts))

    counted = texts.select("text").mapInArrow(count, "shard bigint, code bigint, n bigint")
    return counted.groupBy("shard", "code").agg(F.sum("n").alias("n"))


def discounts(having: dict[int, int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the number of counts of 1 to 4."""
    n = [having.get(k, 0) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k
        out.append(min(max(d, 0.05), k - 0.05))
    return np.array(out)


def _discounted(counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted shares of each row of counts, and the weight left for the lower order."""
    off = d[np.minimum(counts, 3).astype(np.int64)]
    total = counts.sum(axis=-1, keepdims=True)
    seen = total > 0
    share = np.where(seen, (counts - off) / np.maximum(total, 1), 0.0)
    left = np.where(seen, off.sum(axis=-1, keepdims=True) / np.maximum(total, 1), 1.0)
    return share, left


class LowerOrders(NamedTuple):
    """Interpolated probability of each class alone, and the discounts of pairs and of trigrams."""

    p1: np.ndarray
    d2: np.ndarray
    d3: np.ndarray
    width: int


def lower_orders(counts: DataFrame, letters: Alphabet) -> LowerOrders:
    """From continuation counts; the driver gets one number a class."""
    context = F.expr(f"code div {letters.width}") * SHARDS + F.col("shard")
    pairs = counts.groupBy((context % letters.width).alias("v"), (F.col("code") % letters.width).alias("w")).agg(
        F.count("*").alias("n")
    )
    found = pairs.groupBy("w").agg(F.count("*").alias("n")).toArrow()
    unigram = np.zeros(letters.width, np.int64)
    unigram[found.column("w").to_numpy()] = found.column("n").to_numpy()

    def having(counted: DataFrame) -> dict[int, int]:
        return dict(counted.where(F.col("n") <= 4).groupBy("n").count().collect())

    share, left = _discounted(unigram, discounts({k: int((unigram == k).sum()) for k in (1, 2, 3, 4)}))
    return LowerOrders(share + left / letters.size, discounts(having(pairs)), discounts(having(counts)), letters.width)


def _backed_off(codes: np.ndarray, counts: np.ndarray, d: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Discounted shares of the wanted codes, and the weight that their contexts leave to the lower
    order. ``codes`` has those with counts, in order: context times ``width`` and the last class."""
    if not len(codes):
        return np.zeros(len(wanted)), np.ones(len(wanted))
    contexts, heads = np.unique(codes // width, return_index=True)
    off = d[np.minimum(counts, 3)]
    total, weight = np.add.reduceat(counts, heads), np.add.reduceat(off, heads)
    at = np.minimum(np.searchsorted(contexts, wanted // width), len(contexts) - 1)
    left = np.where(contexts[at] == wanted // width, weight[at] / total[at], 1.0)
    place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    share = np.where(codes[place] == wanted, (counts[place] - off[place]) / total[at], 0.0)
    return share, left


class Pairs:
    """Interpolated bigram probabilities ``[v, w]`` of the middle characters of a shard, which
    follow from the shard's trigrams: a pair is continued once by each that has it."""

    def __init__(self, shard: int, codes: np.ndarray, lower: LowerOrders) -> None:
        self.lower = lower
        context, last = np.divmod(codes, lower.width)
        middle = (context * SHARDS + shard) % lower.width
        self.codes, self.counts = np.unique(middle * lower.width + last, return_counts=True)

    def __len__(self) -> int:
        return self.lower.width

    def __getitem__(self, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        v, w = pair
        share, left = _backed_off(self.codes, self.counts, self.lower.d2, v * len(self) + w, len(self))
        return share + left * self.lower.p1[w]


def shard_table(
    shard: int, codes: np.ndarray, times: np.ndarray, p2: np.ndarray | Pairs, d3: np.ndarray, wanted: np.ndarray | None = None
) -> np.ndarray:
    """Log10 probability of the wanted trigram codes of a shard, if none are named of every one."""
    width = len(p2)
    if wanted is None:
        wanted = np.arange(width**3 // SHARDS)
    order = np.argsort(codes)
    share, left = _backed_off(codes[order], times[order], d3, wanted, width)
    context, last = np.divmod(wanted, width)
    return np.log10(share + left * p2[(context * SHARDS + shard) % width, last])


def _pack(keys: list[int], codes: list[np.ndarray], times: list[np.ndarray], width: int = CLASSES) -> list[tuple[int, bytes]]:
    """Per shard the documents' trigrams: keys, how many codes each has, codes and counts."""
    doc = np.repeat(np.arange(len(keys)), [len(c) for c in codes])
    shard, code = _shards(np.concatenate(codes), width)
    count = np.concatenate(times)
    order = np.argsort(shard, kind="stable")
    doc, shard, code, count = doc[order], shard[order], code[order], count[order]
    bounds = np.searchsorted(shard, np.arange(SHARDS + 1))
    ids = np.array(keys, np.int64)
    out = []
    for s in range(SHARDS):
        part = slice(bounds[s], bounds[s + 1])
        if part.start == part.stop:
            continue
        held, runs = np.unique(doc[part], return_counts=True)
        # Distinct codes are written once, a document has their places.
        known, at = np.unique(code[part], return_inverse=True)
        # A count is one byte; more than 254 times is written behind.
        large = np.flatnonzero(count[part] > 254)
        blob = b"".join(
            [
                np.array([len(held), len(at), len(large), len(known)], np.int64).tobytes(),
                ids[held].tobytes(),
                count[part][large].astype(np.int64).tobytes(),
                known.astype(np.int64).tobytes(),
                runs.astype(np.uint32).tobytes(),
                at.astype(np.min_scalar_type(len(known))).tobytes(),
                np.minimum(count[part], 255).astype(np.uint8).tobytes(),
            ]
        )
        out.append((s, blob))
    return out


def _parts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, how many codes each has, the distinct codes, the places of the codes in them, counts."""
    docs, codes, large, distinct = np.frombuffer(blob, np.int64, 4)
    at = 32
    parts = []
    kinds = ((np.int64, docs), (np.int64, large), (np.int64, distinct), (np.uint32, docs), (np.min_scalar_type(distinct), codes), (np.uint8, codes))
    for kind, n in kinds:
        parts.append(np.frombuffer(blob, kind, n, at))
        at += parts[-1].nbytes
    keys, rest, known, runs, places, count = parts
    count = count.astype(np.int64)
    count[count == 255] = rest
    return keys, runs, known, places, count


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, runs, known, places, count = _parts(blob)
    return keys, runs, known[places], count


def doc_key() -> Column:
    """Identity of a document: rows equal in id and text are one, others meet by chance only."""
    return F.xxhash64(F.lit("quality"), "doc_id", "text")


def log_probabilities(docs: DataFrame, counts: DataFrame, shared, lower: LowerOrders) -> DataFrame:
    """``(key, tokens, logp, rare)`` of every text with characters, from a join per shard.

    ``docs`` has ``key`` and ``text``. A shard is dealt out to several groups, which each get
    its counts, so that a group's share of the documents fits into memory.
    """
    spark = docs.sparkSession
    deals = max(1, -(-partitions(spark) // 8))
    sent = spark.sparkContext.broadcast(lower)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, number = shared.value, 0
        for batch in batches:
            keys, codes, times, size = [], [], [], 0

            def done() -> pa.RecordBatch:
                packed = _pack(keys, codes, times, letters.width)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _ in packed], pa.int64()),
                        pa.array([(keys[0] + number) % deals] * len(packed), pa.int64()),
                        pa.array([b for _, b in packed], pa.binary()),
                    ],
                    ["shard", "deal", "blob"],
                )

            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if not text:
                    continue
                found, n = np.unique(trigrams(text, letters), return_counts=True)
                keys.append(key)
                codes.append(found)
                times.append(n)
                size += len(text)
                if size >= _CHUNK_CHARS:
                    yield done()
                    number += 1
                    keys, codes, times, size = [], [], [], 0
            if keys:
                yield done()
                number += 1

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        keys, tokens, logs, rare = [], [], [], []
        if group.num_rows:
            shard = group.column("shard")[0].as_py()
            codes, times = known.column("code").to_numpy(), known.column("n").to_numpy()
            blobs = [blob.as_py() for blob in group.column("blob")]
            wanted = np.unique(np.concatenate([_parts(blob)[2] for blob in blobs]))
            table = shard_table(shard, codes, times, Pairs(shard, codes, sent.value), sent.value.d3, wanted)
            for blob in blobs:
                ids, runs, own, places, count = _parts(blob)
                logp = table[np.searchsorted(wanted, own)][places]
                heads = np.cumsum(runs, dtype=np.int64) - runs
                keys.append(ids)
                tokens.append(np.add.reduceat(count, heads))
                logs.append(np.add.reduceat(count * logp, heads))
                rare.append(np.add.reduceat(count * (logp < RARE), heads))
        none = [np.empty(0, np.int64)]
        return pa.table(
            {
                "key": np.concatenate(keys or none),
                "tokens": np.concatenate(tokens or none),
                "logp": np.concatenate(logs or [np.empty(0)]),
                "rare": np.concatenate(rare or none),
            }
        )

    dealt = docs.select("key", "text").mapInArrow(deal, "shard bigint, deal bigint, blob binary")
    every = counts.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))))
    partial = (
        dealt.groupBy("shard", "deal")
        .cogroup(every.select("shard", "deal", "code", "n").groupBy("shard", "deal"))
        .applyInArrow(score, "key bigint, tokens bigint, logp double, rare bigint")
    )
    return partial.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tokens", "logp", "rare")])


def _band(tokens: Column) -> Column:
    band = F.lit(0)
    for start in BANDS:
        band = band + (tokens > start).cast("int")
    return band


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, key, lang, n_tokens, perplexity, low_limit, limit,
    rare_share, rare_limit, keep``.

    ``perplexity`` is per character (the end of the text counts as one) under the model of the
    trusted documents, ``rare_share`` the share of characters less likely than ``RARE``; the
    limits are quantiles over the trusted documents of the same language and length band, else
    of the same band, else there are none and the document stays. A document is kept within its
    limits. Null and empty texts have no perplexity and are not kept. A null
    language is a language of its own. Rows with equal id and text are counted once per row
    and get equal results. Without trusted documents everything with characters is kept.
    """
    shared_folder(docs.sparkSession)
    keyed = docs.select("doc_id", "lang", "text", doc_key().alias("key"))
    trusted = trusted_documents(keyed, labels)
    letters = alphabet(trusted)
    shared = docs.sparkSession.sparkContext.broadcast(letters)
    # One table of counts serves the lower orders, the discounts and all shards.
    counts = count_trigrams(trusted, shared).checkpoint()
    # Repeated rows would add up under one key; a mean over equal rows is the same.
    scores = log_probabilities(keyed, counts, shared, lower_orders(counts, letters)).select(
        "key",
        "tokens",
        F.pow(F.lit(10.0), -F.col("logp") / F.col("tokens")).alias("perplexity"),
        (F.col("rare") / F.col("tokens")).alias("rare_share"),
    )
    rows = keyed.select("doc_id", "lang", "key", F.length("text").alias("_chars")).join(scores, "key", "left")
    rows = rows.withColumn("n_tokens", F.when(F.col("tokens").isNotNull(), F.col("_chars").cast("bigint") + 1))
    rows = rows.withColumn("band", _band(F.col("n_tokens"))).checkpoint()

    def quantile(name: str, q: float = UPPER_QUANTILE) -> Column:
        return F.percentile_approx(name, q, 10_000)

    def limits(prefix: str) -> list[Column]:
        few = F.greatest(ALLOWANCE * (1 / F.count("*") - 1 / ENOUGH), F.lit(0.0))
        ends = {}
        for name, q in (("low_limit", LOWER_QUANTILE), ("limit", UPPER_QUANTILE)):
            end = quantile("perplexity", q)
            ends[name] = end + few * (end - quantile("perplexity", 0.5))
        return [*[end.alias(prefix + name) for name, end in ends.items()], quantile("rare_share").alias(f"{prefix}rare_limit")]

    known = rows.join(trusted_ids(labels), "doc_id", "left_semi").where(F.col("perplexity").isNotNull())
    # One row a language and band, and one a band.
    own = known.groupBy(F.col("lang").alias("_lang"), F.col("band").alias("_band")).agg(*limits("_own_")).checkpoint()
    if own.limit(MAX_BROADCAST_LIMITS + 1).count() <= MAX_BROADCAST_LIMITS:
        own = F.broadcast(own)
    pooled = known.groupBy(F.col("band").alias("_band2")).agg(*limits("_pooled_"))
    names = ("low_limit", "limit", "rare_limit")
    limited = (
        rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("band") == F.col("_band")), "left")
        .join(F.broadcast(pooled), F.col("band") == F.col("_band2"), "left")
        .withColumns({name: F.coalesce(f"_own_{name}", f"_pooled_{name}") for name in names})
    )
    within = F.col("perplexity").between(F.col("low_limit"), F.col("limit")) & (F.col("rare_share") <= F.col("rare_limit"))
    keep = F.col("perplexity").isNotNull() & (F.col("limit").isNull() | within)
    return limited.select(
        "doc_id",
        "key",
        "lang",
        "n_tokens",
        "perplexity",
        "low_limit",
        "limit",
        "rare_share",
        "rare_limit",
        keep.alias("keep"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, columns and order of columns unchanged."""
    key, name = unused(docs, "_key", "_kept")
    kept = judged(docs, labels).where("keep").select(F.col("key").alias(name)).distinct()
    return docs.withColumn(key, doc_key()).join(kept, F.col(key) == F.col(name), "left_semi").drop(key)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, rare characters, their limits and verdict of every document."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")
