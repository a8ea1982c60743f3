"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash. A source takes all its documents a whole number of times and, once
more, those below a hash threshold. The threshold is found without sorting: tokens are summed
by source and hash bucket, the bucket in which the budget ends is the only one that is cut
further, and so on over ``LEVELS`` levels of ``BITS`` bits. Taking is then a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitledger.llm.text import table, unused
from bitledger.session import shared_folder

CYCLE = (5, 2, 1)
MAX_COPIES = 3
BITS, LEVELS = 12, 5
# Up to so many sources (tens of bytes each) the thresholds are broadcast; beyond, joined.
MAX_BROADCAST_SOURCES = 50_000
_SALT = "mixing"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_SPACE_WORD)), F.lit(0)).cast("bigint")


def place_of() -> Column:
    """The document's hash as a number of ``BITS * LEVELS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(_SALT), "doc_id", "text"), 64 - BITS * LEVELS)


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], max_copies: int) -> DataFrame:
    """Per source its size, weight and target. One row a source; the windows see those only.

    Sources stand in code-point order, null last, and weigh the numbers of ``cycle`` in turn.
    Filled in order of size per weight, a source stops at ``max_copies`` times its size as
    soon as its share of what is left would exceed that; the others share the rest by weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle)))
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (turn + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / weight_left).withColumn(
        "open", F.col("cap") > F.col("level") * F.col("weight")
    )
    # All sources from the first open one on share at its level.
    shared = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(every)
    return level.withColumn("shared", shared).select(
        "source",
        "source_size",
        F.when(F.col("open"), F.col("shared") * F.col("weight")).otherwise(F.col("cap")).alias("target"),
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source ``whole`` (times that all is taken) and ``below``, the hash up to which
    documents are taken once more; null where none is."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.select(
        "source",
        whole.cast("bigint").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("need"),
    ).withColumn("prefix", F.lit(0).cast("bigint"))
    for depth in range(LEVELS):
        rest = BITS * (LEVELS - depth - 1)
        # Only documents of the boundary bucket so far meet their source's row.
        inside = sizes.select(
            F.col("source").alias("_s"),
            "size",
            F.shiftright("place", rest + BITS).alias("_p"),
            F.shiftright("place", rest).bitwiseAND(F.lit((1 << BITS) - 1)).alias("bucket"),
        )
        sums = (
            inside.join(state, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_p") == F.col("prefix")))
            .groupBy("source", "whole", "need", "prefix", "bucket")
            .agg(F.sum("size").alias("tokens"))
        )
        # At most 2^BITS buckets a source.
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        state = (
            sums.withColumn("_to", F.sum("tokens").over(up_to))
            .where((F.col("_to") > F.col("need")) & (F.col("_to") - F.col("tokens") <= F.col("need")))
            .select(
                "source",
                "whole",
                (F.col("need") - (F.col("_to") - F.col("tokens"))).alias("need"),
                (F.shiftleft("prefix", BITS) + F.col("bucket")).alias("prefix"),
                F.col("tokens").alias("_last"),
            )
        )
        if depth < LEVELS - 1:
            state = state.drop("_last")
    # The document at the boundary is taken where that brings the sum nearer to the target.
    below = F.col("prefix") + F.when(F.col("need") * 2 >= F.col("_last"), 1).otherwise(0)
    found = state.select(F.col("source").alias("_s"), below.alias("below"))
    bare = targets.select("source", "source_size", "target", whole.cast("bigint").alias("whole"))
    return bare.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix_sources(
    docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_copies: int = MAX_COPIES
) -> DataFrame:
    """All columns of ``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``.

    Sizes are white-space words (a null text has none). A null source is a source of its own,
    the last. ``mix_copies`` (0 to ``max_copies``) says how often the mix takes the document;
    a source's taken words differ from its target by at most the size of the documents at its
    threshold. The choice depends on ``doc_id`` and ``text`` alone, so reruns agree and equal
    rows are all taken alike. Rows without words may count as taken or not. An empty table
    gives an empty result; columns of ``docs`` with the new names are replaced.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    # The texts are read once for all levels; sizes and hashes are a small part of them.
    sizes = docs.select("source", word_count(F.col("text")).alias("size"), place_of().alias("place")).checkpoint()
    found = thresholds(sizes, source_targets(sizes, cycle, max_copies)).checkpoint()
    small = found.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    plain = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    source, whole, below, place = unused(plain, "_source", "_whole", "_below", "_place")
    limits = found.select(
        F.col("source").alias(source),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("whole").alias(whole),
        F.col("below").alias(below),
    )
    placed = plain.withColumns({"mix_size": word_count(F.col("text")), place: place_of()})
    joined = placed.join(F.broadcast(limits) if small else limits, F.col("source").eqNullSafe(F.col(source)))
    once_more = F.coalesce((F.col(place) < F.col(below)).cast("bigint"), F.lit(0))
    return joined.withColumn(
        "mix_copies", F.least(F.col(whole) + once_more, F.lit(max_copies).cast("bigint"))
    ).drop(source, whole, below, place)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and taken words of every document."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )
