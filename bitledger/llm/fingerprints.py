"""Document fingerprints by I-Match with several randomised lexicon subsets.

Only DataFrame and SQL functions are used. Terms are hashed to ``SLOTS`` slots whose document
frequencies are counted over all documents; the lexicon is the band of slots with a middling
inverse document frequency. It is one array of bits, of a size that does not depend on the
corpus. A document keeps its terms in the band, distinct and sorted; the hash of all of them
and of those in each lexicon subset make up the fingerprint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitledger.llm.text import lower_ascii, partitions, table

SLOTS = 1 << 22
# Band of log2(documents / documents with the term).
LOW_IDF, HIGH_IDF = 4.0, 10.0
# Random subsets of the lexicon: so many of each size, one term in 16, in 64 or in 256. Large
# subsets tell short texts apart, small ones leave long texts something in common.
SUBSETS = 12
SUBSET_PARTS = (16, 64, 256)
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms_of(text: Column) -> Column:
    """Distinct terms: lower-cased (A-Z) runs of ASCII letters, digits and code points from U+0080."""
    words = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _NOT_WORD)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def lexicon(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF) -> DataFrame:
    """One row ``bits``: an array of longs with a bit for each slot whose idf is in the band."""
    total = docs.where(F.col("text").isNotNull()).agg(F.count("*")).scalar()
    slots = docs.select(F.explode(F.array_distinct(F.transform(terms_of(F.col("text")), _slot))).alias("slot"))
    counted = slots.groupBy("slot").agg(F.count("*").alias("df"))
    idf = F.log2(total / F.col("df"))
    band = counted.where((idf >= low) & (idf <= high))
    words = band.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")
    )
    every = docs.sparkSession.range(SLOTS // 64).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    # A fixed number of rows, whatever the corpus.
    return filled.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits")
    )


def kept_terms(text: Column, bits: Column) -> Column:
    """Sorted distinct terms in the band, or all terms where none is, with their hashes."""

    def set_at(slot: Column) -> Column:
        word = F.get(bits, F.shiftright(slot, 6))
        return F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    def inside(term: Column) -> Column:
        return _with(_slot(term), set_at)

    def choose(terms: Column) -> Column:
        return _with(F.filter(terms, inside), lambda band: F.when(F.size(band) > 0, band).otherwise(terms))

    return F.transform(
        F.array_sort(_with(terms_of(text), choose)), lambda t: F.struct(t.alias("t"), F.xxhash64(t).alias("h"))
    )


def fingerprint(kept: Column) -> Column:
    """Hash of all kept terms and of those in each subset, eight hex digits each; ``.`` for none."""

    def digest(terms: Column) -> Column:
        text = F.concat_ws(" ", F.transform(terms, lambda x: x["t"]))
        return F.when(F.size(terms) == 0, ".").otherwise(F.right(F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"), F.lit(8)))

    def part_of(terms: Column, k: int, part: int) -> Column:
        # Another window of the terms' hashes for each k; its larger subsets hold the smaller ones.
        return F.filter(terms, lambda x: F.pmod(F.shiftright(x["h"], 4 * k), F.lit(part)) == 0)

    def subsets(terms: Column, k: int, parts: tuple[int, ...]) -> Column:
        def written(held: Column) -> Column:
            return F.concat_ws("-", digest(held), *([subsets(held, k, parts[1:])] if parts[1:] else []))

        return _with(part_of(terms, k, parts[0]), written)

    return F.concat_ws("-", digest(kept), *[subsets(kept, k, SUBSET_PARTS) for k in range(SUBSETS)])


def likeness(one: Column, other: Column) -> Column:
    """Share of equal hashes among the places where either fingerprint has terms; 1 if none has."""
    pairs = F.arrays_zip(F.split(one, "-").alias("a"), F.split(other, "-").alias("b"))
    used = F.filter(pairs, lambda p: (p["a"] != ".") | (p["b"] != "."))
    same = F.size(F.filter(used, lambda p: p["a"] == p["b"]))
    return _with(F.size(used), lambda n: F.when(n == 0, 1.0).otherwise(same / n))


def with_fingerprints(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF) -> DataFrame:
    """All columns of ``docs`` with ``terms_kept`` and ``fingerprint``; no document is moved.

    Null and wordless texts have no terms and the fingerprint of the empty text. Equal texts
    have equal fingerprints. Columns with the new names are replaced.
    """
    bits = lexicon(docs, low, high).scalar()
    kept = docs.drop("fingerprint", "terms_kept").withColumn("_bits", bits)
    kept = kept.withColumn("_kept", kept_terms(F.col("text"), F.col("_bits")))
    return kept.withColumns(
        {"terms_kept": F.transform("_kept", lambda x: x["t"]), "fingerprint": fingerprint(F.col("_kept"))}
    ).drop("_bits", "_kept")


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows with ``_range`` (descending neighbours share one) and ``_guest``.

    The range bounds are ids that occur. The largest id of a range is sent to the next higher
    range as well, as a guest after its last row, and the largest of all to the lowest range,
    so that every row finds its successor in its own range.
    """
    width = max(1, math.isqrt(ranges))
    marks = [k / ranges for k in range(1, ranges)] + [1.0]
    bounds = docs.agg(F.array_sort(F.array_distinct(F.percentile_approx("_id", marks, 100_000))).alias("b"))
    steps = F.filter("b", lambda x, i: (i + 1) % width == 0)
    found = bounds.select(F.struct("b", steps.alias("s")).alias("x")).scalar()
    placed = docs.withColumn("_x", found)
    coarse = F.size(F.filter(F.col("_x.s"), lambda x: x < F.col("_id")))
    own = _with(
        coarse * width,
        lambda c: c + F.size(F.filter(F.slice(F.col("_x.b"), c + 1, F.lit(width)), lambda x: x < F.col("_id"))),
    )
    placed = placed.withColumn("_own", own)
    largest = F.get(F.col("_x.b"), F.col("_own")) == F.col("_id")
    here = F.struct(F.col("_own").alias("_range"), F.lit(False).alias("_guest"))
    there = F.struct(
        F.pmod(F.col("_own") + 1, F.size("_x.b")).cast("int").alias("_range"), F.lit(True).alias("_guest")
    )
    places = F.when(largest, F.array(here, there)).otherwise(F.array(here))
    return placed.withColumn("_p", F.explode(places)).select(*docs.columns, "_p._range", "_p._guest")


def edited_fingerprints(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF) -> DataFrame:
    """Per row of ``docs`` the fingerprints of its text and of an edited one, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document in descending ``doc_id`` (after the last: the first); equal
    ids stand in order of their texts, null ids come last. Returns ``doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next``. Null texts count as empty; an
    empty table gives an empty result; only ``doc_id`` and ``text`` are read. Texts move once,
    to ranges of ids. ``doc_id`` is an integer column.
    """
    bits = lexicon(docs, low, high).scalar()
    lowest = F.lit(-(2**63)).cast("bigint")
    plain = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("_id")
    )
    ranged = _in_ranges(plain, partitions(docs.sparkSession))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("_id").desc(), "text")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)
    )
    texts = (
        ranged.withColumn("_next", F.lead("text").over(order))
        .withColumn("edited", edited)
        .drop("_next")
        .withColumn("_bits", bits)
        .withColumn("_kept", kept_terms(F.col("text"), F.col("_bits")))
        .withColumn("_edited_kept", kept_terms(F.when(~F.col("_guest"), F.col("edited")), F.col("_bits")))
        .drop("_bits")
        .withColumns({"fingerprint": fingerprint(F.col("_kept")), "edited_fingerprint": fingerprint(F.col("_edited_kept"))})
        .drop("_kept", "_edited_kept")
        .withColumn("_next_fingerprint", F.lead("fingerprint").over(order))
    )
    return texts.where(~F.col("_guest")).select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_fingerprint")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
