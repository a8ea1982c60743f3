"""Source divergence audit: which sources of a language differ, and in which terms.

1. Terms in ``min_docs`` documents of a language or more are kept; sorted by language and bytes
   they get their ordinals.
2. The kept terms, dealt to buckets by hash, become minimal acyclic transducers that map a term
   to its ordinal: one per language and bucket of ``BUCKET_TERMS`` terms (expected).
3. All texts are read again. A task adds up equal words of a group (language and source) and
   sends them to the buckets, salted by the amount of text; there they stream through the
   transducer, and what it accepts is counted by group and ordinal.
4. Shares are compared in exact integers, blocks of ordinals by stripes of sources, so that
   neither the vocabulary nor the pairs of sources meet in one task. Ordinals break ties.

Nothing is broadcast by hand and nothing is collected but two totals.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitledger.llm.text import LOWER, UPPER, partitions, table, utf8
from bitledger.llm.transducer import Transducer, build
from bitledger.session import shared_folder

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
# Expected kept terms of a bucket, bytes of text whose words one deal counts.
BUCKET_TERMS = 50_000
DEAL_BYTES = 32 << 20
# Distinct words that a task holds before it sends them on.
_HELD = 300_000
# A longer text is cut between words into pieces of about so many bytes.
_PIECE = 4 << 20
# Ordinals of a block, sources of a stripe, cells of a matrix at once.
BLOCK, STRIPE = 4096, 256
_CELLS = 1 << 22
# Bytes of a term: ASCII letters, lower-cased, and all of code points from U+0080.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    text = text.translate(_TERM)
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + _PIECE)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def _named(docs: DataFrame) -> DataFrame:
    """``(lang, source, text)`` as strings, nulls as empty ones."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_frequencies(named: DataFrame) -> DataFrame:
    """``(lang, term, docs)``: documents of a language that hold a term, added up in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def done() -> Iterator[pa.RecordBatch]:
            for lang, counter in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counter), np.int64))),
                        pa.array(list(counter), pa.binary()).cast(pa.string()),
                        pa.array(list(counter.values()), pa.int64()),
                    ],
                    ["lang", "term", "docs"],
                )
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found: set[bytes] = set()
                for words in terms_of(text):
                    found.update(words)
                counts[lang].update(found)
                if sum(map(len, counts.values())) > _HELD:
                    yield from done()
        yield from done()

    rows = named.select("lang", "text").mapInArrow(count, "lang string, term string, docs bigint")
    return rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, docs, ordinal)`` of the terms in ``min_docs`` documents of their language
    or more; ordinals count from 0 over all languages, by language and term in byte order.

    Null languages and texts read as empty; a term is a run of letters and of code points from
    U+0080, lower-cased in A-Z alone. Repeated rows are documents of their own; an empty table
    gives an empty result.
    """
    shared_folder(docs.sparkSession)
    kept = document_frequencies(_named(docs)).where(F.col("docs") >= min_docs)
    ranges = kept.repartitionByRange(partitions(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
            at += batch.num_rows
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, places], ["lang", "term", "docs", "part", "place"])

    placed = ranges.mapInArrow(number, "lang string, term string, docs bigint, part int, place bigint").checkpoint()
    # One row a partition.
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return placed.join(first, "part").select("lang", "term", "docs", (F.col("first") + F.col("place")).alias("ordinal"))


def _bucket(term: Column, buckets: int) -> Column:
    """The bucket of a term; ``zlib.crc32`` of its bytes gives the same."""
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def transducers(terms: DataFrame, buckets: int) -> DataFrame:
    """``(lang, bucket, machine, ordinals)``: the transducer of a bucket's sorted terms and the
    ordinals of the vocabulary at its own."""

    def make(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("ordinal").to_numpy())
        words = group.column("term").cast(pa.binary()).take(pa.array(order))
        return pa.table(
            {
                "lang": group.column("lang").slice(0, 1),
                "bucket": group.column("bucket").slice(0, 1),
                "machine": pa.array([build(w.as_py() for w in words)], pa.binary()),
                "ordinals": pa.array([group.column("ordinal").to_numpy()[order].tobytes()], pa.binary()),
            }
        )

    dealt = terms.select("lang", _bucket(F.col("term"), buckets).alias("bucket"), "term", "ordinal")
    return dealt.groupBy("lang", "bucket").applyInArrow(make, "lang string, bucket int, machine binary, ordinals binary")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, ordinal, n)``: occurrences of the terms of ``vocabulary`` in each group.

    ``n`` is above 0. Words are counted by streaming them through the transducers.
    """
    named = _named(docs)
    buckets = max(1, -(-terms.count() // BUCKET_TERMS))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = max(1, -(-size // (DEAL_BYTES * buckets)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        chunk = TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            rows: list[tuple] = []
            for (lang, source), counter in counts.items():
                parts: dict[int, list[bytes]] = defaultdict(list)
                for word in counter:
                    parts[zlib.crc32(word) % buckets if buckets > 1 else 0].append(word)
                for bucket, words in parts.items():
                    numbers = np.fromiter(map(counter.__getitem__, words), np.int64, len(words))
                    rows.append((bucket, chunk % salts, lang, source, b" ".join(words), numbers.tobytes()))
            counts.clear()
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary())
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "salt", "lang", "source", "words", "numbers"]
            )

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                for words in terms_of(text):
                    counts[lang, source].update(words)
                if sum(map(len, counts.values())) > _HELD:
                    yield done()
                    chunk += 1
        yield done()

    def recount(words: pa.Table, machines: pa.Table) -> pa.Table:
        out: dict[str, list] = {"lang": [], "source": [], "ordinal": [], "n": []}
        langs = words.column("lang").to_pylist()
        rows_of: dict[str, list[int]] = defaultdict(list)
        for row, lang in enumerate(langs):
            rows_of[lang].append(row)
        for lang, machine, known in zip(
            machines.column("lang").to_pylist(), machines.column("machine"), machines.column("ordinals")
        ):
            rows = rows_of.get(lang)
            if not rows:
                continue
            reader = Transducer(machine.as_py())
            ordinals = np.frombuffer(known.as_py(), np.int64)
            sources, codes = np.unique([words.column("source")[r].as_py() for r in rows], return_inverse=True)
            blobs = [words.column("words")[r].as_py() for r in rows]
            numbers = [np.frombuffer(words.column("numbers")[r].as_py(), np.int64) for r in rows]
            text = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
            stops = np.flatnonzero(text == 32)
            starts = np.concatenate([[0], stops[:-1] + 1])
            at = reader.ordinals(text, starts, stops - starts)
            owner = np.repeat(codes, [len(x) for x in numbers])
            held = at >= 0
            cells, back = np.unique(owner[held] * reader.terms + at[held], return_inverse=True)
            sums = np.zeros(len(cells), np.int64)
            np.add.at(sums, back, np.concatenate(numbers)[held])
            out["lang"].append(pa.array([lang], pa.string()).take(pa.array(np.zeros(len(cells), np.int64))))
            out["source"].append(pa.array(sources.tolist(), pa.string()).take(pa.array(cells // reader.terms)))
            out["ordinal"].append(pa.array(ordinals[cells % reader.terms]))
            out["n"].append(pa.array(sums))
        kinds = {"lang": pa.string(), "source": pa.string(), "ordinal": pa.int64(), "n": pa.int64()}
        return pa.table({c: pa.chunked_array(out[c], kinds[c]) for c in kinds})

    dealt = named.mapInArrow(deal, "bucket int, salt int, lang string, source string, words binary, numbers binary")
    machines = transducers(terms, buckets).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    counted = (
        dealt.groupBy("bucket", "salt")
        .cogroup(machines.groupBy("bucket", "salt"))
        .applyInArrow(recount, "lang string, source string, ordinal bigint, n bigint")
    )
    return counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, exact for totals below 9e15."""
    whole = np.asarray(total, np.int64) + 2 * terms
    rest, share = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // whole
        rest = rest % whole
    return 1 + share


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The same on columns, by division of decimals."""
    exact = (count.cast("decimal(19,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", exact, total.cast("decimal(19,0)") + 2 * terms.cast("decimal(19,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each two sources of a language with kept terms, both ways.

    ``counts`` as of ``term_counts``; ``groups``: lang, source, place (from 0 in its language),
    sources, total, terms.
    """

    def compare(held: pa.Table, present: pa.Table) -> pa.Table:
        out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
        if held.num_rows and present.num_rows:
            order = np.argsort(present.column("place").to_numpy())
            names = [present.column("source")[int(k)].as_py() for k in order]
            totals = present.column("total").to_numpy()[order]
            terms = present.column("terms")[0].as_py()
            place = {name: k for k, name in enumerate(names)}
            row = np.array([place[s] for s in held.column("source").to_pylist()], np.int64)
            found, column = np.unique(held.column("ordinal").to_numpy(), return_inverse=True)
            n = held.column("n").to_numpy()
            first = STRIPE * held.column("stripe")[0].as_py()
            mine = range(first, min(first + STRIPE, len(names)))
            sums = np.zeros((len(mine), len(names)), np.int64)
            width = max(1, _CELLS // len(names))
            for at in range(0, len(found), width):
                here = (column >= at) & (column < at + width)
                cells = np.zeros((len(names), min(width, len(found) - at)), np.int64)
                cells[row[here], column[here] - at] = n[here]
                p = _shares(cells, totals[:, None], terms)
                for k in mine:
                    apart = p[k + 1 :] - p[k]
                    sums[k - first, k + 1 :] += (apart * apart // (p[k + 1 :] + p[k])).sum(axis=1)
            for k in mine:
                out["source"] += [names[k]] * (len(names) - k - 1)
                out["item"] += names[k + 1 :]
                out["value"] += sums[k - first, k + 1 :].tolist()
            out["lang"] = [present.column("lang")[0].as_py()] * len(out["value"])
        return pa.table(
            {c: pa.array(out[c], pa.int64() if c == "value" else pa.string()) for c in ("lang", "source", "item", "value")}
        )

    stripes = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / STRIPE).cast("int"))).alias("stripe")
    cut = groups.select("lang", "sources").distinct().select("lang", stripes)
    block = F.floor(F.col("ordinal") / BLOCK).alias("block")
    cells = counts.select("lang", "source", "ordinal", "n", block).join(cut, "lang")
    places = counts.select("lang", block).distinct().join(cut, "lang").join(groups, "lang")
    # Names of their own, since both sides come from the same tables.
    places = places.select(*[F.col(c).alias(c) for c in ("lang", "block", "stripe", "source", "place", "total", "terms")])
    keys = ("lang", "block", "stripe")
    sums = (
        cells.groupBy(*keys)
        .cogroup(places.groupBy(*keys))
        .applyInArrow(compare, "lang string, source string, item string, value bigint")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    return sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far the sources of each language differ.

    Part ``pair``: every other source of the language with the divergence of the two, summed over
    all kept terms. Part ``term``: the ``top`` kept terms that a source has more of than its
    language. A term's share is ``1 + floor(10^9 (n + 2) / (N + 2 V))`` of its group, and two
    shares p, q are ``floor((p - q)^2 / (p + q))`` apart; all in integers, exact for up to 9e15
    words. Ranks go by value, then by item in byte order. Null texts, languages and sources
    read as empty. A group without terms has equal shares of all; a language without kept terms
    has zeros. Only ``lang``, ``source`` and ``text`` are read; an empty table gives no rows.
    """
    shared_folder(docs.sparkSession)
    terms = vocabulary(docs, min_docs).checkpoint()
    counts = term_counts(docs, terms).checkpoint()
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    by_lang = Window.partitionBy("lang")
    groups = (
        named.join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select(
            "lang",
            "source",
            (F.row_number().over(by_lang.orderBy("source")) - 1).alias("place"),
            F.count("*").over(by_lang).alias("sources"),
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("terms", F.lit(0)).alias("terms"),
        )
        .checkpoint()
    )
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = (
        groups.select("lang", "source")
        .join(others, "lang")
        .where("source <> item")
        .join(pair_sums(counts, groups.where("terms > 0")), ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    lang_totals = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shared = (
        counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
        .join(lang_totals, "lang")
        .join(whole, ["lang", "ordinal"])
        .select(
            "lang",
            "source",
            "ordinal",
            _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
        .where("p > q")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = (
        shared.select("lang", "source", "ordinal", _distance(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= top)
    )
    named_terms = best.join(terms.select("ordinal", F.col("term").alias("item")), "ordinal").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank"
    )
    return pairs.union(named_terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; nulls, ties and empty groups as ``audit`` defines them."""
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (s.total + 2 * v.v))::BIGINT AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (
  SELECT lang, term, (1 + {SCALE}::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)))::BIGINT AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
tops AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM tops QUALIFY rank <= {TOP}
"""
