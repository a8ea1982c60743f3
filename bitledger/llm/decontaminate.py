"""Benchmark decontamination with a generalised suffix automaton over words.

The test items, normalised to words, are put into one automaton whose states stand for the
word sequences that occur in them. Training texts are streamed through it once; the length of
the longest match that ends at a word tells whether a whole window of some item ends there.
Items travel to the tasks in blocks of bounded size (``BLOCK_BYTES``), each read and broadcast
by itself. A worker holds one automaton at a time, some hundred times its block, and the texts of
all blocks, so its memory grows with the benchmark's text alone; several blocks are built anew
for every 16 MB of documents. Documents are not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitledger.llm.text import alnum_words, lower_ascii, table, utf8

WINDOW = 10
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Text bytes of one block of items; an item is never cut.
BLOCK_BYTES = 1_000_000
# Runs of hit words from this length on are cut out of a text.
CUT_WORDS = 8
# A shorter item is cut out where it stands in at most this share of the documents (two at
# least); a commoner one is no sign of the benchmark.
RARE_SHARE = 0.0001
# A document goes altogether when more than this share of its words is hit.
MAX_COVERAGE = 0.5


class SuffixAutomaton:
    """Every word sequence of the items, with the items that hold a window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        words = [(name, w) for name, w in items if w]
        for _, w in words:
            last = 0
            for word in w:
                last = self._extend(last, word)
        self._mark(words)

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for the short sequences of ``q``, to which the edges from ``p`` up then lead."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _mark(self, words: list[tuple[str, list[bytes]]]) -> None:
        size, window = len(self.next), self.window
        order = sorted(range(1, size), key=self.length.__getitem__)
        # The state of the last ``window`` words of a state's sequences.
        self.tail = [0] * size
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.tail[v] = v if self.length[up] < window else self.tail[up]
        self.items: list[set[str]] = [set() for _ in range(size)]
        short: list[dict[int, set[str]]] = [{} for _ in range(size)]
        for name, w in words:
            v = 0
            for i, word in enumerate(w):
                v = self.next[v][word]
                if i + 1 >= window:
                    self.items[self.tail[v]].add(name)
            if len(w) < window:
                short[v].setdefault(len(w), set()).add(name)
        # Whole short items that end where a state ends, longest first.
        self.short: list[list[tuple[int, set[str]]]] = [[] for _ in range(size)]
        for v in order:
            self.short[v] = sorted(short[v].items(), reverse=True) + self.short[self.link[v]]
        self.acts = [bool(self.tail[v] or self.short[v]) for v in range(size)]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit words as ``[start, end)`` in order of their ends, and the items they come from."""
        edges, link, length, acts = self.next, self.link, self.length, self.acts
        root, window = edges[0], self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        v = matched = 0
        for i, word in enumerate(words):
            if v:
                while v and word not in edges[v]:
                    v = link[v]
                    matched = length[v]
                if v:
                    v = edges[v][word]
                    matched += 1
                else:
                    v = root.get(word, 0)
                    matched = 1 if v else 0
            else:
                v = root.get(word, 0)
                if not v:
                    continue
                matched = 1
            if v and acts[v]:
                if matched >= window:
                    spans.append((i + 1 - window, i + 1))
                    items |= self.items[self.tail[v]]
                for size, names in self.short[v]:
                    if size <= matched:
                        spans.append((i + 1 - size, i + 1))
                        items |= names
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs; runs that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcasts of (item id as text, text) lists of about ``block_bytes`` each."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    context = benchmark.sparkSession.sparkContext
    cut = F.pmod(F.xxhash64("name", "text"), F.lit(max(count, 1)))
    return [
        context.broadcast([tuple(row) for row in items.where(cut == k).collect()]) for k in range(count)
    ]


class _Matcher:
    """Streams texts through one automaton after the other; one alone is kept."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window, self.kept = blocks, window, None

    def _automata(self) -> Iterator[SuffixAutomaton]:
        if self.kept:
            yield self.kept
            return
        for block in self.blocks:
            built = SuffixAutomaton(((n, alnum_words(t.encode())) for n, t in block.value), self.window)
            if len(self.blocks) == 1:
                self.kept = built
            yield built

    def __call__(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text the number of words, the merged runs and the items."""
        found = [[0, [], set()] for _ in texts]
        first = True
        for automaton in self._automata():
            for text, row in zip(texts, found):
                words = alnum_words(text or b"")
                spans, items = automaton.hits(words)
                row[0] = len(words)
                row[1] += spans
                row[2] |= items
            first = False
        if first:
            for text, row in zip(texts, found):
                row[0] = len(alnum_words(text or b""))
        return [(n, merged(spans), items) for n, spans, items in found]


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts of a batch, a bounded number of bytes at a time, and where they begin."""
    start, texts, size = 0, [], 0
    for text in utf8(batch.column(at)):
        texts.append(text)
        size += len(text or b"")
        if size >= 16_000_000:
            yield start, texts
            start, texts, size = start + len(texts), [], 0
    if texts:
        yield start, texts


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, item_ids, runs``.

    A word is hit when it lies inside an occurrence of a window, which is ``window`` words in
    a row of an item, or a whole shorter item. ``runs`` holds the hit words as disjoint
    ``[start, end)`` pairs and ``item_ids`` the items, sorted as text, whose windows occur.
    A null or wordless text has no words and no hits; items without words match nothing; a
    null item id reads as empty text; several rows of one item id count as one item. Rows are
    kept as they are, repeated ones included; an empty benchmark hits nothing. Only ``doc_id``
    and ``text`` (``item_id`` and ``text``) are read, other columns are ignored.
    """
    blocks = _blocks(benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(blocks, window)
        for batch in batches:
            for start, texts in _chunks(batch, 1):
                rows = match(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array([sum(e - s for s, e in runs) for _, runs, _ in rows], pa.int64()),
                        pa.array([sorted(items) for _, _, items in rows], pa.list_(pa.string())),
                        pa.array(
                            [[{"start": s, "end": e} for s, e in runs] for _, runs, _ in rows],
                            pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                        ),
                    ],
                    ["doc_id", "n_words", "n_hit", "item_ids", "runs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_hit bigint, item_ids array<string>, "
        "runs array<struct<start:bigint,end:bigint>>",
    )


def _rare_items(docs: DataFrame, benchmark: DataFrame, below: int, share: float) -> DataFrame:
    """Items of fewer than ``below`` words that stand in few documents, counted over all of them.
    The documents are read for it only where the benchmark has such items."""
    words = F.filter(F.split(lower_ascii(F.col("text")), _NOT_WORD), lambda w: w != "")
    named = benchmark.where(F.col("text").isNotNull()).select(words.alias("_words"), "text")
    short = named.where(F.size("_words").between(1, below - 1)).select(F.concat_ws(" ", "_words").alias("item_id"), "text")
    short = short.dropDuplicates(["item_id"])
    if short.isEmpty():
        return short
    seen = match_benchmark(docs, short, below).select(F.explode("item_ids").alias("item_id"))
    limit = max(2, int(share * docs.count()))
    return short.join(seen.groupBy("item_id").count().where(F.col("count") <= limit), "item_id", "left_semi")


def _word_places(text: bytes) -> list[tuple[int, int]]:
    places, at = [], 0
    lowered = text.lower()
    for word in alnum_words(text):
        at = lowered.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    return places


def cut_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs and what stands between them."""
    places, out, at = _word_places(text), [], 0
    for start, end in runs:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    cut_words: int = CUT_WORDS,
    max_coverage: float = MAX_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
    rare_share: float = RARE_SHARE,
) -> DataFrame:
    """The documents without benchmark passages, all columns of ``docs`` in their order.

    Documents with more than ``max_coverage`` of their words hit go. From the others, runs of
    at least ``cut_words`` hit words are cut out, again where the cut itself joins words to a
    new match; ``n_chars``, where there is one, follows the new text. Whole items of fewer words
    are cut too where they stand in at most ``rare_share`` of the documents (or in two); commoner
    ones are what clean text says as well. All other texts stay byte for byte. Null and empty
    texts stay. Hits are those of ``match_benchmark``.
    """
    blocks = _blocks(benchmark, block_bytes)
    rare = _blocks(_rare_items(docs, benchmark, cut_words, rare_share), block_bytes)
    at = docs.columns.index("text")
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    schema: T.StructType = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, match_rare = _Matcher(blocks, window), _Matcher(rare, cut_words)
        for batch in batches:
            for start, texts in _chunks(batch, at):
                part = batch.slice(start, len(texts))
                keep, changed = [True] * len(texts), {}
                todo = list(range(len(texts)))
                while todo:
                    again = []
                    few = match_rare([texts[i] for i in todo]) if rare else [(0, [], set())] * len(todo)
                    for i, (n, runs, _), (_, short, _) in zip(todo, match([texts[i] for i in todo]), few):
                        hit = sum(e - s for s, e in runs)
                        cut = merged([(s, e) for s, e in runs if e - s >= cut_words] + short)
                        if i not in changed and hit > max_coverage * n:
                            keep[i] = False
                        elif cut:
                            texts[i] = changed[i] = cut_runs(texts[i], cut)
                            again.append(i)
                    todo = again
                columns = part.columns
                if changed:
                    columns[at] = pa.array([t if t is None else t.decode() for t in texts], part.schema.types[at])
                    if length_at >= 0:
                        lengths = columns[length_at].to_pylist()
                        for i, text in changed.items():
                            lengths[i] = len(text.decode())
                        columns[length_at] = pa.array(lengths, part.schema.types[length_at])
                out = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield out if all(keep) else out.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``benchmark`` in every document."""
    found = match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, item, i, n FROM grams JOIN win USING (n, g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
