"""Language identification with script ranges and Viterbi over per-word scores.

Each word gets a score per language from hashed character n-grams; the script of its letters
narrows the languages down first. Along a text the best sequence of languages is found with a
penalty for each switch, which labels the spans of mixed text. Many texts go through the
recursion at once, one word place at a time, so it runs in numpy. The model has ``BUCKETS``
numbers a language and is broadcast; documents are not moved.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.text import table, utf8

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
# Log score that a switch of language must gain.
SWITCH_PENALTY = 12.0
# A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
# Languages that have all buckets; more share as many numbers.
MAX_LANGUAGES = 256
# Languages that a model can have at all; a column with more holds no languages.
LIMIT = 1 << 15
# Distinct words a task remembers before it forgets them and scores them anew.
_CACHE = 100_000
_CHUNK_WORDS = 300_000
# Words whose n-grams are hashed at once (some hundred bytes each for each array).
_SLICE = 20_000
UNKNOWN = "und"

# First code points of script ranges, ascending; each range reaches to the next start.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
_STARTS = [start for start, _ in _RANGES]
SCRIPTS = sorted({name for _, name in _RANGES})
_SCRIPT_AT = [SCRIPTS.index(name) for _, name in _RANGES]
# Bytes of words: ASCII letters and everything from 0x80 on.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letter_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and code points from U+0080."""
    if not text.isascii():
        return text.decode().lower().encode().translate(_LETTERS).split()
    return text.lower().translate(_LETTERS).split()


def script_of(char: str) -> int:
    return _SCRIPT_AT[bisect_right(_STARTS, ord(char)) - 1]


def letters_and_script(word: bytes) -> tuple[int, int]:
    """Number of letters and script of the first letter; without letters (0, 0)."""
    if word.isascii():
        return len(word), _SCRIPT_AT[0]
    text = word.decode()
    letters = sum(map(str.isalpha, text))
    return (letters, script_of(next(filter(str.isalpha, text)))) if letters else (0, 0)


def gram_buckets(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each marked word, and the position of the word.

    All words are hashed at once; word after word, so positions ascend.
    """
    joined = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(joined))
    code = np.zeros(len(joined), np.uint64)
    found, places = [], []
    for n in ORDERS:
        ahead = np.zeros(len(joined), np.uint64)
        ahead[: len(joined) - n + 1] = joined[n - 1 :]
        code = code * np.uint64(256) + ahead
        at = np.flatnonzero(left >= n)
        mixed = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(40)) % np.uint64(buckets))
        places.append(owner[at])
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(found).astype(np.int64)[order], place[order]


def held_out(remainder: int, modulus: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text) % modulus == remainder


class LanguageModel:
    """Log scores of n-gram buckets per language, and which languages a script allows."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        totals = counts.sum(axis=0, keepdims=True) + SMOOTHING * len(counts)
        # Overlapping n-grams say much the same thing; the mean over the orders tempers that.
        self.logs = (np.log((counts + SMOOTHING) / totals) / len(ORDERS)).astype(np.float32)
        shares = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        allowed = shares >= SCRIPT_SHARE
        # A script that no language knows leaves all of them.
        self.allowed = np.where(allowed.any(axis=1, keepdims=True), allowed, True)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each word and its scores; a word without letters scores 0 everywhere."""
        slices = [self._slice(words[k : k + _SLICE]) for k in range(0, len(words), _SLICE)]
        return np.concatenate([x for x, _ in slices]), np.concatenate([x for _, x in slices])

    def _slice(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = np.array([letters_and_script(w) for w in words], np.int64).reshape(-1, 2)
        letters, scripts = parts[:, 0], parts[:, 1]
        buckets, place = gram_buckets(words, len(self.logs))
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        scores = np.add.reduceat(self.logs[buckets], heads, axis=0)
        scores = np.where(self.allowed[scripts], scores, np.float32(-1e4))
        return letters, np.where(letters[:, None] > 0, scores, np.float32(0))


def fit(docs: DataFrame, buckets: int = BUCKETS) -> LanguageModel:
    """The model of all rows with a text and a language. Every n-gram of every text counts.

    Tasks add up per language and bucket before the shuffle; the driver gets one number a
    language and bucket, at most ``BUCKETS * MAX_LANGUAGES`` of them: beyond so many languages
    each has fewer buckets.
    """

    whole = buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = whole
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, found in words.items():
                total = sums.setdefault(lang, np.zeros(buckets + len(SCRIPTS), np.int64))
                if not found:
                    continue
                every, numbers = list(found), list(found.values())
                for k in range(0, len(every), _SLICE):
                    part = every[k : k + _SLICE]
                    kinds = np.array([letters_and_script(w) for w in part], np.int64)
                    times = np.array(numbers[k : k + _SLICE], np.int64) * (kinds[:, 0] > 0)
                    at, place = gram_buckets(part, buckets)
                    total[:buckets] += np.bincount(at, times[place], minlength=buckets).astype(np.int64)
                    np.add.at(total, buckets + kinds[:, 1], times * kinds[:, 0])
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), utf8(batch.column(0))):
                words.setdefault(lang, Counter()).update(letter_words(text))
                if sum(map(len, words.values())) > _CACHE:
                    settle()
        settle()
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())],
                ["lang", "bucket", "n"],
            )

    trained = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = (
        trained.mapInArrow(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
    )
    names = sorted(row[0] for row in trained.select("lang").distinct().limit(LIMIT + 1).collect())
    if len(names) > LIMIT:
        raise ValueError(f"more than {LIMIT} languages")
    # More languages share as many numbers: buckets are folded, a power of two of them together.
    while buckets > 1 and buckets * len(names) > BUCKETS * MAX_LANGUAGES and buckets % 2 == 0:
        buckets //= 2
    at = F.col("bucket")
    folded = F.when(at < whole, F.pmod(at, F.lit(buckets))).otherwise(at - whole + buckets)
    rows = sums.groupBy("lang", folded.alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets + len(SCRIPTS), len(names)), np.float64)
    place = {name: k for k, name in enumerate(names)}
    columns = [place[name] for name in rows.column("lang").to_pylist()]
    counts[rows.column("bucket").to_numpy(), columns] = rows.column("n").to_numpy()
    return LanguageModel(names, counts[:buckets], counts[buckets:])


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of each word of many texts whose words stand one text after the other.

    Staying wins a tie against switching; equal languages go to the first.
    """
    n, k = scores.shape
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    # Texts that still have a word at place t come first.
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    stayed = np.ones((n, k), bool)
    source = np.zeros(n, np.int16)
    state = np.zeros((len(sizes), k), np.float64)
    for t in range(longest):
        a = active[t]
        at = starts[:a] + t
        if t:
            before = state[:a]
            best = before.argmax(axis=1)
            switched = before[np.arange(a), best] - penalty
            stay = before >= switched[:, None]
            stayed[at], source[at] = stay, best
            state[:a] = np.where(stay, before, switched[:, None])
        state[:a] += scores[at]
    labels = np.zeros(n, np.int16)
    current = state.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = current[:a]
        current[:a] = np.where(stayed[at, current[:a]], current[:a], source[at])
    return labels


class _Labeller:
    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.letters = np.empty(0, np.int64)
        self.scores = np.empty((0, len(self.model.languages)), np.float32)

    def _learn(self, texts: list[list[bytes]]) -> None:
        """Scores the words that no earlier text had, all at once."""
        ids = self.ids
        new = list({word for words in texts for word in words if word not in ids})
        if new:
            letters, scores = self.model.words(new)
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
            self.letters = np.concatenate([self.letters, letters])
            self.scores = np.concatenate([self.scores, scores])

    def __call__(self, texts: list[list[bytes]]) -> list[tuple[str, float, list[dict]]]:
        """Language, share of its letters and spans of each text of words."""
        names = self.model.languages
        lengths = np.array([len(words) for words in texts], np.int64)
        if not names or not lengths.sum():
            return [(UNKNOWN, 0.0, [])] * len(texts)
        if len(self.ids) > _CACHE:
            self._forget()
        self._learn(texts)
        ids = np.fromiter((self.ids[w] for words in texts for w in words), np.int64, int(lengths.sum()))
        labels = viterbi(self.scores[ids], lengths)
        letters = self.letters[ids]
        text_of = np.repeat(np.arange(len(texts)), lengths)
        shares = np.bincount(
            text_of * len(names) + labels, letters, minlength=len(texts) * len(names)
        ).reshape(len(texts), len(names))
        cuts = np.flatnonzero((np.diff(labels) != 0) | (np.diff(text_of) != 0)) + 1
        heads = np.concatenate([[0], cuts])
        tails = np.concatenate([cuts, [len(ids)]])
        first = np.concatenate([[0], np.cumsum(lengths)])
        spans: list[list[dict]] = [[] for _ in texts]
        for head, tail in zip(heads.tolist(), tails.tolist()):
            k = int(text_of[head])
            spans[k].append(
                {"first": head - int(first[k]), "last": tail - 1 - int(first[k]), "lang": names[labels[head]]}
            )
        out = []
        for row, found in zip(shares, spans):
            total = row.sum()
            best = int(row.argmax())
            out.append((names[best], float(row[best] / total), found) if total else (UNKNOWN, 0.0, []))
        return out


def label_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, lang_score, lang_spans``.

    ``lang_spans`` has runs of words (ASCII letters and code points from U+0080, counted from
    0) with their language. ``lang_pred`` is the language with most letters (ties: the first
    by name) and ``lang_score`` its share of all letters. A null text, one without a letter, and
    every text under a model without languages is ``und`` with score 0 and no spans. Only the
    text decides. Rows are kept as they are; columns of ``docs`` with the new names are
    replaced; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _Labeller(shared.value)
        for batch in batches:
            start, texts, size = 0, [], 0

            def done() -> pa.RecordBatch:
                rows = label(texts)
                part = batch.slice(start, len(texts))
                return pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.float64()),
                        pa.array([r[2] for r in rows], pa.list_(span)),
                    ],
                    [*part.schema.names, "lang_pred", "lang_score", "lang_spans"],
                )

            for text in utf8(batch.column(at)):
                texts.append(letter_words(text or b""))
                size += len(texts[-1])
                if size >= _CHUNK_WORDS:
                    yield done()
                    start, texts, size = start + len(texts), [], 0
            if texts:
                yield done()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(
        run,
        ", ".join([*fields, "lang_pred string", "lang_score double", "lang_spans array<struct<first:bigint,last:bigint,lang:string>>"]),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 leaves another remainder than 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(1, 3))
    model = fit(docs.where(~F.col("held_out")))
    return label_languages(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id",
        "held_out",
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.size("lang_spans").cast("bigint").alias("n_spans"),
    )
