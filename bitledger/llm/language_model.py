"""LM scoring with a hashed maximum-entropy model.

A word is predicted class first: the classes are the end of a text, the commonest words one by
one, and groups of words with like endings. The class follows from a softmax over hashed
n-gram and skip features of the words before and their classes; the word within its class
follows from its count. Weights are trained by rounds of distributed updates: each round reads
its share of the training texts, every task adds up observed and expected feature counts, and
their sums move the weights. Counts of words never pass through one place, and texts do not
move: a task scores the classes where it reads a text, and asks shards of the counts once for
each word of a chunk of texts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.answers import added, answers, gathered, steps, walked
from bitledger.llm.language import held_out
from bitledger.llm.text import partitions, space_words, table, utf8
from bitledger.session import scratch_path, shared_folder

CLASSES = 32
COMMON_WORDS = 11  # classes 1 to 11; 0 is the end of a text
_GROUPS = CLASSES - 1 - COMMON_WORDS
# Rows of the weights: the word before, the one before that (skip), both (bigram), the classes
# of the two before, and the classes of the third and fourth before (skip).
_WORD, _SKIP, _BIGRAM = 4096, 2048, 4096
_PAIR = CLASSES * CLASSES
_STARTS = np.cumsum([0, _WORD, _SKIP, _BIGRAM, _PAIR])
ROWS = int(_STARTS[-1]) + _PAIR
KINDS = 5
ROUNDS = 3
RATE = 0.5
# Counts added to both sides of an update, so that rare features move little.
CAUTION = 20.0
_CHUNK = 16_384
_CACHE = 300_000
_BLOCK = 512  # rows of weights that are summed together
# Words before a token that bear on it.
_PAD = 4
# Tokens of the texts of a chunk, and bytes after which a long text is read in pieces.
CHUNK_TOKENS = 2_000_000
_PIECE = 4 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
END = b""


def _pieces(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text in pieces of bounded size, and whether a piece is the last."""
    at = 0
    while len(text) - at > 2 * _PIECE and (found := _WHITE.search(text, at + _PIECE)):
        yield space_words(text[at : found.start()]), False
        at = found.start()
    yield space_words(text[at:] if at else text), True


def class_group(word: bytes) -> int:
    return 1 + COMMON_WORDS + zlib.crc32(word[-3:]) % _GROUPS


def _group_column(word: Column) -> Column:
    last = F.substring(word, -3, 3)
    whole = F.when(F.octet_length(word) < 3, word).otherwise(last)
    return (F.crc32(whole) % _GROUPS + 1 + COMMON_WORDS).cast("int")


def count_words(texts: DataFrame) -> DataFrame:
    """``(w, c)``: counts of all words; the end of a text counts as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "c"]
            )
            found.clear()
            return out

        for batch in batches:
            for text in utf8(batch.column(0)):
                for words, _ in _pieces(text or b""):
                    found.update(words)
                found[END] += 1
                if len(found) > _CACHE:
                    yield done()
        yield done()

    return texts.select("text").mapInArrow(count, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What a model keeps of the counts: totals and classes. Its size does not depend on them."""

    def __init__(self, counts: DataFrame):
        word = F.col("w") != F.lit(bytearray(END))
        total = counts.agg(F.sum("c"), F.count("*")).first()
        self.tokens, self.distinct = total[0] or 0, total[1]
        ends = counts.where(~word).agg(F.sum("c")).first()[0] or 0
        words = counts.where(word)
        top = words.orderBy(F.desc("c"), "w").limit(COMMON_WORDS).collect()
        self.common = {bytes(row["w"]): k + 1 for k, row in enumerate(top)}
        groups = words.groupBy(_group_column(F.col("w")).alias("g")).agg(
            F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")
        )
        mass, once = np.zeros(CLASSES), np.zeros(CLASSES)
        mass[0] = ends
        for row in groups.collect():
            mass[row["g"]], once[row["g"]] = row["c"], row["once"]
        for row in top:
            k = class_group(bytes(row["w"]))
            mass[k] -= row["c"]
            once[k] -= row["c"] == 1
            mass[self.common[bytes(row["w"])]] = row["c"]
        self.once = once
        # A group leaves unseen words what words seen once have, and one more.
        self.unseen = np.where(np.arange(CLASSES) > COMMON_WORDS, once + 1, 0)
        self.mass = mass + self.unseen
        self.bias = np.log((mass + 1) / (mass + 1).sum()).astype(np.float32)

    def in_class(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probability of words within their classes, from their counts (0: unseen)."""
        single = classes <= COMMON_WORDS
        share = np.where(counts > 0, counts, self.unseen[classes]) / np.maximum(self.mass[classes], 1)
        return np.where(single, 0.0, np.log10(np.where(single, 1.0, share)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + (self.distinct + 1)))


class _Codes(dict):
    """Per word its hash and class in one number, remembered up to a bound."""

    def __init__(self, common: dict[bytes, int]):
        super().__init__()
        self.common = common
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
            self[END] = 0
        known = self.common.get(word)
        value = self[word] = (zlib.crc32(word) << 5) | (class_group(word) if known is None else known)
        return value


class _Numbers(dict):
    """Words numbered as they come, with their codes and the hashes by which they are counted."""

    def __init__(self, common: dict[bytes, int]):
        super().__init__()
        self.common = common
        self.start()

    def start(self) -> None:
        self.clear()
        self.codes, self.keys = array("q"), array("q")
        self[END]  # number 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.codes)
        known = self.common.get(word)
        group = 0 if not word else class_group(word) if known is None else known
        self.codes.append((zlib.crc32(word) << 5) | group)
        self.keys.append(word_key(word))
        return number


def word_key(word: bytes) -> int:
    """What ``xxhash64`` of Spark gives for the word."""
    value = xxhash.xxh64_intdigest(word, 42)
    return value - (1 << 64) if value >> 63 else value


def _flat(texts: list[list[bytes]], numbers: dict, before: list[list[int]], ended: list[bool]):
    """Numbers of all words, each text after the numbers ``before`` it, an end as 0 where it ends;
    and the tokens of each text."""
    flat: list[int] = []
    lengths = []
    for words, context, last in zip(texts, before, ended):
        flat += context
        flat += map(numbers.__getitem__, words)
        if last:
            flat.append(0)
        lengths.append(len(words) + last)
    return np.array(flat, np.int64), np.array(lengths, np.int64)


def _rows(every: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight rows and class of each token, the text it is of and its place, from codes."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(of)) + _PAD * (of + 1)
    one, two, three, four = (every[at - k] for k in (1, 2, 3, 4))
    h1, h2 = one >> 5, two >> 5
    c1, c2, c3, c4 = one & 31, two & 31, three & 31, four & 31
    rows = np.empty((KINDS, len(at)), np.int32)
    rows[0] = h1 % _WORD
    rows[1] = _STARTS[1] + (h2 * 2654435761 >> 7) % _SKIP
    rows[2] = _STARTS[2] + (h1 * 40503 + h2 * 30011 >> 5) % _BIGRAM
    rows[3] = _STARTS[3] + c1 * CLASSES + c2
    rows[4] = _STARTS[4] + c3 * CLASSES + c4
    return rows, every[at] & 31, of, at


def features(texts: list[list[bytes]], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight rows and class of each token (words and one end a text), and the text it is of."""
    flat, lengths = _flat(texts, codes, [[0] * _PAD] * len(texts), [True] * len(texts))
    return _rows(flat, lengths)[:3]


def class_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log probability of every class for each token."""
    logits = weights[rows[0]] + bias
    for kind in rows[1:]:
        logits += weights[kind]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def target_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's own class."""
    logits = weights[rows[0]] + bias
    for kind in rows[1:]:
        logits += weights[kind]
    logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(classes)), classes]
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def _in_chunks(texts: Iterator[bytes | None], numbers: dict) -> Iterator[tuple]:
    """Some texts or pieces at a time: the rows they are of, words, the numbers of the words
    before each and whether its text ends with it."""
    rows, words, before, ended, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        context = [0] * _PAD
        for piece, last in _pieces(text or b""):
            rows.append(row)
            words.append(piece)
            before.append(context)
            ended.append(last)
            size += len(piece) + 1
            context = (context + [numbers[w] for w in piece[-_PAD:]])[-_PAD:] if not last else context
            if size >= _CHUNK:
                yield rows, words, before, ended
                rows, words, before, ended, size = [], [], [], [], 0
    if rows:
        yield rows, words, before, ended


def feature_sums(texts: DataFrame, weights: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Observed and expected counts, ``[2, ROWS, CLASSES]``, summed over the texts.

    Every task sends its sums once, in blocks of rows, and they are added up block by block as
    they stream in; at most as many tasks read as there are shuffle partitions.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((weights, vocabulary.bias, vocabulary.common))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, common = shared.value
        codes = _Codes(common)
        seen = np.zeros(ROWS * CLASSES, np.float32)
        expected = np.zeros((CLASSES, ROWS))
        texts = (text for batch in batches for text in utf8(batch.column(0)))
        for _, words, before, ended in _in_chunks(texts, codes):
            every, target = _rows(*_flat(words, codes, before, ended))[:2]
            for start in range(0, len(target), _CHUNK):
                rows, classes = every[:, start : start + _CHUNK], target[start : start + _CHUNK]
                shares = np.exp(class_logs(w, bias, rows))
                by_class = np.ascontiguousarray(shares.T, np.float64)
                for k, kind in enumerate(rows):
                    first, last = _STARTS[k], [*_STARTS[1:], ROWS][k]
                    inner = kind - first
                    for c in range(CLASSES):
                        expected[c, first:last] += np.bincount(inner, by_class[c], minlength=last - first)
                    np.add.at(seen, kind * CLASSES + classes, np.float32(1))
        both = np.stack([seen.reshape(ROWS, CLASSES), expected.T.astype(np.float32)])
        blocks = [k for k in range(0, ROWS, _BLOCK) if both[:, k : k + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([both[:, k : k + _BLOCK].tobytes() for k in blocks], pa.binary())],
            ["block", "sums"],
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                values = np.frombuffer(blob, np.float32).astype(np.float64)
                sums[block] = sums[block] + values if block in sums else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            ["block", "sums"],
        )

    schema = "block bigint, sums binary"
    parts = min(partitions(spark), ROWS // _BLOCK)
    spread = texts.select("text").coalesce(partitions(spark)).mapInArrow(add, schema)
    out = np.zeros((2, ROWS, CLASSES))
    for row in spread.repartition(parts, "block").mapInArrow(total, schema).collect():
        k = row["block"]
        part = np.frombuffer(bytes(row["sums"]), np.float64).reshape(2, -1, CLASSES)
        out[:, k : k + part.shape[1]] = part
    return out


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over all texts in ``rounds`` disjoint shares, one update a share."""
    weights = np.zeros((ROWS, CLASSES), np.float32)
    share = F.pmod(F.xxhash64(F.lit("share"), "doc_id", F.length("text")), F.lit(rounds))
    for k in range(rounds):
        seen, expected = feature_sums(texts.where(share == k), weights, vocabulary)
        weights += (RATE * np.log((seen + CAUTION) / (expected + CAUTION))).astype(np.float32)
    return weights


def _score_classes(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """Rows of two kinds by ``chunk``: documents with their tokens, the log10 probability of
    their classes and their words (``at`` and ``times``, as places in the chunk); and one with the
    distinct words of the chunk, as ``keys`` and ``classes``."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, vocabulary.bias, vocabulary.common))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "doc_id", "held_out", "n_tokens", "class_score", "at", "times", "size", "keys", "classes"]
    schema = (
        f"chunk bigint, doc_id {kind}, held_out boolean, n_tokens bigint, class_score double, "
        "at binary, times binary, size bigint, keys binary, classes binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, common = shared.value
        numbers = _Numbers(common)
        chunk = TaskContext.get().partitionId() << 32
        for group in _runs(batches):
            ids = pa.concat_arrays([b.column(0) for b in group])
            n = len(ids)
            tokens, score = np.zeros(n, np.int64), np.zeros(n)
            keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
            waiting: list[np.ndarray] = []
            held = 0
            texts = (text for b in group for text in utf8(b.column(2)))
            for rows, words, before, ended in _in_chunks(texts, numbers):
                flat, lengths = _flat(words, numbers, before, ended)
                found, classes, of, at = _rows(np.array(numbers.codes, np.int64)[flat], lengths)
                owner = np.array(rows)[of]
                tokens += np.bincount(owner, minlength=n)
                for start in range(0, len(classes), _CHUNK):
                    part = slice(start, start + _CHUNK)
                    logs = target_logs(w, bias, found[:, part], classes[part])
                    score += np.bincount(owner[part], logs, minlength=n)
                waiting.append(owner << 32 | flat[at])
                held += len(of)
                if held >= CHUNK_TOKENS:
                    keys, times = _collect(keys, times, waiting)
                    waiting, held = [], 0
            keys, times = _collect(keys, times, waiting)
            hashes = np.array(numbers.keys, np.int64)
            # Words of one hash, if ever, are counted as one.
            distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            keys, times = added(keys >> 32 << 32 | place[keys & 0xFFFFFFFF], times)
            cuts = np.searchsorted(keys, np.arange(n + 1) << 32)
            parts = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:])]
            chunks = pa.array(np.full(n, chunk, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    chunks, ids, pa.concat_arrays([b.column(1) for b in group]), pa.array(tokens), pa.array(score / np.log(10)),
                    pa.array([steps(keys[x] & 0xFFFFFFFF) for x in parts], pa.binary()),
                    pa.array([times[x].astype(np.uint32).tobytes() for x in parts], pa.binary()),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                ],
                names,
            )
            classes = (np.array(numbers.codes, np.int64)[first] & 31).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    chunks[:1], pa.nulls(1, ids.type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()),
                    pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                    pa.array([len(distinct)], pa.int64()), pa.array([distinct.tobytes()], pa.binary()),
                    pa.array([classes.tobytes()], pa.binary()),
                ],
                names,
            )
            numbers.start()
            chunk += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _collect(keys: np.ndarray, times: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([np.empty(0, np.int64), *more])
    return added(np.concatenate([keys, new]), np.concatenate([times, np.ones(len(new), np.int64)]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows in groups of about CHUNK_TOKENS tokens, taken to have six bytes; a row is in one."""
    group, size = [], 0
    for batch in batches:
        start = 0
        for row, text in enumerate(batch.column(2)):
            size += len(text.as_buffer() or b"") // 6 + 1
            if size >= CHUNK_TOKENS:
                yield [*group, batch.slice(start, row + 1 - start)]
                group, size, start = [], 0, row + 1
        if start < batch.num_rows:
            group.append(batch.slice(start))
    if group:
        yield group


def score_texts(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` per row of ``docs``.

    Texts are read once and do not move. What a task has found of a chunk of them is written to
    the shared folder, and meets there the counts of the chunk's distinct words.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "scored")
    _score_classes(docs, vocabulary, weights).write.parquet(path, compression="zstd")
    rows = spark.read.parquet(path)
    asked = rows.where(F.col("keys").isNotNull()).select("chunk", "size", "keys")
    keyed = counts.groupBy(F.xxhash64("w").alias("key")).agg(F.sum("c").alias("number")).checkpoint()
    answered = answers(asked, keyed, lambda blob: np.frombuffer(blob, np.int64))
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def total(group: pa.Table, known: pa.Table) -> pa.Table:
        model = shared.value
        classes = next(x.as_py() for x in group.column("classes") if x.is_valid)
        c = gathered(known)
        share = model.in_class(np.frombuffer(classes, np.uint8).astype(np.int64), c)
        base = model.base(c)
        group = group.filter(group.column("at").is_valid())
        out = np.zeros((3, group.num_rows))
        for k, (at, times) in enumerate(zip(group.column("at"), group.column("times"))):
            here, weight = walked(at.as_py()), np.frombuffer(times.as_py(), np.uint32).astype(np.float64)
            out[:, k] = weight[c[here] > 0].sum(), weight @ base[here], weight @ share[here]
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "held_out": group.column("held_out"),
                "n_tokens": group.column("n_tokens"),
                "n_known": pa.array(out[0].astype(np.int64)),
                "base_score": pa.array(out[1]),
                "score": pa.array(out[2] + group.column("class_score").to_numpy()),
            }
        )

    return (
        rows.select("chunk", "doc_id", "held_out", "n_tokens", "class_score", "at", "times", "classes")
        .groupBy("chunk")
        .cogroup(answered.groupBy("chunk"))
        .applyInArrow(
            total,
            f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
        )
    )


def score_held_out(docs: DataFrame, remainder: int = 2, modulus: int = 7) -> DataFrame:
    """Learn from the rows whose crc32 of the id leaves another remainder, score all rows.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; the scores
    are log10 probabilities of the whole text, ``base_score`` by smoothed word counts alone.
    Words are lower-cased (A-Z) runs without ASCII white space, and every text has one end as
    its last token. Null and empty texts consist of the end. A null id counts as empty text for
    the split. Repeated rows are trained on and scored each. Without training rows all words
    are unknown and all classes alike. Only ``doc_id`` and ``text`` are read; an empty table
    gives an empty result.
    """
    shared_folder(docs.sparkSession)
    split = docs.select("doc_id", "text").withColumn("held_out", held_out(remainder, modulus))
    training = split.where(~F.col("held_out"))
    counts = count_words(training).checkpoint()
    vocabulary = Vocabulary(counts)
    weights = train(training, vocabulary)
    scored = score_texts(split, counts, vocabulary, weights)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from six in seven of them."""
    return score_held_out(table(spark, sf_dir, "documents"))
