"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

1. A task cuts texts before single spaces, where neither tokenizer has a token across, into
   words with what stands beside them. Each different word of a chunk of documents is encoded and
   aligned once.
2. Words are aligned by comparing the byte offsets where tokens end. An end that both tokenizers
   share is a cut. Divide and conquer finds them: from the middle of an interval outwards, each
   end of A is looked for among the ends of B by bisect; the first that both share splits the
   interval in two, and an interval without one is a leaf group. The intervals of all words of a
   batch take each step together.
3. Tokens whose bytes overlap are linked. Links are added up by id pair in chunks of documents,
   then over the corpus; the highest count of each B id is one number a vocabulary entry.
4. Each chunk asks shards of the counted pairs for the pairs it holds, so that neither the pairs
   nor the documents meet in one place.

Texts are read once; the results are written to the shared folder before they are counted.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.answers import added, answers, gathered, steps, walked
from bitledger.llm.text import table
from bitledger.session import scratch_path

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Characters of texts whose new words are encoded together; a longer text is read in pieces.
_BATCH = 1_000_000
# Words, and different words, after which a chunk of documents ends.
CHUNK_WORDS, CHUNK_DISTINCT = 2_000_000, 400_000
# A space that stands alone between two characters, the second no white space.
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others for U+0100 and up, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


# How byte-level vocabularies of this kind cut a text before merging bytes.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizers:
    """Both tokenizers with the bytes of their ids.

    The byte-level file gives each merge once and in the order of its ids. Then merging the pair
    with the smallest id, as rank vocabularies do, gives the same tokens, about ten times faster;
    a file that is not like this is read by the library it is written for.
    """

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.byte = Tokenizer.from_file(byte_path)
        self.byte.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        entries = self.byte.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.bytes_b = []
        for k in range(self.piece.vocab_size()):
            piece = self.piece.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.piece.is_byte(k) else piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # No piece holds a space after another character, so text can be cut before one.
        self.cuttable = not any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.bytes_b)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = {end: np.array([b"%d%s" % (k, end) for k in range(most)], object) for end in (b",", b"|", b";")}
        self.ranked = None
        if (ranks := self._ranks(json.loads(self.byte.to_str()))) is not None:
            self.ranked = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ranks(self, file: dict) -> dict[bytes, int] | None:
        model, cut = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not file["normalizer"] and cut.get("type") == "ByteLevel"
        if not plain or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("ignore_merges"):
            return None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get("".join(pair)) for pair in pairs]
        special = {t["id"] for t in file["added_tokens"]}
        ordinary = sorted(set(model["vocab"].values()) - special)
        # 256 single bytes, then each merge's token with the next id.
        if None in made or made != ordinary[256:] or any(len(self.bytes_a[k]) != 1 for k in ordinary[:256]):
            return None
        return {self.bytes_a[k]: k for k in ordinary}

    def encode_a(self, text: str) -> list[int]:
        """Ids of A for the text as it is."""
        if self.ranked:
            return self.ranked.encode_ordinary(text)
        return self.byte.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.encode_a(" " + t) for t in texts], self.piece.encode(texts, num_threads=1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and numbers of ids of A and B, word after word, and which words keep their bytes.

        Words as they are cut from texts; those without white space at their ends are encoded by
        A as one text, since a space between them is a cut.
        """
        raw = [b" " + w.encode() for w in words]
        if not words or any(w[0].isspace() or w[-1].isspace() for w in words):
            a = [self.encode_a(" " + w) for w in words]
            n_a = np.array([len(x) for x in a], np.int64)
            ids_a = np.fromiter(chain.from_iterable(a), np.int64, int(n_a.sum()))
        else:
            ids_a = np.array(self.encode_a(" " + " ".join(words)), np.int64)
            ends = np.cumsum(self.size_a[ids_a])
            stops = np.cumsum([len(x) for x in raw])
            last = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            if (ends[last] != stops).any():
                raise ValueError("the byte-level vocabulary has a token across a space between words")
            n_a = np.diff(last, prepend=-1)
        b = self.piece.encode(words, num_threads=1)
        n_b = np.array([len(x) for x in b], np.int64)
        ids_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        return ids_a, n_a, ids_b, n_b, self._kept(self.bytes_a, ids_a, n_a, raw) & self._kept(self.bytes_b, ids_b, n_b, raw)

    @staticmethod
    def _kept(entries: list[bytes], ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        parts = list(map(entries.__getitem__, ids.tolist()))
        if b"".join(parts) == b"".join(raw):
            # The bytes agree as a whole; words agree where their tokens end with them.
            ends = np.cumsum([len(x) for x in parts])
            stops = np.cumsum(counts)
            whole = np.where(stops > 0, ends[np.maximum(stops, 1) - 1], 0) == np.cumsum([len(x) for x in raw])
            return whole & np.concatenate([[True], whole[:-1]])
        stops = np.cumsum(counts).tolist()
        return np.array([b"".join(parts[x:y]) == w for x, y, w in zip([0, *stops[:-1]], stops, raw)], bool)

    def holds(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both encodings give the bytes of the text after a space."""
        whole = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """Loaded once in a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (byte_path, piece_path) not in _LOADED:
        _LOADED[byte_path, piece_path] = Tokenizers(byte_path, piece_path)
    return _LOADED[byte_path, piece_path]


def pieces_of(text: str, size: int, cuttable: bool) -> Iterator[str]:
    """The text in pieces of ``size`` characters or more, cut at spaces that stand alone, which are
    left out: the next piece has its space from the tokenizers again. Tokens of neither cross
    them: the pattern of A takes a space with what follows it, and no piece of B holds a space
    after another character."""
    at = 0
    while cuttable and len(text) - at > 2 * size and (found := _CUT.search(text, at + size)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions in ``ends_a`` of the ends that ``ends_b`` has too, ascending.

    ``ends_a`` and ``ends_b`` ascend over all texts; a text is an interval of tokens of A from
    ``first`` to ``last``, and its last end is shared. An open interval tries one end a step, in
    turn below and above its middle and one further from it, until one is shared or none is left.
    """
    cuts = [last]
    low, high = first, last
    tried = np.zeros(len(low), np.int64)
    while True:
        # Inner ends of an interval are those from low up to the one before high.
        alive = tried < high - low
        low, high, tried = low[alive], high[alive], tried[alive]
        if not len(low):
            break
        middle = (low + high - 1) // 2
        probe = middle + np.where(tried % 2, (tried + 1) // 2, -(tried // 2))
        at = np.searchsorted(ends_b, ends_a[probe])
        shared = ends_b[at] == ends_a[probe]
        hit = probe[shared]
        cuts.append(hit)
        low, high, tried = (
            np.concatenate([low[~shared], low[shared], hit + 1]),
            np.concatenate([high[~shared], hit, high[shared]]),
            np.concatenate([tried[~shared] + 1, np.zeros(2 * len(hit), np.int64)]),
        )
    return np.sort(np.concatenate(cuts))


class Aligned:
    """Numbers, groups and links of some texts, aligned together."""

    def __init__(self, known: Tokenizers, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray):
        self.n_a, self.n_b = n_a, n_b
        ends_a, ends_b = np.cumsum(known.size_a[ids_a]), np.cumsum(known.size_b[ids_b])
        stop_a = np.cumsum(n_a)
        cuts_a = shared_cuts(ends_a, ends_b, stop_a - n_a, stop_a - 1)
        cuts_b = np.searchsorted(ends_b, ends_a[cuts_a])
        stops = np.searchsorted(cuts_a, stop_a - 1) + 1
        self.n_groups = np.diff(stops, prepend=0)
        # Between neighbouring ends of either tokenizer lies one link.
        every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        every = every[np.concatenate([[True], every[1:] != every[:-1]])]
        self.pairs = ids_a[np.searchsorted(ends_a, every)] * len(known.bytes_b) + ids_b[np.searchsorted(ends_b, every)]
        self.n_links = np.diff(np.searchsorted(every, ends_a[stop_a - 1], side="right"), prepend=0)
        self._written(known, ids_a, ids_b, cuts_a, cuts_b, stops)

    def _written(self, known: Tokenizers, ids_a, ids_b, cuts_a, cuts_b, stops) -> None:
        size_a, size_b = np.diff(cuts_a, prepend=-1), np.diff(cuts_b, prepend=-1)
        # Tokens of a group stand together, first those of A, then those of B.
        head = np.cumsum(size_a + size_b) - size_a - size_b
        place_a = np.arange(len(ids_a)) + np.repeat(head - (cuts_a + 1 - size_a), size_a)
        place_b = np.arange(len(ids_b)) + np.repeat(head + size_a - (cuts_b + 1 - size_b), size_b)
        words = np.empty(len(ids_a) + len(ids_b), object)
        words[place_a] = known.written[b","][ids_a]
        words[place_b] = known.written[b","][ids_b]
        words[place_a[cuts_a]] = known.written[b"|"][ids_a[cuts_a]]
        words[place_b[cuts_b]] = known.written[b";"][ids_b[cuts_b]]
        bounds = np.concatenate([[0], (head + size_a + size_b)[stops - 1]]).tolist()
        words = words.tolist()
        self.groups = [b"".join(words[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]


class Words:
    """The different words of a chunk, numbered as they come, each encoded and aligned once."""

    def __init__(self, known: Tokenizers):
        self.known = known
        self.start()

    def start(self) -> None:
        self.number: dict[str, int] = {}
        self.numbers = [np.empty((0, 4), np.int64)]
        self.groups: list[bytes] = []
        self.fine: list[bool] = []
        self.pairs = [np.empty(0, np.int64)]

    def __len__(self) -> int:
        return len(self.groups)

    def learn(self, words: list[str]) -> None:
        """Numbers, groups and links of words that are new; none where a tokenizer changes one."""
        odd = [w for w in words if w[0].isspace() or w[-1].isspace()]
        plain = [w for w in words if not (w[0].isspace() or w[-1].isspace())]
        for part in (plain, odd):
            if part:
                self._learn(part)

    def _learn(self, words: list[str]) -> None:
        ids_a, n_a, ids_b, n_b, fine = self.known.encode_words(words)
        numbers, groups = np.zeros((len(words), 4), np.int64), [b""] * len(words)
        if fine.any():
            kept_a, kept_b = np.repeat(fine, n_a), np.repeat(fine, n_b)
            found = Aligned(self.known, ids_a[kept_a], n_a[fine], ids_b[kept_b], n_b[fine])
            numbers[fine] = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links], axis=1)
            for k, written in zip(np.flatnonzero(fine).tolist(), found.groups):
                groups[k] = written
            self.pairs.append(found.pairs)
        self.number.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
        self.groups += groups
        self.fine += fine.tolist()
        self.numbers.append(numbers)

    def read(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's words."""
        cut = [_CUT.split(t) if self.known.cuttable else [t] for t in texts]
        new = list(dict.fromkeys(w for words in cut for w in words if w not in self.number))
        if new:
            self.learn(new)
        return [list(map(self.number.__getitem__, words)) for words in cut]


def _digest(text: str, words: Words) -> tuple[array, str | None]:
    """Words of a text, read in pieces, and the digest of its groups; None if it has no tokens."""
    out, digest, last = array("q"), hashlib.sha256(), b""
    for piece in pieces_of(text, _BATCH, words.known.cuttable):
        (numbers,) = words.read([piece])
        if not all(map(words.fine.__getitem__, numbers)):
            return array("q"), None
        out.extend(numbers)
        # The written groups end with a semicolon, which stands between groups alone.
        digest.update(last)
        written = b"".join(map(words.groups.__getitem__, numbers))
        digest.update(written[:-1])
        last = b";"
    return out, digest.hexdigest()


def token_groups(docs: DataFrame, byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> DataFrame:
    """``docs`` with ``token_groups``: for each group the ids of A and of B, in order.

    The column is an array of ``(a array<int>, b array<int>)``, null where the text has no tokens:
    null or empty, or changed by a tokenizer. A column of that name is replaced. No document
    moves. The arrays of a text are one row, so a text's tokens have to fit a row.
    """
    kind = "array<struct<a:array<int>,b:array<int>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizers(byte_path, piece_path)
        held = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            groups = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found: list | None = []
                for piece in pieces_of(text, _BATCH, known.cuttable) if text else ():
                    (a,), (b,) = known.encode([piece])
                    if not known.holds(piece, a, b):
                        found = None
                        break
                    whole = Aligned(known, np.array(a), np.array([len(a)]), np.array(b), np.array([len(b)]))
                    for part in whole.groups[0][:-1].split(b";"):
                        sides = part.split(b"|")
                        found.append({"a": list(map(int, sides[0].split(b","))), "b": list(map(int, sides[1].split(b",")))})
                groups.append(found or None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(groups, held)], [*names, "token_groups"])

    rest = [c for c in docs.columns if c.lower() != "token_groups"]
    names = [f"c{k}" for k in range(len(rest))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)], F.col("text").alias("t"))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(rest, names))
    made = plain.mapInArrow(run, f"{schema}, token_groups {kind}")
    return made.select(*[F.col(n).alias(c) for c, n in zip(rest, names)], "token_groups")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _encode_chunks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of two kinds by ``chunk``: documents (``doc_id``, numbers, ``at`` and ``times``, their
    words as places in the chunk and how often they stand) and one a chunk: its distinct id pairs
    as ``keys`` with their ``times``, and of each word the ``links`` as places among the keys,
    with the words' numbers of links as ``at``."""
    kind = docs.schema["doc_id"].dataType
    schema = (
        f"chunk bigint, doc_id {kind.simpleString()}, {', '.join(f'{n} bigint' for n in _NUMBERS)}, "
        "groups_sha256 string, at binary, times binary, size bigint, keys binary, links binary"
    )
    names = ["chunk", "doc_id", *_NUMBERS, "groups_sha256", "at", "times", "size", "keys", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizers(byte_path, piece_path))
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        count = 0
        id_kind = None

        def rows(ids: pa.Array, numbers: np.ndarray, *tail: list) -> pa.RecordBatch:
            """Rows of the schema: digests, at, times, size, keys, links as lists; absent ones null."""
            n = len(ids)
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, chunk, np.int64)),
                    ids,
                    *[pa.array(numbers[:, k]) for k in range(4)],
                    *[pa.array(x or [None] * n, k) for x, k in zip(tail, kinds)],
                ],
                names,
            )

        def done() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(w) for _, w, _ in held])
            owner = np.repeat(np.arange(len(held)), sizes)
            every = np.concatenate([np.asarray(w, np.int64) for _, w, _ in held])
            numbers = np.concatenate(words.numbers)
            sums = np.zeros((len(held), 4), np.int64)
            heads = np.cumsum(sizes) - sizes
            for k in range(4):
                sums[:, k] = np.add.reduceat(numbers[every, k], heads)
            cells, times = added(owner << 32 | every, np.ones(len(every), np.int64))
            cuts = np.searchsorted(cells, np.arange(len(held) + 1) << 32)
            parts = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:])]
            yield rows(
                pa.array([i.as_py() for i, _, _ in held], id_kind),
                sums,
                [x for _, _, x in held],
                [steps(cells[x] & 0xFFFFFFFF) for x in parts],
                [times[x].astype(np.uint32).tobytes() for x in parts],
                [],
                [],
                [],
            )
            # Links of a word count as often as the word stands in documents that have tokens.
            pairs, link_counts = np.concatenate(words.pairs), numbers[:, 3]
            keys, place = np.unique(pairs, return_inverse=True)
            often = np.bincount(every, minlength=len(words))
            seen = np.zeros(len(keys), np.int64)
            np.add.at(seen, place, np.repeat(often, link_counts))
            yield rows(
                pa.nulls(1, id_kind), np.zeros((1, 4), np.int64), [None], [link_counts.astype(np.uint32).tobytes()], [seen.tobytes()],
                [len(keys)], [steps(keys)], [place.astype(np.uint32).tobytes()],
            )

        for batch in batches:
            ids, id_kind = batch.column(0), batch.column(0).type
            texts = batch.column(1).to_pylist()
            bare = np.zeros(len(ids), bool)
            start = 0
            while start < len(texts):
                # Texts whose words are read together.
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= _BATCH):
                    size += len(texts[stop] or "")
                    stop += 1
                short = [k for k in range(start, stop) if texts[k] and len(texts[k]) <= _BATCH]
                read = dict(zip(short, words.read([texts[k] for k in short])))
                for k in range(start, stop):
                    if k in read:
                        numbers = read[k]
                        fine = all(map(words.fine.__getitem__, numbers))
                        digest = hashlib.sha256(b"".join(map(words.groups.__getitem__, numbers))[:-1]).hexdigest() if fine else None
                    else:
                        numbers, digest = _digest(texts[k], words) if texts[k] else ([], None)
                    if digest is None:
                        bare[k] = True
                        continue
                    held.append((ids[k], array("i", numbers), digest))
                    count += len(numbers)
                start = stop
                if count >= CHUNK_WORDS or len(words) >= CHUNK_DISTINCT:
                    if held:
                        yield from done()
                    held, count, chunk = [], 0, chunk + 1
                    words.start()
            # Documents without tokens need no chunk.
            if bare.any():
                n = int(bare.sum())
                yield rows(ids.filter(pa.array(bare)), np.zeros((n, 4), np.int64), [""] * n, [b""] * n, [b""] * n, [], [], [])
        if held:
            yield from done()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(chunks: DataFrame, size_b: int) -> DataFrame:
    """``(pair, n, best)``: links of each id pair in the corpus, and whether no pair of its B id
    has more. ``pair`` is id of A times ``size_b`` plus id of B."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, times in zip(batch.column(0), batch.column(1)):
                numbers = np.frombuffer(times.as_py(), np.int64)
                # Words of documents without tokens may have left pairs that nobody holds.
                held = numbers > 0
                yield pa.RecordBatch.from_arrays([pa.array(walked(pairs.as_py())[held]), pa.array(numbers[held])], ["pair", "n"])

    rows = chunks.where(F.col("keys").isNotNull()).select("keys", "times").mapInArrow(unpack, "pair bigint, n bigint")
    counts = rows.groupBy("pair").agg(F.sum("n").alias("n")).checkpoint()
    b = F.pmod("pair", F.lit(size_b)).alias("b")
    # At most one row for each entry of B's vocabulary.
    most = F.broadcast(counts.groupBy(b).agg(F.max("n").alias("most")))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A is the byte-level vocabulary, which encodes a space and the text, B the one of pieces.
    ``n_best`` counts the links whose pair has its B id's highest count over the corpus (ties
    included), ``count_sum`` adds up the counts of all links, ``groups_sha256`` is the digest of
    the groups as ``a1,a2|b1;a3|b2``. Null and empty texts, and texts that a tokenizer changes,
    have no tokens: zeros and an empty digest. Repeated rows count each; a null ``doc_id`` is
    kept; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read. A long
    text is read in pieces; one without spaces is one word. Both paths must be readable by
    every executor.
    """
    spark = docs.sparkSession
    size_b = len(tokenizers(byte_path, piece_path).bytes_b)
    path = scratch_path(spark, "alignment")
    _encode_chunks(docs, byte_path, piece_path).write.parquet(path, compression="zstd")
    chunks = spark.read.parquet(path)
    counts = pair_counts(chunks, size_b)
    # The count and the mark in one number.
    numbered = counts.select(F.col("pair").alias("key"), (F.col("n") * 2 + F.col("best").cast("bigint")).alias("number")).checkpoint()
    answered = answers(chunks.where(F.col("keys").isNotNull()).select("chunk", "size", "keys"), numbered, walked)

    def total(rows: pa.Table, known: pa.Table) -> pa.Table:
        own = rows.column("links").is_valid()
        words = rows.filter(own)
        sizes = np.frombuffer(words.column("at")[0].as_py(), np.uint32).astype(np.int64)
        links = gathered(known)[np.frombuffer(words.column("links")[0].as_py(), np.uint32)]
        # Sums by word: differences of running totals, since a word may have no links.
        ends = np.cumsum(sizes)
        by_word = [np.concatenate([[0], np.cumsum(x)]) for x in (links >> 1, links & 1)]
        count, best = (x[ends] - x[ends - sizes] for x in by_word)
        documents = rows.filter(pc.invert(own))
        n_best, sums = [], []
        for at, times in zip(documents.column("at"), documents.column("times")):
            here, weight = walked(at.as_py()), np.frombuffer(times.as_py(), np.uint32).astype(np.int64)
            n_best.append(int(weight @ best[here]))
            sums.append(int(weight @ count[here]))
        return pa.table(
            {c: documents.column(c) for c in ("doc_id", *_NUMBERS, "groups_sha256")}
            | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    documents = chunks.where(F.col("keys").isNull())
    none = documents.where("n_links = 0").select(
        "doc_id", *_NUMBERS, "groups_sha256", *[F.lit(0).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    )
    columns = f"doc_id {kind}, {', '.join(f'{n} bigint' for n in _NUMBERS)}, groups_sha256 string, n_best bigint, count_sum bigint"
    counted = (
        chunks.where("n_links > 0 OR keys IS NOT NULL")
        .select("chunk", "doc_id", *_NUMBERS, "groups_sha256", "at", "times", "links")
        .groupBy("chunk")
        .cogroup(answered.groupBy("chunk"))
        .applyInArrow(total, columns)
    )
    return counted.union(none)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document; nulls, empty and changed texts give zeros, as in ``align``."""
    found = align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
