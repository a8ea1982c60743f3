"""N-gram Jaccard join: documents with similar shingle sets, as components or as every link.

1. Each document becomes its set of hashed shingles. Equal sets are one class from here on.
2. All shingles are dealt out by hash to buckets that find which of them occur in two classes
   or more, and in how many. A class whose shingles are its own to more than the allowed share
   cannot have a partner and ends here; of the others the rarest shared shingles that fill the
   prefix become keys. Two classes that link share a key.
3. Classes connected by keys form blocks; a class is in one block. In a block the classes form
   a signature tree (nodes with OR-combined bitmaps and size ranges). A dual traversal drops
   pairs of nodes whose largest possible overlap cannot reach the threshold; pairs that are
   left are verified on the sets themselves.
4. Blocks too large for a task are cut by size range and hash, linked inside, linked between
   representatives of what is connected, also across size ranges, and then between pieces not
   yet connected.

The shared elements of a set are written once; blocks, pieces and labels are tables of set
identities, joined with the elements where sets are compared.

For components, links are found until they are known: a pair that is connected already is not
compared, so thousands of close copies need about as many comparisons as there are copies.
``class_pairs`` and ``link_counts`` compare such pairs too and return every link.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.components import EDGES, connected_components
from bitledger.llm.signature_tree import Sets, all_links, spanning_links
from bitledger.llm.text import partitions, space_words, table, utf8
from bitledger.session import shared_folder

WIDTH = 5
PERCENT = 80
# Numbers of classes and set elements up to which a block is one tree in one task.
BLOCK_DOCS, BLOCK_ELEMENTS = 2000, 4_000_000
# Document frequencies above are counted as this one; among such elements the hash decides.
COMMON = 64
_CHUNK_ELEMENTS = 1_500_000
# Elements of one bucket of shingles (expected); the number of buckets follows from the data.
BUCKET_ELEMENTS = 1_500_000
# Representatives of a large group in each size range (expected), and how large that is.
REPRESENTATIVES, LARGE_GROUP = 32, 250
_KEY_BITS = 48
_KEY_MASK = np.uint64((1 << _KEY_BITS) - 1)
_REMEMBERED = 200_000


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], known: _WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, none is empty."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, size, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    # A finishing step, so that all bits depend on all words.
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xC4CEB9FE1A85EC53)
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def set_id(hashes: np.ndarray) -> int:
    """64-bit identity of a set; equal sets share it and others meet by chance only."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def row_key() -> Column:
    """Identity of a row by its id and text."""
    return F.xxhash64(F.lit("row"), "doc_id", "text")


def set_summary(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, sk, n)`` per row: identity and size of its set, null identity if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            keys, sizes = [], []
            for text in utf8(batch.column(2)):
                hashes = shingle_hashes(space_words(text or b""), known)
                keys.append(set_id(hashes) if len(hashes) else None)
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())],
                ["doc_id", "row_key", "sk", "n"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, row_key bigint, sk bigint, n bigint")


# Blobs: a header of four numbers, then columns. Rows of a set stand together.
def _blob(sets: np.ndarray, sizes: np.ndarray, runs: np.ndarray, keys: np.ndarray, more: np.ndarray, kind) -> bytes:
    return b"".join(
        [
            np.array([len(sets), len(keys), len(more), 0], np.int64).tobytes(),
            sets.astype(np.int64).tobytes(),
            more.astype(kind).tobytes(),
            sizes.astype(np.uint32).tobytes(),
            runs.astype(np.uint32).tobytes(),
            (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
            (keys >> np.uint64(32)).astype(np.uint16).tobytes(),
        ]
    )


def _parts(blob: bytes, kind):
    sets, keys, more, _ = np.frombuffer(blob, np.int64, 4)
    at, out = 32, []
    for what, n in (
        (np.int64, sets), (kind, more), (np.uint32, sets), (np.uint32, sets), (np.uint32, keys), (np.uint16, keys)
    ):
        out.append(np.frombuffer(blob, what, n, at))
        at += out[-1].nbytes
    ids, more, sizes, runs, low, high = out
    return ids, sizes, runs, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), more


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _emit(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"]
    )


def _common_blobs(ids, sizes, owner, elements, buckets: int) -> list[tuple[int, bytes]]:
    """(set, element) pairs of known common elements, dealt out by set."""
    target = np.mod(ids[owner], buckets)
    order = np.lexsort((owner, target))
    owner, elements, target = owner[order], elements[order], target[order]
    out = []
    for t in np.unique(target):
        part = target == t
        held, runs = np.unique(owner[part], return_counts=True)
        frequency = np.full(int(part.sum()), COMMON, np.uint8)
        out.append((int(t), _pairs(ids[held], sizes[held], runs, elements[part], frequency)))
    return out


def _pairs(ids, sizes, runs, elements: np.ndarray, frequency: np.ndarray) -> bytes:
    return b"".join(
        [
            np.array([len(ids), len(elements)], np.int64).tobytes(),
            ids.astype(np.int64).tobytes(),
            elements.astype(np.uint64).tobytes(),
            sizes.astype(np.uint32).tobytes(),
            runs.astype(np.uint32).tobytes(),
            frequency.astype(np.uint8).tobytes(),
        ]
    )


def _unpairs(blob: bytes):
    sets, pairs = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for kind, n in ((np.int64, sets), (np.uint64, pairs), (np.uint32, sets), (np.uint32, sets), (np.uint8, pairs)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    ids, elements, sizes, runs, frequency = out
    return ids, sizes, runs, elements, frequency


def _element_ids(bucket: np.ndarray | int, keys: np.ndarray) -> np.ndarray:
    return (np.asarray(bucket, np.uint64) << np.uint64(_KEY_BITS)) | keys


def shared_elements(docs: DataFrame, count: int | None = None) -> DataFrame:
    """``(bucket, blob)``: all (set, element) pairs whose element is in two sets or more, with
    its capped frequency, dealt out by set. ``count`` is about how many elements there are.

    Elements common within a task are sent on once instead of once a set, so that a passage in
    a third of all documents does not fill its bucket.
    """
    if count is None:
        # Words of four letters and a space.
        count = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    buckets = max(1, -(-count // BUCKET_ELEMENTS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHashes(), set()
        ids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def done() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            hashes = np.concatenate(sets)
            bucket = _bucket_of(hashes, buckets)
            order = np.argsort(bucket, kind="stable")
            owner, bucket, keys = owner[order], bucket[order], hashes[order] & _KEY_MASK
            bounds = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            names = np.array(ids, np.int64)
            rows, commons = [], []
            for b in range(buckets):
                part = slice(bounds[b], bounds[b + 1])
                if part.start == part.stop:
                    continue
                own, key = owner[part], keys[part]
                values, back, count = np.unique(key, return_inverse=True, return_counts=True)
                often = count >= COMMON
                if often.any():
                    gone = often[back]
                    commons.append((own[gone], _element_ids(b, key[gone])))
                    own, key = own[~gone], key[~gone]
                who, runs = np.unique(own, return_counts=True)
                rows.append((b, _blob(names[who], sizes[who], runs, key, values[often], np.uint64)))
            if commons:
                own = np.concatenate([x for x, _ in commons])
                elements = np.concatenate([x for _, x in commons])
                rows += [(buckets + t, x) for t, x in _common_blobs(names, sizes, own, elements, buckets)]
            return _emit(rows)

        for batch in batches:
            for text in utf8(batch.column(0)):
                hashes = shingle_hashes(space_words(text or b""), known)
                if not len(hashes):
                    continue
                name = set_id(hashes)
                if name in seen:
                    continue
                if len(seen) > _REMEMBERED:
                    seen.clear()
                seen.add(name)
                ids.append(name)
                sets.append(hashes)
                held += len(hashes)
                if held >= _CHUNK_ELEMENTS:
                    yield done()
                    ids, sets, held = [], [], 0
        if ids:
            yield done()

    def find(group: pa.Table) -> pa.Table:
        b = group.column("bucket")[0].as_py()
        if b >= buckets:
            return pa.table({"bucket": pa.array([b - buckets] * group.num_rows, pa.int64()), "blob": group.column("blob")})
        parts = [_parts(x.as_py(), np.uint64) for x in group.column("blob")]
        del group
        names = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        keys = np.concatenate([p[3] for p in parts])
        often = np.unique(np.concatenate([p[4] for p in parts]))
        # Sets are numbered, so that equal sets from several tasks count once.
        named, first, number = np.unique(names, return_index=True, return_inverse=True)
        sizes = sizes[first]
        owner = np.repeat(number, np.concatenate([p[2] for p in parts]))
        del parts
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[fresh], owner[fresh]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        runs = np.diff(np.append(heads, len(keys)))
        frequency = np.minimum(runs, COMMON)
        frequency[np.isin(keys[heads], often, assume_unique=True)] = COMMON
        frequency = np.repeat(frequency, runs)
        shared = frequency > 1
        keys, owner, frequency = keys[shared], owner[shared], frequency[shared]
        target = np.mod(named[owner], buckets)
        order = np.lexsort((owner, target))
        keys, owner, frequency, target = keys[order], owner[order], frequency[order], target[order]
        cuts = np.searchsorted(target, np.arange(buckets + 1))
        rows = []
        for t in range(buckets):
            part = slice(cuts[t], cuts[t + 1])
            if part.start < part.stop:
                who, count = np.unique(owner[part], return_counts=True)
                rows.append((t, _pairs(named[who], sizes[who], count, _element_ids(b, keys[part]), frequency[part])))
        return pa.table(
            {"bucket": pa.array([t for t, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())}
        )

    dealt = docs.select("text").mapInArrow(deal, "bucket bigint, blob binary")
    return dealt.groupBy("bucket").applyInArrow(find, "bucket bigint, blob binary")


def candidates(docs: DataFrame, percent: int = PERCENT, count: int | None = None) -> DataFrame:
    """``(sk, n, elements, prefix)`` of the sets that can have a partner: size, shared elements
    (sorted) and the keys, at least one of which any partner has too."""

    def choose(group: pa.Table) -> pa.Table:
        parts = [_unpairs(x.as_py()) for x in group.column("blob")]
        names = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        named, first, number = np.unique(names, return_index=True, return_inverse=True)
        sizes = sizes[first].astype(np.int64)
        owner = np.repeat(number, np.concatenate([p[2] for p in parts]))
        elements = np.concatenate([p[3] for p in parts])
        frequency = np.concatenate([p[4] for p in parts])
        order = np.lexsort((elements, owner))
        elements, owner, frequency = elements[order], owner[order], frequency[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
        elements, owner, frequency = elements[fresh], owner[fresh], frequency[fresh]
        cuts = np.searchsorted(owner, np.arange(len(named) + 1))
        out: dict[str, list] = {"sk": [], "n": [], "elements": [], "prefix": []}
        for k in range(len(named)):
            mine = elements[cuts[k] : cuts[k + 1]]
            n = int(sizes[k])
            least = -(-percent * n // 100)
            if len(mine) < least:
                continue
            # Elements of no other set come first in the order and fill the prefix in part.
            rest = (n - least + 1) - (n - len(mine))
            rank = np.lexsort((mine, frequency[cuts[k] : cuts[k + 1]]))[:rest]
            out["sk"].append(int(named[k]))
            out["n"].append(n)
            out["elements"].append(np.sort(mine.view(np.int64)).tobytes())
            out["prefix"].append(mine[rank].view(np.int64))
        return pa.table(
            {
                "sk": pa.array(out["sk"], pa.int64()),
                "n": pa.array(out["n"], pa.int64()),
                "elements": pa.array(out["elements"], pa.binary()),
                "prefix": pa.array(out["prefix"], pa.list_(pa.int64())),
            }
        )

    return shared_elements(docs, count).groupBy("bucket").applyInArrow(
        choose, "sk bigint, n bigint, elements binary, prefix array<bigint>"
    )


def _blocks_to_links(rows: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links ``(a, b)`` inside blocks. ``rows``: bin, block, side, label, sk, n, elements.

    A bin holds whole blocks. Where a block has sides 0 and 1, only pairs across are compared.
    ``every``: also links between sets that are connected already.
    """

    def link(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_numpy()
        sides = group.column("side").to_numpy()
        sk = group.column("sk").to_numpy()
        n = group.column("n").to_numpy()
        labels = group.column("label").to_numpy()
        order = np.lexsort((sk, sides, blocks))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(blocks[order]) != 0, [True]]))
        column = group.column("elements").combine_chunks()
        a, b = array("q"), array("q")
        for start, stop in zip(cuts[:-1], cuts[1:]):
            at = order[start:stop]
            split = int(np.searchsorted(sides[at], 1))
            sets = [np.frombuffer(column[int(k)].as_py(), np.int64) for k in at]
            left = Sets(n[at[:split]], sets[:split])
            right = Sets(n[at[split:]], sets[split:]) if split < len(at) else None
            links = all_links(left, right, percent) if every else spanning_links(left, right, labels[at], percent)
            for x, y in links:
                a.append(sk[at[x]])
                b.append(sk[at[y]])
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.groupBy("bin").applyInArrow(link, "a bigint, b bigint")



def _band(n: Column, percent: int) -> Column:
    """Size range of a set; sets that link are in the same or in neighbouring ranges."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")


def _piece(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``piece``: each group of ``keys`` cut by hash into pieces that fit a task."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_docs"), F.sum("size").alias("_size"))
    pieces = F.greatest(F.ceil(F.col("_docs") / BLOCK_DOCS), F.ceil(F.col("_size") / BLOCK_ELEMENTS))
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], pieces.alias("_pieces"))
    matched = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return (
        rows.join(totals, matched)
        .withColumn("piece", F.pmod(F.xxhash64("sk"), F.col("_pieces")).cast("int"))
        .drop("_pieces", *[f"_{k}" for k in keys])
    )


def _with_elements(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Rows ``bin, block, side, label, sk`` with the size and the elements of their set."""
    return placed.select("bin", "block", "side", "label", "sk").join(found.select("sk", "n", "elements"), "sk")


def _inside(pieces: DataFrame, found: DataFrame, percent: int, *keys: str) -> DataFrame:
    block = F.xxhash64(*keys, "piece")
    placed = pieces.select(block.alias("bin"), block.alias("block"), F.lit(0).alias("side"), "label", "sk")
    return _blocks_to_links(_with_elements(placed, found), percent)


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``label``, the component of their set under ``links``."""
    names = connected_components(links).select(F.col("node").alias("sk"), F.col("component").alias("_label"))
    return rows.drop("label").join(names, "sk", "left").withColumn("label", F.coalesce("_label", "sk")).drop("_label")


def _large_blocks(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links of blocks too large for one task. ``members``: component, sk, n, size."""
    parts = few_parts(members)
    plain = members.withColumn("band", _band(F.col("n"), percent)).withColumn("label", F.col("sk")).coalesce(parts).checkpoint()
    by_band = ("component", "band")
    first = _inside(_piece(plain, *by_band), found, percent, *by_band).checkpoint()

    # One representative of what is connected inside a piece stands for it in a second round.
    labelled = _labelled(plain, first).coalesce(parts).checkpoint()
    heads = labelled.where("label = sk")
    second = _inside(_piece(heads, *by_band), found, percent, *by_band).checkpoint()

    # Then some of each large group of a size range meet those of the next range.
    labelled = _labelled(plain, first.union(second)).coalesce(parts).checkpoint()
    sizes = labelled.groupBy("component", "band", "label").agg(F.count("*").alias("held"))
    chosen = F.pmod(F.xxhash64(F.lit("chosen"), "sk"), F.ceil(F.col("held") / REPRESENTATIVES)) == 0
    groups = labelled.join(sizes.where(F.col("held") >= LARGE_GROUP), ["component", "band", "label"]).where(chosen)
    met = groups.drop("held").withColumn("meets", F.explode(F.array("band", F.col("band") + 1)))
    third = _inside(_piece(met, "component", "meets"), found, percent, "component", "meets").checkpoint()

    # Pieces of one label alone need no comparing; others are compared with each other.
    known = first.union(second).union(third)
    labelled = _labelled(plain, known).coalesce(parts).checkpoint()
    often = labelled.groupBy("component", "band", "label").count().where(F.col("count") >= LARGE_GROUP)
    often = often.select("component", "band", "label", F.col("label").alias("class"))
    cut = _piece(labelled.join(often, ["component", "band", "label"], "left"), "component", "band", "class")
    return known.union(_between(cut.coalesce(parts).checkpoint(), found, percent))


def _between(cut: DataFrame, found: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links inside pieces and between pieces whose sizes allow it, but not within a class."""
    names = cut.select("component", "band", "class", "piece").distinct()
    left = names.select("component", *[F.col(c).alias(f"{c}_a") for c in ("band", "class", "piece")])
    right = names.select("component", *[F.col(c).alias(f"{c}_b") for c in ("band", "class", "piece")])
    # Pieces are thousands of times fewer than sets. Each pair once; equal labels never.
    key_a, key_b = (F.struct(f"band_{s}", F.coalesce(f"class_{s}", F.lit(0)), F.col(f"class_{s}").isNull(), f"piece_{s}") for s in "ab")
    near = F.col("band_b").isin(F.col("band_a"), F.col("band_a") + 1)
    ordered = (F.col("band_b") > F.col("band_a")) | (key_a <= key_b)
    pairs = left.join(right, "component").where(near & ordered & ~F.coalesce(F.col("class_a") == F.col("class_b"), F.lit(False)))
    pairs = pairs.withColumn("block", F.xxhash64("component", "band_a", "class_a", "piece_a", "band_b", "class_b", "piece_b"))
    itself = (F.col("band_a") == F.col("band_b")) & F.col("class_a").eqNullSafe(F.col("class_b")) & (F.col("piece_a") == F.col("piece_b"))

    def end(name: str, side: int) -> Column:
        parts = [F.col(f"{c}_{name}").alias(c) for c in ("band", "class", "piece")]
        return F.struct(*parts, F.lit(side).alias("side"))

    both = F.array(end("a", 0), end("b", 1))
    ends = F.explode(F.when(itself, F.array(end("a", 0))).otherwise(both)).alias("p")
    sides = pairs.select("component", "block", ends).select("component", "block", "p.*")
    met = sides.alias("s").join(
        cut.alias("c"),
        (F.col("s.component") == F.col("c.component"))
        & (F.col("s.band") == F.col("c.band"))
        & (F.col("s.piece") == F.col("c.piece"))
        & F.col("s.class").eqNullSafe(F.col("c.class")),
    )
    placed = met.select(F.col("s.block").alias("bin"), "s.block", "s.side", "c.label", "c.sk")
    return _blocks_to_links(_with_elements(placed, found), percent, every)


def _members(docs: DataFrame, percent: int, count: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates with their elements; their ``component, sk, n, size``; the large components."""
    shared_folder(docs.sparkSession)
    found = candidates(docs, percent, count).checkpoint()
    parts = few_parts(found)
    slim = found.select("sk", "n", (F.octet_length("elements") / 8).cast("bigint").alias("size"), "prefix").coalesce(parts)
    keys = slim.select("sk", F.explode("prefix").alias("key"))
    least = keys.groupBy("key").agg(F.min("sk").alias("low"), F.max("sk").alias("high")).where("low < high")
    edges = keys.join(least.select("key", "low"), "key").select(F.col("sk").alias("a"), F.col("low").alias("b"))
    blocks = connected_components(edges.coalesce(parts)).withColumnRenamed("node", "sk")
    members = slim.drop("prefix").join(blocks, "sk").coalesce(parts).checkpoint()
    totals = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("size").alias("size"))
    large = totals.where((F.col("docs") > BLOCK_DOCS) | (F.col("size") > BLOCK_ELEMENTS)).select("component")
    return found, members, large.coalesce(parts).checkpoint()


def few_parts(sets: DataFrame) -> int:
    """Parts for a table of a few numbers a set: more partitions would hold next to nothing."""
    return max(1, min(partitions(sets.sparkSession), -(-sets.count() // EDGES)))


def class_links(docs: DataFrame, percent: int = PERCENT, count: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between set identities whose components are those of all links."""
    found, members, large = _members(docs, percent, count)
    # A task reads bins of some blocks; a block is at most BLOCK_ELEMENTS.
    bins = max(1, -(-(members.agg(F.sum("size")).first()[0] or 0) // (BLOCK_ELEMENTS // 4)))
    small = members.join(large, "component", "left_anti").select(
        F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"),
        F.col("component").alias("block"),
        F.lit(0).alias("side"),
        F.col("sk").alias("label"),
        "sk",
    )
    links = _blocks_to_links(_with_elements(small, found), percent)
    if large.isEmpty():
        return links
    return links.union(_large_blocks(members.join(large, "component", "left_semi"), found, percent))


def class_pairs(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every link ``(a, b)`` between different sets, each once with ``a < b``.

    ``a`` and ``b`` are the identities ``sk`` of ``set_summary``, which has the rows of each set;
    rows of one set are linked without a pair. The rows grow with the square of a group of
    different near copies, since they are the join itself; a task makes those of one block, or
    of two pieces of a large one.
    """
    found, members, large = _members(docs, percent)
    block = F.col("component")
    small = members.join(large, "component", "left_anti").select(
        block.alias("bin"), block.alias("block"), F.lit(0).alias("side"), F.col("sk").alias("label"), "sk"
    )
    links = _blocks_to_links(_with_elements(small, found), percent, every=True)
    if not large.isEmpty():
        plain = members.join(large, "component", "left_semi").withColumns(
            {"band": _band(F.col("n"), percent), "class": F.lit(None).cast("bigint"), "label": F.col("sk")}
        )
        cut = _piece(plain, "component", "band", "class").coalesce(few_parts(members)).checkpoint()
        links = links.union(_between(cut, found, percent, every=True))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link_counts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, row_key, sk, n, n_links)`` per row of ``docs``: how many other rows it links with.

    Rows of equal sets link with each other, rows with empty sets (null ``sk``) with none.
    """
    shared_folder(docs.sparkSession)
    sets = set_summary(docs).checkpoint()
    held = sets.where(F.col("sk").isNotNull()).groupBy("sk").agg(F.count("*").alias("_rows")).checkpoint()
    pairs = class_pairs(docs, percent)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(held.withColumnRenamed("sk", "b"), "b").groupBy("a").agg(F.sum("_rows").alias("_others"))
    linked = held.join(others.withColumnRenamed("a", "sk"), "sk", "left").select(
        "sk", (F.col("_rows") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links")
    )
    return sets.join(linked, "sk", "left").select(
        "doc_id", "row_key", "sk", "n", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")
    )


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id, row_key)`` per row of ``docs``.

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its
    distinct shingles of five words, or its whole sequence if it is shorter. Documents link
    when 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest ``doc_id``
    reachable by links, itself included. Null, empty and wordless texts have size 0 and are
    linked with nothing. Repeated rows and equal texts are linked; a null ``doc_id`` is never
    the smallest unless there is no other. Only ``doc_id`` and ``text`` are read; an empty
    table gives an empty result. ``class_id`` names the component (null for empty sets) and
    ``row_key`` is that of ``row_key()``. Shingles are compared by hashes of about 54 bits.
    """
    shared_folder(docs.sparkSession)
    # A few numbers a document, used twice below.
    sets = set_summary(docs).checkpoint()
    elements = sets.agg(F.sum("n")).first()[0] or 0
    joined = connected_components(class_links(docs, percent, elements))
    placed = sets.join(joined.withColumnRenamed("node", "sk"), "sk", "left").withColumn(
        "class", F.coalesce("component", "sk")
    )
    smallest = placed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("_least"))
    return placed.join(smallest, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"),
        F.col("class").alias("class_id"),
        "row_key",
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates, columns unchanged.

    Of each component the row with the smallest ``doc_id`` stays (null ids last; then by row
    key); rows that repeat its id and text are copies too. Rows with empty sets all stay.
    """
    found = jaccard_components(docs, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    heads = found.where(F.col("class_id").isNotNull()).groupBy("class_id").agg(F.min(order).alias("head"))
    kept = heads.select(F.col("head.row_key").alias("_kept"))
    # The row goes along as one column, so that its names cannot clash.
    keyed = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = keyed.join(kept, F.col("key") == F.col("_kept"), "left_semi").dropDuplicates(["key"])
    empty = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return one.union(keyed.where(empty)).select("row.*")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
"""
