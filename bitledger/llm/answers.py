"""Numbers of many keys for chunks of documents, without the keys or the documents in one place.

A chunk is a run of documents that one task has read. It asks once for each of its distinct
keys; questions and the table of keys meet in shards of bounded size, and a shard that many ask
is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of a shard, and asked keys that meet a shard at once (expected).
SHARD_KEYS = 500_000
ASKED_KEYS = 2_000_000


def added(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    if not len(keys):
        return keys, numbers
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(numbers[order], heads)


def steps(places: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as differences, which compress well."""
    return np.diff(places, prepend=0).astype(np.uint32).tobytes()


def walked(blob: bytes) -> np.ndarray:
    """The numbers that ``steps`` wrote."""
    return np.cumsum(np.frombuffer(blob, np.uint32).astype(np.int64))


def answers(chunks: DataFrame, table: DataFrame, read: Callable[[bytes], np.ndarray]) -> DataFrame:
    """``(chunk, places, numbers)``: for the distinct ``keys`` of each chunk, where they stand in
    it (uint32) and their numbers (int64), in some rows; 0 for keys that the table lacks.

    ``chunks``: chunk, size (how many keys), keys (binary that ``read`` turns into int64).
    ``table``: key and number, both bigint, a key once. Both are read more than once.
    """
    shards = max(1, -(-table.count() // SHARD_KEYS))
    asked = chunks.agg(F.sum("size")).first()[0] or 0
    salts = max(1, -(-asked // (shards * ASKED_KEYS)))

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("key").to_numpy())
        return pa.table(
            {
                "shard": group.column("shard").slice(0, 1),
                "keys": pa.array([group.column("key").to_numpy()[order].tobytes()], pa.binary()),
                "numbers": pa.array([group.column("number").to_numpy()[order].tobytes()], pa.binary()),
            }
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = read(blob.as_py())
                shard = keys % shards
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                here = [k for k in range(shards) if bounds[k] < bounds[k + 1]]
                mine = [order[bounds[k] : bounds[k + 1]] for k in here]
                n = len(here)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(here, pa.int32()),
                        pa.array([(chunk ^ (chunk >> 32)) % salts] * n, pa.int32()),
                        pa.array([chunk] * n, pa.int64()),
                        pa.array([x.astype(np.uint32).tobytes() for x in mine], pa.binary()),
                        pa.array([keys[x].tobytes() for x in mine], pa.binary()),
                    ],
                    ["shard", "salt", "chunk", "places", "keys"],
                )

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        known = np.frombuffer(held.column("keys")[0].as_py(), np.int64) if held.num_rows else np.empty(0, np.int64)
        values = np.frombuffer(held.column("numbers")[0].as_py(), np.int64) if held.num_rows else known
        out = []
        for blob in asked.column("keys"):
            keys = np.frombuffer(blob.as_py(), np.int64)
            numbers = np.zeros(len(keys), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                numbers = np.where(known[at] == keys, values[at], 0)
            out.append(numbers.tobytes())
        return pa.table({"chunk": asked.column("chunk"), "places": asked.column("places"), "numbers": pa.array(out, pa.binary())})

    packed = (
        table.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "number")
        .groupBy("shard")
        .applyInArrow(pack, "shard int, keys binary, numbers binary")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    questions = chunks.select("chunk", "keys").mapInArrow(
        ask, "shard int, salt int, chunk bigint, places binary, keys binary"
    )
    return (
        questions.groupBy("shard", "salt")
        .cogroup(packed.groupBy("shard", "salt"))
        .applyInArrow(answer, "chunk bigint, places binary, numbers binary")
    )


def gathered(answered: pa.Table) -> np.ndarray:
    """The numbers of one chunk's keys, in their order."""
    places = [np.frombuffer(x.as_py(), np.uint32) for x in answered.column("places")]
    out = np.zeros(sum(map(len, places)), np.int64)
    for place, numbers in zip(places, answered.column("numbers")):
        out[place] = np.frombuffer(numbers.as_py(), np.int64)
    return out
