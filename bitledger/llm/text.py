"""Words, Arrow helpers and names shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Bytes that belong to a word of letters and digits; all others become a space. Bytes from
# 0x80 on are parts of other code points and always belong.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs without ASCII white space."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and code points from U+0080."""
    return text.translate(_ALNUM).split()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, one at a time; None for null."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The caller's number of shuffle partitions: what a share of the data is cut into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def binary_list(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def int64(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
