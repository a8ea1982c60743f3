"""Rounding that makes up for its errors: each weight rounded moves those after it in its row.

The activations of a layer give its Gram matrix, added up in tiles: a task multiplies what it
reads and sends one tile set a layer. The matrix, as wide as a weight row whatever the number of
samples, is inverted in one task a layer. Weight rows are independent of each other given it and
are rounded in blocks of rows, column by column, so a layer's rows spread over many tasks.

Rows are ``(layer, row_id, vec)``: activation samples, and weight rows over input channels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64
# Share of the mean diagonal that is added to the diagonal.
DAMPING = 0.01
BLOCK_ROWS = 4096


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of equal length as matrices, with the rows they stand in; null and empty ones are skipped."""
    lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()])
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, values.astype(np.float64).reshape(-1, n)


def gram_tiles(activations: DataFrame, key: str = "layer") -> DataFrame:
    """``(layer, width, i, j, tile)``: the sum of x xᵀ over a layer's samples in tiles of 64 by 64
    float64, those on and above the diagonal. Missing values in a vector count as 0."""
    kind = activations.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, width int, i int, j int, tile binary"
    names = [key, "width", "i", "j", "tile"]

    def tiles(values: list, sums: dict) -> Iterator[pa.RecordBatch]:
        for (name, width), total in sums.items():
            edge = range(-(-width // TILE))
            padded = np.zeros((len(edge) * TILE,) * 2)
            padded[:width, :width] = total
            at = [(i, j) for i in edge for j in edge if i <= j]
            blobs = [padded[i * TILE : (i + 1) * TILE, j * TILE : (j + 1) * TILE].tobytes() for i, j in at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(at), values[0]),
                    pa.array([width] * len(at), pa.int32()),
                    pa.array([i for i, _ in at], pa.int32()),
                    pa.array([j for _, j in at], pa.int32()),
                    pa.array(blobs, pa.binary()),
                ],
                names,
            )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.column(0).type]
            layers = batch.column(0).to_pylist()
            for rows, x in _vectors(batch.column(1)):
                x = np.nan_to_num(x, nan=0.0)
                held = np.array([str(layers[k]) for k in rows])
                for name in np.unique(held):
                    part = x[held == name]
                    key_of = (layers[rows[int(np.argmax(held == name))]], x.shape[1])
                    sums[key_of] = sums.get(key_of, 0) + part.T @ part
        yield from tiles(kinds, sums)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(TILE * TILE)
        for blob in group.column("tile"):
            total += np.frombuffer(blob.as_py(), np.float64)
        return group.slice(0, 1).set_column(4, "tile", pa.array([total.tobytes()], pa.binary()))

    parts = activations.select(key, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(multiply, schema)
    return parts.groupBy(key, "width", "i", "j").applyInArrow(add, schema)


def _matrix(group: pa.Table) -> np.ndarray:
    width = group.column("width")[0].as_py()
    edge = -(-width // TILE)
    whole = np.zeros((edge * TILE, edge * TILE))
    for i, j, blob in zip(group.column("i").to_pylist(), group.column("j").to_pylist(), group.column("tile")):
        tile = np.frombuffer(blob.as_py(), np.float64).reshape(TILE, TILE)
        whole[i * TILE : (i + 1) * TILE, j * TILE : (j + 1) * TILE] = tile
        whole[j * TILE : (j + 1) * TILE, i * TILE : (i + 1) * TILE] = tile.T
    return whole[:width, :width]


def feedback_factor(gram: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """Upper Cholesky factor of the damped matrix's inverse. Channels never active stand alone."""
    held = gram.copy()
    diagonal = np.einsum("ii->i", held)
    diagonal[diagonal == 0] = 1.0
    diagonal += damping * diagonal.mean()
    return np.linalg.cholesky(np.linalg.inv(held)).T


def round_with_feedback(
    weights: np.ndarray, factor: np.ndarray, bits: int, group_size: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the scale of each element. Scales are those of round-to-nearest, taken of each
    group when it is reached, after what the columns before have moved."""
    work = weights.astype(np.float64).copy()
    rows, width = work.shape
    size = group_size or width
    codes, scales = np.zeros((rows, width), np.int32), np.zeros((rows, width))
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    for first in range(0, width, size):
        stop = min(first + size, width)
        scale = np.abs(work[:, first:stop]).max(axis=1) / ((2.0**bits - 1) / 2)
        # Errors act at once inside the group and together on the columns after it.
        errors = np.empty((rows, stop - first))
        for k in range(first, stop):
            column = work[:, k]
            ratio = np.divide(column, scale, out=np.zeros(rows), where=scale > 0)
            codes[:, k] = np.clip(np.rint(ratio), low, high)
            scales[:, k] = scale
            error = (column - codes[:, k] * scale) / factor[k, k]
            work[:, k + 1 : stop] -= np.outer(error, factor[k, k + 1 : stop])
            errors[:, k - first] = error
        work[:, stop:] -= errors @ factor[first:stop, stop:]
    return codes, scales


def quantize_with_feedback(
    weights: DataFrame,
    activations: DataFrame,
    bits: int = 4,
    group_size: int | None = 128,
    damping: float = DAMPING,
    key: str = "layer",
) -> DataFrame:
    """Weights rounded with error feedback, one row per element: ``layer, row_id, pos, value, q,
    scale, dequantized``.

    A layer's rows are as wide as its activations; rows of another width, and those of a layer
    without activations, are rounded without feedback. Null and empty vectors have no elements,
    a missing value in a vector is 0. Blocks of rows meet a copy of their layer's factor; a row's
    result does not depend on its block.
    """
    layer = weights.schema[key].dataType.simpleString()
    row = weights.schema["row_id"].dataType.simpleString()

    def invert(group: pa.Table) -> pa.Table:
        factor = feedback_factor(_matrix(group), damping)
        return pa.table(
            {
                key: group.column(key).slice(0, 1),
                "width": group.column("width").slice(0, 1),
                "factor": pa.array([factor.tobytes()], pa.binary()),
            }
        )

    factors = gram_tiles(activations, key).groupBy(key, "width").applyInArrow(invert, f"{key} {layer}, width int, factor binary")
    placed = weights.select(key, "row_id", F.col("vec").cast("array<double>").alias("vec")).where(F.size("vec") > 0)
    placed = placed.withColumn("width", F.size("vec"))
    counts = placed.groupBy(key, "width").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    counts = counts.select(F.col(key).alias("_key"), F.col("width").alias("_width"), "blocks")
    same = [F.col(key).eqNullSafe(F.col("_key")), F.col("width") == F.col("_width")]
    spread = placed.join(counts, same).withColumn("block", F.pmod(F.xxhash64("row_id", "vec"), F.col("blocks")).cast("int"))
    copies = factors.join(counts, same).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def quantize(rows: pa.Table, factor: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "scale": [], "vec": []}
        if rows.num_rows:
            width = rows.column("width")[0].as_py()
            vectors = rows.column("vec").combine_chunks()
            flat = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
            w = flat.reshape(-1, width)
            held = np.frombuffer(factor.column("factor")[0].as_py(), np.float64).reshape(width, width) if factor.num_rows else np.eye(width)
            codes, scales = round_with_feedback(w, held, bits, group_size)
            out = {"q": list(codes), "scale": list(scales), "vec": list(w)}
        return pa.table(
            {
                key: rows.column(key),
                "row_id": rows.column("row_id"),
                "vec": pa.array(out["vec"], pa.list_(pa.float64())),
                "q": pa.array(out["q"], pa.list_(pa.int32())),
                "scale": pa.array(out["scale"], pa.list_(pa.float64())),
            }
        )

    done = (
        spread.select(key, "row_id", "vec", "width", "block")
        .groupBy(key, "width", "block")
        .cogroup(copies.select(F.col(key).alias(key), F.col("width").alias("width"), "block", "factor").groupBy(key, "width", "block"))
        .applyInArrow(quantize, f"{key} {layer}, row_id {row}, vec array<double>, q array<int>, scale array<double>")
    )
    elements = done.select(key, "row_id", F.posexplode(F.arrays_zip("vec", "q", "scale")).alias("pos", "x"))
    return elements.select(
        key, "row_id", "pos", F.col("x.vec").alias("value"), F.col("x.q").alias("q"), F.col("x.scale").alias("scale"),
        (F.col("x.q") * F.col("x.scale")).alias("dequantized"),
    )


def output_error(quantized: DataFrame, activations: DataFrame, key: str = "layer") -> DataFrame:
    """``(layer, scheme, output_mse)``: mean over samples and weight rows of the squared change of
    a layer's outputs. ``quantized``: layer, scheme, row_id, pos, value, dequantized.

    The change of an output is the product of a row's errors with a sample; its mean square is
    the errors' form under the Gram matrix, so samples and weights are never multiplied out.
    """
    layer = activations.schema[key].dataType.simpleString()
    errors = (
        quantized.withColumn("e", F.col("value") - F.col("dequantized"))
        .groupBy(key, "scheme", "row_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda p: p["e"]).alias("vec"))
    )
    # The Gram matrix of the errors has the same size as that of the samples.
    both = F.concat_ws("\u0001", F.col(key).cast("string"), "scheme")
    of_errors = gram_tiles(errors.select(both.alias("both"), "vec"), "both")
    of_samples = gram_tiles(activations, key)
    rows = errors.groupBy(key, "scheme").agg(F.count("*").alias("rows"))
    samples = activations.where(F.size("vec") > 0).groupBy(key).agg(F.count("*").alias("samples"))

    def product(group: pa.Table) -> pa.Table:
        value = 0.0
        for x, y, i, j in zip(*[group.column(c) for c in ("tile", "other", "i", "j")]):
            part = float(np.frombuffer(x.as_py(), np.float64) @ np.frombuffer(y.as_py(), np.float64))
            value += part if i.as_py() == j.as_py() else 2 * part
        return pa.table({key: group.column(key).slice(0, 1), "scheme": group.column("scheme").slice(0, 1), "form": [value]})

    names = errors.select(key, "scheme").distinct().withColumn("both", both)
    met = (
        of_errors.join(names, "both")
        .drop("both")
        .join(of_samples.withColumnRenamed("tile", "other"), [key, "width", "i", "j"])
    )
    forms = met.groupBy(key, "scheme").applyInArrow(product, f"{key} {layer}, scheme string, form double")
    return (
        forms.join(rows, [key, "scheme"])
        .join(samples, key)
        .select(key, "scheme", (F.col("form") / F.col("rows") / F.col("samples")).alias("output_mse"))
    )
