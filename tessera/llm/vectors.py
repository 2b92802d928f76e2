"""Vectors as exact integers in blocks, and sums of them: what the two clusterings share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a step: rows are worked on together up to as many components.
STEP = 1 << 20
LONGEST = (1 << 63) - 1


def finite(vec: Column) -> Column:
    """Not null and without null or non-finite components."""
    value = lambda x: x.cast("double")
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < F.lit(float("inf")))), F.lit(False))


def bound(dim: int) -> int:
    """Largest absolute integer of a component: squared distances of ``dim`` of them stay under 2^62."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def integers(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) as int64 (rows, dim); what passes ``bound`` stands at the bound."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * float(scale)), -bound(dim), bound(dim)).astype(np.int64).reshape(-1, dim)


def steps(batch: pa.RecordBatch, column: int, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch's rows in slices of at most STEP components, and their integers."""
    size = max(1, STEP // dim)
    for k in range(0, batch.num_rows, size):
        part = batch.slice(k, size)
        yield part, integers(part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64), dim, scale)


def cell_means(vectors: DataFrame, dim: int, scale: int, n_cells: int, width: int, place: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> dict[int, list[int]]:
    """{cell: componentwise floor(sum / count)} of the non-empty cells; n_cells * width numbers in all, whatever the input.

    vectors has one column of ``dim`` doubles. place gives for a block of integers pairs (cell of each row, rows of
    ``width`` integers). A partition adds up its cells before the shuffle; sums and quotients are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_cells, width + 1), np.int64)
        for batch in batches:
            for _, x in steps(batch, 0, dim, scale):
                for cells, rows in place(x):
                    order = np.argsort(cells, kind="stable")
                    own, first = np.unique(cells[order], return_index=True)
                    if len(own):
                        total[own, 0] += np.diff(np.append(first, len(cells)))
                        total[own, 1:] += np.add.reduceat(rows[order], first, axis=0)
        used = np.flatnonzero(total[:, 0])
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * (width + 1), pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), sums], ["cell", "sums"])

    parts = vectors.mapInArrow(run, "cell int, sums array<long>").select("cell", F.posexplode("sums").alias("at", "value"))
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cell", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found.setdefault(r["cell"], [0] * (width + 1))[r["at"]] = int(r["value"])
    return {cell: [s // n for s in sums] for cell, (n, *sums) in found.items()}
