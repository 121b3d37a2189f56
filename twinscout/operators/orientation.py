"""Correlation of image pairs under rotations and reflections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.operators.vectors import vector_matrix

# The orientations tried for the second image, in this order.
ORIENTATIONS = (
    "Original",
    "Rotate 90",
    "Rotate 180",
    "Rotate 270",
    "Flip LR",
    "Flip UD",
    "Flip LR + Rotate 90",
)

PIXELS_AT_ONCE = 4_000_000


def orientation_maps(side: int) -> np.ndarray:
    """Row ``o`` lists, for every output pixel, the input pixel orientation ``o`` puts
    there (row-major squares)."""
    r, c = np.indices((side, side))
    last = side - 1
    sources = [
        (r, c),
        (c, last - r),
        (last - r, last - c),
        (last - c, r),
        (r, last - c),
        (last - r, c),
        (c, r),
    ]
    return np.stack([(row * side + col).ravel() for row, col in sources])


def orientation_corr(pairs: DataFrame, side: int) -> DataFrame:
    """Pearson correlation of image ``a`` with each orientation of image ``b``.

    ``pairs``: id_a, id_b, a, b (row-major squares of ``side`` x ``side``).  Turning an
    image changes neither mean nor variance, so both are taken once per pair; a flat
    image correlates 0.0 with everything.  Pairs are worked off batch by batch inside
    the scan stage.
    """
    schema = "id_a bigint, id_b bigint, correlations array<double>"

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = orientation_maps(side)
        step = max(1, PIXELS_AT_ONCE // (side * side))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                a = vector_matrix(batch.column("a"), side * side)
                b = vector_matrix(batch.column("b"), side * side)
                a -= a.mean(axis=1, keepdims=True)
                b -= b.mean(axis=1, keepdims=True)
                scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                shared = np.stack([(a * b[:, order]).sum(axis=1) for order in maps], axis=1)
                safe = np.where(scale > 0, scale, 1.0)[:, None]
                result = np.where(scale[:, None] > 0, shared / safe, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id_a"),
                        batch.column("id_b"),
                        pa.array(list(result), pa.list_(pa.float64())),
                    ],
                    names=["id_a", "id_b", "correlations"],
                )

    scored = pairs.select("id_a", "id_b", "a", "b").mapInArrow(correlate, schema)
    named = F.arrays_zip(
        F.array(*[F.lit(name) for name in ORIENTATIONS]).alias("orientation"),
        F.col("correlations").alias("correlation"),
    )
    return scored.select("id_a", "id_b", F.inline(named).alias("orientation", "correlation"))
