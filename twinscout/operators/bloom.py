"""Bloom filters built in tasks, tested before an exchange.

A filter is a bitmap in blocks.  Tasks set the bits of their keys and pass on the blocks they touched; blocks are
merged by OR.  Keys enter by their 64-bit hash, made by Spark, so any columns can be a key.  A row whose
key is in the filter's table always passes; of others a share of about ``rate`` does, and the join behind it
is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.operators.sizing import BROADCAST_BYTES, shuffle_partitions

BLOCK_BYTES = 1 << 16
RATE = 0.01


def filter_size(keys: int, rate: float = RATE, most_bytes: int = BROADCAST_BYTES) -> tuple[int, int]:
    """(bytes, bits per key) of a filter for so many keys; a size that ``most_bytes`` cuts lets more rows pass."""
    wanted = max(1, math.ceil(-max(keys, 1) * math.log(rate) / math.log(2) ** 2 / 8))
    size = min(most_bytes, -(-wanted // BLOCK_BYTES) * BLOCK_BYTES)
    return size, max(1, min(16, round(8 * size / max(keys, 1) * math.log(2))))


def _places(hashes: np.ndarray, size: int, bits: int):
    """Bit numbers of each hash, one array per bit: double hashing over the halves of the hash."""
    hashes = hashes.astype(np.int64).view(np.uint64)
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    for at in range(bits):
        yield (low + np.uint64(at) * high) % np.uint64(8 * size)


def build_filter(keys: DataFrame, on: Sequence[str], rate: float = RATE, rows: int | None = None) -> tuple[Broadcast, int]:
    """(broadcast bitmap, bits per key) of the ``on`` columns of ``keys``; ``rows`` is their number, else counted.

    What reaches the driver is the bitmap, ``BROADCAST_BYTES`` at most.
    """
    spark = keys.sparkSession
    size, bits = filter_size(keys.count() if rows is None else rows, rate)
    schema = "block int, bits binary"

    def blocks(found: dict[int, np.ndarray]):
        for block, own in found.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

    def touched(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for places in _places(batch.column(0).to_numpy(zero_copy_only=False), size, bits):
                home = places // np.uint64(8 * BLOCK_BYTES)
                for block in np.unique(home).tolist():
                    own = found.setdefault(block, np.zeros(BLOCK_BYTES, dtype=np.uint8))
                    inside = (places[home == block] % np.uint64(8 * BLOCK_BYTES)).astype(np.int64)
                    np.bitwise_or.at(own, inside // 8, (1 << (inside % 8)).astype(np.uint8))
        yield from blocks(found)

    def merged(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(own, dtype=np.uint8)
                found[block] = own | found[block] if block in found else own
        yield from blocks(found)

    hashed = keys.where(reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in on])).select(F.xxhash64(*on).alias("hash"))
    parts = hashed.mapInArrow(touched, schema)
    whole = np.zeros(size, dtype=np.uint8)
    for row in parts.repartition(shuffle_partitions(spark), "block").mapInArrow(merged, schema).toLocalIterator():
        at = row.block * BLOCK_BYTES
        whole[at : at + BLOCK_BYTES] = np.frombuffer(row.bits, dtype=np.uint8)[: size - at]
    return spark.sparkContext.broadcast(whole), bits


def maybe_in(df: DataFrame, bitmap: Broadcast, bits: int, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns may be in the filter; a null among them never is."""
    taken = {name.lower() for name in df.columns}
    mark = next(name for name in (f"{'_' * n}hash" for n in range(1, 99)) if name not in taken)

    def passing(batches):
        for batch in batches:
            whole = bitmap.value
            hashes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            keep = np.ones(len(hashes), dtype=bool)
            for places in _places(hashes, len(whole), bits):
                places = places.astype(np.int64)
                keep &= (whole[places // 8] >> (places % 8).astype(np.uint8)) & 1 == 1
            rows = batch.filter(pa.array(keep))
            yield rows.select(range(batch.num_columns - 1))

    have = df.where(reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in on]))
    return have.withColumn(mark, F.xxhash64(*on)).mapInArrow(passing, df.schema)


def filtered_join(large: DataFrame, small: DataFrame, on: Sequence[str], rows: int | None = None, how: str = "inner") -> DataFrame:
    """Inner or semi join of which ``large`` sends on only what a Bloom filter of ``small`` lets pass.

    Meant for sides too large to be broadcast, of which few rows of ``large`` find a partner.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("rows without a partner can only be left out of an inner or a semi join")
    if large.select(*on).dtypes != small.select(*on).dtypes:
        raise ValueError("the keys of both sides must have the same types: their hashes are compared")
    bitmap, bits = build_filter(small.select(*on), on, rows=rows)
    return maybe_in(large, bitmap, bits, on).join(small.hint("merge"), list(on), how)
