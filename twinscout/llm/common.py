"""Helpers the operators share: white space, words, columns and names."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, all else as it is (no Unicode case folding)."""
    return F.translate(column, UPPER, UPPER.lower())


def word_count(column: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("bigint")


#: Stands for a null id; it sorts below every other.
NULL_ID = -(1 << 63)


def id_or_least(column: str = "doc_id") -> Column:
    """An id as long, null as ``NULL_ID``."""
    return F.coalesce(F.col(column).cast("long"), F.expr(f"{NULL_ID + 1}L - 1L"))


def content_key(column: Column) -> Column:
    """64 bits of a text.  With an id it names a row, also where ids repeat or are null."""
    return F.xxhash64(column)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name no column of ``df`` has, in any case."""
    taken = {name.lower() for name in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unique(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:12]}"


#: Texts differ in length by orders of magnitude, so rows alone do not bound a batch.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between the JVM and its Python workers by bytes, in a session that
    sets no bound of its own."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))


def in_slices(batch: pa.RecordBatch, rows: int = 256):
    """A batch in small slices, so that Python objects of only few texts live at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
