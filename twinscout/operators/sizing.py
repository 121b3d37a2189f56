"""Size-checked broadcasts and skew-proof top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscout.sources.shared import materialized

# Largest side sent to every executor on purpose.
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_within(df: DataFrame, rows: int | None, row_bytes: int) -> DataFrame:
    """Hint a broadcast only if ``rows`` (a proven upper bound) fits the budget.

    Beyond it a sort-merge join is asked for, as the optimizer's own estimate knows
    nothing of rows made inside a task; hot keys are then split at run time.  Without a
    bound the choice is left to Spark.
    """
    if rows is None:
        return df
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def broadcast_measured(df: DataFrame, row_bytes: Column) -> DataFrame:
    """As ``broadcast_within``, but the size is measured by a job of its own.  Meant for
    small derived tables (queries, their keywords), never for the catalog."""
    size = df.agg(F.sum(row_bytes.cast("bigint")).alias("bytes")).first().bytes or 0
    return broadcast_within(df, size, 1)


def join_small(
    large: DataFrame, small: DataFrame, on: Sequence[str], rows: int | None, row_bytes: int, salts: int = 8
) -> DataFrame:
    """Inner join with a side of at most ``rows`` rows, whatever share of ``large`` one key holds.

    Within the budget of ``broadcast_within`` the small side is broadcast.  Beyond it the rows of
    a key are spread over ``salts`` tasks by a hash of their columns, and the small side is repeated
    as often: adaptive execution does not split a side that is an aggregate or feeds one.
    """
    if rows is None or rows * row_bytes <= BROADCAST_BYTES:
        return large.join(broadcast_within(small, rows, row_bytes), list(on))
    own = F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = small.withColumn("_salt", every).hint("merge")
    return large.withColumn("_salt", own).join(salted, [*on, "_salt"]).drop("_salt")


def join_spread(
    large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", row_bytes: Column | None = None, salts: int = 16
) -> DataFrame:
    """Inner, left or semi join with a side of at most one row per key, whatever share of ``large`` one key holds.

    ``small`` is written and measured.  Within the bound it is broadcast; beyond it the rows of a key are spread over
    ``salts`` tasks and ``small`` is repeated as often.  For keys that are an aggregate, which adaptive
    execution does not split, and whose number nobody knows beforehand.
    """
    small = materialized(small, "side")
    row_bytes = F.lit(64) if row_bytes is None else row_bytes
    size = small.agg(F.sum(row_bytes.cast("bigint")).alias("bytes")).first().bytes or 0
    if size <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), list(on), how)
    taken = {name.lower() for name in [*large.columns, *small.columns]}
    salt = next(name for name in (f"{'_' * n}salt" for n in range(1, 99)) if name not in taken)
    own = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in large.columns]), F.lit(salts)).cast("int")
    every = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return large.withColumn(salt, own).join(every, [*on, salt], how).drop(salt)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over all tasks by ``keys``, before costly work on each.  A compressed table of short rows is one or a few
    splits however many rows it has, so that work would be left to as many tasks."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    spread: Sequence[str],
    position: str = "position",
    salts: int = 8,
) -> DataFrame:
    """First ``limit`` rows of every group with their 1-based position.

    ``order`` must be a total order.  Few groups (often one) meet many input tasks, so
    every group is first cut inside salted sub-groups (hash of the ``spread`` columns)
    and only the survivors meet in one task: at most ``limit`` x ``salts`` rows.  Both cuts
    also happen before their shuffle, because Spark pushes a rank limit below it.
    """
    if salts > 1:
        salt = F.pmod(F.xxhash64(*spread), F.lit(salts))
        within = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn(position, F.row_number().over(within))
            .where(F.col(position) <= limit)
            .drop("_salt", position)
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(whole)).where(F.col(position) <= limit)
