"""Positions of rows within groups of any size, by prefix sums over sorted ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscout.operators.sizing import broadcast_measured, shuffle_partitions
from twinscout.sources.shared import materialized


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], rank: str = "rank", rows: str = "rows") -> DataFrame:
    """``df`` with the 0-based ``rank`` of a row in its group and the group's number of ``rows``.

    Rows are sorted by group and ``order`` over ranges, one task each, and written, so a group that
    holds a third of the table spans many tasks.  What meets beyond that is one row per group and
    range.  Null groups are groups; rows that ``order`` does not tell apart get positions in any order.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    placed = ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = materialized(placed, "ranges")
    counts = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_all": F.sum("_n").over(whole)})
    keys = [F.col(name).alias(f"_group{at}") for at, name in enumerate(group)]
    bases = materialized(counts.select(F.col("_range").alias("_own"), *keys, "_before", "_first", F.col("_all").alias(rows)), "bases")
    key_bytes = [F.coalesce(F.octet_length(F.col(f"_group{at}").cast("string")), F.lit(0)) for at in range(len(group))]
    bases = broadcast_measured(bases, sum(key_bytes, F.lit(64)))
    same = F.col("_range") == F.col("_own")
    for at, name in enumerate(group):
        same = same & F.col(name).eqNullSafe(F.col(f"_group{at}"))
    joined = placed.join(bases, same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(rank), rows)
