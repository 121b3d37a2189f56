"""Column layout, union, row numbers and profile of listing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscout.functions.fields import as_text, parse_price
from twinscout.operators.sizing import broadcast_measured, broadcast_within, shuffle_partitions
from twinscout.sources.shared import materialized

# Canonical columns and the layouts' names for them, best first.
COLUMN_SOURCES = {
    "SKU": ("Input_SKU", "Best_ZSKU", "Standard_ZSKU"),
    "Title": ("Best_Title", "Standard_Title"),
    "Price": ("Best_Price", "Standard_Price"),
    "Image URL": ("Best_Main_Image_URL", "Standard_Main_Image_URL"),
}
SOURCE_FILE = "Source File"
# Canonical column names and their names inside the engine.
LISTING_NAMES = {
    "SKU": "sku",
    "Title": "title",
    "Price": "price",
    "Image URL": "image_url",
    "Source File": "source_file",
}
TEXT_COLUMNS = ("SKU", "Title", "Image URL")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Give a table the canonical column names.

    A canonical name already present stays; else its best available source is renamed.
    Other sources keep their names and remain as attributes.  Metadata only.
    """
    check_columns(df)
    renames = {}
    for target, sources in COLUMN_SOURCES.items():
        available = [s for s in sources if s in df.columns]
        if target not in df.columns and available:
            renames[available[0]] = target
    return df.withColumnsRenamed(renames)


def check_columns(df: DataFrame) -> None:
    """Refuse columns that differ in letter case only: Spark cannot tell them apart."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return
    lowered = [c.lower() for c in df.columns]
    twice = sorted({c for c in df.columns if lowered.count(c.lower()) > 1})
    if twice:
        raise ValueError(f"columns differ only in case: {twice}; set spark.sql.caseSensitive")


def union_evolving(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; absent columns are null.

    A column whose types differ between the tables becomes text before the union, as
    the SQL union would otherwise try to read every text as a number.
    """
    if not frames:
        raise ValueError("no tables to combine")
    types: dict[str, set[str]] = {}
    for frame in frames:
        for field in frame.schema.fields:
            types.setdefault(field.name, set()).add(field.dataType.simpleString())
    mixed = {name for name, kinds in types.items() if len(kinds) > 1}
    result = None
    for frame in frames:
        fields = frame.schema.fields
        columns = [
            as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if f.name in mixed else F.col(f"`{f.name}`")
            for f in fields
        ]
        frame = frame.select(*columns)
        result = frame if result is None else result.unionByName(frame, allowMissingColumns=True)
    return result


def to_listings(df: DataFrame) -> DataFrame:
    """A canonical table in the engine's own column names and types; further columns
    stay as they are."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    columns: list[Column] = []
    for name, short in LISTING_NAMES.items():
        dtype = fields.get(name)
        if dtype is None:
            value = F.lit(None).cast("double" if name == "Price" else "string")
        elif name == "Price":
            value = parse_price(F.col(name), dtype)
        else:
            value = as_text(F.col(f"`{name}`"), dtype)
        columns.append(value.alias(short))
    extras = [F.col(f"`{name}`") for name in fields if name not in LISTING_NAMES]
    return df.select(*columns, *extras)


def assign_row_id(df: DataFrame, file: str, position: str, block: Sequence[str] = ()) -> DataFrame:
    """Number rows 1, 2, ... in (file, position) order as ``row_id``.

    ``position`` rises inside each (file, block) without gaps.  The rows themselves are
    not moved: only their counts per file (or block of a file) are summed up in order,
    and that table, one row per file or block, is joined back.  It is itself split into
    ranges of consecutive files, whose totals are the only thing summed in one task; a
    checkpoint pins the ranges.
    """
    group = [file, *block]
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows"), F.min(position).alias("_first"))
    slices = shuffle_partitions(df.sparkSession)
    sliced = sizes.repartitionByRange(slices, *group).withColumn("_slice", F.spark_partition_id())
    sliced = materialized(sliced)
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_slice").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("_slice")
        .agg(F.sum("_rows").alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    inside = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    offsets = (
        sliced.withColumn("_inside", inside)
        .join(broadcast_within(starts, slices, 32), "_slice")
        .select(*group, (F.col("_start") + F.col("_inside") - F.col("_first") + 1).alias("_offset"))
    )
    numbered = df.join(broadcast_measured(offsets, F.length(file) + 64), group)
    return numbered.withColumn("row_id", F.col("_offset") + F.col(position)).drop("_offset")


def sku_profile(df: DataFrame, sku: str = "SKU") -> DataFrame:
    """Rows, distinct SKUs and their difference; rows without SKU count as duplicates."""
    counts = df.agg(F.count("*").alias("total_rows"), F.countDistinct(sku).alias("unique_skus"))
    return counts.withColumn("duplicate_skus", F.col("total_rows") - F.col("unique_skus"))


def last_row_per_sku(df: DataFrame, sku: str = "sku", row_id: str = "row_id") -> DataFrame:
    """The last row of every SKU.  An aggregate, so map-side combining leaves at most one
    row per task of a hot SKU to shuffle."""
    rest = [c for c in df.columns if c != sku]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(row_id)).alias("last")
    return df.where(F.col(sku).isNotNull()).groupBy(sku).agg(last).select(sku, "last.*")


def filter_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """How many rows pass the first filter, the first two, and so on, in one pass."""
    passed, counts = F.lit(True), [F.count("*").alias("original")]
    for name, predicate in predicates.items():
        passed = passed & F.coalesce(predicate, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return df.agg(*counts)

