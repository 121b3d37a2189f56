"""Catalog profiles from mergeable sketches: a new file costs only itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2**14 registers: a standard error of 0.8 % of the distinct SKUs.
LOG_REGISTERS = 14
#: Size of the quantile sketches: ranks within about 1.7 %.
KLL_SIZE = 200
QUARTILES = (0.25, 0.5, 0.75)
PROFILE = (
    "source_file string, total_rows bigint, rows_with_sku bigint, skus binary, least_price double, most_price double, prices binary"
)


def file_profiles(listings: DataFrame) -> DataFrame:
    """One row per source file of ``listings`` (sku, price, source_file): counts, price bounds and two sketches.
    Prices that are null or NaN are left out, blank SKUs are null.  Sketches are combined before the
    shuffle, so a file that holds most rows is many tasks."""
    price = F.col("price").cast("double")
    price = F.when(~F.isnan(price), price)
    sku = F.expr("nullif(trim(sku), '')")
    return listings.select("source_file", sku.alias("sku"), price.alias("price")).groupBy("source_file").agg(
        F.count("*").alias("total_rows"), F.count("sku").alias("rows_with_sku"), F.hll_sketch_agg("sku", LOG_REGISTERS).alias("skus"),
        F.min("price").alias("least_price"), F.max("price").alias("most_price"), F.kll_sketch_agg_double("price", KLL_SIZE).alias("prices"),
    )


def store_profiles(profiles: DataFrame, folder: str) -> str:
    """Add profiles to the store.  A file that is profiled again counts by its newest profile."""
    names = F.lit(uuid.uuid4().hex)
    profiles.withColumns({"stored_at": F.current_timestamp(), "batch": names}).write.mode("append").parquet(folder)
    return folder


def stored_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The newest profile of each file."""
    rows = spark.read.schema(f"{PROFILE}, stored_at timestamp, batch string").parquet(folder)
    columns = [field.split()[0] for field in PROFILE.split(", ")]
    newest = rows.groupBy("source_file").agg(F.max_by(F.struct(*columns[1:]), F.struct("stored_at", "batch")).alias("newest"))
    return newest.select("source_file", "newest.*")


def _quartiles(sketch: Column) -> list[Column]:
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(rank)).alias(f"price_q{round(rank * 100)}") for rank in QUARTILES]


def catalog_profile(profiles: DataFrame, *by: str) -> DataFrame:
    """Profiles put together, over the whole catalog or ``by`` columns: total_rows, distinct_skus (estimated),
    duplicate_rows (total rows less distinct SKUs, so rows without one count), price bounds and quartiles."""
    whole = profiles.groupBy(*by).agg(
        F.sum("total_rows").alias("total_rows"), F.hll_sketch_estimate(F.hll_union_agg("skus")).alias("distinct_skus"),
        F.min("least_price").alias("least_price"), F.max("most_price").alias("most_price"), F.kll_merge_agg_double("prices").alias("_prices"),
    )
    duplicates = F.greatest(F.col("total_rows") - F.col("distinct_skus"), F.lit(0)).alias("duplicate_rows")
    return whole.select(*by, "total_rows", "distinct_skus", duplicates, "least_price", "most_price", *_quartiles(F.col("_prices")))
