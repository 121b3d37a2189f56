"""The image cache as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscout.functions.fields import file_name, image_key
from twinscout.sources.shared import materialized


#: What opening a file counts as, when files are dealt to tasks.  Spark's 4 MB make a task of every 32 small files.
OPEN_COST = "spark.sql.files.openCostInBytes"
OPEN_BYTES = 64 * 1024


def image_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every decoded file of the cache with its key and size; files that are not images
    have null sizes.  Decoding happens on the executors, once: the sizes are written to the shared folder."""
    scan = spark.read.format("image").option("dropInvalid", False).load(folder)
    size = [
        F.when(F.col(f"image.{side}") > 0, F.col(f"image.{side}")).alias(side)
        for side in ("width", "height")
    ]
    path = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    sizes = scan.select(
        file_name(path).alias("file_name"), image_key(path).alias("sku_key"), *size
    )
    usual = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, str(OPEN_BYTES))
    try:
        return materialized(sizes, "images-scanned")
    finally:
        spark.conf.set(OPEN_COST, usual)


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, lengths and times of the cached files without reading their contents.
    Spark's file sources pass over empty files and names starting with ``_``; a cache
    that may hold such files keeps its own manifest instead."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        image_key(F.col("path")).alias("sku_key"),
        "length",
        F.col("modificationTime").alias("mtime"),
    )
