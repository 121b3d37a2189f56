"""Ranked matches at rest: JSON lines or Parquet, one folder per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCH_SCHEMA = (
    "source_file string, row_id bigint, sku string, title string, price double, ai_score double, "
    "text_similarity double, image_filename string, rank int, query_id bigint"
)


def write_matches(df: DataFrame, path: str, format: str = "json") -> None:
    """Write matches partitioned by query; null fields are kept as fields."""
    writer = df.repartition("query_id").write.mode("overwrite").partitionBy("query_id")
    if format == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(format).save(path)


def read_matches(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Read matches back; a missing folder is an error."""
    return spark.read.schema(MATCH_SCHEMA).format(format).load(path)
