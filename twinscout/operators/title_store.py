"""A stored table of title vectors: every distinct title is encoded once, over all runs.

The store is a folder of Parquet batches (title_id, digest, title, vector, embed_error).  A title is known by the SHA-256 of
its text; ``title_id``, 63 bits of it, names its vector in searches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscout.operators.embedding import embed_batches
from twinscout.operators.matching import has_title
from twinscout.operators.sizing import broadcast_measured, shuffle_partitions
from twinscout.sources.shared import materialized

STORED = "title_id bigint, digest binary, title string, vector array<float>, embed_error string"


def title_digest(title: Column) -> Column:
    return F.unhex(F.sha2(title, 256))


def title_id(digest: Column) -> Column:
    """63 bits of a digest as a number."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("bigint")


def stored_titles(spark: SparkSession, store: str) -> DataFrame:
    """All rows of the store; an empty table where nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(store)


def missing_titles(listings: DataFrame, store: str) -> DataFrame:
    """(digest, title): the distinct titles of ``listings`` (title) that the store has no vector for.  Equal titles
    meet by digest in an aggregate combined before its shuffle; failed ones are tried again."""
    asked = listings.where(has_title(F.col("title"))).select(title_digest(F.col("title")).alias("digest"), "title")
    distinct = asked.groupBy("digest").agg(F.first("title").alias("title"))
    known = stored_titles(listings.sparkSession, store).where("vector IS NOT NULL").select("digest")
    return distinct.join(known, "digest", "left_anti")


def encode_missing(listings: DataFrame, store: str, make_encoder: Callable, width: int) -> int:
    """Encode the titles that the store misses, add them to it and return their number.

    Titles are dealt out by ranges of length, so an encoder's batch holds titles of about one length and all tasks
    have about as many.  A failing batch is stored with its error and without vectors.
    """
    spark = listings.sparkSession
    missing = materialized(missing_titles(listings, store), "missing")
    length = F.length("title")
    dealt = missing.withColumn("_length", length).repartitionByRange(shuffle_partitions(spark), "_length", "digest")
    encoded = embed_batches(dealt.sortWithinPartitions("_length"), make_encoder, width)
    rows = encoded.select(title_id(F.col("digest")).alias("title_id"), "digest", "title", "vector", "embed_error")
    rows.write.mode("append").parquet(store)
    return missing.count()


def with_text_vectors(listings: DataFrame, store: str) -> tuple[DataFrame, DataFrame]:
    """(``listings`` with ``text_vec_id``, title vectors (text_vec_id, vector)) from the store.

    ``text_vec_id`` is computed from the title itself, so listings are joined with nothing; it is null where there is no
    title.  A title without a stored vector has an id that names none.
    """
    digest = F.when(has_title(F.col("title")), title_digest(F.col("title")))
    rows = stored_titles(listings.sparkSession, store).where("vector IS NOT NULL")
    vectors = rows.groupBy(F.col("title_id").alias("text_vec_id")).agg(F.first("vector").alias("vector"))
    return listings.withColumn("text_vec_id", title_id(digest)), vectors


def encoded_share(listings: DataFrame, store: str) -> DataFrame:
    """(titles, encoded, failed): distinct titles of the listings, those with a vector, those with an error only."""
    digests = listings.where(has_title(F.col("title"))).select(title_digest(F.col("title")).alias("digest")).distinct()
    known = stored_titles(listings.sparkSession, store).groupBy("digest").agg(F.max(F.col("vector").isNotNull()).alias("has"))
    met = digests.join(broadcast_measured(known, F.lit(48)), "digest", "left")
    return met.agg(
        F.count("*").alias("titles"), F.count_if("has").alias("encoded"), F.count_if(~F.col("has")).alias("failed"),
    )
