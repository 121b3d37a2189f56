"""What to fetch before a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.operators import matching as m
from twinscout.operators.cache import keyword_fetch_scope, missing_images
from twinscout.plans.search import one_query
from twinscout.sources.shared import materialized


def fetch_plan(
    listings: DataFrame,
    manifest: DataFrame,
    image_dir: str,
    title: str = "",
    images: str = "",
    min_price: float | None = None,
    max_price: float | None = None,
) -> DataFrame:
    """Images missing from the cache (manifest: file_name) that one search would need.

    Listings in the price range that share a keyword with the reference title: the one
    given, else that of the listing named by a query image; all of them if there is no
    such title or nothing shares a word with it.
    """
    spark = listings.sparkSession
    wanted = spark.createDataFrame([(1, title)], "query_id bigint, reference_title string")
    if not title:
        query = one_query(spark, images=images, min_price=min_price, max_price=max_price)
        no_scores = spark.createDataFrame(
            [], "query_id bigint, sku_key string, visual_score double, hit int"
        )
        found = m.resolve_reference_title(listings, query, no_scores, 1, images.count(";") + 1, 1)
        found = found.select("query_id", F.col("reference_title").alias("found"))
        named = wanted.join(found, "query_id", "left").select(
            "query_id", F.coalesce("found", "reference_title").alias("reference_title")
        )
        # One row, read several times below: the catalog is searched for it once.
        wanted = materialized(named, "title")
    priced = m.price_range(listings, min_price, max_price)
    return missing_images(keyword_fetch_scope(priced, wanted), manifest, image_dir)
