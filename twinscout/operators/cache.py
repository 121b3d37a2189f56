"""Quality of the image cache and planning of what to fetch or index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.functions.fields import file_name
from twinscout.functions.text import strip, title_keywords
from twinscout.operators.matching import has_title
from twinscout.operators.sizing import broadcast_measured, broadcast_within, join_spread
from twinscout.sources.shared import materialized

# Where a card's picture comes from when neither file is cached.
PLACEHOLDER = "https://placehold.co/300x300/121829/ffffff?text=Image+Not+Found"


def image_validity(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """Status of every file in the manifest (file_name, length): ok, empty or corrupt.

    The scan (file_name, width) cannot see empty files, so the manifest decides who is
    judged.  Names starting with a dot are not part of the cache.
    """
    judged = manifest.where(~F.startswith(F.col("file_name"), F.lit(".")))
    decoded = scan.where("width is not null").select("file_name", F.lit(True).alias("decoded"))
    status = (
        F.when(F.col("length") == 0, F.lit("empty"))
        .when(F.col("decoded"), F.lit("ok"))
        .otherwise(F.lit("corrupt"))
    )
    return judged.join(decoded, "file_name", "left").select("file_name", "length", status.alias("status"))


def bad_images(validity: DataFrame) -> DataFrame:
    """How many files the cache should lose."""
    return validity.agg(F.count_if(F.col("status") != "ok").alias("bad_images"))


def missing_images(listings: DataFrame, manifest: DataFrame, image_dir: str) -> DataFrame:
    """Fetch plan (sku, image_url, dest): one row per SKU whose ``<sku>.jpg`` is absent.

    The lowest row wins among listings of a SKU.  Collapsing first (an aggregate
    combined before its shuffle) leaves unique keys on both sides of the anti-join, so a
    SKU repeated across the catalog costs nothing there.
    """
    asked = listings.select("row_id", strip("sku").alias("sku"), strip("image_url").alias("image_url"))
    usable = (F.col("sku") != "") & (F.col("image_url") != "") & (F.lower("image_url") != "nan")
    first = asked.where(usable).groupBy("sku").agg(F.min_by("image_url", "row_id").alias("image_url"))
    plan = first.withColumn("file_name", F.concat("sku", F.lit(".jpg")))
    absent = plan.join(manifest.select("file_name"), "file_name", "left_anti")
    dest = F.concat(F.lit(image_dir.rstrip("/") + "/"), "file_name")
    return absent.select("sku", "image_url", dest.alias("dest"))


def fetch_outcome(log: DataFrame) -> DataFrame:
    """Class of every logged fetch (status, content_type, error)."""
    html = F.coalesce(F.contains(F.lower("content_type"), F.lit("html")), F.lit(False))
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("status").isNull(), F.lit("pending"))
        .when((F.col("status") == 200) & html, F.lit("rejected"))
        .when(F.col("status") == 200, F.lit("stored"))
        .otherwise(F.lit("failed"))
    )
    return log.withColumn("outcome", outcome)


def fetch_progress(log: DataFrame) -> DataFrame:
    """Per run: finished fetches (whatever their outcome), all fetches, whole percent.
    The percentage is truncated from a floating quotient, so 29 of 100 is 28."""
    done = F.count_if(F.col("outcome") != "pending")
    counts = fetch_outcome(log).groupBy("run_id").agg(
        done.alias("completed"), F.count("*").alias("total")
    )
    percent = (F.col("completed") / F.col("total") * 100.0).cast("bigint")
    return counts.withColumn("percent", percent)


def keyword_fetch_scope(listings: DataFrame, queries: DataFrame) -> DataFrame:
    """Listings worth fetching images for: those sharing a keyword with the title of any
    query (query_id, reference_title) of the batch.

    A query that no listing matches, or that has no title, asks for everything.  One pass
    takes the titles apart and writes the pairs of row number and asked keyword; both which
    queries match and which listings are in scope are read from those.  ``row_id`` is unique.
    """
    asked = queries.select("query_id", title_keywords(F.col("reference_title")).alias("asked"))
    asked_words = asked.select("query_id", F.explode("asked").alias("keyword"))
    vocabulary = asked_words.select("keyword").distinct()
    small = broadcast_measured(vocabulary, F.length("keyword") * 4 + 32)
    words = listings.where(has_title(F.col("title"))).select(
        "row_id", F.explode(title_keywords(F.col("title"))).alias("keyword")
    )
    hits = materialized(words.join(small, "keyword", "left_semi"), "scope")
    present = hits.select("keyword").distinct()
    unmatched = asked.join(asked_words.join(present, "keyword", "left_semi"), "query_id", "left_anti")
    if not unmatched.isEmpty():
        return listings
    rows = broadcast_measured(hits.select("row_id").distinct(), F.lit(16))
    return listings.join(rows, "row_id", "left_semi")


def index_delta(listing: DataFrame, index: DataFrame, no_indexing: bool = False) -> DataFrame:
    """What to do with each cached file: ``add``, ``update`` or ``remove`` from the
    vector index.  Both inputs: path, length, mtime, one row per path.  ``no_indexing``
    skips the check."""
    old = index.select("path", F.col("length").alias("old_length"), F.col("mtime").alias("old_mtime"))
    both = listing.select("path", "length", "mtime").join(old, "path", "full_outer")
    changed = (F.col("length") != F.col("old_length")) | (F.col("mtime") != F.col("old_mtime"))
    action = (
        F.when(F.col("old_length").isNull(), F.lit("add"))
        .when(F.col("length").isNull(), F.lit("remove"))
        .when(changed, F.lit("update"))
    )
    delta = both.select("path", action.alias("action")).where("action is not null")
    return delta.limit(0) if no_indexing else delta


def local_image_path(
    df: DataFrame, manifest: DataFrame, image_dir: str, rows_at_most: int | None = None
) -> DataFrame:
    """Add ``image_path``: the SKU's cached ``.jpg``, else ``.png``, else a placeholder.

    The manifest is cut down to the few names the rows can ask for before it is joined.  Without
    ``rows_at_most`` the sides are measured, and a SKU that fills most of the rows is spread.
    """
    folder = image_dir.rstrip("/") + "/"
    sku = strip(F.col("sku"))
    asked = df.select(F.explode(F.array(F.concat(sku, F.lit(".jpg")), F.concat(sku, F.lit(".png")))).alias("file_name"))
    if rows_at_most is None:
        names = join_spread(manifest.select("file_name"), asked.distinct(), ["file_name"], "left_semi", F.octet_length("file_name") + F.lit(32))
    else:
        names = manifest.select("file_name").join(broadcast_within(asked, 2 * rows_at_most, 128), "file_name", "left_semi")
    ending = F.regexp_extract("file_name", r"\.([^.]*)$", 1)
    found = names.groupBy(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("_stem")).agg(
        F.bool_or(ending == "jpg").alias("_jpg"), F.bool_or(ending == "png").alias("_png")
    )
    path = (
        F.when(F.col("_jpg"), F.concat(F.lit(folder), sku, F.lit(".jpg")))
        .when(F.col("_png"), F.concat(F.lit(folder), sku, F.lit(".png")))
        .otherwise(F.lit(PLACEHOLDER))
    )
    listed = df.withColumn("_stem", sku)
    if rows_at_most is None:
        joined = join_spread(listed, found, ["_stem"], "left", F.octet_length("_stem") + F.lit(32))
    else:
        joined = listed.join(found, "_stem", "left")
    return joined.withColumn("image_path", path).drop("_stem", "_jpg", "_png")
