"""Everything before a search, in order: judge the cache, plan what to fetch, bring the vector index up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscout.operators import cells, title_store
from twinscout.operators.cache import image_validity, index_delta
from twinscout.operators.schedule import PER_HOST, WORKERS, fetch_schedule
from twinscout.operators.sizing import broadcast_measured
from twinscout.plans.fetch import fetch_plan
from twinscout.sources.shared import materialized

INDEX_FIELDS = ("path", "length", "mtime")


def healthy_files(manifest: DataFrame, validity: DataFrame) -> DataFrame:
    """Rows of the manifest (file_name, ...) that were judged ok.  Few files are not, so those are looked for."""
    bad = materialized(validity.where("status <> 'ok'").select("file_name"), "damaged")
    judged = manifest.where(~F.startswith(F.col("file_name"), F.lit(".")))
    return judged.join(broadcast_measured(bad, F.octet_length("file_name") + F.lit(32)), "file_name", "left_anti")


def prepare_fetches(
    listings: DataFrame, manifest: DataFrame, scan: DataFrame, image_dir: str,
    workers: int = WORKERS, per_host: int = PER_HOST, **search,
) -> tuple[DataFrame, DataFrame]:
    """(validity, schedule) of one search.

    validity: every file of the cache with its status.  schedule: what the search would need and the cache does not
    hold in good order, with ``reason`` (damaged or absent) and the slot of ``fetch_schedule``.  ``search``: title,
    images, min_price, max_price as in ``fetch_plan``.
    """
    validity = materialized(image_validity(manifest, scan), "validity")
    plan = fetch_plan(listings, healthy_files(manifest, validity).select("file_name"), image_dir, **search)
    bad = validity.where("status <> 'ok'").select(F.concat(F.lit(image_dir.rstrip("/") + "/"), "file_name").alias("dest"), F.lit("damaged").alias("reason"))
    slots = fetch_schedule(plan, workers, per_host)
    named = slots.join(broadcast_measured(bad, F.octet_length("dest") + F.lit(32)), "dest", "left")
    return validity, named.withColumn("reason", F.coalesce("reason", F.lit("absent")))


def refresh_index(spark: SparkSession, folder: str, images: DataFrame, no_indexing: bool = False) -> int:
    """The index version to search: ``folder`` brought to the state of ``images`` (image_id, sku_key, vector, path, length,
    mtime), built where there is none yet.

    Files are told apart by path, length and time; only cells of changed files are written.  ``no_indexing`` takes the
    newest version as it is, and nothing to change makes no new version.
    """
    known = cells.versions(spark, folder)
    if not known:
        return cells.build_cells(images, folder)
    if no_indexing:
        return known[-1]
    have = images.where("vector IS NOT NULL").select(*INDEX_FIELDS)
    delta = materialized(index_delta(have, cells.indexed(spark, folder).select(*INDEX_FIELDS)), "delta")
    return known[-1] if delta.isEmpty() else cells.apply_index_delta(spark, folder, delta, images)


def encoded_listings(listings: DataFrame, store: str, make_encoder: Callable, width: int) -> tuple[DataFrame, DataFrame]:
    """(listings with ``text_vec_id``, title vectors) for a search over a catalog that has no title vectors, or not all.

    Titles that the store misses are encoded first, each distinct one once over all runs; so a search never leaves a
    listing out because nobody encoded its title.  A title whose encoding fails is the exception; it stays in the store
    with its error and is tried again.
    """
    title_store.encode_missing(listings, store, make_encoder, width)
    return title_store.with_text_vectors(listings, store)
