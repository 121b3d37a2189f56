"""Registered queries over whole catalogs: the vector index, set joins, groups, schedules and stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscout.functions.text import sku_key
from twinscout.operators import bloom, cache, cells, groups, hot_words, matching, overlap, prices, profiles, rotations, schedule, title_store
from twinscout.operators.embedding import letter_counts
from twinscout.plans.prepare import encoded_listings, prepare_fetches, refresh_index
from twinscout.plans.search import find_duplicates
from twinscout.sources.shared import materialized, new_shared_path
from twinscout.workload import views

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MIN_OVERLAP = groups.MIN_OVERLAP


def registered(function):
    REGISTRY[function.__name__] = function
    return function


# --- the vector index ----------------------------------------------------------------


def _indexed_images(spark, sf_dir) -> str:
    folder = new_shared_path(spark, "index")
    cells.build_cells(views.images(spark, sf_dir), folder)
    return folder


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "image_id", "sku_key", F.round("score", 6).alias("score"), "hit")


@registered
def visual_search_pruned(spark, sf_dir):
    """The flagship's visual search through the index."""
    vectors = views.flagship_vectors(spark, sf_dir)
    return _hits(cells.search_cells(spark, _indexed_images(spark, sf_dir), vectors, matching.VISUAL_TOP_K))


@registered
def visual_search_pruned_small_cut(spark, sf_dir):
    vectors = views.flagship_vectors(spark, sf_dir)
    return _hits(cells.search_cells(spark, _indexed_images(spark, sf_dir), vectors, 50))


@registered
def visual_search_pruned_batch(spark, sf_dir):
    _, vectors = views.batch_queries(spark, sf_dir)
    return _hits(cells.search_cells(spark, _indexed_images(spark, sf_dir), vectors, 100)).drop("sku_key")


def _changed_index(spark, sf_dir) -> str:
    """The index of the cache's earlier state, brought to the present by the delta."""
    folder = new_shared_path(spark, "index")
    cells.build_cells(views.earlier_vectors(spark, sf_dir), folder)
    delta = cache.index_delta(views.image_manifest(spark, sf_dir), cells.indexed(spark, folder))
    cells.apply_index_delta(spark, folder, delta, views.cached_vectors(spark, sf_dir))
    return folder


@registered
def apply_index_delta(spark, sf_dir):
    return cells.indexed(spark, _changed_index(spark, sf_dir)).select("path", "image_id", "length", "mtime")


@registered
def visual_search_after_delta(spark, sf_dir):
    vectors = views.flagship_vectors(spark, sf_dir)
    return _hits(cells.search_cells(spark, _changed_index(spark, sf_dir), vectors, 50))


# --- set joins and groups ------------------------------------------------------------


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("left_id", "right_id", "shared", F.round("overlap", 6).alias("overlap"))


@registered
def overlap_join(spark, sf_dir):
    """Classes of listings whose titles share most of their keywords."""
    classes, _ = overlap.keyword_classes(views.dealt_titles(spark, sf_dir))
    return _pairs(overlap.overlap_pairs(classes, MIN_OVERLAP))


@registered
def overlap_classes(spark, sf_dir):
    _, members = overlap.keyword_classes(views.document_listings(spark, sf_dir))
    return members


@registered
def overlap_join_benchmark(spark, sf_dir):
    """Benchmark passages against whole documents."""
    passages, _ = overlap.keyword_classes(views.benchmark_queries(spark, sf_dir), "query_id", "reference_title")
    documents = overlap.keyword_rows(views.document_listings(spark, sf_dir))
    return _pairs(overlap.overlap_join_rows(passages, documents, MIN_OVERLAP))


@registered
def duplicate_groups(spark, sf_dir):
    return groups.duplicate_groups(views.dealt_titles(spark, sf_dir))


@registered
def duplicate_group_report(spark, sf_dir):
    return groups.group_report(views.listings(spark, sf_dir), groups.duplicate_groups(views.dealt_titles(spark, sf_dir)))


@registered
def keyword_pairs(spark, sf_dir):
    """The pairs of the keyword prefilter, hot words by bitmap and the rest by a salted join."""
    pairs = hot_words.keyword_pairs(views.document_listings(spark, sf_dir), views.benchmark_queries(spark, sf_dir))
    return pairs.select("query_id", "row_id")


@registered
def filtered_scores(spark, sf_dir):
    """Attribute rows with their SKU's score; rows without one stop at a Bloom filter before the exchange."""
    hits = matching.visual_search(views.images(spark, sf_dir), views.flagship_vectors(spark, sf_dir))
    scores = materialized(matching.visual_scores(hits), "scores").drop("hit")
    rows = views.attributes(spark, sf_dir).select("row_id", "sku", sku_key(F.col("sku")).alias("sku_key"))
    found = bloom.filtered_join(rows, scores, ["sku_key"])
    return found.select("query_id", "row_id", "sku", F.round("visual_score", 6).alias("visual_score"))


@registered
def turned_copies(spark, sf_dir):
    """Every picture and a turned, slightly changed copy of it, among themselves."""
    pairs, _ = rotations.turned_copies(views.turned_images(spark, sf_dir), views.VECTOR_SIDE)
    return pairs.select("id_a", "id_b", "orientation", F.round("correlation", 6).alias("correlation"))


# --- prices, fetches, profiles, titles -----------------------------------------------


@registered
def price_range_batch(spark, sf_dir):
    """The listings in a price range around each query's own; some ranges are open."""
    leads = materialized(views.lead_listings(spark, sf_dir), "leads")
    price = F.col("lead.row_id") / 10 + 899.9
    queries = leads.select(
        F.col("lead.row_id").alias("query_id"),
        F.when(F.col("source_file") != "PROMO", price - 1.25).alias("min_price"),
        F.when(F.col("source_file") != "LARGE", price + 3).alias("max_price"),
    )
    return prices.price_join(views.listings(spark, sf_dir), queries).select("query_id", "row_id")


@registered
def fetch_schedule(spark, sf_dir):
    """``pages`` as a fetch plan."""
    page = F.col("page_id").cast("string")
    plan = views.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("P"), page).alias("sku"), F.col("url").alias("image_url"), F.concat(F.lit("pages/P"), page).alias("dest")
    )
    return schedule.fetch_schedule(plan).select("sku", "host", "round", "slot", "worker")


@registered
def prepared_fetches(spark, sf_dir):
    """What a search needs and the cache does not hold in good order, with its slots."""
    manifest = views.image_manifest(spark, sf_dir)
    scan = manifest.where("length > 0 AND brand <> 'Brand#7'").select("file_name", F.lit(8).alias("width"))
    _, slots = prepare_fetches(views.listings(spark, sf_dir), manifest, scan, views.IMAGE_DIR, images="query/Z7.jpg", min_price=901.0)
    return slots.select("sku", "dest", "reason", "round", "slot", "worker")


@registered
def refreshed_index(spark, sf_dir):
    """An index refreshed twice: the second time there is nothing to do."""
    folder, images = new_shared_path(spark, "index"), views.cached_vectors(spark, sf_dir)
    found = [refresh_index(spark, folder, own) for own in (views.earlier_vectors(spark, sf_dir), images, images)]
    rows = cells.indexed(spark, folder, found[-1]).agg(F.count("*").alias("files"), F.count_distinct("path").alias("paths"))
    return rows.select("files", "paths", *[F.lit(v).alias(f"version_{at}") for at, v in enumerate(found, 1)])


@registered
def sku_profile_sketch(spark, sf_dir):
    """``orders`` as three files, profiled one after another; estimates beside the exact numbers."""
    rows = views.attributes(spark, sf_dir).select(
        F.upper("sku").alias("sku"), F.col("Match_Count").alias("price"), F.coalesce("Best_Product_URL", F.lit("F")).alias("source_file")
    )
    store = new_shared_path(spark, "profiles")
    for name in ("F", "O", "P"):
        profiles.store_profiles(profiles.file_profiles(rows.where(F.col("source_file") == name)), store)
    found = profiles.catalog_profile(profiles.stored_profiles(spark, store))
    found = materialized(found, "profile")
    median = found.first().price_q50
    exact = rows.agg(F.count_distinct("sku").alias("skus"), F.count_if(F.col("price") <= median).alias("below")).first()
    close = F.abs(F.col("distinct_skus") - exact.skus) <= 0.03 * exact.skus
    share = F.abs(F.lit(exact.below) / F.col("total_rows") - 0.5) <= 0.03
    return found.select("total_rows", "least_price", "most_price", close.alias("distinct_close"), share.alias("median_close"))


@registered
def encode_titles_once(spark, sf_dir):
    """Half of the catalog, then all of it, through a stored table of title vectors."""
    catalog, store = views.listings(spark, sf_dir), new_shared_path(spark, "titles")
    title_store.encode_missing(catalog.where(F.col("source_file").isin("ECONOMY", "SMALL", "LARGE")), store, letter_counts, 26)
    title_store.encode_missing(catalog, store, letter_counts, 26)
    letters = F.array_join(F.transform(F.first("vector"), lambda x: x.cast("int")), ",")
    stored = title_store.stored_titles(spark, store)
    return stored.groupBy("title").agg(F.count("*").alias("times_encoded"), letters.alias("letters"))


@registered
def find_duplicates_raw_titles(spark, sf_dir):
    """The flagship search over a catalog without title vectors: all titles are encoded through a store."""
    listings, vectors = encoded_listings(views.listings(spark, sf_dir).drop("text_vec_id"), new_shared_path(spark, "titles"), letter_counts, 26)
    shown = views.flagship_vectors(spark, sf_dir).drop("query_id")
    knobs = {name: value for name, value in views.FLAGSHIP.items() if name != "images"} | {"min_text_sim": 0.9}
    matches = find_duplicates(listings, views.images(spark, sf_dir), vectors, shown, make_encoder=letter_counts, width=26, **knobs)
    scores = [F.round(name, 6).alias(name) for name in ("ai_score", "text_similarity")]
    return matches.select("query_id", "rank", "row_id", "sku", "title", "price", "source_file", "image_filename", *scores)
