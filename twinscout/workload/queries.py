"""The registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscout.functions import fields, text
from twinscout.operators import cache, listings as tables, matching, report
from twinscout.operators.embedding import embed_batches, letter_counts
from twinscout.operators.orientation import orientation_corr
from twinscout.plans.fetch import fetch_plan
from twinscout.plans.report import report_view
from twinscout.plans.search import find_duplicates_batch
from twinscout.sources import images as image_source
from twinscout.sources import listings as listing_source
from twinscout.sources.matches import read_matches, write_matches
from twinscout.sources.shared import materialized, new_shared_path
from twinscout.workload import catalog, views

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLAGSHIP_TOP = views.FLAGSHIP["top"]


def registered(function):
    REGISTRY[function.__name__] = function
    return function


def six(column: str | Column) -> Column:
    return F.round(column, 6)


def words(column: str | Column) -> Column:
    """A set as comparable text."""
    return F.array_join(F.array_sort(column), " ")


# --- sources and sinks ---------------------------------------------------------------


@registered
def load_listings(spark, sf_dir):
    loaded = listing_source.load_listings(spark, views.listing_folder(spark, sf_dir))
    return loaded.select("row_id", "sku", "title", "price", "source_file", "Best_Brand")


@registered
def prefer_curated_table(spark, sf_dir):
    """A workbook holding the catalog twice; the curated table is the one read."""
    workbook = new_shared_path(spark, "workbook")
    catalog = views.listings(spark, sf_dir)
    catalog.select(F.col("sku").alias("SKU")).write.parquet(f"{workbook}/All_Rows.parquet")
    catalog.select(F.col("sku").alias("Best_ZSKU"), F.col("title").alias("Best_Title")).write.parquet(
        f"{workbook}/{listing_source.CURATED_TABLE}.parquet"
    )
    return listing_source.prefer_curated_table(spark, workbook).select("SKU", "Title")


@registered
def normalize_columns(spark, sf_dir):
    raw = views.table(spark, sf_dir, "part").select(
        views.sku_column("p_partkey").alias("Best_ZSKU"),
        F.col("p_partkey").alias("Input_SKU"),
        F.col("p_name").alias("Standard_Title"),
        F.col("p_retailprice").alias("Price"),
        F.col("p_size").alias("Best_Price"),
        F.col("p_brand").alias("Best_Brand"),
    )
    return tables.normalize_columns(raw)


@registered
def union_evolving(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("SKU"), F.col("p_name").alias("Title"),
        F.col("p_retailprice").alias("Price"),
    )
    people = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("double").alias("SKU"), F.col("c_name").alias("Title"),
        F.col("c_mktsegment").alias("Segment"),
    )
    docs = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("SKU"),
        F.col("text").alias("Title"), F.col("lang").alias("Language"),
    )
    return tables.union_evolving([parts, people, docs])


@registered
def assign_row_id(spark, sf_dir):
    """Rows of five files numbered in file order."""
    names = ("customer", "documents", "pages", "part", "supplier")
    found = [(f"{name}.parquet", [f"{sf_dir}/{name}.parquet"]) for name in sorted(names)]
    united = listing_source.unite(spark, found, normalize=False)
    numbered = tables.assign_row_id(united, "_file", "_at", ["_block"])
    return numbered.select(
        F.col("Source File").alias("source_file"), "row_id",
        F.coalesce("c_custkey", "doc_id", "page_id", "p_partkey", "s_suppkey").alias("natural_key"),
    )


@registered
def combine_listings(spark, sf_dir):
    """All supplied tables as one, profiled per source."""
    combined = listing_source.combine_listings(spark, sf_dir)
    return combined.groupBy(F.col("Source File").alias("source_file")).agg(
        F.count("*").alias("total_rows"),
        F.countDistinct("p_partkey").alias("parts"),
        F.countDistinct("doc_id").alias("docs"),
        F.count("text").alias("texts"),
        F.sum(F.length("text")).cast("bigint").alias("text_chars"),
        F.count("o_orderkey").alias("orders"),
    )


@registered
def write_combined(spark, sf_dir):
    """The union written and read again."""
    path = new_shared_path(spark, "combined")
    listing_source.write_combined(union_evolving(spark, sf_dir), path)
    return spark.read.parquet(path)


@registered
def matches_as_json(spark, sf_dir):
    """The batch's matches written as JSON lines and read again."""
    path = new_shared_path(spark, "matches")
    write_matches(_batch(spark, sf_dir), path)
    return _published(read_matches(spark, path))


@registered
def matches_as_parquet(spark, sf_dir):
    path = new_shared_path(spark, "matches")
    write_matches(_flagship(spark, sf_dir), path, "parquet")
    return _published(read_matches(spark, path, "parquet"))


@registered
def image_scan(spark, sf_dir):
    return image_source.image_scan(spark, views.image_folder(spark, sf_dir))


# --- image cache ---------------------------------------------------------------------


@registered
def image_validity(spark, sf_dir):
    scan = image_source.image_scan(spark, views.image_folder(spark, sf_dir))
    return cache.image_validity(views.image_folder_manifest(spark, sf_dir), scan)


@registered
def bad_images(spark, sf_dir):
    return cache.bad_images(image_validity(spark, sf_dir))


@registered
def image_dims(spark, sf_dir):
    """Sizes of both images of every pair of neighbours."""
    scan = image_source.image_scan(spark, views.image_folder(spark, sf_dir))
    sizes = scan.join(views.image_folder_manifest(spark, sf_dir), "file_name")
    a = sizes.select(F.col("vec_id").alias("id_a"), F.col("width").alias("width_a"), F.col("height").alias("height_a"))
    b = sizes.select(
        (F.col("vec_id") - 1).alias("id_a"), F.col("width").alias("width_b"), F.col("height").alias("height_b")
    )
    return a.join(b, "id_a")


@registered
def missing_images(spark, sf_dir):
    valid = views.image_manifest(spark, sf_dir).where("length > 0")
    return cache.missing_images(views.listings(spark, sf_dir), valid, views.IMAGE_DIR)


@registered
def fetch_plan_for_search(spark, sf_dir):
    """The reference title comes from the query image's name."""
    return fetch_plan(
        views.listings(spark, sf_dir),
        views.image_manifest(spark, sf_dir).where("length > 0"),
        views.IMAGE_DIR,
        images="query/unknown.jpg; query/Z7.jpg",
        min_price=901.0,
    )


@registered
def fetch_outcome(spark, sf_dir):
    return cache.fetch_outcome(views.fetch_log(spark, sf_dir)).select("event_id", "sku", "outcome")


@registered
def fetch_progress(spark, sf_dir):
    return cache.fetch_progress(views.fetch_log(spark, sf_dir))


def _flagship_title(spark) -> DataFrame:
    return spark.createDataFrame([(1, views.FLAGSHIP_TITLE)], "query_id bigint, reference_title string")


@registered
def keyword_fetch_scope(spark, sf_dir):
    scope = cache.keyword_fetch_scope(views.listings(spark, sf_dir), _flagship_title(spark))
    return scope.select("row_id", "sku", "title")


@registered
def keyword_fetch_scope_fallback(spark, sf_dir):
    """One of the passages shares no word with the catalog, so everything is in scope."""
    scope = cache.keyword_fetch_scope(
        views.listings(spark, sf_dir), views.benchmark_queries(spark, sf_dir)
    )
    return scope.select("row_id", "sku", "title")


@registered
def index_delta(spark, sf_dir):
    return cache.index_delta(views.image_manifest(spark, sf_dir), views.indexed_images(spark, sf_dir))


@registered
def local_image_path(spark, sf_dir):
    found = cache.local_image_path(
        views.listings(spark, sf_dir).select("row_id", "sku"),
        views.image_manifest(spark, sf_dir).where("length > 0"),
        views.IMAGE_DIR,
    )
    return found.select("row_id", "sku", "image_path")


# --- filters -------------------------------------------------------------------------


@registered
def price_range(spark, sf_dir):
    kept = matching.price_range(views.listings(spark, sf_dir), 905.0, 960.0)
    return kept.select("row_id", "sku", "price")


@registered
def price_range_text(spark, sf_dir):
    """The same on prices that arrive as text, some of them not numbers."""
    price = F.col("p_retailprice").cast("string")
    written = (
        F.when(F.col("p_type") == "PROMO", F.concat(price, F.lit("d")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("  "), price, F.lit("\t")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("AED "), price))
        .when(F.col("p_type") == "MEDIUM", F.lit("nan"))
        .otherwise(price)
    )
    raw = views.table(spark, sf_dir, "part").select("p_partkey", written.alias("price"))
    return matching.price_range(raw, 905.0, 960.0).select("p_partkey")


@registered
def title_contains(spark, sf_dir):
    kept = matching.title_contains(views.listings(spark, sf_dir), "RING x1")
    return kept.select("row_id", "sku", "title", "image_url")


@registered
def title_contains_documents(spark, sf_dir):
    kept = matching.title_contains(views.document_listings(spark, sf_dir), "licen[cs]e")
    return kept.select("row_id", "sku")


@registered
def keyword_prefilter(spark, sf_dir):
    queries = views.batch_titles(spark, sf_dir)
    pairs = matching.keyword_prefilter(views.dealt_titles(spark, sf_dir), queries)
    return pairs.select("query_id", "row_id")


@registered
def keyword_prefilter_documents(spark, sf_dir):
    pairs = matching.keyword_prefilter(
        views.document_listings(spark, sf_dir), views.benchmark_queries(spark, sf_dir)
    )
    return pairs.select("query_id", "row_id")


@registered
def strict_model_match(spark, sf_dir):
    """Every listing beside the first listing of its brand and source."""
    leads = views.lead_listings(spark, sf_dir).select("brand", "source_file", F.col("lead.title").alias("other"))
    catalog = text.with_features(views.listings(spark, sf_dir), "title", "mine")
    pairs = catalog.join(text.with_features(leads, "other", "theirs"), ["brand", "source_file"])
    same = ~text.strict_mismatch(F.col("mine"), F.col("theirs"))
    return pairs.where(same).select("row_id", "title", "other")


def _document_features(spark, sf_dir) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return views.neighbours(text.with_features(docs, "text", "facts"), "doc_id", "facts")


def _neighbour_listings(spark, sf_dir) -> DataFrame:
    catalog = views.listings(spark, sf_dir).select("row_id", "title")
    return views.neighbours(text.with_features(catalog, "title", "facts"), "row_id", "facts")


@registered
def strict_model_match_documents(spark, sf_dir):
    pairs = _document_features(spark, sf_dir)
    return pairs.select("doc_id", text.strict_mismatch(F.col("mine"), F.col("theirs")).alias("mismatch"))


@registered
def semantic_text_sim(spark, sf_dir):
    return _flagship_text(spark, sf_dir, -2.0)


def _flagship_text(spark, sf_dir, floor: float) -> DataFrame:
    query = views.flagship_query(spark, sf_dir).select(
        "query_id", F.col("title_vector").alias("vector"), F.lit(floor).alias("floor")
    )
    hits = matching.semantic_text_sim(views.title_vectors(spark, sf_dir), query)
    return hits.select("query_id", "text_vec_id", six("text_similarity").alias("text_similarity"))


@registered
def text_threshold(spark, sf_dir):
    """A threshold of 0 stands for the default one."""
    scored = _flagship_text(spark, sf_dir, -2.0).withColumn(
        "min_text_sim", F.when(F.col("text_vec_id") > 100, F.lit(0.1)).otherwise(F.lit(0.0))
    )
    return matching.text_threshold(scored, F.col("min_text_sim"))


def _flagship_hits(spark, sf_dir, top_k: int = matching.VISUAL_TOP_K) -> DataFrame:
    return matching.visual_search(
        views.images(spark, sf_dir), views.flagship_vectors(spark, sf_dir), top_k
    )


@registered
def visual_threshold(spark, sf_dir):
    scores = matching.visual_scores(_flagship_hits(spark, sf_dir))
    kept = matching.visual_threshold(scores, F.lit(0.2))
    return kept.select("query_id", "sku_key", six("visual_score").alias("visual_score"))


# --- strings and sets ----------------------------------------------------------------


@registered
def clean_title(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.clean_title(F.col("text")).alias("clean"))


@registered
def title_keywords(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", words(text.title_keywords(F.col("text"))).alias("keywords"))


@registered
def title_overlap(spark, sf_dir):
    """Every document with its successor, whole texts."""
    ratio = text.overlap_ratio(F.col("mine.keywords"), F.col("theirs.keywords"))
    return _document_features(spark, sf_dir).select("doc_id", six(ratio).alias("overlap"))


@registered
def title_overlap_listings(spark, sf_dir):
    ratio = text.overlap_ratio(F.col("mine.keywords"), F.col("theirs.keywords"))
    return _neighbour_listings(spark, sf_dir).select("row_id", six(ratio).alias("overlap"))


@registered
def model_codes(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", words(text.model_codes(F.col("html"))).alias("models"))


@registered
def model_conflict(spark, sf_dir):
    conflict = text.model_conflict(F.col("mine.models"), F.col("theirs.models"))
    return _document_features(spark, sf_dir).select("doc_id", conflict.alias("conflict"))


@registered
def number_conflict(spark, sf_dir):
    mine, theirs = F.col("mine.numbers"), F.col("theirs.numbers")
    return _document_features(spark, sf_dir).select(
        "doc_id", words(mine).alias("numbers"), text.number_conflict(mine, theirs).alias("conflict")
    )


@registered
def modifier_conflict(spark, sf_dir):
    mine, theirs = F.col("mine.modifiers"), F.col("theirs.modifiers")
    return _neighbour_listings(spark, sf_dir).select(
        "row_id", words(mine).alias("modifiers"), text.modifier_conflict(mine, theirs).alias("conflict")
    )


@registered
def query_image_list(spark, sf_dir):
    """Order comments as image lists: the words of each document between semicolons."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit(" ; ")).alias("images"))
    return docs.select("doc_id", F.posexplode(fields.query_image_list(F.col("images"))).alias("position", "image"))


@registered
def file_stem(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", fields.file_stem(F.col("url")).alias("stem"))


@registered
def sku_key(spark, sf_dir):
    """Keys of untidy SKUs: every listing's title with stray white space around it."""
    untidy = F.concat(F.lit(" \t"), F.col("title"), F.lit("\n "))
    return views.listings(spark, sf_dir).select("row_id", text.sku_key(untidy).alias("sku_key"))


@registered
def image_url_list(spark, sf_dir):
    urls = fields.image_url_list(F.col("Combined_All_Image_URLs"))
    return views.attributes(spark, sf_dir).select(
        "row_id", F.size(urls).alias("image_count"),
        F.array_join(F.slice(urls, 1, fields.THUMBNAILS), "|").alias("thumbnails"),
    )


@registered
def price_label(spark, sf_dir):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", fields.price_label(price).alias("price_label"))


@registered
def match_count_label(spark, sf_dir):
    rows = views.attributes(spark, sf_dir).withColumn("Match_Count", F.when(F.col("Best_Stock") > 0, F.col("Match_Count")))
    kind = rows.schema["Match_Count"].dataType
    return rows.select("row_id", fields.match_count_label(F.col("Match_Count"), kind).alias("match_badge"))


# --- vectors and images --------------------------------------------------------------


@registered
def visual_search(spark, sf_dir):
    hits = _flagship_hits(spark, sf_dir)
    return hits.select("query_id", "image_id", "sku_key", six("score").alias("score"), "hit")


@registered
def visual_search_small_cut(spark, sf_dir):
    hits = _flagship_hits(spark, sf_dir, 50)
    return hits.select("query_id", "image_id", "sku_key", six("score").alias("score"), "hit")


@registered
def visual_search_batch(spark, sf_dir):
    _, query_vectors = views.batch_queries(spark, sf_dir)
    hits = matching.visual_search(views.images(spark, sf_dir), query_vectors, 100)
    return hits.select("query_id", "image_id", six("score").alias("score"), "hit")


@registered
def visual_scores(spark, sf_dir):
    """Scores per brand instead of SKU, so that keys have many images."""
    brands = views.listings(spark, sf_dir).select(F.col("row_id").alias("image_id"), "brand")
    hits = _flagship_hits(spark, sf_dir).join(brands, "image_id")
    scores = matching.visual_scores(hits.drop("sku_key").withColumnRenamed("brand", "sku_key"))
    return scores.select("query_id", "sku_key", six("visual_score").alias("visual_score"), "hit")


@registered
def embed_batches_letters(spark, sf_dir):
    """Whole documents through a small encoder."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    embedded = embed_batches(docs, letter_counts, 26, title="text")
    counts = F.array_join(F.transform("vector", lambda x: x.cast("int")), ",")
    return embedded.select("doc_id", counts.alias("letters"), "embed_error")


@registered
def orientation_correlation(spark, sf_dir):
    pairs = orientation_corr(views.image_pairs(spark, sf_dir), views.VECTOR_SIDE)
    return pairs.select("id_a", "id_b", "orientation", six("correlation").alias("correlation"))


# --- joins ---------------------------------------------------------------------------


@registered
def has_visual_score(spark, sf_dir):
    scores = matching.visual_scores(_flagship_hits(spark, sf_dir, 50))
    return matching.has_visual_score(views.listings(spark, sf_dir), scores, 1, 50).select("row_id", "sku")


@registered
def attach_visual_score(spark, sf_dir):
    """Attribute rows, several per SKU, each with its SKU's score."""
    scores = matching.visual_scores(_flagship_hits(spark, sf_dir))
    rows = matching.attach_visual_score(views.attributes(spark, sf_dir), scores, matching.VISUAL_TOP_K)
    return rows.select("query_id", "row_id", "sku", six("visual_score").alias("visual_score"))


@registered
def enrich_attributes(spark, sf_dir):
    rows = report.enrich_attributes(
        views.listings(spark, sf_dir).select("row_id", "sku"), views.attributes(spark, sf_dir)
    )
    return rows.select("row_id", "sku", "Best_ZSKU", "Best_Brand", "Best_Color", "Best_Stock", "Match_Count")


@registered
def resolve_reference_title(spark, sf_dir):
    queries, query_vectors = views.batch_queries(spark, sf_dir)
    hits = matching.visual_search(views.images(spark, sf_dir), query_vectors)
    scores = materialized(matching.visual_scores(hits), "scores")
    titles = matching.resolve_reference_title(views.listings(spark, sf_dir), queries, scores)
    return titles.select("query_id", "reference_title", "reference_row")


# --- aggregates ----------------------------------------------------------------------


@registered
def price_bounds(spark, sf_dir):
    asked = views.batch_queries(spark, sf_dir)
    return report.price_bounds(_batch(spark, sf_dir, asked), asked[0])


@registered
def result_summary(spark, sf_dir):
    asked = views.batch_queries(spark, sf_dir)
    return report.result_summary(_batch(spark, sf_dir, asked), asked[0])


@registered
def sku_profile(spark, sf_dir):
    sku = F.when(F.col("l_returnflag") != "R", views.sku_column("l_partkey"))
    return tables.sku_profile(views.table(spark, sf_dir, "lineitem").select(sku.alias("SKU")))


@registered
def last_row_per_sku(spark, sf_dir):
    rows = views.attributes(spark, sf_dir).select("sku", "row_id", "Best_Brand", "Match_Count")
    return tables.last_row_per_sku(rows)


@registered
def filter_counts(spark, sf_dir):
    wanted = F.lit(views.FLAGSHIP_TITLE)
    return tables.filter_counts(
        views.listings(spark, sf_dir),
        {
            "min_price": F.col("price") >= 905.0,
            "max_price": F.col("price") <= 960.0,
            "keyword": F.arrays_overlap(text.title_keywords(F.col("title")), text.title_keywords(wanted)),
        },
    )


# --- ranking and report --------------------------------------------------------------


@registered
def rank_matches(spark, sf_dir):
    """Attribute rows ranked per brand: many ties, one query per priority, -1 for none."""
    scored = views.attributes(spark, sf_dir).select(
        F.conv(F.substring(F.md5("Best_Brand"), 1, 6), 16, 10).cast("bigint").alias("query_id"),
        F.col("Best_Stock").cast("double").alias("visual_score"),
        F.round(F.col("Match_Count") / 100000).alias("text_similarity"),
        "row_id",
    )
    return matching.rank_matches(scored.withColumn("query_id", F.coalesce("query_id", F.lit(-1))), 300)


def _cards(spark, sf_dir) -> DataFrame:
    """All attribute rows as cards, ranked by row within their status."""
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(0.4)).when(
        F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")
    )
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query_id"),
        (F.col("o_orderkey") + 1).cast("int").alias("rank"),
        fields.shown_price(price).alias("shown_price"),
    )


@registered
def facet_price(spark, sf_dir):
    return report.facet_price(_cards(spark, sf_dir), 0, 100000)


@registered
def facet_price_open_end(spark, sf_dir):
    return report.facet_price(_cards(spark, sf_dir), 50000, None)


@registered
def sort_by_rank(spark, sf_dir):
    return report.sort_report(_cards(spark, sf_dir), "rank")


@registered
def sort_price_desc(spark, sf_dir):
    return report.sort_report(_cards(spark, sf_dir), "price-desc")


@registered
def sort_price_asc(spark, sf_dir):
    return report.sort_report(_cards(spark, sf_dir), "price-asc")


@registered
def match_record(spark, sf_dir):
    rows = views.listings(spark, sf_dir).select(
        F.lit(1).cast("bigint").alias("query_id"), "row_id",
        F.concat(F.lit(" "), "sku", F.lit("\t")).alias("sku"), "title", "price",
        F.when(F.col("source_file") != "PROMO", F.col("source_file")).alias("source_file"),
        F.lit(0.5).alias("visual_score"), F.lit(0.25).alias("text_similarity"),
        F.col("row_id").cast("int").alias("rank"),
    )
    return matching.match_record(rows)


@registered
def card_fields(spark, sf_dir):
    rows = views.attributes(spark, sf_dir).withColumn("price", F.col("Match_Count"))
    return _card_columns(report.card_fields(rows))


def _card_columns(cards: DataFrame, *more: str) -> DataFrame:
    return cards.select(
        "row_id", "sku", "zsku", "brand", "color", "stock", "product_url",
        F.array_join("tags", "|").alias("tags"), "image_count",
        F.array_join("thumbnails", "|").alias("thumbnails"), "match_badge", "price_label",
        *more,
    )


@registered
def selection_export(spark, sf_dir):
    """The cheap half of every query's matches, selected and exported."""
    matches = materialized(_batch(spark, sf_dir), "matches")
    enriched = report.enrich_attributes(matches, views.attributes(spark, sf_dir))
    cards = materialized(report.card_fields(enriched), "cards")
    chosen = cards.where(F.col("shown_price") < 950).select("query_id", "sku")
    return report.selection_export(cards, chosen)


# --- whole searches ------------------------------------------------------------------


def _published(matches: DataFrame) -> DataFrame:
    return matches.select(
        "query_id", "rank", "row_id", "sku", "title", "price", "source_file", "image_filename",
        six("ai_score").alias("ai_score"), six("text_similarity").alias("text_similarity"),
    )


def _flagship(spark, sf_dir, top_k: int = matching.VISUAL_TOP_K) -> DataFrame:
    return find_duplicates_batch(
        views.listings(spark, sf_dir),
        views.flagship_query(spark, sf_dir),
        views.flagship_vectors(spark, sf_dir),
        views.images(spark, sf_dir),
        views.title_vectors(spark, sf_dir),
        top_k,
    )


def _batch(spark, sf_dir, asked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    queries, query_vectors = asked or views.batch_queries(spark, sf_dir)
    return find_duplicates_batch(
        views.listings(spark, sf_dir), queries, query_vectors,
        views.images(spark, sf_dir), views.title_vectors(spark, sf_dir),
    )


@registered
def find_duplicates(spark, sf_dir):
    return _published(_flagship(spark, sf_dir))


@registered
def find_duplicates_small_cut(spark, sf_dir):
    """The visual cut bites before the price, keyword and text filters."""
    return _published(_flagship(spark, sf_dir, 50))


@registered
def find_duplicates_strict(spark, sf_dir):
    query = views.flagship_query(spark, sf_dir).withColumn("strict", F.lit(True))
    return _published(
        find_duplicates_batch(
            views.listings(spark, sf_dir), query, views.flagship_vectors(spark, sf_dir),
            views.images(spark, sf_dir), views.title_vectors(spark, sf_dir),
        )
    )


@registered
def find_duplicates_batch_queries(spark, sf_dir):
    return _published(_batch(spark, sf_dir))


@registered
def report_view_flagship(spark, sf_dir):
    cards = report_view(
        _flagship(spark, sf_dir),
        views.attributes(spark, sf_dir),
        views.image_manifest(spark, sf_dir).where("length > 0"),
        views.IMAGE_DIR,
        start_price=901,
        end_price=955,
        sort_by="price-desc",
        matches_at_most=FLAGSHIP_TOP,
    )
    return _card_columns(cards, "rank", "position", "image_path")


# Names of the inventory for functions whose own name is taken by the library.
REGISTRY["write_matches"] = REGISTRY.pop("matches_as_json")
REGISTRY["read_matches"] = REGISTRY.pop("matches_as_parquet")
REGISTRY["fetch_plan"] = REGISTRY.pop("fetch_plan_for_search")
REGISTRY["embed_batches"] = REGISTRY.pop("embed_batches_letters")
REGISTRY["orientation_corr"] = REGISTRY.pop("orientation_correlation")
REGISTRY["find_duplicates_batch"] = REGISTRY.pop("find_duplicates_batch_queries")
REGISTRY["report_view"] = REGISTRY.pop("report_view_flagship")
REGISTRY |= catalog.REGISTRY
