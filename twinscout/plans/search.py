"""The whole duplicate search as one plan over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinscout.functions.fields import query_image_list
from twinscout.functions.text import strict_mismatch, title_features, with_features
from twinscout.operators import matching as m
from twinscout.operators.embedding import embed_batches
from twinscout.operators.sizing import broadcast_within
from twinscout.sources.shared import materialized

# The knobs of one query and the three sets of defaults in use.
QUERY_SCHEMA = (
    "query_id bigint, images string, title string, title_vector array<double>, top int, "
    "min_score double, min_text_sim double, strict boolean, min_price double, max_price double"
)
SEARCH_DEFAULTS = {
    "search": {"top": 500, "min_score": 0.20, "min_text_sim": 0.70, "strict": False},
    "wrapper": {"top": 50, "min_score": 0.20, "min_text_sim": 0.70, "strict": False},
    "desktop": {"top": 500, "min_score": 0.20, "min_text_sim": 0.70, "strict": True},
}


def one_query(spark: SparkSession, query_id: int = 1, preset: str = "search", **knobs) -> DataFrame:
    """A query table of one row; unnamed knobs take the preset's defaults."""
    blank = {"images": "", "title": "", "title_vector": None, "min_price": None, "max_price": None}
    values = {"query_id": query_id, **blank, **SEARCH_DEFAULTS[preset], **knobs}
    names = [field.split()[0] for field in QUERY_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(values[name] for name in names)], QUERY_SCHEMA)


def _defaulted(queries: DataFrame) -> DataFrame:
    """Null knobs take the defaults of a plain search, so a query means the same alone and in a
    batch."""
    defaults = SEARCH_DEFAULTS["search"]
    return queries.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()})


def _facts(queries: DataFrame) -> Row:
    """Size and limits of the query table: the only thing the plan needs to know early."""
    titled = m.has_title(F.col("title"))
    return queries.agg(
        F.count("*").alias("n"),
        F.count_if(~titled).alias("untitled"),
        F.count_if(titled & F.col("title_vector").isNull()).alias("unencoded"),
        F.count_if("strict").alias("strict"),
        F.coalesce(F.sum(F.size(query_image_list(F.col("images")))), F.lit(0)).alias("images"),
        F.coalesce(F.sum(F.length("title")), F.lit(0)).alias("title_chars"),
        F.coalesce(F.max("top"), F.lit(0)).alias("top"),
        F.coalesce(F.min("top"), F.lit(0)).alias("least_top"),
        F.when(F.count("min_price") == F.count("*"), F.min("min_price")).alias("low"),
        F.when(F.count("max_price") == F.count("*"), F.max("max_price")).alias("high"),
    ).first()


def _encoded(queries: DataFrame, make_encoder: Callable | None, width: int) -> DataFrame:
    """Give titles without a vector the one the encoder makes."""
    if make_encoder is None:
        raise ValueError("queries with a title need a title_vector, or an encoder must be given")
    encoded = embed_batches(queries, make_encoder, width)
    vector = F.coalesce("title_vector", F.col("vector").cast("array<double>"))
    return materialized(encoded.withColumn("title_vector", vector).select(*queries.columns), "queries")


def _references(
    listings: DataFrame, queries: DataFrame, scores: DataFrame, title_vectors: DataFrame, facts: Row,
    scores_at_most: int,
) -> DataFrame:
    """Reference title, its vector and the query's knobs (at most one row per query)."""
    knobs = queries.select(
        "query_id",
        F.col("title").alias("reference_title"),
        F.col("title_vector").alias("vector"),
        m.effective_text_floor(F.col("min_text_sim")).alias("floor"),
        "strict", "min_price", "max_price", "top",
    )
    if not facts.untitled:
        return knobs
    resolved = m.resolve_reference_title(
        listings, queries, scores, facts.n, facts.images, scores_at_most
    )
    resolved = materialized(resolved.where(m.has_title(F.col("reference_title"))), "titles")
    wanted = resolved.select("query_id", "text_vec_id").where("text_vec_id is not null")
    borrowed = title_vectors.join(broadcast_within(wanted, facts.n, 32), "text_vec_id").select(
        "query_id", F.col("vector").cast("array<double>").alias("borrowed")
    )
    found = (
        resolved.select("query_id", "reference_title")
        .join(borrowed, "query_id", "left")
        .join(knobs.drop("reference_title"), "query_id")
    )
    vector = F.coalesce("vector", "borrowed")
    return materialized(found.withColumn("vector", vector).drop("borrowed"), "references")


def _scored_listings(catalog: DataFrame, scores: DataFrame, n: int, scores_at_most: int) -> DataFrame:
    """Listings with the queries that scored them and their title features as ``have``.

    With several queries the scores are first gathered per SKU key (at most one entry
    per query), so that a listing is joined, and its title taken apart, once and not
    once per query.
    """
    scores = scores.select("query_id", "sku_key", "visual_score")
    if n > 1:
        asked = F.collect_list(F.struct("query_id", "visual_score")).alias("asked")
        scores = scores.groupBy("sku_key").agg(asked)
    listed = with_features(m.attach_visual_score(catalog, scores, scores_at_most), "title", "have")
    if n > 1:
        listed = listed.select("*", F.inline("asked"))
    return listed.drop("asked", "sku_key")


def find_duplicates_batch(
    listings: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    images: DataFrame,
    title_vectors: DataFrame,
    top_k: int = m.VISUAL_TOP_K,
    make_encoder: Callable | None = None,
    width: int = 0,
) -> DataFrame:
    """Ranked matches of every query.

    listings: row_id, sku, title, price, source_file, text_vec_id
    queries: see ``QUERY_SCHEMA``;  query_vectors: query_id, position, vector
    images: image_id, sku_key, vector;  title_vectors: text_vec_id, vector
    make_encoder, width: encoder for given titles that come without ``title_vector``,
    see ``embed_batches``

    Image vectors are only scanned, of the title vectors only those of candidates leave the
    scan.  Candidates are a written table, because they name the vectors and are scored; so
    are the scores where a title must first be found in the catalog.
    """
    queries = _defaulted(queries)
    facts = _facts(queries)
    if facts.least_top < 0:
        raise ValueError("top must not be negative")
    if facts.unencoded:
        queries = _encoded(queries, make_encoder, width)
    scores_at_most = facts.n * top_k

    scores = m.visual_scores(m.visual_search(images, query_vectors, top_k))
    if facts.untitled:
        scores = materialized(scores, "scores")
    references = _references(listings, queries, scores, title_vectors, facts, scores_at_most)
    title_chars = facts.title_chars
    if facts.untitled:
        title_chars = references.agg(F.sum(F.length("reference_title")).alias("n")).first().n or 0

    knobs = references.select(
        "query_id", "strict", "min_price", "max_price", "top",
        title_features(F.col("reference_title")).alias("wanted"),
    )
    minimum = broadcast_within(queries.select("query_id", "min_score"), facts.n, 64)
    strong = m.visual_threshold(scores.join(minimum, "query_id"), F.col("min_score"))

    catalog = m.price_range(listings, facts.low, facts.high).where(m.has_title(F.col("title")))
    scored = _scored_listings(catalog, strong, facts.n, scores_at_most)
    pairs = scored.join(broadcast_within(knobs, facts.n * 256 + title_chars * 12, 1), "query_id").where(
        m.in_price_range(F.col("price"), F.col("min_price"), F.col("max_price"))
        & F.arrays_overlap("have.keywords", "wanted.keywords")
    )
    if facts.strict:
        pairs = pairs.where(~F.col("strict") | ~strict_mismatch(F.col("have"), F.col("wanted")))
    pairs = pairs.drop("have", "wanted", "strict", "min_price", "max_price")
    # Candidates first, so that only their titles are compared.
    pairs = materialized(pairs, "candidates")
    matches = m.candidate_text_sim(pairs, title_vectors, references.where("vector is not null"))
    ranked = m.rank_matches(matches, facts.top).where(F.col("rank") <= F.col("top"))
    return m.match_record(ranked)


def find_duplicates(
    listings: DataFrame,
    images: DataFrame,
    title_vectors: DataFrame,
    query_vectors: DataFrame,
    top_k: int = m.VISUAL_TOP_K,
    make_encoder: Callable | None = None,
    width: int = 0,
    **knobs,
) -> DataFrame:
    """The search for one query; ``query_vectors``: position, vector.  Knobs as in
    ``one_query``."""
    query = one_query(listings.sparkSession, **knobs)
    vectors = query_vectors.withColumn("query_id", F.lit(knobs.get("query_id", 1)).cast("bigint"))
    return find_duplicates_batch(
        listings, query, vectors, images, title_vectors, top_k, make_encoder, width
    )
