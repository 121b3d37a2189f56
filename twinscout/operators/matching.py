"""Filters, joins and ranking that turn scored listings into matches.

Row conventions: listings have ``row_id, sku, title, price, source_file``; scores have
``query_id, sku_key, visual_score``.  Everything is keyed by ``query_id``; one query is
a batch of one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.functions.fields import file_stem, parse_price, query_image_list
from twinscout.functions.text import overlap_ratio, sku_key, strip, title_keywords
from twinscout.operators.ranking import ranked
from twinscout.operators.sizing import broadcast_measured, broadcast_within, join_small, top_per_group
from twinscout.operators.vectors import dot_product, l2_norm, nearest, similar
from twinscout.sources.shared import materialized

# Search defaults.
VISUAL_TOP_K = 2000
TOP_MATCHES = 500
MIN_VISUAL_SCORE = 0.20
MIN_TEXT_SIMILARITY = 0.70
UNKNOWN_SOURCE = "Unknown"

SCORE_BYTES = 96
STEM_BYTES = 256


def in_price_range(price: Column, low: Column, high: Column) -> Column:
    """Inclusive bounds; a null bound is open, a missing price (NaN too) fails any set bound."""
    price = F.when(~F.isnan(price), price)
    return (low.isNull() | F.coalesce(price >= low, F.lit(False))) & (
        high.isNull() | F.coalesce(price <= high, F.lit(False))
    )


def price_range(
    df: DataFrame, low: float | None = None, high: float | None = None, column: str = "price"
) -> DataFrame:
    """Keep rows whose price lies within the given bounds.

    On a numeric column the bounds compare the stored column itself, so they reach the
    file scan.
    """
    if low is None and high is None:
        return df
    if column not in df.columns:
        warnings.warn(f"no column {column!r}: price filter skipped", stacklevel=2)
        return df
    dtype = df.schema[column].dataType
    numeric = dtype.typeName() in ("double", "float", "integer", "long", "short", "decimal")
    price = F.col(column) if numeric else parse_price(F.col(column), dtype)
    if numeric and dtype.typeName() in ("double", "float"):
        df = df.where(~F.isnan(price))
    if low is not None:
        df = df.where(price >= F.lit(float(low)))
    if high is not None:
        df = df.where(price <= F.lit(float(high)))
    return df


def title_contains(df: DataFrame, pattern: str, column: str = "title") -> DataFrame:
    """Rows whose title matches a pattern in any letter case."""
    hit = F.coalesce(F.col(column).rlike("(?iu)" + pattern), F.lit(False))
    return df.where(hit)


def has_title(title: Column) -> Column:
    return F.coalesce(title != "", F.lit(False))


def asked_words(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((keyword, at, asking), (at, ids)) of queries (query_id, reference_title): ``ids`` are up to 64 distinct queries, and the
    bits of ``asking``, from the lowest on, tell which of them have the keyword in their title."""
    asked = queries.select("query_id", title_keywords(F.col("reference_title")).alias("words")).where(F.size("words") > 0)
    each = asked.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    numbered = ranked(each, [], ["query_id"], "number", "total")
    numbered = materialized(numbered.select("query_id", "words", F.floor(F.col("number") / 64).alias("at"), (F.col("number") % 64).cast("int").alias("bit")), "numbered")
    own = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")))
    asking = numbered.select("at", "bit", F.explode("words").alias("keyword")).groupBy("keyword", "at").agg(own.alias("asking"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bit", "query_id"))), lambda entry: entry["query_id"])
    return materialized(asking, "asking"), materialized(numbered.groupBy("at").agg(listed.alias("ids")), "asked")


def keyword_prefilter(listings: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs (query_id, row_id) whose titles share at least one keyword.

    ``queries`` has ``query_id, reference_title``.  An equi-join on single keywords that
    carries only the row number and, for each 64 queries, a number of which each query is a bit.  The numbers of a
    row are joined by OR, so what is shuffled is a row per listing and 64 queries, not one per pair, and pairs are made
    when nothing is left to do.  The query side is broadcast when its size is measured to be small; else
    hot keywords are split at run time.
    """
    asking, asked = asked_words(queries)
    words = listings.where(has_title(F.col("title"))).select(
        "row_id", F.explode(title_keywords(F.col("title"))).alias("keyword")
    )
    met = words.join(broadcast_measured(asking, F.length("keyword") * 4 + 80), "keyword")
    return asked_pairs(met.select("row_id", "at", "asking"), asked)


def asked_pairs(met: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct pairs (query_id, row_id) of rows (row_id, at, asking) that met words of ``asked_words``."""
    met = met.groupBy("row_id", "at").agg(F.bit_or("asking").alias("asking"))
    named = met.join(broadcast_measured(asked, F.size("ids") * 16 + 48), "at")
    have = F.filter("ids", lambda _, bit: F.call_function("shiftright", F.col("asking"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return named.select(F.explode(have).alias("query_id"), "row_id")


def visual_search(
    images: DataFrame, query_vectors: DataFrame, top_k: int = VISUAL_TOP_K
) -> DataFrame:
    """Best ``top_k`` cached images of every query with their 1-based hit position.

    ``images``: image_id, sku_key, vector.  ``query_vectors``: query_id, position,
    vector (one row per query image).  The cut is over the whole image cache, before any
    listing filter.  Ties go to the lower image id.
    """
    candidates = nearest(images, query_vectors, top_k)
    order = [F.col("score").desc(), F.col("image_id").asc()]
    return top_per_group(candidates, ["query_id"], order, top_k, ["image_id"], "hit")


def visual_scores(hits: DataFrame) -> DataFrame:
    """One score per (query, SKU key).  Among several images of a key the last hit, so
    the lowest score, counts; ``hit`` keeps the position of the first."""
    return hits.groupBy("query_id", "sku_key").agg(
        F.min("score").alias("visual_score"), F.min("hit").alias("hit")
    )


def has_visual_score(
    listings: DataFrame, scores: DataFrame, query_id: int, scores_at_most: int | None = None
) -> DataFrame:
    """Listings whose SKU key has a score of the given query."""
    own = scores.where(F.col("query_id") == query_id).select("sku_key")
    keys = broadcast_within(own, scores_at_most, SCORE_BYTES)
    keyed = listings.withColumn("sku_key", sku_key(F.col("sku")))
    return keyed.join(keys, "sku_key", "left_semi")


def attach_visual_score(
    listings: DataFrame, scores: DataFrame, scores_at_most: int | None = None
) -> DataFrame:
    """Every listing with every query that scored its SKU key.  Duplicate SKU rows all
    stay; scores hold one row per key, so a hot SKU never multiplies."""
    keyed = listings.withColumn("sku_key", sku_key(F.col("sku")))
    return join_small(keyed, scores, ["sku_key"], scores_at_most, SCORE_BYTES)


def effective_text_floor(min_text_sim: Column) -> Column:
    """Zero or less means the default threshold, not "off"."""
    return F.when(min_text_sim > 0, min_text_sim).otherwise(F.lit(MIN_TEXT_SIMILARITY))


def text_threshold(df: DataFrame, min_text_sim: Column, similarity: str = "text_similarity") -> DataFrame:
    return df.where(F.col(similarity) >= effective_text_floor(min_text_sim))


def visual_threshold(df: DataFrame, min_score: Column, score: str = "visual_score") -> DataFrame:
    """Rows with a score of at least ``min_score``; a missing score never passes."""
    return df.where(F.col(score) >= min_score)


def semantic_text_sim(title_vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Cosine similarity of title vectors (text_vec_id, vector) with query title vectors
    (query_id, vector, floor); only pairs at or above the floor come out."""
    return similar(title_vectors, query_vectors)


def candidate_text_sim(pairs: DataFrame, title_vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """``pairs`` (query_id, text_vec_id, ...) whose cosine similarity reaches the query's floor, with
    ``text_similarity``.

    Only the title vectors that the pairs name leave the scan, and only the pairs are scored, so
    nothing depends on how loose the floor is.  ``pairs`` are read twice; hand in a table, whose rows are
    counted from its files.
    """
    named = broadcast_within(pairs.select("text_vec_id").where("text_vec_id is not null").distinct(), pairs.count(), 16)
    titles = title_vectors.join(named, "text_vec_id", "left_semi").select(
        "text_vec_id", F.col("vector").alias("_title"), l2_norm(F.col("vector")).alias("_title_norm")
    )
    asked = query_vectors.select(
        "query_id", "floor", F.col("vector").alias("_asked"), l2_norm(F.col("vector")).alias("_asked_norm")
    )
    both = pairs.join(titles, "text_vec_id").join(
        broadcast_measured(asked, F.size("_asked") * 8 + F.lit(64)), "query_id"
    )
    norms = F.col("_title_norm") * F.col("_asked_norm")
    cosine = F.when(norms > 0, dot_product(F.col("_title"), F.col("_asked")) / norms).otherwise(F.lit(0.0))
    scored = both.withColumn("text_similarity", cosine).where(F.col("text_similarity") >= F.col("floor"))
    return scored.drop("floor", "_title", "_title_norm", "_asked", "_asked_norm")


def pair_text_sim(a: Column, b: Column) -> Column:
    """Cosine similarity of two vector columns of the same row."""
    return dot_product(a, b) / (l2_norm(a) * l2_norm(b))


def title_overlap(a: Column, b: Column) -> Column:
    return overlap_ratio(title_keywords(a), title_keywords(b))


def _option(kind: int, place: Column, hit: Column) -> Column:
    """Rank of one way to find a title: stems before keys, then their own order."""
    return F.struct(F.lit(kind), place.cast("double"), hit.cast("int")).alias("option")


def resolve_reference_title(
    listings: DataFrame, queries: DataFrame, scores: DataFrame,
    queries_at_most: int | None = None, images_at_most: int | None = None,
    scores_at_most: int | None = None,
) -> DataFrame:
    """The title every query is compared with: (query_id, reference_title, reference_row,
    text_vec_id).

    In order: the title given; the title of the first listing whose SKU is exactly the
    stem of a query image, images in order; the title of the best-scoring key found
    among the listings.  ``reference_row`` is null for a given title; a query without
    any title is absent.  Only listings inside the query's price range count.  Queries and
    scores are read twice; hand in tables, not the search that makes them.

    Both kinds of option, stems and scored keys, look their SKU up in one pass over the
    listings.  That pass asks only for the first listing per SKU and price range, an
    aggregate combined before its shuffle, over a join that splits hot SKUs: neither a SKU
    that fills a third of the catalog nor many queries asking for it multiply rows.
    """
    bounds = ["min_price", "max_price"]
    wanted = queries.where(~has_title(F.col("title")))
    stems = wanted.select(
        "query_id", *bounds, F.posexplode(query_image_list(F.col("images"))).alias("pos", "path")
    ).select(
        "query_id", *bounds, file_stem(F.col("path")).alias("sku"), _option(0, F.col("pos"), F.lit(0))
    )
    keys = scores.join(
        broadcast_within(wanted.select("query_id", *bounds), queries_at_most, 64), "query_id"
    ).select(
        "query_id", *bounds, F.col("sku_key").alias("sku"), _option(1, -F.col("visual_score"), F.col("hit"))
    )
    options = stems.unionByName(keys)
    options_at_most = None
    if images_at_most is not None and scores_at_most is not None:
        options_at_most = images_at_most + scores_at_most

    asked = options.select("sku", *bounds).distinct()
    found = F.struct(
        F.coalesce("title", F.lit("")).alias("reference_title"),
        F.col("row_id").alias("reference_row"),
        F.col("text_vec_id"),
    )
    first = (
        join_small(listings, asked, ["sku"], options_at_most, STEM_BYTES)
        .where(in_price_range(F.col("price"), F.col("min_price"), F.col("max_price")))
        .groupBy("sku", *bounds)
        .agg(F.min_by(found, "row_id").alias("found"))
    ).withColumnsRenamed({name: f"_{name}" for name in ("sku", *bounds)})
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in ("sku", *bounds)]
    best = (
        options.join(first, same)
        .groupBy("query_id")
        .agg(F.min_by("found", "option").alias("found"))
        .select("query_id", "found.*")
    )

    given = queries.where(has_title(F.col("title"))).select(
        "query_id",
        F.col("title").alias("reference_title"),
        F.lit(None).cast("bigint").alias("reference_row"),
        F.lit(None).cast("bigint").alias("text_vec_id"),
    )
    return given.unionByName(best)


def rank_matches(df: DataFrame, top: int = TOP_MATCHES) -> DataFrame:
    """Best ``top`` rows per query by visual score, then text similarity, then row."""
    if top < 0:
        raise ValueError("top must not be negative")
    order = [F.col("visual_score").desc(), F.col("text_similarity").desc(), F.col("row_id").asc()]
    return top_per_group(df, ["query_id"], order, top, ["row_id"], "rank")


def match_record(df: DataFrame) -> DataFrame:
    """The published fields of a ranked match."""
    trimmed = strip(F.col("sku"))
    return df.select(
        "query_id",
        F.coalesce("source_file", F.lit(UNKNOWN_SOURCE)).alias("source_file"),
        "row_id",
        trimmed.alias("sku"),
        "title",
        "price",
        F.col("visual_score").alias("ai_score"),
        "text_similarity",
        F.concat(trimmed, F.lit(".jpg")).alias("image_filename"),
        "rank",
    )
