"""Keyword pairs of listings and many queries where some words are in nearly every title.

A mergeable frequent-items sketch finds the hot words.  Queries that ask for a hot word are a bitmap over the
numbers of the queries; a listing joins the bitmaps of its hot words where it lies, without a shuffle.  All
other words are rare: they meet by a join on (word, salt), and bring bitmaps too.  The bitmaps of a listing are joined by OR before
pairs are made, so no pair is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.functions.text import title_keywords
from twinscout.operators.matching import asked_pairs, asked_words, has_title
from twinscout.operators.sizing import BROADCAST_BYTES, broadcast_measured, shuffle_partitions
from twinscout.sources.shared import materialized

#: Words the sketch follows, and hot words taken from it.
SKETCH_WORDS = 4096
MOST_HOT = 64
SALTS = 8


def hot_words(words: DataFrame, share: float, most: int = MOST_HOT) -> list[str]:
    """Words of ``words`` (word) that make up about ``share`` of its rows or more, the most frequent ``most`` of them.

    Sketches of the tasks are merged, so this is one pass and one small row; counts are off by less than the rows over
    ``SKETCH_WORDS`` / 2.
    """
    row = words.agg(F.expr(f"approx_top_k(word, {most}, {SKETCH_WORDS})").alias("top"), F.count("*").alias("rows")).first()
    return [x["item"] for x in row.top or [] if x["count"] >= share * row.rows]


def keyword_pairs(listings: DataFrame, queries: DataFrame, share: float | None = None) -> DataFrame:
    """(query_id, row_id) of listings (row_id, title) and queries (query_id, reference_title) that share a keyword: the
    pairs of ``keyword_prefilter``, for query tables of any size.

    A word is hot from ``share`` of all words of all titles on (by default a quarter of a task's part of them).  The
    bitmaps take (queries / 8) bytes a hot word; hot words whose bitmaps would pass the broadcast bound are left to the
    salted join.  ``query_id`` is unique.
    """
    spark = listings.sparkSession
    tasks = shuffle_partitions(spark)
    share = 1 / (4 * tasks) if share is None else share
    asking, asked = asked_words(queries)
    blocks = asked.count()
    if not blocks:
        return queries.select("query_id", F.lit(0).cast("bigint").alias("row_id")).limit(0)
    # The titles are parsed once.
    titles = listings.where(has_title(F.col("title"))).select("row_id", title_keywords(F.col("title")).alias("words"))
    titles = materialized(titles.where(F.size("words") > 0), "titles")
    most = min(MOST_HOT, int(BROADCAST_BYTES // (8 * blocks)))
    hot = hot_words(titles.select(F.explode("words").alias("word")), share, most) if most else []

    named = F.array(*[F.lit(w) for w in hot]).cast("array<string>")
    rare = titles.select("row_id", F.explode(F.array_except("words", named)).alias("keyword"))
    rare = rare.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    wanted = asking.where(~F.col("keyword").isin(hot)) if hot else asking
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rare.join(broadcast_measured(wanted, F.octet_length("keyword") + F.lit(64)), ["keyword", "salt"]).select("row_id", "at", "asking")
    if hot:
        maps = F.broadcast(materialized(asking.where(F.col("keyword").isin(hot)), "bitmaps"))
        own = titles.select("row_id", F.explode(F.array_intersect("words", named)).alias("keyword"))
        met = met.unionAll(own.join(maps, "keyword").select("row_id", "at", "asking"))
    return asked_pairs(met, asked)
