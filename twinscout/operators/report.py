"""From ranked matches to what a report page shows.

Inputs here are results: at most ``top`` rows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscout.functions.fields import (
    THUMBNAILS, as_text, image_url_list, match_count_label, price_label, shown_price,
)
from twinscout.functions.text import strip
from twinscout.operators.sizing import broadcast_within, join_spread

# Stand-ins for missing values, and the attribute columns a card reads.
DEFAULT_BRAND = "Generic"
DEFAULT_LOW_PRICE = 0
DEFAULT_HIGH_PRICE = 999
UNRANKED = 9999
CARD_COLUMNS = (
    "Best_ZSKU", "Best_Brand", "Best_Color", "Best_Stock", "Best_Product_URL", "Match_Count",
    "Combined_All_Image_URLs",
)


def enrich_attributes(
    matches: DataFrame, attributes: DataFrame, matches_at_most: int | None = None
) -> DataFrame:
    """Left-join attribute columns (sku, row_id, ...) to matches, SKU in any letter case.

    Of one exact SKU the last row counts; of several spellings the one seen first.  The
    attribute table is first cut down to the SKUs among the matches (which are thereby
    read twice); both reductions are aggregates combined before their shuffle.  Without
    ``matches_at_most`` both sides are measured, and a SKU that fills most of either table is spread.
    """
    extras = [c for c in attributes.columns if c not in ("sku", "row_id")]
    asked = matches.select(F.upper(strip(F.col("sku"))).alias("_key")).distinct()
    keyed = attributes.withColumn("_key", F.upper("sku"))
    if matches_at_most is None:
        wanted = join_spread(keyed, asked, ["_key"], "left_semi", F.octet_length("_key") + F.lit(32))
    else:
        wanted = keyed.join(broadcast_within(asked, matches_at_most, 64), "_key", "left_semi")
    per_sku = wanted.groupBy("_key", "sku").agg(
        F.max_by(F.struct(*[f"`{c}`" for c in extras]), "row_id").alias("_last"),
        F.min("row_id").alias("_seen"),
    )
    per_key = per_sku.groupBy("_key").agg(F.min_by("_last", "_seen").alias("_last"))
    listed = matches.withColumn("_key", F.upper(strip(F.col("sku"))))
    if matches_at_most is None:
        joined = join_spread(listed, per_key, ["_key"], "left", F.coalesce(F.octet_length(F.to_json("_last")), F.lit(0)) + F.lit(64))
    else:
        joined = listed.join(broadcast_within(per_key, matches_at_most, 4096), "_key", "left")
    return joined.select(*matches.columns, *[F.col(f"_last.`{c}`").alias(c) for c in extras])


def _attribute(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    if name in df.columns:
        return F.col(f"`{name}`"), df.schema[name].dataType
    return F.lit(None).cast("string"), T.StringType()


def _shown(df: DataFrame, name: str) -> Column:
    """An attribute as text; blank, NaN and numeric zero count as missing."""
    value, dtype = _attribute(df, name)
    if isinstance(dtype, T.NumericType):
        value = F.when(value != 0, value)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
    text = as_text(value, dtype)
    return F.when(text != "", text)


def card_fields(df: DataFrame) -> DataFrame:
    """Add what a card prints from the attributes: zsku, brand, color, stock,
    product_url, tags, image_urls, image_count, thumbnails, match_badge, price_label."""
    zsku, zsku_type = _attribute(df, "Best_ZSKU")
    brand, brand_type = _attribute(df, "Best_Brand")
    count, count_type = _attribute(df, "Match_Count")
    urls, urls_type = _attribute(df, "Combined_All_Image_URLs")
    color, stock = _shown(df, "Best_Color"), _shown(df, "Best_Stock")
    brand_text = F.coalesce(as_text(brand, brand_type), F.lit(DEFAULT_BRAND))
    blank = F.lit("")
    cards = df.select(
        "*",
        F.coalesce(as_text(zsku, zsku_type), "sku").alias("zsku"),
        brand_text.alias("brand"),
        F.coalesce(color, blank).alias("color"),
        F.coalesce(stock, blank).alias("stock"),
        F.coalesce(_shown(df, "Best_Product_URL"), blank).alias("product_url"),
        F.array_compact(F.array(brand_text, color, stock)).alias("tags"),
        image_url_list(as_text(urls, urls_type)).alias("image_urls"),
        match_count_label(count, count_type).alias("match_badge"),
        price_label(F.col("price")).alias("price_label"),
        shown_price(F.col("price")).alias("shown_price"),
    )
    listed = F.slice("image_urls", 1, THUMBNAILS)
    own = F.array("image_path") if "image_path" in df.columns else F.array().cast("array<string>")
    given = F.coalesce(as_text(urls, urls_type), blank) != ""
    return cards.withColumn("image_count", F.size("image_urls")).withColumn(
        "thumbnails", F.when(given, listed).otherwise(own)
    )


def facet_price(
    df: DataFrame, start: float | None = None, end: float | None = None, price: str = "shown_price"
) -> DataFrame:
    """Cards whose displayed price lies in the chosen range; no price counts as 0, a
    blank or zero limit is open."""
    value = F.coalesce(F.col(price), F.lit(0.0))
    df = df.where(value >= F.lit(float(start or 0)))
    return df.where(value <= F.lit(float(end))) if end else df


def report_order(sort_by: str = "rank", price: str = "shown_price") -> list[Column]:
    """Sort columns of the page orders; ties go by rank.

    Descending, a displayed 0 goes last like a missing price; ascending, it goes first.
    """
    rank = F.coalesce(F.col("rank"), F.lit(UNRANKED)).asc()
    value = F.col(price)
    if sort_by == "rank":
        return [rank]
    if sort_by == "price-desc":
        return [F.when(value > 0, value).desc_nulls_last(), rank]
    if sort_by == "price-asc":
        return [value.asc_nulls_last(), rank]
    raise ValueError(f"unknown order {sort_by!r}")


def sort_report(df: DataFrame, sort_by: str = "rank", price: str = "shown_price") -> DataFrame:
    """Number the cards of every query in page order as ``position``."""
    page = Window.partitionBy("query_id").orderBy(*report_order(sort_by, price))
    return df.withColumn("position", F.row_number().over(page))


def _for_all(queries: DataFrame | None, facts: DataFrame) -> DataFrame:
    """One row for every query, also for those without any match."""
    return facts if queries is None else queries.select("query_id").join(facts, "query_id", "left")


def price_bounds(matches: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Whole lowest and highest price per query (fraction cut off), 0 and 999 without
    any price."""
    facts = matches.groupBy("query_id").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    return _for_all(queries, facts).select(
        "query_id",
        F.coalesce(F.col("low").cast("bigint"), F.lit(DEFAULT_LOW_PRICE)).alias("min_price"),
        F.coalesce(F.col("high").cast("bigint"), F.lit(DEFAULT_HIGH_PRICE)).alias("max_price"),
    )


def result_summary(matches: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Match count and the best scores per query as shown (3 decimals, or ``N/A``)."""

    def best(column: str) -> Column:
        text = F.call_function("format_number", F.col(column), F.lit("0.000"))
        return F.when(F.col(column) > 0, text).otherwise(F.lit("N/A")).alias(column)

    facts = matches.groupBy("query_id").agg(
        F.count("*").alias("total_matches"),
        F.max("ai_score").alias("best_visual"),
        F.max("text_similarity").alias("best_text"),
    )
    return _for_all(queries, facts).select(
        "query_id",
        F.coalesce("total_matches", F.lit(0)).alias("total_matches"),
        best("best_visual"),
        best("best_text"),
    )


def selection_export(cards: DataFrame, selection: DataFrame) -> DataFrame:
    """Per query the distinct chosen SKUs and ZSKUs, one per line in rank order, and the
    number of SKUs.  ``selection``: query_id, sku.  Bounded by the report's ``top``."""
    chosen = cards.join(selection, ["query_id", "sku"], "left_semi")

    def lines(column: str) -> DataFrame:
        first = chosen.groupBy("query_id", column).agg(F.min("rank").alias("at"))
        ordered = F.array_sort(F.collect_list(F.struct("at", column)))
        return first.groupBy("query_id").agg(
            F.array_join(F.transform(ordered, lambda e: e[column]), "\n").alias(f"{column}_text"),
            F.count("*").alias(f"{column}_count"),
        )

    return lines("sku").join(lines("zsku").select("query_id", "zsku_text"), "query_id")


