"""Price ranges of many queries at once, joined by dyadic bins.

A price lies in the cell ``floor(price / width)``.  The cells strictly between a query's bounds are cut into
at most two bins of each power of two; a listing has one bin of each power that some query uses.  Listings
meet queries by an equi-join on (power, bin): every pair that meets there is a result.  Only the two
cells that hold the bounds themselves are compared price by price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

#: Cells are numbered within +- 2**POWERS; prices beyond lie in the outermost.
POWERS = 40
#: Stands for the power of the cells that hold a bound.
EDGE = -1


def _cell(price: Column, width: float) -> Column:
    most = float(1 << POWERS)
    held = F.least(F.greatest(price / F.lit(width), F.lit(-most)), F.lit(most))
    return F.when(price.isNotNull(), F.floor(held).cast("bigint"))


def _up(cell: Column, power: Column) -> Column:
    """Cell divided by the power of two, rounded up."""
    return -F.call_function("shiftright", -cell, power)


def query_bins(queries: DataFrame, width: float) -> DataFrame:
    """(query_id, power, bin, min_price, max_price): what each query with a bound covers."""
    outer = 1 << POWERS
    bounded = queries.where("min_price IS NOT NULL OR max_price IS NOT NULL").select(
        "query_id", "min_price", "max_price",
        F.coalesce(_cell(F.col("min_price"), width), F.lit(-outer - 1)).alias("low"),
        F.coalesce(_cell(F.col("max_price"), width), F.lit(outer + 1)).alias("high"),
    ).where("low <= high")
    edges = bounded.select("query_id", "min_price", "max_price", F.lit(EDGE).alias("power"), F.explode(F.array_distinct(F.array("low", "high"))).alias("bin"))
    inner = bounded.select("*", F.explode(F.sequence(F.lit(0), F.lit(POWERS + 1))).alias("power"))
    # The cells [low + 1, high) at a power, as far as no greater power covers them.
    first, end = _up(F.col("low") + 1, F.col("power")), F.call_function("shiftright", F.col("high"), F.col("power"))
    inner = inner.select("query_id", "min_price", "max_price", "power", first.alias("first"), end.alias("end")).where("first < end")
    left, right = F.when(F.col("first") % 2 != 0, F.col("first")), F.when(F.col("end") % 2 != 0, F.col("end") - 1)
    bins = inner.select("query_id", "min_price", "max_price", "power", F.explode(F.array_compact(F.array(left, right))).alias("bin"))
    return edges.unionByName(bins)


def price_join(listings: DataFrame, queries: DataFrame, width: float = 1.0) -> DataFrame:
    """(query_id, row_id) of every listing (row_id, price) within the bounds of a query (query_id, min_price,
    max_price), both inclusive; a null bound is open.

    Missing prices (NaN too) fail every bound.  A query without any bound keeps all listings; that needs no
    join, and it has no rows here.  ``width`` is that of a cell and only changes the speed.
    """
    bins = materialized(query_bins(queries, width), "bins")
    powers = [row.power for row in bins.select("power").distinct().collect()]  # POWERS + 3 at most
    priced = listings.where(F.col("price").isNotNull() & ~F.isnan("price")).select("row_id", F.col("price").cast("double").alias("price"))
    cell = _cell(F.col("price"), width)
    if not powers:
        return bins.select("query_id", F.col("bin").alias("row_id"))
    own = F.array(*[F.struct(F.lit(p).alias("power"), F.shiftright(cell, max(p, 0)).alias("bin")) for p in sorted(powers)])
    spread = priced.select("row_id", "price", F.inline(own))
    met = spread.join(broadcast_measured(bins, F.lit(64)), ["power", "bin"])
    inside = (F.col("min_price").isNull() | (F.col("price") >= F.col("min_price"))) & (F.col("max_price").isNull() | (F.col("price") <= F.col("max_price")))
    return met.where((F.col("power") != EDGE) | inside).select("query_id", "row_id")
