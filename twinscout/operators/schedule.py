"""When to fetch what: slots of parallel requests with a limit per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.operators.ranking import ranked

#: Workers of a search and requests that one host bears at a time.
WORKERS = 30
PER_HOST = 4


def url_host(url: Column) -> Column:
    """The host of a URL in lower case; all that has none shares the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"\A[^/?#]*://([^/?#]*)", 1)), F.lit(""))


def fetch_schedule(plan: DataFrame, workers: int = WORKERS, per_host: int = PER_HOST) -> DataFrame:
    """``plan`` (sku, image_url, dest) with ``host``, ``round``, ``slot`` and ``worker``, all from 0.

    A host's fetches, by SKU, go into rounds of ``per_host``; a round's fetches, by host and SKU, into slots of
    ``workers``.  Slots run one after another by (round, slot): none holds more than ``workers`` fetches, nor
    more than ``per_host`` of a host.  Both positions are prefix sums over sorted ranges, so a host
    that holds most of the plan is not one task.
    """
    if workers < 1 or per_host < 1:
        raise ValueError("workers and per_host must be at least 1")
    order = ["sku", "dest", "image_url"]
    asked = plan.select("sku", "image_url", "dest", url_host(F.col("image_url")).alias("host"))
    by_host = ranked(asked, ["host"], order, "_place", "_fetches")
    rounds = by_host.select(*asked.columns, F.floor(F.col("_place") / per_host).cast("bigint").alias("round"))
    placed = ranked(rounds, ["round"], ["host", *order], "_place", "_fetches")
    return placed.select(
        *asked.columns, "round", F.floor(F.col("_place") / workers).cast("bigint").alias("slot"),
        (F.col("_place") % workers).cast("int").alias("worker"),
    )
