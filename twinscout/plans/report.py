"""The report over ranked matches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from twinscout.operators.cache import local_image_path
from twinscout.operators.report import card_fields, enrich_attributes, facet_price, sort_report
from twinscout.sources.shared import materialized


def report_view(
    matches: DataFrame,
    attributes: DataFrame,
    manifest: DataFrame,
    image_dir: str,
    start_price: float | None = None,
    end_price: float | None = None,
    sort_by: str = "rank",
    matches_at_most: int | None = None,
) -> DataFrame:
    """Matches with attributes, picture, card fields, price facet and page position.

    Matches that come straight from a search are written out first, as both look-ups read
    them twice; ``top`` rows per query at most.
    """
    matches = materialized(matches, "matches")
    pictured = local_image_path(matches, manifest, image_dir, matches_at_most)
    enriched = enrich_attributes(pictured, attributes, matches_at_most)
    return sort_report(facet_price(card_fields(enriched), start_price, end_price), sort_by)
