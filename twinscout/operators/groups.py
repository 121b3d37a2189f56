"""Duplicate groups over a whole catalog: every listing is a query.

Listings of equal titles (as far as the pair rules can tell) are one node.  Nodes are linked where
their keyword sets overlap enough and no strict rule tells them apart.  Groups are the connected
components of the links, found by contracting them round by round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.functions.text import strict_mismatch, with_features
from twinscout.operators.matching import has_title
from twinscout.operators.overlap import overlap_pairs
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

MIN_OVERLAP = 0.8


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the component, for every id of an edge (a, b).

    Each round every node takes its least neighbour, chains of such steps are followed to their ends, and
    edges shrink to edges between the ends; nodes that no edge is left for are done.  Nodes are
    ordered by a hash in between, so long paths of ascending ids take few rounds too.  A node
    with many edges is an aggregate combined before its shuffle and never a list.
    """
    rank = F.xxhash64
    links = edges.select(F.struct(rank("a").alias("h"), F.col("a").alias("id")).alias("a"), F.struct(rank("b").alias("h"), F.col("b").alias("id")).alias("b"))
    links = materialized(links.where("a <> b").distinct(), "links")
    ends = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        steps = materialized(steps, "steps")
        while True:
            then = steps.select(F.col("node").alias("to"), F.col("to").alias("then"))
            moved = steps.join(then, "to").select("node", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved"))
            moved = materialized(moved, "steps")
            steps = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        if ends is None:
            ends = steps.select(F.col("node").alias("id"), F.col("to").alias("end"))
        else:
            on = steps.select(F.col("node").alias("end"), F.col("to").alias("further"))
            ends = materialized(ends.join(on, "end", "left").select("id", F.coalesce("further", "end").alias("end")), "ends")
        left = steps.select(F.col("node").alias("a"), F.col("to").alias("left"))
        right = steps.select(F.col("node").alias("b"), F.col("to").alias("right"))
        links = links.join(left, "a").join(right, "b").where("left <> right").select(F.col("left").alias("a"), F.col("right").alias("b"))
        links = materialized(links.distinct(), "links")
    if ends is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    least = materialized(ends.groupBy("end").agg(F.min("id.id").alias("root")), "roots")
    return ends.join(least, "end").select(F.col("id.id").alias("id"), "root")


def title_nodes(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, words, facts), (row_id, node)): listings whose titles have the same keywords, models, numbers and
    modifiers are one node, named by its least row.  Listings without a title or keyword are left out."""
    facts = with_features(listings.where(has_title(F.col("title"))).select("row_id", "title"), "title", "facts")
    facts = facts.where(F.size("facts.keywords") > 0)
    sets = [F.array_join(F.array_sort(F.col(f"facts.{name}")), " ") for name in ("keywords", "models", "numbers", "modifiers")]
    facts = materialized(facts.select("row_id", "facts", F.unhex(F.sha2(F.concat_ws("\n", *sets), 256)).alias("digest")), "facts")
    nodes = facts.groupBy("digest").agg(F.min("row_id").alias("node"), F.first("facts").alias("facts"))
    nodes = materialized(nodes, "nodes")
    members = facts.select("row_id", "digest").join(broadcast_measured(nodes.select("digest", "node"), F.lit(64)), "digest")
    return nodes.select("node", F.col("facts.keywords").alias("words"), "facts"), members.select("row_id", "node")


def duplicate_links(nodes: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(a, b) of nodes whose keywords overlap by ``min_overlap`` and that no strict rule tells apart."""
    pairs = overlap_pairs(nodes.select(F.col("node").alias("class_id"), "words"), min_overlap)
    mine = nodes.select(F.col("node").alias("left_id"), F.col("facts").alias("mine"))
    theirs = nodes.select(F.col("node").alias("right_id"), F.col("facts").alias("theirs"))
    same = pairs.join(mine, "left_id").join(theirs, "right_id").where(~strict_mismatch(F.col("mine"), F.col("theirs")))
    return same.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def duplicate_groups(listings: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(row_id, group_id) of every listing with keywords (row_id, title, ...): group_id is the least row of all listings
    that links lead to."""
    nodes, members = title_nodes(listings)
    roots = connected(duplicate_links(materialized(nodes, "nodes"), min_overlap))
    roots = broadcast_measured(materialized(roots, "roots"), F.lit(24))
    joined = members.join(roots.withColumnRenamed("id", "node"), "node", "left")
    return joined.select("row_id", F.coalesce("root", "node").alias("group_id"))


def group_report(listings: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: its representative (the listing of least price, then least row), size, price range and
    number of source files.  Null and NaN prices come after all others."""
    price = F.when(~F.isnan("price"), F.col("price"))
    rows = listings.select("row_id", "sku", "title", price.alias("price"), "source_file").join(groups, "row_id")
    first = F.struct(F.col("price").isNull().alias("unpriced"), "price", "row_id", "sku", "title")
    report = rows.groupBy("group_id").agg(
        F.count("*").alias("listings"), F.min("price").alias("least_price"), F.max("price").alias("most_price"),
        F.count_distinct("source_file").alias("sources"), F.min(first).alias("first"),
    )
    return report.select(
        "group_id", "listings", "least_price", "most_price", "sources", F.col("first.row_id").alias("representative"),
        F.col("first.sku").alias("sku"), F.col("first.title").alias("title"),
    )
