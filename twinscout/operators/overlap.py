"""Joins of titles by the overlap of their keyword sets, without looking at all pairs.

``overlap(A, B) = |A and B| / min(|A|, |B|)``.  Keywords get one global order, rarest first.  If A is
the smaller set and at least ``need = ceil(t |A|)`` keywords are shared, the first shared one in that
order stands among the first ``|A| - need + 1`` keywords of A, and has ``need - 1`` or more keywords
after it in B.  So the smaller set probes with its short, rare prefix; an inverted index over all
keywords of the larger sets answers, cut by size and position; and the pairs that meet are verified.
A word of every title is in a prefix only where a title has hardly another.

Two sets of ``SMALL_WORDS`` keywords or fewer meet by a stronger condition: they overlap enough if and only if they have a
subset of ``need`` keywords in common.  The smaller set asks by its subsets of that size, the larger one answers by its own,
so only pairs of the result meet, however few words the titles of a catalog are made of.

Titles of equal keywords are one class.  Pairs are pairs of classes, and membership is a table of its
own, so thousands of copies of a title cost one class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.functions.text import title_keywords
from twinscout.operators.matching import has_title
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

#: Sets of so many keywords meet by their subsets, of which one has 255 at most.
SMALL_WORDS = 8


def keyword_rows(listings: DataFrame, row: str = "row_id", title: str = "title") -> DataFrame:
    """(row_id, words, digest) of titles with keywords: the digest is that of the sorted keywords."""
    words = listings.where(has_title(F.col(title))).select(
        F.col(row).alias("row_id"), F.array_sort(title_keywords(F.col(title))).alias("words")
    )
    words = words.where(F.size("words") > 0).withColumn("digest", F.unhex(F.sha2(F.array_join("words", " "), 256)))
    return materialized(words, "keywords")


def keyword_classes(listings: DataFrame, row: str = "row_id", title: str = "title") -> tuple[DataFrame, DataFrame]:
    """((class_id, words), (row_id, class_id)) of titles with keywords; the class is named by its least row.

    Classes are found by a digest of the sorted keywords.  Titles without keywords overlap with nothing and
    are in no class.
    """
    words = keyword_rows(listings, row, title)
    classes = words.groupBy("digest").agg(F.min("row_id").alias("class_id"), F.first("words").alias("words"))
    classes = materialized(classes, "classes")
    members = words.select("row_id", "digest").join(
        broadcast_measured(classes.select("digest", "class_id"), F.lit(64)), "digest"
    )
    return classes.select("class_id", "words"), members.select("row_id", "class_id")


def _ordered(*sides: DataFrame) -> list[DataFrame]:
    """(class_id, word, place, size): the keywords of each class, rarest over all sides first."""
    spread = [materialized(s.select("class_id", F.explode("words").alias("word")), "words") for s in sides]
    counted = spread[0].select("word")
    for more in spread[1:]:
        counted = counted.unionAll(more.select("word"))
    rarity = materialized(counted.groupBy("word").agg(F.count("*").alias("uses")), "rarity")
    found = []
    for own in spread:
        known = own.join(broadcast_measured(rarity, F.octet_length("word") + F.lit(40)), "word")
        lists = known.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("ranked"))
        placed = lists.select("class_id", F.size("ranked").alias("size"), F.posexplode("ranked").alias("place", "entry"))
        found.append(materialized(placed.select("class_id", F.col("entry.word").alias("word"), (F.col("place") + 1).alias("place"), "size"), "places"))
    return found


def needed(size: Column, threshold: float) -> Column:
    """Shared keywords that a pair needs whose smaller set has ``size``."""
    return F.greatest(F.ceil(F.round(size * F.lit(float(threshold)), 9)), F.lit(1)).cast("int")


def _proposed(small: DataFrame, large: DataFrame, threshold: float, strictly: bool) -> DataFrame:
    """Pairs (small_id, large_id) of which the first has the fewer keywords, or (not ``strictly``) as many."""
    probe = small.withColumn("need", needed(F.col("size"), threshold)).where(F.col("place") <= F.col("size") - F.col("need") + 1)
    probe = probe.select("word", F.col("class_id").alias("small_id"), F.col("size").alias("small_size"), "need")
    posted = large.select("word", F.col("class_id").alias("large_id"), F.col("size").alias("large_size"), "place")
    sizes = F.col("large_size") > F.col("small_size") if strictly else F.col("large_size") >= F.col("small_size")
    met = probe.join(posted, "word").where(sizes & (F.col("large_size") - F.col("place") + 1 >= F.col("need")))
    return met.select("small_id", "large_id")


def _subsets(classes: DataFrame, masks: list[tuple[int, int, int]]) -> DataFrame:
    """(class_id, words, need, subset): the subsets named by ``masks`` (size, need, mask), as text.  No keyword holds a blank."""
    table = classes.sparkSession.createDataFrame(masks, "size int, need int, mask int")
    picked = F.filter("words", lambda _, at: F.call_function("shiftright", F.col("mask"), at).bitwiseAND(F.lit(1)) == 1)
    rows = classes.select("class_id", F.array_sort("words").alias("words"), F.size("words").alias("size")).join(F.broadcast(table), "size")
    return rows.select("class_id", "words", "need", F.array_join(picked, " ").alias("subset"))


def _small_pairs(small: DataFrame, large: DataFrame, threshold: float, strictly: bool) -> DataFrame:
    """(small_id, large_id, mine, theirs, common) of the classes of ``SMALL_WORDS`` keywords or fewer that overlap enough, each
    pair once; two sets of one size (not ``strictly``) from either side.  ``mine`` and ``theirs`` are their words."""
    few = F.size("words") <= SMALL_WORDS
    small, large = small.where(few), large.where(few)
    sizes = [row.size for row in small.select(F.size("words").alias("size")).distinct().collect()]
    needs = {size: max(math.ceil(round(size * threshold, 9)), 1) for size in sizes if size}
    masks = [(size, mask.bit_count(), mask) for size in range(1, SMALL_WORDS + 1) for mask in range(1, 1 << size)]
    probe = _subsets(small, [m for m in masks if needs.get(m[0]) == m[1]])
    posted = _subsets(large, [m for m in masks if any(need == m[1] and size <= m[0] for size, need in needs.items())])
    probe = probe.select(F.col("class_id").alias("small_id"), F.col("words").alias("mine"), "need", "subset")
    posted = posted.select(F.col("class_id").alias("large_id"), F.col("words").alias("theirs"), "subset")
    sizes = F.size("theirs") > F.size("mine") if strictly else F.size("theirs") >= F.size("mine")
    common = F.array_intersect("mine", "theirs")
    met = probe.join(posted, "subset").where(sizes).withColumn("common", common)
    # Of the subsets that a pair has in common, the first one of the common words names it.
    met = met.where(F.array_join(F.slice("common", 1, F.col("need")), " ") == F.col("subset"))
    return met.select("small_id", "large_id", "mine", "theirs", "common")


def _counted(met: DataFrame, left: Column, right: Column) -> DataFrame:
    shared = F.size("common")
    return met.select(left.alias("left_id"), right.alias("right_id"), shared.alias("shared"), (shared / F.size("mine")).alias("overlap"))


def _any_large(classes: DataFrame) -> bool:
    return not classes.where(F.size("words") > SMALL_WORDS).isEmpty()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs with their shared keywords counted, from the classes' own sets."""
    both = pairs.join(left.select(F.col("class_id").alias("left_id"), F.col("words").alias("mine")), "left_id")
    both = both.join(right.select(F.col("class_id").alias("right_id"), F.col("words").alias("theirs")), "right_id")
    smaller = F.least(F.size("mine"), F.size("theirs"))
    shared = F.size(F.array_intersect("mine", "theirs"))
    counted = both.select("left_id", "right_id", shared.alias("shared"), smaller.alias("smaller"))
    kept = counted.where(F.col("shared") >= needed(F.col("smaller"), threshold))
    return kept.select("left_id", "right_id", F.col("shared").cast("int").alias("shared"), (F.col("shared") / F.col("smaller")).alias("overlap"))


def _checked(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and be 1 at most")


def overlap_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, shared, overlap) of every two classes (class_id, words) whose overlap is at least
    ``threshold``; left_id is the smaller number."""
    _checked(threshold)
    classes = materialized(classes, "classes")
    few = _small_pairs(classes, classes, threshold, strictly=False)
    # Two sets of one size meet from both sides; one of them is kept.
    few = few.where((F.size("mine") < F.size("theirs")) | (F.col("small_id") < F.col("large_id"))).where("small_id <> large_id")
    few = _counted(few, F.least("small_id", "large_id"), F.greatest("small_id", "large_id"))
    if not _any_large(classes):
        return few
    (places,) = _ordered(classes)
    # Two sets of one size meet from both sides; the distinct keeps one.
    met = _proposed(places, places.where(F.col("size") > SMALL_WORDS), threshold, strictly=False).where("small_id <> large_id")
    pairs = met.select(F.least("small_id", "large_id").alias("left_id"), F.greatest("small_id", "large_id").alias("right_id"))
    return few.unionByName(_verified(materialized(pairs.distinct(), "proposed"), classes, classes, threshold))


def overlap_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, shared, overlap) of the classes of two tables whose overlap is at least ``threshold``."""
    rows = right.select(F.col("class_id").alias("row_id"), "words", F.col("class_id").alias("digest"))
    return overlap_join_rows(left, materialized(rows, "right"), threshold)


def overlap_join_rows(left: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """``overlap_join`` of classes with ``rows`` (row_id, words, digest) that were not made classes: the class of a row is the least
    row of equal digest.

    The rows are read where they lie: a broadcast index of ``left``, of the words that a pair needs, finds their pairs, which
    are verified in place.  Only rows of fewer words than the largest set of ``left`` are shuffled, and what was found; all rows of a
    class are found together, so it is named when little is left.
    """
    _checked(threshold)
    left = materialized(left.select(F.col("class_id").alias("left_id"), F.col("words").alias("mine")), "left")
    most = left.agg(F.max(F.size("mine"))).first()[0] or 0
    own = left.select("left_id", "mine", F.explode("mine").alias("word"))
    row_bytes = F.octet_length("word") + F.lit(40)
    asked = broadcast_measured(own.select("word").distinct(), row_bytes)
    # Only words of ``left`` are counted; all others are rarer than they, as they find nothing.
    uses = rows.select(F.explode("words").alias("word")).join(asked, "word").groupBy("word").agg(F.count("*").alias("uses"))
    uses = broadcast_measured(materialized(uses, "rarity"), row_bytes)

    def prefix(words: DataFrame, keys: list[str], size: Column) -> DataFrame:
        """The first words of each set in the common order, as many as a pair needs one of."""
        lists = words.join(uses, "word", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word"))).alias("ranked"))
        return lists.select(*keys, F.explode(F.slice("ranked", 1, size - needed(size, threshold) + 1)).alias("entry")).select(*keys, "entry.word")

    few, many = F.size("mine"), F.size("words")
    whole = F.octet_length(F.array_join("mine", " ")) + F.size("mine") * 16 + 64
    probe = prefix(own.select("left_id", "word"), ["left_id"], F.size("ranked")).join(left, "left_id")
    probe = broadcast_measured(materialized(probe, "probe"), row_bytes + whole)
    forth = rows.select("row_id", "digest", "words", F.explode("words").alias("word")).join(probe, "word").where(many >= few)
    short = rows.where(many < most)
    short = materialized(short.select("row_id", "digest", F.explode("words").alias("word")), "short")
    short = prefix(short, ["row_id", "digest"], F.size("ranked")).join(rows.where(many < most).select("row_id", "digest", "words"), ["row_id", "digest"])
    back = short.join(broadcast_measured(own, row_bytes + whole), "word").where(many < few)
    met = forth.select("left_id", "row_id", "digest", "mine", "words").unionByName(back.select("left_id", "row_id", "digest", "mine", "words"))
    smaller, shared = F.least(few, many), F.size(F.array_intersect("mine", "words"))
    counted = met.select("left_id", "row_id", "digest", smaller.alias("smaller"), shared.alias("shared"))
    kept = counted.where(F.col("shared") >= needed(F.col("smaller"), threshold))
    named = kept.groupBy("left_id", "digest", "shared", "smaller").agg(F.min("row_id").alias("right_id"))
    return named.select("left_id", "right_id", "shared", (F.col("shared") / F.col("smaller")).alias("overlap"))
