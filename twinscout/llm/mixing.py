"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Built from DataFrame functions only.  Each source's documents get a hash-random key and are cut
into equal key ranges (``bucket``) of about ``bucket_rows`` rows, so a source of any size is
spread over many tasks.  A window sorts within a bucket, a small one over buckets gives each
its base, and the running sum decides where the source's budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscout.llm.common import WORD, word_count
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    ``weights`` repeat over the sources in code-point order, null last.  All targets together
    are all sizes.  A target stops at ``max_epochs`` times its source; what it can't take goes
    to the others by weight.  In order of cap per weight, the first source that the common
    level of those left does not overfill fixes the level for all after it.  The windows run
    over one row per source.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").cast("bigint").alias("source_size"), F.count("*").alias("n_docs")
    )
    sources = materialized(sources, "sources")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    ordered = sources.withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ordered.withColumn("level", left / heavy)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    levels = levels.withColumn("common", F.max(F.when(fits, F.col("level"))).over(whole))
    # Levels rise up to the first fit and fall after it, so the largest that fits is the common one.
    target = F.least(F.col("cap"), F.coalesce(F.col("common"), F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", "n_docs", target.alias("target"))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def budgets(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Per source: source_size, target, ``epochs`` taken whole, and the cut of the partial one:
    keys below ``cut_key`` are taken, rows at it give ``cut_words`` each.

    One pass over the texts leaves rows (source, key, size), added up where keys repeat.
    """
    narrow = docs.select("source", _key(seed).alias("key"), word_count(F.col("text")).alias("size"))
    narrow = narrow.groupBy("source", "key").agg(F.sum("size").cast("bigint").alias("size"), F.count("*").alias("copies"))
    narrow = materialized(narrow, "sizes")
    targets = source_targets(narrow, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("epochs", epochs).withColumn(
        "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("bigint")
    )
    targets = materialized(targets, "targets")
    facts = broadcast_measured(
        targets.select(
            F.col("source").alias("_source"), "rest", (F.floor(F.col("n_docs") / bucket_rows) + 1).alias("buckets")
        ),
        F.coalesce(F.octet_length("_source"), F.lit(0)) + F.lit(32),
    )
    # The key's upper 32 bits as a share of their range give its bucket.
    share = F.shiftrightunsigned("key", 32).cast("double") / F.lit(float(1 << 32))
    rows = narrow.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.floor(share * F.col("buckets"))).drop("buckets")
    sums = rows.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("base", F.sum("words").over(along) - F.col("words"))
    cut_bucket = sums.where((F.col("base") < F.col("rest")) & (F.col("rest") <= F.col("base") + F.col("words")))
    cut_bucket = cut_bucket.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "base")
    inside = rows.join(
        F.broadcast(cut_bucket),  # one row per source at most, fewer than ``facts``
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")),
    )
    unsigned = F.shiftrightunsigned("key", 1), F.col("key").bitwiseAND(F.lit(1))
    within = Window.partitionBy("source").orderBy(*unsigned)
    inside = inside.withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size"))
    inside = inside.where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("size")))
    cuts = inside.select(
        F.col("source").alias("_source"), F.col("key").alias("cut_key"),
        F.floor((F.col("rest") - F.col("start")) / F.col("copies")).cast("bigint").alias("cut_words"),
    )
    joined = targets.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("source", "source_size", "target", "epochs", "cut_key", "cut_words")


def take(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``epochs`` and ``taken`` at the end; columns of
    ``docs`` that have one of these names are left out.

    ``taken`` counts words, repeats included: every whole epoch takes a document once; the
    last, partial one takes documents in key order up to the exact budget, so a source has at
    most one text taken in part.  Null texts are empty and take 0; the null source is a source;
    an empty table gives an empty result.  The key hashes id and text, so reruns agree; rows
    equal in both are taken alike.
    """
    added = ("size", "source_size", "target", "epochs", "taken", "cut_key", "cut_words", "_source")
    rows = docs.drop(*[name for name in docs.columns if name.lower() in added])
    table = materialized(budgets(docs, weights, max_epochs, seed, bucket_rows), "budgets")
    table = broadcast_measured(
        table.withColumnRenamed("source", "_source"), F.coalesce(F.octet_length("_source"), F.lit(0)) + F.lit(64)
    )
    joined = rows.withColumn("size", word_count(F.col("text"))).join(table, F.col("source").eqNullSafe(F.col("_source")))
    key = _key(seed)
    flip = F.lit(1).cast("bigint")
    half, cut_half = F.shiftrightunsigned(key, 1), F.shiftrightunsigned("cut_key", 1)
    below = (half < cut_half) | ((half == cut_half) & (key.bitwiseAND(flip) < F.col("cut_key").bitwiseAND(flip)))
    partial = F.when(below, F.col("size")).when(key == F.col("cut_key"), F.least("size", "cut_words")).otherwise(0)
    taken = F.col("epochs") * F.col("size") + F.coalesce(partial, F.lit(0))
    return joined.withColumn("taken", taken.cast("bigint")).drop("_source", "cut_key", "cut_words")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, every row as often as it is taken.  A text taken in
    part keeps its first words, joined by single spaces."""
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))  # so no name can clash
    rest = F.col("taken") - F.col("epochs") * F.col("size")
    rows = take(packed, **settings).withColumn("_rest", rest)
    rows = rows.where((F.col("taken") > 0) | ((F.col("size") == 0) & (F.col("epochs") > 0)))
    copies = F.greatest(F.col("epochs") + (F.col("_rest") > 0).cast("bigint"), F.lit(1).cast("bigint"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    cut = (F.col("_copy") > F.col("epochs")) & (F.col("_rest") < F.col("size"))
    first = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("_rest"), F.lit(1)).cast("int"))
    text = F.when(cut, F.array_join(first, " ")).otherwise(F.col("text"))
    return rows.select(*[text.alias(n) if n == "text" else F.col("_row").getField(n).alias(n) for n in docs.columns])
