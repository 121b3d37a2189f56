"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Built from DataFrame functions only.  One pass over the texts writes a narrow table (id, length,
prefix hash) of normalised texts.  Rows whose length is shared, and of those the rows whose
prefix is shared too, survive; only they are read in full again and hashed by SHA-256.  Groups
are counted by aggregates with partial sums, so a group of any size is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.llm.common import NULL_ID, SPACES, free_name, id_or_least
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

PREFIX = 64


def normalised(column: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), f"{SPACES}+", " ")


def duplicate_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, text_key, keep_id, group_size) of the rows whose text another row has too.

    ``text_key`` hashes the text as it is and tells rows of one id apart.  Ids are long, null as the
    smallest.  ``keep_id`` is the smallest doc_id that is not null, else that stand-in.
    """
    text = normalised(F.col("text"))
    signatures = docs.select(
        id_or_least().alias("doc_id"), F.xxhash64("text").alias("text_key"), F.octet_length(text).alias("length"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("prefix"),
    )
    signatures = materialized(signatures, "signatures")
    lengths = materialized(signatures.groupBy("length").count().where("count > 1").select("length"), "lengths")
    survivors = signatures.join(broadcast_measured(lengths, F.lit(16)), "length", "left_semi")
    prefixes = survivors.groupBy("length", "prefix").count().where("count > 1").select("length", "prefix")
    prefixes = materialized(prefixes, "prefixes")
    survivors = survivors.join(broadcast_measured(prefixes, F.lit(24)), ["length", "prefix"], "left_semi")
    survivors = survivors.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    own_id, own_key = free_name(docs, "_id"), free_name(docs, "_key")
    survivors = broadcast_measured(
        materialized(survivors.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)), "survivors"), F.lit(24)
    )
    again = docs.join(
        survivors, (id_or_least() == F.col(own_id)) & (F.xxhash64("text") == F.col(own_key)), "left_semi"
    )
    hashed = again.select(
        id_or_least().alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.unhex(F.sha2(text, 256)).alias("full"),
    )
    hashed = materialized(hashed, "hashed")
    real = F.when(F.col("doc_id") > F.lit(NULL_ID + 1) - 1, F.col("doc_id"))
    groups = hashed.groupBy("full").agg(F.coalesce(F.min(real), F.min("doc_id")).alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialized(groups.where("group_size > 1"), "groups")
    found = hashed.join(groups, "full").groupBy("doc_id", "text_key")
    return found.agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept`` at the end (columns of these names are
    replaced).

    Texts are equal if identical after white-space runs became one space; null is empty.  The
    row of the smallest doc_id stays.  Rows that repeat its id and text are the same document
    and stay with it; each counts in ``group_size``.  Null ids stay only where a group has no
    other, and ``keep_id`` is then null.  A text of any length is read whole; an empty table gives no rows.

    Keys are columns of their own before the join, so where the result's text is not asked for, no text is
    shuffled, however many duplicates there are.
    """
    rows = docs.drop(*[name for name in docs.columns if name.lower() in ("keep_id", "group_size", "kept")])
    own_id, own_key, of_id, of_key = (free_name(rows, name) for name in ("_id", "_key", "_of_id", "_of_key"))
    groups = materialized(duplicate_groups(docs, prefix), "duplicates")
    groups = groups.withColumnsRenamed({"doc_id": of_id, "text_key": of_key})
    groups = broadcast_measured(groups, F.lit(40))
    rows = rows.withColumns({own_id: id_or_least(), own_key: F.xxhash64("text")})
    joined = rows.join(groups, (F.col(own_id) == F.col(of_id)) & (F.col(own_key) == F.col(of_key)), "left")
    least = F.lit(NULL_ID + 1) - 1
    keep = F.coalesce(F.col("keep_id"), F.col(own_id))
    return joined.withColumns(
        {
            "kept": keep == F.col(own_id),
            "keep_id": F.when(keep > least, keep),
            "group_size": F.coalesce("group_size", F.lit(1).cast("bigint")),
        }
    ).drop(own_id, own_key, of_id, of_key)
