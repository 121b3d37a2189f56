"""URL filters: fixed rules by host and path, else association rules mined by FP-growth.

Built from DataFrame functions and Spark's own FP-growth only.  A URL becomes a set of tokens (host
suffixes, path segments with digits as ``#``, file ending, query keys, fragment).  Labelled URLs, blocked ones with an
item more that says so, are the transactions; frequent sets of any length yield rules "tokens -> block".  A rule
needs the same number of blocked URLs in a table of any size.  Confidence, and its lower bound against the
share of blocked URLs, prune rules, and a rule goes too if any part of its tokens is as sure.  Tokens that occur
in the same labelled URLs, as the parts of a template do, are one item, so they do not double the
sets, and a URL that has one of them has the item.  Rules match through an inverted index: each is posted under the
tokens of its rarest item, URLs meet it by an equi-join on tokens, and the rest of the rule is verified on the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.llm.common import ascii_lower, free_name, shuffle_partitions
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

#: The item of blocked URLs; no token looks like it.
BLOCKED = "blocked"
#: Standard errors from a rule's confidence to its lower bound.
DEVIATIONS = 3.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
    up to ``?``, ``#`` or the end.  Null and URLs without ``://`` have both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  A rule (verdict, ``host/path``) fits
    its host and all subdomains if the path starts with its path.  The list is a short setting."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none for null or a text without ``://``."""
    host, path = host_and_path(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda at: F.concat(F.lit("host="), F.array_join(F.slice(labels, at, F.size(labels)), ".")),
    )
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda part: part != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    query_keys = F.transform(F.filter(F.split(query, "&"), lambda part: part != ""), lambda part: F.concat(F.lit("key="), F.substring_index(part, "=", 1)))
    tokens = F.concat(
        suffixes,
        F.transform(segments, lambda part: F.concat(F.lit("path="), part)),
        F.when(ending != "", F.array(F.concat(F.lit("end="), ending))).otherwise(F.array().cast("array<string>")),
        query_keys,
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host != "", F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def _lower_bound(hits: Column, rows: Column) -> Column:
    """Wilson's lower bound of the share of ``hits`` in ``rows``."""
    share, z = hits / rows, F.lit(DEVIATIONS)
    spread = z * F.sqrt(share * (1 - share) / rows + z * z / (4 * rows * rows))
    return (share + z * z / (2 * rows) - spread) / (1 + z * z / rows)


def _items(labelled: DataFrame, min_rows: int) -> DataFrame:
    """(token, item, members, uses): tokens that ``min_rows`` blocked URLs hold.  Those of the same labelled URLs (as
    many, with the same sum of hashes) share an item, named by the least of them."""
    token = labelled.select("row", "blocked", F.explode("tokens").alias("token"))
    mark = F.xxhash64(F.lit("row"), "row").cast("decimal(38,0)")
    facts = token.groupBy("token").agg(F.count("*").alias("uses"), F.count_if("blocked").alias("hits"), F.sum(mark).alias("mark"))
    facts = facts.where(F.col("hits") >= min_rows)
    same = facts.groupBy("uses", "hits", "mark").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return same.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"), "members", "uses")


def frequent_sets(labelled: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """((items, n, k), items as of ``_items``): the sets of items that ``min_rows`` blocked URLs hold, with the number of
    URLs and of blocked ones."""
    spark = labelled.sparkSession
    labelled = materialized(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled")
    items = materialized(_items(labelled, min_rows), "items")
    token = labelled.select("row", "blocked", F.explode("tokens").alias("token"))
    known = token.join(broadcast_measured(items.select("token", "item"), F.octet_length("token") * 2 + F.lit(32)), "token")
    rows = known.groupBy("row", "blocked").agg(F.collect_set("item").alias("items"))
    rows = rows.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCKED))).otherwise(F.col("items")).alias("items"))
    rows = materialized(rows, "transactions")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "items array<string>, n long, k long"), items
    # Half a row less than asked for, so that rounding cannot ask for one more.
    miner = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / n, minConfidence=0.0, numPartitions=shuffle_partitions(spark))
    found = miner.fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    found = materialized(found, "frequent")
    blocked = found.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1))
    blocked = blocked.select(F.array_remove("items", BLOCKED).alias("items"), F.col("n").alias("k"))
    return materialized(found.join(blocked, "items"), "mined"), items


def _surest_parts(found: DataFrame) -> DataFrame:
    """``found`` with ``part``: the highest confidence of a part of its items, null for single items.  All parts of a
    frequent set are frequent, so sizes go up one by one and each set looks at those one item smaller."""
    longest = found.agg(F.max(F.size("items")).alias("longest")).first().longest or 0
    done = level = materialized(found.where(F.size("items") == 1).withColumn("part", F.lit(None).cast("double")), "parts")
    for size in range(2, longest + 1):
        smaller = level.select(F.col("items").alias("less"), F.greatest("confidence", "part").alias("surest"))
        own = found.where(F.size("items") == size)
        less = own.select("items", F.explode(F.transform("items", lambda item: F.array_remove(F.col("items"), item))).alias("less"))
        best = less.join(smaller, "less").groupBy("items").agg(F.max("surest").alias("part"))
        level = materialized(own.join(best, "items", "left"), "parts")
        done = done.unionByName(level)
    return done


def mine_rules(labelled: DataFrame, min_confidence: float = 0.6, min_rows: int = 20) -> DataFrame:
    """(rule_id, tokens, confidence, support, alternatives, index_tokens) from rows (tokens, blocked boolean).

    A rule asks for one token of each of its ``alternatives``; ``tokens`` has the least of each, ``index_tokens`` those
    of the rarest.  ``min_rows`` blocked URLs must hold a rule's tokens, however many URLs there are; ``support`` is
    their share of all.  The lower bound of a rule's confidence must lie above the share of blocked
    URLs.  Without labelled or blocked rows there are no rules.
    """
    counts = labelled.agg(F.count("*").alias("n"), F.count_if("blocked").alias("k")).first()
    if not counts.n or not counts.k:
        return labelled.sparkSession.createDataFrame(
            [], "rule_id long, tokens array<string>, confidence double, support double, alternatives array<array<string>>, index_tokens array<string>"
        )
    found, items = frequent_sets(labelled, min_rows)
    found = _surest_parts(found.withColumn("confidence", F.col("k") / F.col("n")))
    sure = (F.col("confidence") >= min_confidence) & (_lower_bound(F.col("k"), F.col("n")) > counts.k / counts.n)
    rules = found.where(sure & (F.col("part").isNull() | (F.col("part") < F.col("confidence"))))
    rules = materialized(rules.select("items", "confidence", (F.col("k") / counts.n).alias("support")), "sure")
    # Items become their tokens again.
    named = items.select("item", "members", "uses").distinct()
    spread = rules.select("items", "confidence", "support", F.explode("items").alias("item")).join(named, "item")
    whole = spread.groupBy(F.col("items").alias("tokens"), "confidence", "support").agg(
        F.collect_list("members").alias("alternatives"), F.min_by("members", F.struct("uses", "item")).alias("index_tokens")
    )
    return materialized(whole.select(F.xxhash64("tokens").alias("rule_id"), *whole.columns), "rules")


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_key, rule_id, confidence) of the surest rule that a row (url_key, tokens) fits, for rows that fit one."""
    index = broadcast_measured(
        rules.select("rule_id", "confidence", "alternatives", F.explode("index_tokens").alias("token")),
        F.octet_length(F.array_join(F.flatten("alternatives"), " ")) + F.lit(64),
    )
    met = tokens.select("url_key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where(F.forall("alternatives", lambda own: F.arrays_overlap(own, F.col("tokens"))))
    best = F.struct("confidence", "rule_id")
    return met.groupBy("url_key").agg(F.max(best).alias("best")).select("url_key", "best.rule_id", "best.confidence")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    min_confidence: float = 0.6,
) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule, verdict and ``mined_rule`` (columns of these names are
    replaced, all others stay).

    ``labels`` (page_id, blocked) teach the mined rules; null ids and labels are skipped, an id
    labelled twice is blocked if one label says so.  A fixed rule decides first; else a URL is
    blocked if a mined rule matches, and allowed otherwise.  Equal URLs are matched once; null
    URLs have no tokens and are allowed.  A repeated or null page_id is judged by its own URL.  A URL of
    any length is cut whole.  An empty table gives no rows.
    """
    new = ("host", "path", "rule", "verdict", "mined_rule")
    pages = pages.drop(*[name for name in pages.columns if name.lower() in new])
    host, path = host_and_path(F.col("url"))
    marks = labels.where("page_id IS NOT NULL AND blocked IS NOT NULL").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    labelled = pages.select("page_id", "url").join(marks, "page_id").select(url_tokens(F.col("url")).alias("tokens"), "blocked")
    mined = mine_rules(materialized(labelled, "labelled"), min_confidence)
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    matched = match_rules(urls.select(F.col("url").alias("url_key"), url_tokens(F.col("url")).alias("tokens")), mined)
    own, fixed = free_name(pages, "_url"), free_name(pages, "_fixed")
    matched = materialized(matched.select(F.col("url_key").alias(own), F.col("rule_id").alias("mined_rule")), "matched")
    matched = broadcast_measured(matched, F.octet_length(own) + F.lit(24))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.join(matched, F.col("url") == F.col(own), "left").drop(own)
    rows = rows.withColumn("rule", rule).withColumn(fixed, verdict)
    mined_verdict = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", F.coalesce(fixed, mined_verdict)).drop(fixed)
