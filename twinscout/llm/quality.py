"""Host-level quality rules with shrunk failure rates.

Built from DataFrame functions only.  One map over the texts computes the document statistics
(arrays inside a row, no shuffle of words).  Rule failures are added up per host, the rates are
shrunk toward an empirical beta prior (method of moments over hosts, so a host of few documents
is not condemned by one of them), and the host's verdict is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.llm.common import WORD
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

#: A host is rejected if the shrunk share of its documents that fail a rule reaches this.
HOST_LIMIT = 0.5
#: A host is also bad if its rate surely, by this many deviations of its posterior, lies above a rate and above a multiple of
#: the rate of all documents.
DEVIATIONS = 3.0
SURE_RATE = 0.2
SURE_TIMES = 3.0
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules of the host verdict: name -> whether a document fails it.
RULES: Mapping[str, Column] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "long_words": "word_chars > 15 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_lines and
    n_dup_lines (lines with a word; those equal to an earlier one), n_repeat_words (words in
    three-word windows that occur twice or more in the text, first included).

    A null text has none of all.  Repeated windows are found by sorting (hash, position) pairs
    of a row, only where a row has equal hashes at all.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.rlike(line, F.lit(WORD)))
    rows = docs.withColumn("_words", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))).withColumn("_lines", lines)
    joined = F.array_join("_words", "")
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "_joined": joined,
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_windows": F.expr(
                "CASE WHEN size(_words) < 3 THEN CAST(array() AS array<bigint>) ELSE "
                "transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"
            ),
        }
    ).drop("_words", "_lines")
    rows = rows.withColumns(
        {
            "word_chars": F.length("_joined").cast("bigint"),
            "n_symbols": (F.length("_joined") - F.length(F.regexp_replace("_joined", "[#*$%&|<>]", ""))).cast("bigint"),
            "_sorted": F.expr(
                "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN "
                "sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END"
            ),
        }
    ).drop("_joined", "_windows")
    rows = rows.withColumn(
        "_places",
        F.expr(
            "sort_array(transform(filter(_sorted, (x, k) -> (k > 0 AND x.h = _sorted[k - 1].h) OR "
            "(k + 1 < size(_sorted) AND x.h = _sorted[k + 1].h)), x -> x.i))"
        ),
    ).drop("_sorted")
    # A window covers three words, less what the window before it covers already.
    covered = F.expr(
        "aggregate(_places, struct(-3 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n)).n"
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_places")


def host_rates(marked: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """Per host: number of documents and, for every rule, the shrunk failure rate, what it surely exceeds
    (``DEVIATIONS`` of its posterior below it) and the prior's mean.

    The prior of a rule has the mean failure rate of all documents, and the strength by which
    the rates spread over hosts beyond chance (between 1 and 1,000 documents).  Two rows of
    sums reach the driver.
    """
    sums = marked.groupBy(host).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"_fails_{r}").cast("bigint")).alias(f"k_{r}") for r in rules]
    )
    sums = materialized(sums, "hosts")
    moments = sums.agg(
        F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in rules],
    ).first()
    total = moments["n"] or 0
    if not total:
        return sums.select(host, "n", *[F.lit(0.0).alias(f"{kind}_{r}") for kind in ("rate", "surely", "mean") for r in rules])
    means = {r: moments[f"k_{r}"] / total for r in rules}
    spread = sums.agg(
        *[F.sum(F.col("n") * F.pow(F.col(f"k_{r}") / F.col("n") - F.lit(means[r]), 2)).alias(r) for r in rules]
    ).first()
    rates = []
    for rule in rules:
        mean, hosts = means[rule], moments["hosts"]
        chance = mean * (1 - mean)
        # Between-host variance: what the weighted spread holds beyond binomial noise.
        between = (spread[rule] - (hosts - 1) * chance) / max(total - moments["squares"] / total, 1e-9)
        strength = min(max(chance / between - 1, 1.0), 1000.0) if between > 0 and chance > 0 else 1000.0
        rate = (F.col(f"k_{rule}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1)))
        rates += [rate.alias(f"rate_{rule}"), (rate - DEVIATIONS * deviation).alias(f"surely_{rule}"), F.lit(mean).alias(f"mean_{rule}")]
    return sums.select(host, "n", *rates)


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT, rules: Mapping[str, str] = RULES) -> DataFrame:
    """doc_id, host, the statistics, ``base_failed`` and ``kept`` of every row.

    A document that is short or repetitive fails by itself; any other is kept unless the
    shrunk rate of a rule over its host reaches ``limit``, or surely exceeds both ``SURE_RATE`` and ``SURE_TIMES`` the
    rate of all documents.  The null host is a host; rows with null or repeated ids are judged each; null and empty
    texts fail as short.  A text of any length is read whole.  Other columns are left out, whatever their names; an empty
    table gives no rows.
    """
    narrow = statistics(docs.select("doc_id", F.col(host).alias("_host"), "text")).drop("text")
    names = list(rules)
    narrow = narrow.withColumns({f"_fails_{name}": F.expr(rules[name]) for name in names})
    narrow = materialized(narrow, "statistics")
    rates = host_rates(narrow, "_host", names)
    bad = F.lit(False)
    for name in names:
        sure = (F.col(f"surely_{name}") >= SURE_RATE) & (F.col(f"surely_{name}") >= SURE_TIMES * F.col(f"mean_{name}"))
        bad = bad | (F.col(f"rate_{name}") >= limit) | sure
    rejected = rates.where(bad)
    rejected = materialized(rejected.select(F.col("_host").alias("_bad_host"), F.lit(True).alias("_rejected")), "rejected")
    rejected = broadcast_measured(rejected, F.coalesce(F.octet_length("_bad_host"), F.lit(0)) + F.lit(24))
    joined = narrow.join(rejected, F.col("_host").eqNullSafe(F.col("_bad_host")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id", F.col("_host").alias(host), *METRICS, "n_lines",
        base.alias("base_failed"), (~base & F.col("_rejected").isNull()).alias("kept"),
    )
