"""Secret scans through a trigram inverted index.

Built from DataFrame functions only.  From every rule's regular expression a Boolean trigram
query is derived (OR of ANDs); the trigrams of all queries are indexed over lower-cased texts
as postings (gram, text key), once, in a written table.  Queries are answered by intersecting
postings; only their candidates are verified by the expression itself.  A rule without
mandatory trigrams scans every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.llm.common import free_name
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

#: Most alternatives a run of letters may stand for before it is cut.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax Java and Python share.  Matches are leftmost and non-overlapping;
    those of which ``group`` has fewer than ``least`` characters are dropped afterwards."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The expressions of the three base kinds and of well-known key formats.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)


# --- from expressions to trigram queries -----------------------------------------------


def _runs(tokens) -> list[set[str]]:
    """Runs of letters every match holds one after the other, each as the set of its possible
    spellings; an empty string ends a run on either side."""
    runs, current = [], {""}

    def end():
        nonlocal current
        runs.append(current)
        current = {""}

    def extend(choices: set[str]):
        nonlocal current
        joined = {a + b for a in current for b in choices}
        if len(joined) > ALTERNATIVES:
            end()
            joined = set(choices)
        current = joined

    for kind, value in tokens:
        if kind is ops.LITERAL:
            extend({chr(value).lower()})
        elif kind is ops.IN:
            letters = _letters(value)
            if letters is None:
                end()
            else:
                extend(letters)
        elif kind is ops.SUBPATTERN:
            _inside(value[3], extend, end, runs)
        elif kind is ops.BRANCH:
            parts = [_runs(branch) for branch in value[1]]
            if all(len(part) == 1 for part in parts):
                extend(set().union(*[part[0] for part in parts]))
            else:
                end()
        elif kind in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, body = value
            own = _runs(body)
            if most == 1 and len(own) == 1:
                extend(own[0] | {""} if least == 0 else own[0])
            else:
                for _ in range(min(least, 3)):
                    _inside(body, extend, end, runs)
                end()
        elif kind is not ops.AT:
            end()
    runs.append(current)
    return runs


def _inside(tokens, extend, end, runs):
    first, *rest = _runs(tokens)
    extend(first)
    for run in rest:
        end()
        extend(run)


def _letters(value) -> set[str] | None:
    found = set()
    for kind, item in value:
        if kind is ops.LITERAL:
            found.add(chr(item).lower())
        elif kind is ops.RANGE and item[1] - item[0] < 4:
            found.update(chr(c).lower() for c in range(item[0], item[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that every match holds; None if there are none."""
    best = None
    for run in _runs(parser.parse(pattern)):
        clauses = [frozenset(s[at : at + 3] for at in range(len(s) - 2)) for s in sorted(run)]
        if all(clauses):
            clauses = [c for c in dict.fromkeys(clauses) if not any(other < c for other in clauses)]
            score = min(len(c) for c in clauses)
            if best is None or score > best[0]:
                best = (score, clauses)
    return best[1] if best else None


# --- index, candidates, spans -------------------------------------------------------------


def postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """(gram, text_key): which of ``grams`` (by number) the lower-cased texts hold."""
    low = docs.select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("_low"))
    present = F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(at)) for at, g in enumerate(grams)])
    return low.select("text_key", F.explode(F.array_compact(present)).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, set[str]]:
    """(text_key, kinds) of texts that may match a rule, and the kinds that need a full scan."""
    spark = docs.sparkSession
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = sorted({g for query in queries.values() if query for clause in query for g in clause})
    number = {g: at for at, g in enumerate(grams)}
    clauses = [
        (number[g], kind, at, 1 << place, (1 << len(clause)) - 1)
        for kind, query in queries.items() if query
        for at, clause in enumerate(query)
        for place, g in enumerate(sorted(clause))
    ]
    index = materialized(postings(docs, grams), "postings")
    # As many rows as the rules have trigrams.
    wanted = spark.createDataFrame(clauses, "gram int, kind string, clause int, bit long, full long")
    met = index.join(F.broadcast(wanted), "gram").groupBy("text_key", "kind", "clause", "full")
    met = met.agg(F.bit_or("bit").alias("seen")).where("seen = full")
    found = met.groupBy("text_key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return materialized(found, "candidates"), {kind for kind, query in queries.items() if not query}


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches, in code points: between matches lie
    the pieces that splitting at them leaves."""
    lengths = F.zip_with(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)),
        lambda whole, part: F.struct(F.length(whole).alias("whole"), F.length(part).alias("part")),
    )
    pieces = F.split(text, rule.pattern, -1)
    both = F.zip_with(pieces, lengths, lambda piece, m: F.struct(F.length(piece).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(seen, item):
        start = seen.at + item.gap
        end = start + item.m.whole
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = item.m.part >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.array_append(seen.spans, span)).otherwise(seen.spans).alias("spans"))

    matches = F.filter(both, lambda item: item.m.isNotNull())  # the piece after the last match has none
    return F.aggregate(matches, state, step, lambda seen: seen.spans)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, order, end, kind) sorted by start, then by the
    rule's place in ``rules``; start and end in code points, end exclusive.

    Null and empty texts have none.  Rows are kept as they are, repeated ones too: the index is
    by text, so copies share its answer.  A column of that name is replaced, all others stay; a text of any length is read
    whole; an empty table gives no rows.
    """
    texts = docs.where("text IS NOT NULL")
    found, scans = candidates(texts.select("text"), rules)
    docs = docs.drop(*[name for name in docs.columns if name.lower() == "secrets"])
    own_key, own_kinds = free_name(docs, "_key"), free_name(docs, "_kinds")
    found = found.withColumnsRenamed({"text_key": own_key, "kinds": own_kinds})
    found = broadcast_measured(found, F.lit(24) + 16 * F.size(own_kinds))
    rows = docs.join(found, F.xxhash64("text") == F.col(own_key), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = []
    for order, rule in enumerate(rules):
        hit = F.rlike(text, F.lit(rule.pattern))
        if rule.kind not in scans:
            hit = F.coalesce(F.array_contains(own_kinds, rule.kind), F.lit(False)) & hit
        kinds.append(F.when(hit, _spans(text, rule, order)).otherwise(none))
    return rows.withColumn("secrets", F.sort_array(F.concat(*kinds))).drop(own_key, own_kinds)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
