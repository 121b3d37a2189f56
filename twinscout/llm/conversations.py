"""Repair of conversation structure by a run-length dynamic program.

A conversation's turns become symbols of role initial and fault.  Equal consecutive symbols are a run;
a run of k turns is one min-plus product with the k-th power of its symbol's transition, made of
cached binary powers.  States are the four places in ``(s?(ua)+)?``.  As the products are
associative, a conversation may be cut into segments, each read by its own task:

1. Turns (without texts) are sorted over ranges; a conversation's part in a range is a segment.
   Each gives one transition of 4 x 4 numbers and its counts.
2. The transitions of a conversation are multiplied from its end: the cost to go at the end of each
   segment.  That is one row per segment, and a conversation has one segment per range at most.
3. Each segment unrolls its choices: at every place the ASCII-least edit that keeps the cheapest total.
   Segments other than the first do so for each of the four states they may be entered in.
4. The states met at the borders choose among these; the audit of a segment and its turns, now
   with texts, meet by conversation and segment and are read in order.

So no task holds a conversation: one that fills a third of the table is many segments.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.llm.common import SPACES, bound_batches, shuffle_partitions
from twinscout.operators.sizing import BROADCAST_BYTES, broadcast_measured
from twinscout.sources.shared import materialized

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 50
#: A symbol is 2 * initial + truncated; one for turns that must go, whatever their role.
INITIALS = "sua"
OTHER = 3
GONE = 8
#: States: nothing yet, after s, after u, after a.  From a state, where a user or an assistant leads.
STEP = (2, 2, 3, 2)
INSERTED = ("user", "user", "assistant", "user")
#: Cost to end from a state.
ENDING = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of transitions, or of a transition and a vector."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(axis=1), NEVER)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def kept_state(symbol: int, state: int) -> int | None:
    """Where a turn leads that keeps its role, if it may."""
    initial = symbol // 2
    if symbol == GONE or initial == OTHER:
        return None
    if initial == 0:
        return 1 if state == 0 else None
    return STEP[state] if STEP[state] == initial + 1 else None


@lru_cache(maxsize=None)
def power(symbol: int, exponent: int) -> np.ndarray:
    """Transition of 2 ** exponent turns of one symbol, insertions before each included."""
    if exponent:
        half = power(symbol, exponent - 1)
        return _times(half, half)
    closure = np.full((4, 4), NEVER, dtype=np.int64)
    turn = closure.copy()
    for state in range(4):
        closure[state, state] = 0
        closure[state, STEP[state]] = INSERT
        closure[state, STEP[STEP[state]]] = min(closure[state, STEP[STEP[state]]], 2 * INSERT)
        turn[state, state] = DELETE
        if symbol != GONE:
            extra = TRUNCATED * (symbol % 2)
            turn[state, STEP[state]] = REROLE + extra
            kept = kept_state(symbol, state)
            if kept is not None:
                turn[state, kept] = min(turn[state, kept], extra)
    return _times(closure, turn)


def run_transition(symbol: int, turns: int) -> np.ndarray:
    """Transition of a run, by the binary digits of its length."""
    found, exponent = None, 0
    while turns:
        if turns & 1:
            found = power(symbol, exponent) if found is None else _times(found, power(symbol, exponent))
        turns >>= 1
        exponent += 1
    return found


def runs(symbols) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in group)) for symbol, group in groupby(symbols)]


def transition(symbols) -> np.ndarray:
    """Transition of a whole segment."""
    found = np.full((4, 4), NEVER, dtype=np.int64)
    np.fill_diagonal(found, 0)
    for symbol, turns in runs(symbols):
        found = _times(found, run_transition(symbol, turns))
    return found


def unroll(symbols, end: np.ndarray, entry: int, last: bool) -> tuple[str, int] | None:
    """(audit, state at the end) of the ASCII-least cheapest edits of a segment that is entered in a state.

    ``end`` is the cost to go at its end; the last segment also inserts what is missing there.  Null if
    no edits lead on.  Costs to go are kept at the borders of runs; inside a run they are
    made when it is unrolled.
    """
    cut = runs(symbols)
    border = [end]
    for symbol, turns in reversed(cut):
        border.append(_times(run_transition(symbol, turns), border[-1]))
    border.reverse()
    state, audit = entry, []
    if border[0][state] >= NEVER:
        return None
    for (symbol, turns), after in zip(cut, border[1:], strict=True):
        one, inside = power(symbol, 0), [after]
        for _ in range(turns):
            inside.append(_times(one, inside[-1]))
        extra = TRUNCATED * (symbol % 2)
        inside = [vector.tolist() for vector in inside]
        while len(inside) > 1:
            here, then = inside[-1], inside[-2]
            left, kept = here[state], kept_state(symbol, state)
            if DELETE + then[state] == left:
                audit.append("D")
            elif INSERT + here[STEP[state]] == left:
                audit.append("I")
                state = STEP[state]
                continue
            elif kept is not None and extra + then[kept] == left:
                audit.append("K")
                state = kept
            else:
                audit.append("R")
                state = STEP[state]
            inside.pop()
    while last and ENDING[state]:
        audit.append("I")
        state = STEP[state]
    return "".join(audit), state


def turns_with_faults(turns: DataFrame) -> DataFrame:
    """Turns without texts, equal ones (conversation, turn, role, text) once with their number ``n``.

    ``turns``: conv_id, turn, role, text, copies.  ``symbol`` is that of the first of the n; further copies must
    go.  Duplicates are found by an aggregate combined before its shuffle: only contents that a conversation
    holds in several turns are joined back, spread by a salt where they are many.
    """
    trimmed = F.regexp_replace("text", f"{SPACES}+", "")
    narrow = turns.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (trimmed == "").alias("blank"),
        (~trimmed.rlike(r"[.!?]\z")).alias("truncated"), "copies",
    )
    keys = ["conv_id", "turn", "role", "digest", "blank", "truncated"]
    narrow = materialized(narrow.groupBy(*keys).agg(F.sum("copies").alias("n")), "turns")
    contents = narrow.where(~F.col("blank")).groupBy("conv_id", "role", "digest")
    repeated = contents.agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    repeated = materialized(
        repeated.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"), "repeated"
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    size = repeated.agg(F.sum(F.octet_length("_role") + F.lit(96)).alias("bytes")).first().bytes or 0
    if size <= BROADCAST_BYTES:
        joined = narrow.join(F.broadcast(repeated), same, "left")
    else:
        salts = 16
        salted = repeated.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        own = narrow.withColumn("_salt", F.pmod(F.xxhash64("turn", "digest"), F.lit(salts)).cast("int"))
        joined = own.join(salted.hint("merge"), same & (F.col("_salt") == F.col("_to")), "left").drop("_salt", "_to")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    kind = F.array_position(F.array(*[F.lit(x) for x in INITIALS]), F.substring("role", 1, 1))
    kind = F.when(kind > 0, kind - 1).otherwise(F.lit(OTHER))
    role = kind * 2 + F.col("truncated").cast("int")
    fault = F.col("blank") | later
    none, n = F.lit(0).cast("long"), F.col("n")
    return joined.select(
        "conv_id", "turn", "role", "digest", n, F.substring("role", 1, 1).alias("initial"),
        F.when(fault, F.lit(GONE)).otherwise(role).cast("int").alias("symbol"),
        F.when(F.col("blank"), n).otherwise(none).alias("blank"),
        F.when(F.col("blank"), none).when(later, n).otherwise(n - 1).alias("duplicate"),
        F.when(~fault & F.col("truncated"), F.lit(1).cast("long")).otherwise(none).alias("truncated"),
    )


ORDER = ("conv_id", "turn", "role", "digest")


def _segments(batches, names):
    """Rows of one conversation and range after another, from batches sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


def _symbols(pairs):
    for symbol, n in pairs:
        yield symbol
        for _ in range(n - 1):
            yield GONE


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(rows, schema: pa.Schema, size=lambda row: 64, at_most: int = 1 << 21):
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += size(row)
        if held >= at_most:
            yield _record(waiting, schema)
            waiting, held = [], 0
    if waiting:
        yield _record(waiting, schema)


_longs = pa.list_(pa.int64())
_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("matrix", _longs)]
    + [(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal")]
    + [("initials", pa.list_(pa.string())), ("first", pa.int64()), ("last", pa.int64()), ("distinct", pa.int64())]
)
SUMMARY = (
    "conv_id long, part int, matrix array<long>, blank long, duplicate long, truncated long, illegal long, "
    "initials array<string>, first long, last long, distinct long"
)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _summaries(batches):
    names = ["conv_id", "part", "turn", "initial", "symbol", "n", "blank", "duplicate", "truncated"]

    def rows():
        for (conv, part), own in _segments(batches, names):
            illegal = sum((row[3], row[3]) not in LEGAL and row[5] - 1 for row in own)
            illegal += sum((a[3], b[3]) not in LEGAL for a, b in zip(own, own[1:], strict=False))
            turns = [row[2] for row in own if row[2] is not None]
            matrix = transition(_symbols((row[4], row[5]) for row in own))
            yield (
                conv, part, matrix.ravel().tolist(), *(sum(row[i] for row in own) for i in (6, 7, 8)), illegal, [own[0][3], own[-1][3]],
                min(turns, default=None), max(turns, default=None), len(set(turns)),
            )

    return _batches(rows(), _SUMMARY, lambda row: 512)


_REPORT = pa.schema(
    [("conv_id", pa.int64())]
    + [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("parts", pa.list_(pa.int32())), ("ends", pa.list_(_longs))]
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, parts array<int>, ends array<array<long>>"


def _reports(batches):
    """Counts and cost of conversations, and the cost to go at the end of each segment."""

    def rows():
        names = ["conv_id", "conv_id", *_SUMMARY.names[1:]]
        for (conv, _), own in _segments(batches, names):
            own = [row[1:] for row in own]
            end, ends = ENDING, []
            for row in reversed(own):
                ends.append(end.tolist())
                end = _times(np.array(row[2], dtype=np.int64).reshape(4, 4), end)
            between = sum((a[7][1], b[7][0]) not in LEGAL for a, b in zip(own, own[1:], strict=False))
            firsts, lasts = [row[8] for row in own if row[8] is not None], [row[9] for row in own if row[9] is not None]
            # A turn that spans a border is counted on both sides.
            shared = sum(a == b for a, b in zip(lasts, firsts[1:], strict=False))
            gaps = lasts[-1] - firsts[0] + 1 - sum(row[10] for row in own) + shared if firsts else 0
            counts = [sum(row[i] for row in own) for i in (3, 4, 5, 6)]
            yield conv, gaps, *counts[:3], counts[3] + between, int(end[0]), [row[1] for row in own], ends[::-1]

    return _batches(rows(), _REPORT, lambda row: 128 + 48 * len(row[7]))


_AUDIT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()), ("audit", pa.string())])


def _audits(batches):
    """Audits of segments, one for each state it may be entered in, from its turns after one row with the
    cost to go at its end."""

    def rows():
        names = ["part", "conv_id", "symbol", "n", "end", "place", "segments"]
        for (part, conv), own in _segments(batches, names):
            _, _, _, _, end, place, segments = own[0]
            symbols = list(_symbols((row[2], row[3]) for row in own[1:]))
            for entry in range(4) if place else (0,):
                found = unroll(symbols, np.array(end, dtype=np.int64), entry, place == segments - 1)
                if found:
                    yield conv, part, entry, found[1], found[0]

    return _batches(rows(), _AUDIT, lambda row: 64 + len(row[4]))


_TURN = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _repaired(batches):
    """Turns after the edits of their segment's audit, which comes first."""

    def rows():
        audit, at, state, conv, segment = iter(""), 0, 0, None, None

        def insertions():
            """What is left of an audit when its turns are over."""
            nonlocal at, state
            for edit in audit:
                yield conv, segment, at, INSERTED[state], "", edit
                at, state = at + 1, STEP[state]

        for batch in batches:
            for own in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if own[2] == 0:
                    yield from insertions()
                    conv, segment, audit, state, at = own[0], own[1], iter(own[5]), own[6], 0
                    continue
                for _ in range(own[6]):
                    for edit in audit:
                        if edit == "D":
                            break
                        if edit == "I":
                            yield conv, segment, at, INSERTED[state], "", edit
                            at, state = at + 1, STEP[state]
                            continue
                        yield conv, segment, at, own[3] if edit == "K" else INSERTED[state], own[4], edit
                        at, state = at + 1, 1 if edit == "K" and own[3][:1] == "s" else STEP[state]
                        break
        yield from insertions()

    return _batches(rows(), _TURN, lambda row: 64 + len(row[3]) + len(row[4]))


def _chosen(audits: DataFrame) -> DataFrame:
    """The audit of each segment that the states at the borders choose.  Few segments are not alone in their
    conversation: two per range at most, of which only the states are gathered."""
    exits = audits.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("entry", "exit"))).alias("exits"))
    chain = exits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "exits"))).alias("chain")).where(F.size("chain") > 1)

    def walk(batches):
        names = pa.schema([("_conv", pa.int64()), ("_part", pa.int32()), ("_entry", pa.int32())])

        def rows():
            for batch in batches:
                for conv, links in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                    state = 0
                    for link in links:
                        yield conv, link["part"], state
                        state = next((x["exit"] for x in link["exits"] if x["entry"] == state), 0)

        return _batches(rows(), names)

    entries = broadcast_measured(materialized(chain.mapInArrow(walk, "_conv long, _part int, _entry int"), "entries"), F.lit(32))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    return audits.join(entries, same, "left").where(F.col("entry") == F.coalesce("_entry", F.lit(0))).drop("_conv", "_part", "_entry", "exit")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of conversations ``turns`` (conv_id, turn, role, text, copies).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  repaired turns: conv_id, segment, at,
    role, text, edit (K, R or I), in order of segment and at.

    Turns are taken by turn, nulls first, ties by role and by the SHA-256 of the text; ``copies`` is how often a
    row stands there.  A row's first fault counts: blank, duplicate of an earlier row's role and text,
    truncated.  Null roles and texts count as one space, a null conv_id is a conversation of its own, null
    copies are one.  Other columns are left out.  An empty table gives two empty ones.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    tasks = shuffle_partitions(spark)
    blank = F.lit(" ")
    turns = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"), F.coalesce(F.col("copies").cast("long"), F.lit(1).cast("long")).alias("copies"),
    )
    ranged = turns_with_faults(turns).repartitionByRange(tasks, *ORDER)
    ranged = materialized(ranged.withColumn("part", F.spark_partition_id()), "segments")

    def by_range(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition(tasks, "part").sortWithinPartitions("part", "conv_id", *more, "turn", "role", "digest")

    summaries = by_range(ranged).mapInArrow(_summaries, SUMMARY)
    summaries = summaries.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "part")
    report = materialized(summaries.mapInArrow(_reports, REPORT), "reports")
    ends = report.select("conv_id", F.size("parts").alias("segments"), F.posexplode("parts").alias("place", "part"), "ends")
    ends = ends.select("conv_id", "part", "place", "segments", F.element_at("ends", F.col("place") + 1).alias("end"), F.lit(0).alias("kind"))
    listed = ranged.withColumn("kind", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    audits = by_range(listed, "kind").mapInArrow(_audits, "conv_id long, part int, entry int, exit int, audit string")
    audits = materialized(_chosen(materialized(audits, "audits")), "chosen")
    whole = F.array_sort(F.collect_list(F.struct("part", "audit")))
    texts = audits.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda x: x.audit), "").alias("audit"))
    counts = report.drop("parts", "ends")
    both = counts.unionByName(texts, allowMissingColumns=True).groupBy("conv_id").agg(
        *[F.max(name).alias(name) for name in counts.columns[1:]], F.max("audit").alias("audit")
    )

    # Rows of a conversation with several segments find theirs by the first turns of each.
    key = F.struct("turn", "role", "digest")
    several = report.where(F.size("parts") > 1).select(F.col("conv_id").alias("_conv"))
    bounds = ranged.join(broadcast_measured(several, F.lit(16)), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    bounds = bounds.groupBy("conv_id", "part").agg(F.min(key).alias("key")).groupBy(F.col("conv_id").alias("_conv"))
    bounds = materialized(bounds.agg(F.array_sort(F.collect_list(F.struct("part", "key"))).alias("bounds")), "bounds")
    bounds = broadcast_measured(bounds, F.size("bounds") * 128 + F.lit(32))
    keyed = turns.withColumn("digest", F.unhex(F.sha2("text", 256)))
    placed = keyed.join(bounds, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    mine = F.element_at(F.filter("bounds", lambda x: x.key <= F.struct("turn", "role", "digest")), -1)
    rows = placed.select(
        "conv_id", F.coalesce(mine.part, F.lit(-1)).alias("segment"), F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("audit"),
        F.col("copies").cast("int").alias("number"), "turn", "digest",
    )
    alone = report.select(F.col("conv_id").alias("_conv"), F.size("parts").alias("_segments")).where("_segments > 1")
    alone = broadcast_measured(alone, F.lit(24))
    messages = audits.join(alone, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", F.when(F.col("_segments") > 1, F.col("part")).otherwise(F.lit(-1)).alias("segment"), F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", F.col("entry").alias("number"),
        F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"),
    )
    met = rows.unionByName(messages).repartition(tasks, "conv_id", "segment")
    met = met.sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "digest").drop("turn", "digest")
    repaired = met.mapInArrow(_repaired, "conv_id long, segment int, at long, role string, text string, edit string")
    return both, repaired


def transcript_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of a conversation's ``role:text``, joined by line breaks, streamed."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digests(batches):
        def rows():
            conv, state = None, None
            for batch in batches:
                for own, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                    if state is None or own != conv:
                        if state is not None:
                            yield conv, state.hexdigest()
                        conv, state = own, hashlib.sha256(f"{role}:{text}".encode())
                    else:
                        state.update(f"\n{role}:{text}".encode())
            if state is not None:
                yield conv, state.hexdigest()

        return _batches(rows(), schema)

    tasks = shuffle_partitions(repaired.sparkSession)
    ordered = repaired.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "segment", "at")
    return ordered.mapInArrow(digests, "conv_id long, repaired_sha256 string")
