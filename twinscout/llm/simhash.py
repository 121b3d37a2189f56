"""Near duplicates by SimHash and the general pigeonhole principle.

Equal fingerprints are one class.  The bits of the fingerprint are grouped into ``parts`` by
correlation (co-occurrence counts over all classes).  If the thresholds of the parts add up to
radius - parts + 1, two fingerprints within the radius agree within the threshold in at least
one part.  A dynamic program allots unequal thresholds (-1 leaves a part out) so that probes
plus estimated candidates are fewest; the estimate convolves distance distributions of
sub-blocks of at most 8 bits, from histograms over all classes.

Every class is indexed by its value in each part and probes the values around it; the distance
is verified inside the join, so only links leave it.  A pair is reported in the first part that
finds it.  Before that join every class is offered one class per value and part as leader, and
the components of those verified links are labels.  Classes of one label are linked already, so
only links between labels leave the join: the components stay the same, and a large group of
near copies does not emit all its pairs.

Where a ``similarity`` is given, fingerprints (then of the set of shingles) only propose pairs.
Rows of equal shingle sets are one class, and every link, of leaders and between labels, is kept
only if the Jaccard similarity of the two sets, read from the texts again, reaches it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.llm.common import NULL_ID, bound_batches, content_key, free_name, id_or_least, in_slices
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

BITS = 64
#: What a candidate costs next to a probe.
CANDIDATE_COST = 0.1
HASH_SEED = 42
#: Keeps a similarity that is met exactly from being lost to rounding.
SLACK = 1e-6
BLOCK = 255 * 32


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, highest first.  Bits become bytes, eight of
    which are added as one integer, 255 rows at a time."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        rows = -len(bits) % 255 if len(bits) > 255 else 0
        lanes = np.ascontiguousarray(bits).view(np.uint64)
        if rows:
            lanes = np.concatenate([lanes, np.zeros((rows, 8), dtype=np.uint64)])
        sums = lanes.reshape(-1, min(255, len(lanes)), 8).sum(axis=1, dtype=np.uint64)
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return counts


def _mix(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from a hash: one round of multiply and shift, keyed by ``word``."""
    mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the A-Z-lower-cased text, in order; a text of fewer words is one
    shingle, a text without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    count = max(1, len(tokens) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:count].tolist()
    stops = ends[-count:].tolist() if len(tokens) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=count)


def fingerprint(text: bytes, shingle: int, words: int = 1, sets: bool = False) -> list[int]:
    """``words`` 64-bit fingerprints of the text's shingles; all zero without words.  The first takes
    the shingles' hashes, each further one a mix of them.  With ``sets`` a shingle counts once, and
    the number of shingles and a hash of their set follow."""
    hashes = shingle_hashes(text, shingle)
    if sets:
        hashes = np.unique(hashes)
    found = []
    for word in range(words):
        counts = _bit_counts(_mix(hashes, word) if word else hashes)
        found.append(int(np.packbits((2 * counts > len(hashes)).astype(np.uint8)).view(">i8")[0]))
    if sets:
        found += [len(hashes), int(_mix(hashes, words).sum(dtype=np.uint64).astype(np.int64))]
    return found


def fingerprints(
    docs: DataFrame, shingle: int = 3, words: int = 1, keys: dict[str, Column] | None = None, sets: bool = False
) -> DataFrame:
    """``keys`` (name -> long column; doc_id if not given) and ``f0``, ``f1``, ... of every row, from
    its whole text; with ``sets`` also ``size`` and ``set_hash``."""
    bound_batches(docs.sparkSession)
    keys = keys or {"doc_id": F.col("doc_id")}
    chosen = docs.select(
        *[column.cast("long").alias(name) for name, column in keys.items()],
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    names, ids = _class_columns(words, sets), list(keys)

    def compute(batches):
        for whole in batches:
            for batch in in_slices(whole):
                found = [fingerprint(text, shingle, words, sets) for text in batch.column("text").to_pylist()]
                arrays = [batch.column(name) for name in ids]
                arrays += [pa.array([row[at] for row in found], type=pa.int64()) for at in range(len(names))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*ids, *names])

    return chosen.mapInArrow(compute, ", ".join(f"`{name}` long" for name in [*ids, *names]))


def _class_columns(words: int, sets: bool) -> list[str]:
    """What rows of one class have in common."""
    return [*[f"f{at}" for at in range(words)], *(["size", "set_hash"] if sets else [])]


# --- partitions and thresholds ---------------------------------------------------------


def _bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _co_occurrence(batches):
    total, rows = np.zeros((BITS, BITS), dtype=np.float64), 0
    for batch in batches:
        values = batch.column("f0").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(values), 65_536):
            bits = _bits_of(values[at : at + 65_536]).astype(np.float32)
            total += bits.T @ bits
            rows += len(bits)
    cells = np.append(total.reshape(-1), rows).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])


def correlations(classes: DataFrame) -> tuple[np.ndarray, int]:
    """Correlation matrix of the 64 bits and the number of classes: 4,097 sums per task, added by
    Spark, 4,097 rows to the driver."""
    cells = classes.select("f0").mapInArrow(_co_occurrence, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = np.zeros(BITS * BITS + 1)
    for row in cells.collect():
        found[row.cell] = row.n
    rows = max(found[-1], 1.0)
    both = found[:-1].reshape(BITS, BITS) / rows
    share = np.diag(both)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return (both - np.outer(share, share)) / np.outer(spread, spread), int(found[-1])


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) in ``parts`` groups of nearly equal size: a group starts with the bit
    most correlated to the others left and takes the bit most correlated to it, until full."""
    strength = np.abs(correlation) - np.eye(BITS)
    left, groups = set(range(BITS)), []
    for part in range(parts):
        size = (BITS + part) // parts
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _extract(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, packed; the first bit named is the highest."""
    packed = np.zeros(len(values), dtype=np.uint64)
    for bit in bits:
        packed = packed << np.uint64(1) | (values >> np.uint64(BITS - 1 - bit)) & np.uint64(1)
    return packed


def _blocks(groups):
    return [(part, bits[at : at + 8]) for part, bits in enumerate(groups) for at in range(0, len(bits), 8)]


def distance_shares(classes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For every part the share of class pairs at each distance in it, sub-blocks taken as
    independent.  256 sums per sub-block and task."""
    blocks = _blocks(groups)

    def histogram(batches):
        counts = np.zeros((len(blocks), 256), dtype=np.int64)
        for batch in batches:
            values = batch.column("f0").to_numpy(zero_copy_only=False).view(np.uint64)
            for at, (_, bits) in enumerate(blocks):
                counts[at] += np.bincount(_extract(values, bits).astype(np.int64), minlength=256)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(counts.size)), pa.array(counts.reshape(-1))], names=["cell", "n"]
        )

    cells = classes.select("f0").mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(blocks) * 256)
    for row in cells.collect():
        counts[row.cell] = row.n
    values = np.arange(256, dtype=np.uint8)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    shares = [np.ones(1) for _ in groups]
    for (part, _), row in zip(blocks, counts.reshape(-1, 256), strict=True):
        p = row / max(row.sum(), 1)
        own = np.array([(np.outer(p, p) * (apart == d)).sum() for d in range(9)])
        shares[part] = np.convolve(shares[part], own)
    return shares


def _ball(width: int, radius: int) -> int:
    total, term = 0, 1
    for at in range(radius + 1):
        total += term
        term = term * (width - at) // (at + 1)
    return total


def allot(shares: list[np.ndarray], groups: list[list[int]], rows: int, radius: int) -> list[int]:
    """Thresholds, one per part and at least -1, that add up to radius - parts + 1 at least cost:
    half the ball is probed for every class, half the pairs within it are candidates."""
    goal = radius + 1  # of threshold + 1, summed
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for share, bits in zip(shares, groups, strict=True):
        costs = [0.0]
        for t in range(min(radius, len(bits)) + 1):
            costs.append(rows * (1 + (_ball(len(bits), t) - 1) / 2) + CANDIDATE_COST * rows * rows / 2 * share[: t + 1].sum())
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for more in range(min(goal - used, len(costs) - 1) + 1):
                offer = (cost + costs[more], [*chosen, more - 1])
                if used + more not in step or offer < step[used + more]:
                    step[used + more] = offer
        best = step
    return best[goal][1]


# --- links ------------------------------------------------------------------------------


def _masks(width: int, radius: int) -> np.ndarray:
    """All differences of 1..radius bits within a part."""
    found = [sum(1 << b for b in pick) for r in range(1, radius + 1) for pick in combinations(range(width), r)]
    return np.array(found, dtype=np.uint64)


def _keyed(classes: DataFrame, groups, thresholds, probes: bool) -> DataFrame:
    """(key, columns of ``classes``): each class under its own value in every part, or, for ``probes``,
    under the larger values around it."""
    names = classes.columns
    masks = [_masks(len(bits), t) for bits, t in zip(groups, thresholds, strict=True)]

    def keyed(batches):
        for whole in batches:
            for batch in in_slices(whole, 4096):
                values = batch.column("f0").to_numpy(zero_copy_only=False).view(np.uint64)
                for part, bits in enumerate(groups):
                    if thresholds[part] < 0:
                        continue
                    own = _extract(values, bits)
                    base = np.uint64(part << 48)
                    if not probes:
                        yield _with_key(own | base, np.arange(len(own)), batch, names)
                        continue
                    for at in range(0, len(masks[part]), 64):
                        around = own[:, None] ^ masks[part][None, at : at + 64]
                        row, column = np.nonzero(around > own[:, None])
                        yield _with_key(around[row, column] | base, row, batch, names)

    fields = ", ".join(f"`{name}` long" for name in names)
    return classes.mapInArrow(keyed, f"key long, {fields}")


def _with_key(key, rows, batch, names):
    taken = pa.array(rows.astype(np.int64))
    arrays = [pa.array(key.view(np.int64)), *(batch.column(name).take(taken) for name in names)]
    return pa.RecordBatch.from_arrays(arrays, names=["key", *names])


def _long_mask(bits: list[int]) -> int:
    mask = sum(1 << (BITS - 1 - b) for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _apart(words: range, left: str, right: str) -> Column:
    total = F.lit(0)
    for at in words:
        total = total + F.bit_count(F.col(f"{left}.f{at}").bitwiseXOR(F.col(f"{right}.f{at}")))
    return total


def links(
    classes: DataFrame, radius: int, parts: int, words: int = 1, total: int | None = None,
    similarity: float | None = None, confirm: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label) of all classes, and links (a, b) between different labels.

    ``classes`` has distinct rows node, f0, f1, ..., and ``size`` where ``similarity`` is given; it is
    read several times.  Without ``total`` classes are linked within ``radius`` bits of ``f0``.  With
    it, all that the search for ``radius`` meets are linked within ``total`` bits over all
    ``words``; sizes that rule out ``similarity`` go, and ``confirm`` leaves the true ones of pairs
    (a, b).  A label is the least node linked over leaders."""
    correlation, rows = correlations(classes)
    groups = group_bits(correlation, parts)
    thresholds = allot(distance_shares(classes, groups), groups, rows, radius)
    names = classes.columns

    def verified(left: str, right: str) -> Column:
        near = _apart(range(1), left, right) <= radius if total is None else _apart(range(words), left, right) <= total
        if similarity is None:
            return near
        sizes = F.col(f"{left}.size"), F.col(f"{right}.size")
        return near & (F.least(*sizes) >= F.greatest(*sizes) * similarity - SLACK)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialized(pairs.distinct(), name)
        return pairs if confirm is None else materialized(confirm(pairs), name)

    own = _keyed(classes, groups, thresholds, probes=False)
    # Leaders: one class per value and part.
    leaders = own.groupBy("key").agg(
        F.min_by(F.struct(*names), F.xxhash64(*names)).alias("leader"), F.count("*").alias("n")
    ).where("n > 1").select("key", *[F.col(f"leader.{name}").alias(name) for name in names])
    led = own.alias("l").join(
        materialized(leaders, "leaders").alias("r"),
        (F.col("l.key") == F.col("r.key")) & (F.col("l.node") != F.col("r.node")) & verified("l", "r"),
    ).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
    labels = components(confirmed(led, "led")).withColumnRenamed("component", "label")
    marked = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = materialized(marked.select(*names, "label"), "marked")
    own = _keyed(marked, groups, thresholds, probes=False)
    sides = own.withColumn("probe", F.lit(0)).unionByName(
        _keyed(marked, groups, thresholds, probes=True).withColumn("probe", F.lit(1))
    )
    difference = F.col("l.f0").bitwiseXOR(F.col("r.f0"))
    earlier = F.lit(False)
    for part in range(1, parts):
        for before in range(part):
            if thresholds[part] >= 0 and thresholds[before] >= 0:
                seen = F.bit_count(difference.bitwiseAND(F.lit(_long_mask(groups[before])))) <= thresholds[before]
                earlier = earlier | ((F.shiftright("l.key", 48) == part) & seen)
    condition = (
        (F.col("l.key") == F.col("r.key"))
        & ((F.col("l.probe") == 1) | (F.col("l.node") < F.col("r.node")))
        & (F.col("l.label") != F.col("r.label"))
        & verified("l", "r")
        & ~earlier
    )
    found = sides.alias("l").join(own.alias("r"), condition)
    found = found.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
    labels = marked.select("node", "label")
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("of_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("of_b"))
    found = confirmed(found, "found").join(of_a, "a").join(of_b, "b")
    return labels, found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()


def similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of ``classes`` (node, text_key) whose shingle sets have a Jaccard
    similarity of at least ``similarity``.  Texts of nodes in no pair are not read into sets."""
    bound_batches(docs.sparkSession)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialized(classes.select("node", "text_key").join(nodes, "node"), "wanted")
    texts = docs.select(content_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = texts.join(broadcast_measured(wanted, F.lit(24)), "text_key").dropDuplicates(["node"]).select("node", "text")

    def compute(batches):
        for whole in batches:
            for batch in in_slices(whole):
                found = [np.unique(shingle_hashes(text, shingle)).view(np.int64) for text in batch.column("text").to_pylist()]
                lists = pa.array(found, type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])

    sets = materialized(texts.mapInArrow(compute, "node long, shingles array<long>"), "sets")
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("in_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("in_b"))
    both = F.size(F.array_intersect("in_a", "in_b"))
    near = both >= (F.size("in_a") + F.size("in_b") - both) * similarity - SLACK
    return pairs.join(of_a, "a").join(of_b, "b").where(near).select("a", "b")


def _roots(pointers: DataFrame) -> DataFrame:
    """Every node's root, from (node, root) with falling pointers: each round doubles what a pointer
    spans."""
    pointers = materialized(pointers, "pointers")
    while True:
        far = pointers.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = pointers.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
        new = materialized(new, "pointers")
        pointers = new.select("node", "root")
        if new.where("moved").isEmpty():
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Every node points at its least neighbour below it, and all nodes of a root become one.  Edges
    inside it go, edges between the same two roots become one, so that later rounds read only what is
    left; at most half of the nodes of a component are roots.  Each round is written to the shared
    folder."""
    found = None
    while True:
        ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialized(ordered.where("a != b").distinct(), "edges")
        if found is not None and edges.isEmpty():
            return found
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        roots = _roots(least.select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        if found is None:
            found = roots.withColumnRenamed("root", "component")
        else:
            step = roots.withColumnRenamed("node", "component")
            found = found.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            found = materialized(found, "labels")
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("of_a"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("of_b"))
        edges = edges.join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    radius: int = 13,
    parts: int = 6,
    words: int = 3,
    total: int | None = 46,
    keys: dict[str, Column] | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """Every row's ``keys``, fingerprint ``f0`` and ``component_id``: the smallest doc_id reachable over
    links, itself included.

    Without ``total`` links join fingerprints that differ in at most ``radius`` bits of ``f0``; with
    it, those met by the search for ``radius`` that differ in at most ``total`` of all 64 *
    ``words`` bits.  With ``similarity`` fingerprints are of shingle sets, and a link holds only if
    the Jaccard similarity of the sets reaches it.  The defaults propose pairs of a similarity of
    0.8: such a pair differs in 15 % of all bits (29 of 192) on average.  Rows without words have
    fingerprint 0 and are one class.  Null ids count only where a component has no other; then
    ``component_id`` is null.
    """
    keys = keys or {"doc_id": F.col("doc_id")}
    sets = similarity is not None
    extra = {"_text_key": content_key(F.col("text"))} if sets else {}
    marks = materialized(fingerprints(docs, shingle, words, {**keys, **extra}, sets), "fingerprints")
    names = _class_columns(words, sets)
    firsts = [F.min("doc_id").alias("first_id"), *([F.min("_text_key").alias("text_key")] if sets else [])]
    classes = marks.groupBy(*names).agg(*firsts)
    # One fingerprint is its own number.
    classes = materialized(classes.withColumn("node", F.col("f0") if len(names) == 1 else F.monotonically_increasing_id()), "classes")
    confirm = (lambda pairs: similar(docs, classes, pairs, shingle, similarity)) if sets else None
    labels, edges = links(classes.select("node", *[n for n in names if n != "set_hash"]), radius, parts, words, total, similarity, confirm)
    found = components(edges).withColumnRenamed("node", "label")
    joined = classes.join(labels, "node").join(found, "label", "left").select(
        *names, "first_id", F.coalesce("component", "label").alias("component")
    )
    joined = materialized(joined, "joined")
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialized(joined.join(smallest, "component").select(*names, "component", "component_id"), "named")
    return marks.join(named, names).select(*keys, "f0", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, **settings) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (nulls last; of several rows
    with it, the least content hash, and of rows equal in both, one).  Rows are linked by a Jaccard
    similarity of their five-word shingles of at least ``similarity``.

    Only ids and hashes are grouped.  The rows to drop are broadcast if they measure small.  Null and empty texts are one
    group; a text of any length is one set of shingles; all other columns stay, whatever their names; an empty table
    gives no rows.
    """
    keys = {"doc_id": id_or_least(), "text_key": content_key(F.col("text"))}
    marks = materialized(near_duplicates(docs, keys=keys, similarity=similarity, **settings), "components")
    order = F.struct((F.col("doc_id") == F.lit(NULL_ID + 1) - 1).alias("missing"), "doc_id", "text_key")
    kept = materialized(marks.groupBy("component").agg(F.min(order).alias("keep"), F.count("*").alias("n")).where("n > 1"), "kept")
    rows = marks.join(kept, "component")
    is_kept = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("text_key") == F.col("keep.text_key"))
    dropped = materialized(rows.where(~is_kept).select("doc_id", "text_key").distinct(), "dropped")
    repeated = rows.where(is_kept).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialized(repeated.select("doc_id", "text_key"), "repeated")

    other_id, other_key = free_name(docs, "_other_id"), free_name(docs, "_other_key")

    def matches(other: DataFrame) -> tuple[DataFrame, Column]:
        renamed = broadcast_measured(other.withColumnsRenamed({"doc_id": other_id, "text_key": other_key}), F.lit(24))
        return renamed, (id_or_least() == F.col(other_id)) & (content_key(F.col("text")) == F.col(other_key))

    docs = docs.join(*matches(dropped), "left_anti")
    if repeated.isEmpty():
        return docs
    # Rows equal in id and text meet, and one of each stays: that of the least hash over all its columns.
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    once = docs.join(*matches(repeated), "left_semi").groupBy(id_or_least().alias("id"), content_key(F.col("text")).alias("key"))
    once = once.agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{name}`") for name in docs.columns])).alias("row")).select("row.*")
    return docs.join(*matches(repeated), "left_anti").unionByName(once)
