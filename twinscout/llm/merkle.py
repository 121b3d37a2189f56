"""Merkle manifest of a dataset by time-forward processing.

Every node has a label: (tree, round, index), children before parents.  In each round the nodes of
the smallest labels, a whole band of ``BAND`` levels, are dealt out by blocks and sorted by label;
a task runs over its block with a priority queue ordered by label, which delivers the digests
of children to their parents.  What reaches beyond the block (its one root) goes back to the
external queue, a table in the shared folder, and is met in a later round.  The reversed sweep runs
over the same tables from the last round to the first: a block gets the proof suffix of its root,
its queue delivers suffixes from parents to children, and so on down to the leaves.

A block holds 256 leaves at most, whatever the source; a source that fills a third of the table
is many blocks.  Texts are read once and never shuffled, rounds are few (log of the rows to the
base 256), and suffixes travel once per block, not once per leaf.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscout.llm.common import UPPER, shuffle_partitions
from twinscout.operators.ranking import ranked
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

FAN_OUT = 16
#: Levels of the tree that a round passes.
BAND = 2
BLOCK = FAN_OUT**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column, fields=FIELDS) -> Column:
    """Digest of a row; ``text`` stands for the column of that name."""
    return F.sha2(F.concat(*[_encoded(text if name == "text" else F.col(name)) for name in fields]), 256)


def _levels(nodes: int) -> int:
    """Levels a round passes over a tree of so many nodes."""
    return 0 if nodes <= 1 else 1 if nodes <= FAN_OUT else BAND


def sweep_up(digests: list[str], levels: int) -> list[list[str]]:
    """Digests by level above a block's lowest nodes.  A priority queue ordered by node label (level,
    index) delivers child digests; the node of the smallest label is made of all its messages."""
    tree = [list(digests)]
    queue = [(1, at // FAN_OUT, at, digest) for at, digest in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        level, index = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heapq.heappop(queue)[3])
        if level == len(tree):
            tree.append([])
        tree[level].append(digest := node_digest(children))
        if level < levels:
            heapq.heappush(queue, (level + 1, index // FAN_OUT, index, digest))
    return tree


def sweep_down(tree: list[list[str]], suffix: list[str]) -> list[list[str]]:
    """Proof suffixes of a block's lowest nodes, given that of its root.  A suffix is a list of digests
    before and after the node, joined, level by level: [before, after, before, after, ...].  The
    reversed queue holds nodes by falling label."""
    found = [None] * len(tree[0])
    queue = [(-(len(tree) - 1), 0, suffix)]
    while queue:
        level, index, own = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            found[index] = own
            continue
        first = index * FAN_OUT
        children = tree[level - 1][first : first + FAN_OUT]
        for at in range(len(children)):
            path = ["".join(children[:at]), "".join(children[at + 1 :]), *own]
            heapq.heappush(queue, (-(level - 1), -(first + at), path))
    return found


def fold(digest: str, suffix: list[str]) -> str:
    """The root that a leaf's digest and its siblings give."""
    for before, after in zip(suffix[::2], suffix[1::2], strict=True):
        digest = hashlib.sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


def _blocks(batches, names: list[str]):
    """Rows block by block (tree, block), from batches sorted by them: (key, list of rows)."""
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


def _up(batches):
    """The root of every block, a node of the next round."""
    names, types, out = ("tree", "rank", "rows", "digest"), (pa.int64(), pa.int64(), pa.int64(), pa.string()), []
    for (tree, block), rows in _blocks(batches, ["tree", "block", "rank", "rows", "digest"]):
        nodes = rows[0][3]
        top = sweep_up([row[4] for row in rows], _levels(nodes))[-1]
        out.append((tree, block, -(-nodes // BLOCK), top[0]))
        if len(out) >= 4096:
            yield _record(out, names, types)
            out = []
    if out:
        yield _record(out, names, types)


def _record(rows: list[tuple], names, types) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _down(batches):
    """Nodes with their suffix, from nodes and one row with the suffix of their block (rank -1)."""
    names, types = ("tree", "rank", "suffix"), (pa.int64(), pa.int64(), pa.list_(pa.string()))
    out, held = [], 0
    for (tree, block), rows in _blocks(batches, ["tree", "block", "rank", "rows", "digest", "suffix"]):
        own, rows = rows[0], rows[1:]
        swept = sweep_up([row[4] for row in rows], _levels(rows[0][3]))
        for row, suffix in zip(rows, sweep_down(swept, own[5]), strict=True):
            out.append((tree, row[2], suffix))
            held += sum(map(len, suffix))
        if held >= 1 << 21:
            yield _record(out, names, types)
            out, held = [], 0
    if out:
        yield _record(out, names, types)


def _leaves(batches):
    """Leaves with the digest of their proof and the root that their altered digest folds to."""
    names = ("tree", "doc_id", "leaf", "proof_sha256", "folded_root")
    types, out = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), []
    for (tree, _), rows in _blocks(batches, ["tree", "block", "rank", "rows", "digest", "suffix", "altered", "doc_id"]):
        own, rows = rows[0], rows[1:]
        swept = sweep_up([row[4] for row in rows], _levels(rows[0][3]))
        for row, suffix in zip(rows, sweep_down(swept, own[5]), strict=True):
            out.append((tree, row[7], row[4], node_digest(suffix), fold(row[6] or row[4], suffix)))
        if len(out) >= 4096:
            yield _record(out, names, types)
            out = []
    if out:
        yield _record(out, names, types)


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks dealt out and sorted by label."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "rank")


def _rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The external queue of each round: nodes (tree, rank, rows, digest), until trees are one node."""
    queue = [nodes]
    while most > 1:
        dealt = _dealt(queue[-1].withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long")))
        up = dealt.mapInArrow(_up, "tree long, rank long, rows long, digest string")
        queue.append(materialized(up, "queue"))
        most = -(-most // BLOCK)
    return queue


def _with_suffix(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes by block, after a row (rank -1) with the suffix of their block's root."""
    own = nodes.withColumns({"block": F.floor(F.col("rank") / BLOCK).cast("long"), "suffix": F.lit(None).cast("array<string>")})
    roots = above.select("tree", F.col("rank").alias("block"), F.lit(-1).cast("long").alias("rank"), "suffix")
    return _dealt(own.unionByName(roots, allowMissingColumns=True))


def _suffixes(queue: list[DataFrame], last: DataFrame) -> DataFrame:
    """Suffixes of the lowest round but one: the reversed sweep over the tables of the rounds."""
    above = last
    for nodes in queue[-2:0:-1]:
        down = _with_suffix(nodes.select("tree", "rank", "rows", "digest"), above)
        above = materialized(down.mapInArrow(_down, "tree long, rank long, suffix array<string>"), "suffixes")
    return above


def manifest(docs: DataFrame, altered_where: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs`` (doc_id,
    source, lang, n_chars, text).

    Leaves of a source ascend by doc_id, nulls first, equal ids by digest; every 16 nodes become
    one until a source is one node, its subroot; subroots, ordered by source (null first, bytewise),
    become the root alike.  ``proof_sha256`` hashes a leaf's siblings up to the root.  A row where
    ``altered_where`` holds is checked with A-Z of its text lower-cased; a null there is no.

    Nulls in any column are ``-``.  Rows that repeat one another are leaves of their own.  A text of any
    length is read once, in the scan.  Other columns are left out.  An empty table gives no rows.
    """
    hit = F.coalesce(altered_where, F.lit(False)) if altered_where is not None else F.lit(False)
    text = F.col("text").cast("string")
    lower = F.translate(text, UPPER, UPPER.lower())
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        leaf_digest(text).alias("digest"), F.when(hit & (lower != text), leaf_digest(lower)).alias("altered"),
    )
    # Written before the ranges are sampled, or all texts would be hashed twice.
    leaves = ranked(materialized(leaves, "hashed"), ["source"], ["doc_id", "digest"])
    per_source = materialized(leaves.groupBy("source").agg(F.max("rows").alias("leaves")), "sources")
    sources = ranked(per_source, [], ["source"], "tree", "trees")
    sources = materialized(sources.select(F.col("source").alias("_source"), "tree", "trees", "leaves"), "trees")
    facts = sources.agg(F.max("leaves").alias("leaves"), F.max("trees").alias("trees")).first()
    named = broadcast_measured(sources.select("_source", "tree"), F.coalesce(F.octet_length("_source"), F.lit(0)) + F.lit(64))
    leaves = leaves.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    leaves = materialized(leaves.select("tree", "rank", "rows", "doc_id", "digest", "altered"), "leaves")
    queue = _rounds(leaves.select("tree", "rank", "rows", "digest"), facts.leaves or 0)

    # The tree over the subroots, whose places are the numbers of their trees.
    subroots = queue[-1].select("tree", "digest")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(facts.trees or 0).cast("long").alias("rows"), "digest")
    upper = _rounds(tops, facts.trees or 0)
    row = upper[-1].select("digest").first()
    root = F.lit(row.digest if row else None).cast("string")
    nothing = F.array().cast("array<string>")
    last = upper[-1].select("tree", "rank", nothing.alias("suffix"))
    above = _suffixes(upper, last)
    if len(upper) > 1:
        lowest = _with_suffix(upper[0].select("tree", "rank", "rows", "digest"), above)
        above = materialized(lowest.mapInArrow(_down, "tree long, rank long, suffix array<string>"), "suffixes")
    # A place in the upper tree is a source's tree, whose one top node has place 0.
    above = above.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "suffix")
    lowest = _with_suffix(leaves, _suffixes(queue, above))
    checked = lowest.mapInArrow(_leaves, "tree long, doc_id long, leaf string, proof_sha256 string, folded_root string")
    tops = broadcast_measured(subroots.withColumnRenamed("digest", "subroot"), F.lit(96))
    return checked.join(tops, "tree").select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
