"""Packing documents into token windows by best fit, decreasing.

Every task packs the documents of its own input split, so no token is shuffled.  Overlong
documents are first cut into full windows; the remainders are placed, longest first, into the
open window of least sufficient room, found by a segment tree over remaining capacities.  A
task works in pools of about ``pool_tokens``, which bounds its memory for any split.

Windows that a pool leaves with more than ``slack`` of padding are cut into pieces of
power-of-two lengths, which need no padding at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.llm import tokens
from twinscout.llm.common import bound_batches, in_slices

WINDOW = 4096
POOL_TOKENS = 2_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Open windows by remaining room.  A leaf of the segment tree stands for one room and holds
    its number of windows, an inner node their sum; ``tightest`` descends to the smallest room
    that suffices."""

    def __init__(self, window: int):
        self.leaves = 1 << (window).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows.setdefault(room, []).append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window of least room >= ``need``: (room, window)."""
        node = need + self.leaves
        if not self.tree[node]:
            # Up to the first right sibling that holds windows, then down its left edge.
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of item numbers; ``lengths`` are at most ``window``.  Longest first, ties in
    the given order."""
    rooms, filled = OpenWindows(window), []
    for item in sorted(range(len(lengths)), key=lambda at: (-lengths[at], at)):
        found = rooms.tightest(lengths[item])
        if found is None:
            found = (window, len(filled))
            filled.append([])
        room, at = found
        filled[at].append(item)
        if room > lengths[item]:
            rooms.put(room - lengths[item], at)
    return filled


def _powers(total: int):
    """``total`` as a falling sum of powers of two."""
    while total:
        part = 1 << (total.bit_length() - 1)
        yield part
        total -= part


def pack_pool(lengths: list[int], window: int, slack: int):
    """Pieces (item, start, length, sequence, offset) of one pool of documents."""
    pieces, rest, sequence = [], [], 0
    for item, length in enumerate(lengths):
        full = length // window
        for at in range(full):
            pieces.append((item, at * window, window, sequence, 0))
            sequence += 1
        if length % window:
            rest.append((item, full * window, length % window))
    for group in best_fit([length for _, _, length in rest], window):
        parts = [rest[at] for at in group]
        used = sum(length for _, _, length in parts)
        goals = [used] if window - used <= slack else list(_powers(used))
        goal, offset = goals.pop(0), 0
        for item, start, length in parts:
            while length:
                if offset == goal:
                    goal, offset, sequence = goals.pop(0), 0, sequence + 1
                cut = min(length, goal - offset)
                pieces.append((item, start, cut, sequence, offset))
                start, length, offset = start + cut, length - cut, offset + cut
        sequence += 1
    return pieces, sequence


def _packer(shipped, end_id: int, window: int, slack: int, pool_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(ids, docs, base):
        pieces, used = pack_pool([len(x) // 4 for x in docs], window, slack)
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[p[0]] for p in part], type=pa.int64()),
                    pa.array([p[1] for p in part], type=pa.int64()),
                    pa.array([p[2] for p in part], type=pa.int64()),
                    pa.array([len(docs[p[0]]) // 4 for p in part], type=pa.int64()),
                    pa.array([base + p[3] for p in part], type=pa.int64()),
                    pa.array([p[4] for p in part], type=pa.int64()),
                    pa.array([docs[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in part], type=pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
        return used

    def pack(batches):
        encode_all = tokens.encoder(shipped.value).encode_all
        base = TaskContext.get().partitionId() << 40
        ids, docs, size = [], [], 0
        for whole in batches:
            for batch in in_slices(whole, tokens.ROWS):
                for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode_all(batch.column("text").to_pylist()), strict=True):
                    ids.append(doc_id)
                    docs.append(own + end)
                    size += len(docs[-1]) // 4
                    if size >= pool_tokens:
                        base += yield from flush(ids, docs, base)
                        ids, docs, size = [], [], 0
        if docs:
            yield from flush(ids, docs, base)

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    window: int = WINDOW,
    slack: int = WINDOW // 64,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, doc_tokens (all ids
    of the document, ``end_id`` at its end included), sequence_id, offset in the sequence, and
    the piece's ids as little-endian unsigned 32-bit integers.

    Null texts are empty: their one id is ``end_id``.  Rows with null or repeated ids are
    packed each.  ``sequence_id`` is unique (the task's number above 2**40) but not gapless; a
    lost task is packed again alike, as it reads the same split in the same order.
    """
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(tokens.definition(tokenizer_path))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return chosen.mapInArrow(_packer(shipped, end_id, window, slack, pool_tokens), SCHEMA)
