"""Lines repeated across documents: range-sorted hashes in, keep bitmaps out.

Every line of at least ``min_chars`` gives one small row (128-bit hash of its key, document,
position).  The rows are range-partitioned by (hash, document, position) and sorted inside the
partitions, so a line of any frequency is spread over as many partitions as it needs.  Each
task streams its rows once.  A line whose rows all lie inside the partition is decided there.
The rows of the first and the last line of a partition (and of any run longer than
``RUN_ROWS``) are passed on with the facts of that run; the facts, at most two per partition
and one per ``RUN_ROWS`` rows, are merged and joined back to them.

The result is a compressed bitmap of kept lines for every document that loses some.  Text is
never sorted or grouped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinscout.llm.common import bound_batches, content_key, free_name, id_or_least, in_slices, shuffle_partitions
from twinscout.operators.sizing import broadcast_measured
from twinscout.sources.shared import materialized

RUN_ROWS = 1_000_000


def _line_keys(min_chars: int):
    def keys(batches):
        for whole in batches:
            for batch in in_slices(whole):
                high, low, doc, text_key, position = [], [], [], [], []
                rows = zip(*(batch.column(name).to_pylist() for name in ("doc_id", "text_key", "text")), strict=True)
                for doc_id, own, text in rows:
                    for at, line in enumerate(text.split(b"\n")):
                        key = line.strip().lower()  # bytes: ASCII white space and A-Z only
                        if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
                            continue
                        digest = xxhash.xxh3_128_intdigest(key)
                        high.append(digest >> 64)
                        low.append(digest & 0xFFFFFFFFFFFFFFFF)
                        doc.append(doc_id)
                        text_key.append(own)
                        position.append(at)
                columns = [np.array(high, dtype=np.uint64).view(np.int64), np.array(low, dtype=np.uint64).view(np.int64)]
                columns += [np.array(doc, dtype=np.int64), np.array(text_key, dtype=np.int64), np.array(position, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "doc_id", "text_key", "position"])

    return keys


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_key, position) of every line whose key has ``min_chars`` code
    points or more; keys are stripped of ASCII white space and lower-cased in A-Z."""
    chosen = docs.select(
        id_or_least().alias("doc_id"), content_key(F.col("text")).alias("text_key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return chosen.mapInArrow(_line_keys(min_chars), "h1 long, h2 long, doc_id long, text_key long, position int")


def _emit(kind, rows, facts):
    """Rows of one kind: 0 dropped line, 1 undecided line, 2 facts of a run."""
    n = len(rows["position"])
    extra = {name: np.full(n, value, dtype=np.int64) for name, value in facts.items()}
    arrays = [np.full(n, kind, dtype=np.int32), *(rows[k] for k in ("h1", "h2", "doc_id", "text_key", "position"))]
    arrays += [extra.get(k, np.zeros(n, dtype=np.int64)) for k in ("piece", "first_doc", "last_doc", "n_docs")]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=STREAM_NAMES)


STREAM_NAMES = ["kind", "h1", "h2", "doc_id", "text_key", "position", "piece", "first_doc", "last_doc", "n_docs"]
STREAM_SCHEMA = (
    "kind int, h1 long, h2 long, doc_id long, text_key long, position int, "
    "piece long, first_doc long, last_doc long, n_docs long"
)


def _stream(min_docs: int):
    names = ("h1", "h2", "doc_id", "text_key", "position")

    def facts_of(run, piece):
        docs = run["doc_id"]
        return {"piece": piece, "first_doc": docs[0], "last_doc": docs[-1], "n_docs": 1 + np.count_nonzero(np.diff(docs))}

    def undecided(run, piece):
        yield _emit(1, run, {})
        yield _emit(2, {k: v[:1] for k, v in run.items()}, facts_of(run, piece))

    def decide(runs, starts):
        """Drops of complete runs: one array of rows, ``starts`` of the runs in it."""
        docs = runs["doc_id"]
        new = np.ones(len(docs), dtype=np.int64)
        new[1:] = docs[1:] != docs[:-1]
        new[starts] = 1
        lengths = np.diff([*starts, len(docs)])
        repeated = np.repeat(np.add.reduceat(new, starts) >= min_docs, lengths)
        last = np.repeat(docs[np.cumsum(lengths) - 1], lengths)
        drop = repeated & (docs != last)
        return {k: v[drop] for k, v in runs.items()}

    def stream(batches):
        base = TaskContext.get().partitionId() << 32
        piece, carry, first = 0, None, True
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            if carry is not None:
                rows = {k: np.concatenate([carry[k], v]) for k, v in rows.items()}
            if not len(rows["h1"]):
                continue
            change = (np.diff(rows["h1"]) != 0) | (np.diff(rows["h2"]) != 0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            if first and len(starts) > 1:
                yield from undecided({k: v[: starts[1]] for k, v in rows.items()}, base + piece)
                piece, first = piece + 1, False
                rows = {k: v[starts[1] :] for k, v in rows.items()}
                starts = starts[1:] - starts[1]
            whole = {k: v[: starts[-1]] for k, v in rows.items()}
            if len(starts) > 1:
                yield _emit(0, decide(whole, starts[:-1]), {})
            carry = {k: v[starts[-1] :] for k, v in rows.items()}
            if len(carry["h1"]) > RUN_ROWS:
                yield from undecided(carry, base + piece)
                piece, carry, first = piece + 1, None, True
        if carry is not None and len(carry["h1"]):
            yield from undecided(carry, base + piece)

    return stream


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, position) of the lines to drop: keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents keep their lines only in the largest doc_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    keys = line_keys(docs, min_chars)
    order = ["h1", "h2", "doc_id", "text_key", "position"]
    ranged = keys.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    streamed = materialized(ranged.mapInArrow(_stream(min_docs), STREAM_SCHEMA), "lines")
    # Pieces of a run follow each other; a document cut by a border counts once.
    along = Window.partitionBy("h1", "h2").orderBy("piece")
    facts = (
        streamed.where("kind = 2")
        .withColumn("n_docs", F.col("n_docs") - F.coalesce(F.lag("last_doc").over(along) == F.col("first_doc"), F.lit(False)).cast("long"))
        .groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        .where(F.col("n_docs") >= min_docs)
    )
    open_rows = streamed.where("kind = 1").select("h1", "h2", "doc_id", "text_key", "position")
    facts = broadcast_measured(materialized(facts, "facts"), F.lit(48))
    late = open_rows.join(facts, ["h1", "h2"]).where(F.col("doc_id") != F.col("last_doc"))
    columns = ("doc_id", "text_key", "position")
    return streamed.where("kind = 0").select(*columns).unionByName(late.select(*columns))


def _pack(positions) -> bytes:
    """Dropped positions as a compressed bitmap, bit ``i`` of byte ``i // 8`` set if kept."""
    bits = np.ones((max(positions) // 8 + 1) * 8, dtype=np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def kept_bits(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")


def _bitmaps(batches):
    for whole in batches:
        for batch in in_slices(whole):
            maps = [_pack(p) for p in batch.column("positions").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(maps, type=pa.binary())],
                names=["doc_id", "text_key", "bitmap"],
            )


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row (doc_id, text_key, bitmap) per document that loses lines.

    A document is its id and its text (``text_key``), so rows that repeat an id with another
    text stay apart; as holders of a line they count as one document.  Null ids are one
    document below all others (shown as the smallest long).  Lines beyond a bitmap's end are
    kept.  Grouping collects the positions of one document, at most its number of lines.
    """
    drops = dropped_lines(docs, min_chars, min_docs)
    grouped = drops.groupBy("doc_id", "text_key").agg(F.collect_set("position").alias("positions"))
    return grouped.mapInArrow(_bitmaps, "doc_id long, text_key long, bitmap binary")


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the remaining lines joined by newline as text, and ``n_lines`` (before) and
    ``n_dropped`` added under free names at the end.

    Null and empty texts are one empty line; a null text without loss becomes the empty text.  A text of any
    length is read whole; all other columns stay, whatever their names; an empty table gives no rows.
    Bitmaps are broadcast if they measure small, else joined by a shuffle.
    """
    maps = materialized(keep_bitmaps(docs, min_chars, min_docs), "bitmaps")
    map_id, map_key, map_bits = (free_name(docs, name) for name in ("_map_id", "_map_key", "_map_bits"))
    maps = maps.select(F.col("doc_id").alias(map_id), F.col("text_key").alias(map_key), F.col("bitmap").alias(map_bits))
    maps = broadcast_measured(maps, F.length(map_bits) + F.lit(32))
    joined = docs.join(
        maps, (id_or_least() == F.col(map_id)) & (content_key(F.col("text")) == F.col(map_key)), "left"
    ).drop(map_id, map_key)
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    schema = StructType([*docs.schema.fields, StructField(n_lines, LongType()), StructField(n_dropped, LongType())])
    names, at = docs.columns, docs.columns.index("text")

    def rebuild(batches):
        for whole in batches:
            for batch in in_slices(whole):
                texts, before, lost = [], [], []
                for text, bits in zip(batch.column("text").to_pylist(), batch.column(map_bits).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    before.append(len(lines))
                    if bits is not None:
                        kept = kept_bits(bits)
                        lines = [line for k, line in enumerate(lines) if k >= len(kept) or kept[k]]
                    lost.append(before[-1] - len(lines))
                    texts.append("\n".join(lines))
                columns = batch.columns[: len(names)]
                columns[at] = pa.array(texts, type=batch.schema.field("text").type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(before, type=pa.int64()), pa.array(lost, type=pa.int64())],
                    names=[*names, n_lines, n_dropped],
                )

    return joined.select(*names, map_bits).mapInArrow(rebuild, schema)
