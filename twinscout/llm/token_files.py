"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and streams
three flat files of a shard: ids (unsigned 16-bit where the vocabulary fits, else 32-bit), offsets (unsigned 64-bit, ids before each
document within the shard, one more than documents) and doc_ids (signed 64-bit).  The driver
gets one row per shard and turns token counts into the shards' bases by prefix sums.

Files are written under a name of the attempt and moved into place when complete, so a task
that is run again replaces its shard by the same bytes.  Paths are URIs of any file system
that pyarrow knows; shards on a local or mounted path are memory-mapped for reading.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscout.llm import tokens
from twinscout.llm.common import NULL_ID, bound_batches, id_or_least, in_slices, shuffle_partitions

KINDS = ("ids", "offsets", "docs")
READ_DOCS = 4096


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def id_type(definition: str, end_id: int) -> str:
    """The narrowest of the two id types that holds the vocabulary."""
    size = max(tokens.encoder(definition).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    return "<u2" if size <= 1 << 16 else "<u4"


def _writer(shipped, folder: str, end_id: int, dtype: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        encode_all = tokens.encoder(shipped.value).encode_all
        shard = TaskContext.get().partitionId()
        system, path = _open(folder)
        attempt = uuid.uuid4().hex
        names = {kind: f"{path}/shard-{shard:06d}.{kind}" for kind in KINDS}
        streams = {kind: system.open_output_stream(f"{name}.{attempt}") for kind, name in names.items()}
        at = rows = 0
        streams["offsets"].write(np.array([0], dtype="<u8").tobytes())
        for whole in batches:
            for batch in in_slices(whole, tokens.ROWS):
                ids = encode_all(batch.column("text").to_pylist())
                streams["ids"].write(np.frombuffer(end.join(ids) + end, dtype="<u4").astype(dtype, copy=False).tobytes())
                offsets = at + np.cumsum([len(own) // 4 + 1 for own in ids])
                at = int(offsets[-1])
                rows += len(ids)
                streams["offsets"].write(offsets.astype("<u8").tobytes())
                streams["docs"].write(batch.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        for kind, stream in streams.items():
            stream.close()
            system.move(f"{names[kind]}.{attempt}", names[kind])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "rows": [rows], "n_ids": [at]})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the shards into ``folder`` and return (shard, rows, n_ids, base, id_type): base is the number
    of ids in all shards before it.

    Documents lie in ascending doc_id order, null ids first, ties by content hash; null texts are
    empty, so their one id is ``end_id``.  Every row is written, repeated ones too.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    definition = tokens.definition(tokenizer_path)
    dtype = id_type(definition, end_id)
    shipped = spark.sparkContext.broadcast(definition)
    rows = docs.select(id_or_least().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    written = ranged.select("doc_id", "text").mapInArrow(_writer(shipped, folder, end_id, dtype), "shard long, rows long, n_ids long")
    # One row per shard.  Collected, as bases are needed in order and files must be written once.
    shards = sorted(written.collect(), key=lambda row: row.shard)
    base, table = 0, []
    for row in shards:
        table.append((row.shard, row.rows, row.n_ids, base, dtype))
        base += row.n_ids
    return spark.createDataFrame(table, "shard long, rows long, n_ids long, base long, id_type string")


def _map(system, path: str, dtype: str) -> np.ndarray:
    if isinstance(system, fs.LocalFileSystem):
        size = system.get_file_info(path).size
        return np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype=dtype)
    with system.open_input_stream(path) as stream:
        return np.frombuffer(stream.read(), dtype=dtype)


def _reader(folder: str):
    def read(batches):
        system, path = _open(folder)
        for batch in batches:
            for shard, base, dtype in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "id_type")), strict=True):
                name = f"{path}/shard-{shard:06d}"
                ids = _map(system, f"{name}.ids", dtype)
                offsets = _map(system, f"{name}.offsets", "<u8")
                docs = _map(system, f"{name}.docs", "<i8")
                for at in range(0, len(docs), READ_DOCS):
                    part = np.array(docs[at : at + READ_DOCS], dtype=np.int64)
                    bounds = np.array(offsets[at : at + len(part) + 1], dtype=np.int64)
                    checks = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part, mask=part == NULL_ID), pa.array(bounds[:-1] + base),
                            pa.array(np.diff(bounds)), pa.array(checks, type=pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: one task per shard.  The
    checksum is of the ids as unsigned 32-bit integers, whatever their type in the file."""
    tasks = max(1, shards.count())
    spread = shards.select("shard", "base", "id_type").repartitionByRange(tasks, "shard")
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
