"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

1. Split.  Each task splits its texts into words as the tokenizer's own pre-tokenizer does, in
   chunks of whole documents of about ``CHUNK_WORDS`` words.  A document becomes the sequence of
   its words' numbers in the chunk's list of distinct words, frequent words first.
2. Encode.  The chunks' lists meet by word: dealt out by hash of the word, equal words of all
   chunks are in one task, which encodes each distinct word once.
3. Join back by position.  Ids return to the chunk's list, the list and the number sequences meet
   by chunk, and every number is replaced by its word's ids.
4. Decode.  Ids are joined to the table of pieces (id, piece), which is as large as the
   vocabulary file and no larger, and the pieces are put together by the tokenizer's decoder.

Texts are not shuffled: only number sequences (about 1.5 bytes a word) and words, once per
chunk.  Memory is bounded by a chunk's distinct words and by one document.

The split is made twice, once for the words and once for the sequences.  A chunk is named by a
hash of its place and of its documents, so a run that met other documents cannot pair a sequence
with a foreign list: it fails.  Input with an exchange in its plan, whose partitions may differ
from run to run, is written to the shared folder first.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.llm import tokens
from twinscout.llm.common import bound_batches, in_slices, shuffle_partitions
from twinscout.sources.shared import materialized

CHUNK_WORDS = 4_000_000
#: Parts of the hash of words.  A chunk sends one row per part at most.
PARTS = 512
#: Characters split at a time, and words of the documents that are put together at a time.
PIECE_CHARS = 1 << 20
GROUP_WORDS = 1 << 18
#: Words are bytes in UTF-8; these marks, which UTF-8 never has, stand before added tokens and whole texts.
ADDED, WHOLE = b"\xffa", b"\xfft"
#: The one pattern of words that is split without looking at words one by one.
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
EXCHANGED = "chunk long, part int, names binary, numbers binary"
_EXCHANGED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("names", pa.binary()), ("numbers", pa.binary())])


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _binary(lengths: np.ndarray, data) -> pa.BinaryArray:
    """Byte strings that lie one after another."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _content(strings: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array that starts at its buffers' start."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[: len(strings) + 1] if len(strings) else np.zeros(1, dtype=np.int32)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)


# --- splitting -----------------------------------------------------------------------


def _kinds() -> np.ndarray:
    """0: white space, 1: letter, 2: number, 3: other, of the characters that need no library."""
    kinds = np.full(0x180, 3, dtype=np.uint8)
    for kind, major in ((1, "L"), (2, "N")):
        kinds[[ord(c) for c in tokens._class(major)]] = kind
    kinds[[9, 10, 13, 32]] = 0
    return kinds


_KINDS = _kinds()


def plain_words(texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of texts of usual characters in lower case by ``PLAIN_WORDS``, and their number per text.

    A word is a run of one kind of character, a single number, or an apostrophe that stands alone
    before letters with the first of them where they are an ending of the pattern.
    """
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    kinds = np.zeros(len(points) + 4, dtype=np.uint8)
    kinds[1:-3] = _KINDS[points]
    own, before = kinds[1:-3], kinds[:-4]
    starts = (own != 0) & ((own != before) | (own == 2))
    lone = np.nonzero((points == 39) & (before != 3) & (kinds[2:-2] == 1))[0]
    if len(lone):
        letters = np.concatenate([points, np.zeros(3, dtype="<u4")])
        first, second = letters[lone + 1], letters[lone + 2]
        size = np.isin(first, [ord(c) for c in "stmd"]).astype(np.int64)
        for pair in ("re", "ve", "ll"):
            size[(first == ord(pair[0])) & (second == ord(pair[1]))] = 2
        lone, size = lone[size > 0], size[size > 0]
        starts[lone + 1] = False
        after = lone + 1 + size
        starts[after[kinds[after + 1] == 1]] = True
    raw = np.frombuffer(joined.encode(), dtype=np.uint8)
    solid = raw[(raw != 32) & (raw != 10) & (raw != 9) & (raw != 13)]
    ends = np.cumsum(np.where(own != 0, 1 + (points >= 0x80), 0))
    at = np.nonzero(starts)[0]
    offsets = np.empty(len(at) + 1, dtype=np.int32)
    offsets[:-1] = ends[at] - (1 + (points[at] >= 0x80))
    offsets[-1] = len(solid)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    borders = np.cumsum([len(text) + 1 for text in texts]) - 1
    return words, np.diff(np.searchsorted(at, borders), prepend=0)


class Splitter:
    """Words of texts as the tokenizer's pre-tokenizer cuts them."""

    def __init__(self, encoder: tokens.Encoder):
        self.encoder = encoder
        rules = json.dumps(json.loads(encoder.tokenizer.to_str()).get("pre_tokenizer"))
        self.plain = encoder.lower and encoder.split is not None and json.dumps({"Regex": PLAIN_WORDS}) in rules
        self.back = {ord(letter): byte for byte, letter in encoder.letters.items()}

    def usual(self, text: str) -> bool:
        encoder = self.encoder
        return encoder.split is not None and not tokens._UNUSUAL.search(text) and not (encoder.added and encoder.added.search(text))

    def words(self, texts: list[str]):
        """(words, places of texts in the list, their numbers of words) for one group of texts after another."""
        waiting, size = [], 0

        def plain():
            words, counts = plain_words([part for _, part in waiting])
            return words, [at for at, _ in waiting], counts

        for at, text in enumerate(texts):
            if not (self.plain and self.usual(text)):
                if waiting:
                    yield plain()
                    waiting, size = [], 0
                found = pa.array(self._one(text), type=pa.binary())
                yield found, [at], np.array([len(found)])
                continue
            for part in tokens._parts(text.lower()):
                waiting.append((at, part))
                size += len(part)
                if size >= PIECE_CHARS:
                    yield plain()
                    waiting, size = [], 0
        if waiting:
            yield plain()

    def _one(self, text: str) -> list[bytes]:
        encoder = self.encoder
        if encoder.split is None:
            return [WHOLE + text.encode()] if text else []
        if self.usual(text):
            return [word.encode() for part in tokens._parts(text.lower() if encoder.lower else text) for word in encoder.split.findall(part)]
        return self._by_library(text)

    def _by_library(self, text: str) -> list[bytes]:
        """Added tokens are taken out first; what lies between is normalised and split by the library."""
        encoder, found, at = self.encoder, [], 0
        normal, split = encoder.tokenizer.normalizer, encoder.tokenizer.pre_tokenizer.pre_tokenize_str

        def between(part: str) -> None:
            part = normal.normalize_str(part) if normal else part
            found.extend(word.translate(self.back).encode("latin-1") for word, _ in split(part))

        for met in encoder.added.finditer(text) if encoder.added else ():
            between(text[at : met.start()])
            found.append(ADDED + met.group().encode())
            at = met.end()
        between(text[at:])
        return found


class _Chunk:
    """Documents of a chunk until it is full."""

    def __init__(self, splitter: Splitter, task: int):
        self.splitter, self.task, self.count = splitter, task, 0
        self._start()

    def _start(self) -> None:
        self.name = xxhash.xxh64(np.array([self.task, self.count], dtype="<i8").tobytes())
        self.ids, self.sizes, self.words, self.size = [], [], [], 0

    def add(self, ids: list, texts: list[str]) -> None:
        sizes = np.zeros(len(texts), dtype=np.int64)
        for text in texts:
            self.name.update(text.encode())
        for words, at, counts in self.splitter.words(texts):
            self.words.append(words)
            np.add.at(sizes, at, counts)
        self.ids.extend(ids)
        self.sizes.append(sizes)
        self.size += int(sizes.sum())

    def close(self, lists: bool):
        """Rows of the chunk's list, or of its documents' number sequences."""
        chunk = int(np.uint64(self.name.intdigest()).astype(np.int64))
        words = pa.chunked_array(self.words, type=pa.binary()).combine_chunks().dictionary_encode()
        numbers, words, sizes = words.indices.to_numpy(zero_copy_only=False), words.dictionary, np.concatenate(self.sizes)
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        if lists:
            parts = np.fromiter(map(zlib.crc32, words.to_pylist()), dtype=np.uint32, count=len(words)) % PARTS
            dealt = np.argsort(parts, kind="stable")
            offsets, data = _content(words.take(pa.array(dealt)))
            bounds = np.searchsorted(parts[dealt], np.arange(PARTS + 1))
            for part in np.nonzero(np.diff(bounds))[0].tolist():
                a, b = bounds[part], bounds[part + 1]
                lengths = np.diff(offsets[a : b + 1]).astype("<u4").tobytes()
                names = zstandard.compress(lengths + data[offsets[a] : offsets[b]].tobytes(), 3)
                yield chunk, part, names, _pack(rank[dealt[a:b]])
        else:
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                start = int(ends[first] - sizes[first])
                last = max(first + 1, int(np.searchsorted(ends, start + GROUP_WORDS, side="right")))
                ids = self.ids[first:last]
                header = np.array([0 if x is None else x for x in ids], dtype="<i8").tobytes() + bytes(x is None for x in ids)
                yield chunk, PARTS, header + sizes[first:last].astype("<i8").tobytes(), _pack(rank[numbers[start : ends[last - 1]]])
                first = last
        self.count += 1
        self._start()


def _batches(rows, at_most: int = 4 << 20):
    """Rows of ``_EXCHANGED`` as batches of a bounded size in bytes."""
    waiting, held = [], 0

    def batch():
        columns = zip(*waiting, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _EXCHANGED, strict=True)], schema=_EXCHANGED)

    for row in rows:
        waiting.append(row)
        held += len(row[2]) + len(row[3]) + 64
        if held >= at_most:
            yield batch()
            waiting, held = [], 0
    if waiting:
        yield batch()


def _splitting(shipped, chunk_words: int, lists: bool):
    def rows(batches):
        chunk = None
        for whole in batches:
            for batch in in_slices(whole):
                if chunk is None and batch.num_rows:
                    chunk = _Chunk(Splitter(tokens.encoder(shipped.value)), batch.column("task")[0].as_py())
                if batch.num_rows:
                    chunk.add(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    if chunk.size >= chunk_words:
                        yield from chunk.close(lists)
        if chunk is not None and chunk.ids:
            yield from chunk.close(lists)

    return lambda batches: _batches(rows(batches))


# --- encoding ------------------------------------------------------------------------


def word_ids(encoder: tokens.Encoder, word: bytes) -> list[int]:
    if word[:2] == ADDED:
        return [encoder.tokenizer.token_to_id(word[2:].decode())]
    if word[:2] == WHOLE:
        return encoder.tokenizer.encode(word[2:].decode(), add_special_tokens=False).ids
    return [token.id for token in encoder.tokenize(word.decode("latin-1").translate(encoder.letters))]


def _encoding(shipped):
    """Lists sorted by part: words become ids, each distinct word of a part encoded once."""

    def rows(batches):
        encoder, part, known = tokens.encoder(shipped.value), None, {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[1] != part:
                    part, known = row[1], {}
                count = len(_unpack(row[3]))
                raw, ids, at = zstandard.decompress(row[2]), [], 4 * count
                for length in np.frombuffer(raw[:at], dtype="<u4").tolist():
                    word = raw[at : at + length]
                    at += length
                    own = known.get(word)
                    if own is None:
                        own = known[word] = np.array(word_ids(encoder, word), dtype="<u4").tobytes()
                    ids.append(own)
                lengths = np.fromiter(map(len, ids), dtype=np.uint32, count=count) // 4
                yield row[0], row[1], _pack(np.concatenate([lengths, np.frombuffer(b"".join(ids), dtype="<u4")])), row[3]

    return lambda batches: _batches(rows(batches))


# --- joining back --------------------------------------------------------------------


class _List:
    """A chunk's distinct words by number: their ids, and the pieces of their ids put together."""

    def __init__(self, numbers: list[np.ndarray], ids: list[np.ndarray], pieces: pa.BinaryArray):
        nothing = np.zeros(0, dtype=np.int64)
        number = np.concatenate(numbers or [nothing])
        lengths = np.concatenate([x[: len(n)] for x, n in zip(ids, numbers, strict=True)] or [nothing]).astype(np.int64)
        self.flat = np.concatenate([x[len(n) :] for x, n in zip(ids, numbers, strict=True)] or [nothing]).astype(np.int32)
        starts = np.cumsum(lengths) - lengths
        self.lengths, self.starts = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
        self.lengths[number], self.starts[number] = lengths, starts
        # The id-to-piece join: pieces of all ids in a row, cut into words.
        offsets, data = _content(pieces.take(pa.array(self.flat)))
        texts = _binary(offsets[starts + lengths] - offsets[starts], data)
        place = np.empty(len(number), dtype=np.int64)
        place[number] = np.arange(len(number))
        self.texts = texts.take(pa.array(place))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, ids before each word and in all)."""
        lengths = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.starts[numbers] - ends[:-1], lengths) + np.arange(ends[-1])], ends


def _joining(shipped, vocabulary):
    """Rows sorted by chunk, the list's parts before the documents."""

    def join(batches):
        glue, finish = decoder_of(shipped.value)
        pieces = pa.array([(piece + glue).encode() for piece in vocabulary.value], type=pa.binary())
        chunk, numbers, ids, words = None, [], [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != chunk:
                    chunk, numbers, ids, words = row[0], [], [], None
                if row[1] < PARTS:
                    numbers.append(_unpack(row[3]))
                    ids.append(_unpack(row[2]))
                    continue
                if words is None:
                    words = _List(numbers, ids, pieces)
                yield _documents(words, row[2], _unpack(row[3]), len(glue.encode()), finish)

    return join


def _documents(words: _List, header: bytes, numbers: np.ndarray, glue: int, finish) -> pa.RecordBatch:
    count = len(header) // 17
    doc_ids, sizes = np.frombuffer(header[: 8 * count], dtype="<i8"), np.frombuffer(header[9 * count :], dtype="<i8")
    if len(numbers) and numbers.max() >= len(words.lengths):
        raise RuntimeError("a chunk's documents changed between the two splits")
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat, before = words.ids(numbers)
    offsets, data = _content(words.texts.take(pa.array(numbers)))
    decoded = _binary(np.diff(offsets[ends]), data)
    if glue:
        decoded = pc.binary_slice(decoded, 0, -glue)
    if finish:
        decoded = pa.array([finish(text.decode()) for text in decoded.to_pylist()], type=pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, mask=np.frombuffer(header[8 * count : 9 * count], dtype=bool)), pa.array(np.diff(before[ends])),
            pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), pa.array(flat)), decoded.cast(pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids", "decoded"],
    )


def decoder_of(definition: str):
    """(what stands between pieces, last step if there is one) of the tokenizer's decoder."""
    decoder = json.loads(definition).get("decoder")
    if decoder is None:
        return " ", None
    if decoder["type"] == "ByteLevel":
        back = {ord(letter): byte for byte, letter in tokens._byte_letters().items()}
        return "", lambda text: text.translate(back).encode("latin-1").decode("utf-8", "replace")
    raise ValueError(f"no id-to-piece join for the decoder {decoder['type']}")


def pieces_of(definition: str) -> list[str]:
    """Piece by id, added tokens included; ids without a piece are empty."""
    rules = json.loads(definition)
    table = {number: piece for piece, number in rules["model"]["vocab"].items()}
    table |= {token["id"]: token["content"] for token in rules.get("added_tokens") or []}
    return [table.get(at, "") for at in range(max(table, default=-1) + 1)]


def _fixed_partitions(docs: DataFrame) -> DataFrame:
    """``docs``, written first where its partitions may differ from run to run."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialized(docs, "texts") if "Exchange" in plan or "Shuffle" in plan else docs


def encode_and_decode(docs: DataFrame, tokenizer_path: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) of every row of ``docs`` (doc_id, text).

    Ids are those of the ``tokenizers`` library's ``encode(text, add_special_tokens=False)`` without
    truncation and padding; ``decoded`` is its ``decode(ids, skip_special_tokens=False)``.

    Null texts are empty: no ids, an empty decoded text.  Rows with null, equal or repeated ids
    give a row each.  A text of any length is one document of a chunk.  Other columns are left
    out, whatever their names.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    definition = tokens.definition(tokenizer_path)
    decoder_of(definition)  # an unknown decoder is refused before any job
    shipped = spark.sparkContext.broadcast(definition)
    vocabulary = spark.sparkContext.broadcast(pieces_of(definition))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The scan's own partition; a task's number would count the other side of the union too.
    texts = _fixed_partitions(texts).withColumn("task", F.spark_partition_id())
    tasks = shuffle_partitions(spark)
    lists = texts.mapInArrow(_splitting(shipped, chunk_words, True), EXCHANGED)
    lists = lists.repartition(tasks, "part").sortWithinPartitions("part")
    encoded = lists.mapInArrow(_encoding(shipped), EXCHANGED)
    sequences = texts.mapInArrow(_splitting(shipped, chunk_words, False), EXCHANGED)
    met = encoded.unionAll(sequences).repartition(tasks, "chunk").sortWithinPartitions("chunk", "part")
    return met.mapInArrow(_joining(shipped, vocabulary), "doc_id long, n_tokens long, ids array<int>, decoded string")
