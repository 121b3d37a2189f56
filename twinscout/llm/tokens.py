"""Token ids of a public tokenizer, with words encoded once per worker.

``Encoder`` gives the ids that the ``tokenizers`` library gives for a whole text.  Texts of
common Latin characters without added tokens (``<|endoftext|>``) are split into words as the pre-tokenizer's own regular expression does,
each distinct word is encoded once by the library's own model and remembered in a bounded
table.  Many texts are split and looked up at a time, as arrays.  Any other text goes through the library as a whole, so the result is the same for
every text.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from itertools import pairwise
from operator import attrgetter
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words remembered by a worker, and the most bytes of their texts.
TABLE_ENTRIES, TABLE_BYTES = 200_000, 16 << 20
#: Long texts are split into words in parts of about this many characters.
PART = 1 << 18
#: Parts are split and looked up together, about this many characters at a time.
BLOCK = 1 << 21
#: Rows of an Arrow batch given to ``encode_all`` at a time.
ROWS = 1024
#: Characters whose class and case agree in every Unicode version: anything else takes the
#: library's path.
_USUAL = "\t\n\r -~¡-¬®-įı-ňŊ-ž"
_UNUSUAL = re.compile(f"[^{_USUAL}]")
#: A word border of both supported expressions, whatever stands around it.
_BORDER = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: The expression of lower-case tokenizers whose words ``_starts`` finds.
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(major: str) -> str:
    """The usual characters of a Unicode category, as the inside of a character class."""
    usual = re.compile(f"[{_USUAL}]")
    return "".join(c for c in map(chr, range(0x180)) if usual.match(c) and unicodedata.category(c)[0] == major)


def _pattern(words: str) -> re.Pattern:
    """The library's expression for usual characters, with the two classes (always in brackets) written out."""
    return re.compile(words.replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N")))


def _parts(text: str):
    """``text`` in parts of about ``PART`` characters that words never cross."""
    start = 0
    while len(text) - start > PART:
        border = _BORDER.search(text, start + PART)
        if border is None:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:]


def _byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level models: printable Latin-1 stands for itself, every other byte
    for the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + at) for at, b in enumerate(others)}


_LETTERS = np.array([ord(letter) for _, letter in sorted(_byte_letters().items())], dtype="<u2")
_ID = attrgetter("id")

#: Kinds of characters; ``_END`` closes a text and occurs in no usual one.
_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK, _END = range(6)
_APOSTROPHE = 39


def _kinds() -> np.ndarray:
    kinds = np.full(0x180, _OTHER, dtype=np.uint8)
    for kind, major in ((_LETTER, "L"), (_NUMBER, "N")):
        kinds[[ord(c) for c in _class(major)]] = kind
    kinds[[9, 10, 13]], kinds[32], kinds[0] = _BLANK, _SPACE, _END
    return kinds


_KINDS = _kinds()


def _starts(points: np.ndarray, kinds: np.ndarray, plain: bool) -> np.ndarray:
    """Where words start in usual texts, each closed by one ``_END``, which is a word by itself.

    A word is a run of one kind with the space before it, or white space; of white space before a run, the last
    character stands alone.  An ending of ``PLAIN_WORDS`` is a word where a match of the expression would begin at its
    apostrophe.  ``plain`` is for that expression, which drops white space and takes numbers one by one.
    """
    before, after = np.full_like(kinds, _END), np.full_like(kinds, _END)
    before[1:], after[:-1] = kinds[:-1], kinds[1:]
    starts = (kinds != before) | (kinds == _END)
    if plain:
        starts |= kinds == _NUMBER
    else:
        inside = ((kinds == _SPACE) | (kinds == _BLANK)) & ((before == _SPACE) | (before == _BLANK))
        starts = np.where(inside, after <= _OTHER, starts)
    starts &= (kinds > _OTHER) | (before != _SPACE)
    lone = np.flatnonzero(points == _APOSTROPHE)
    lone = lone[starts[lone] | plain & (before[lone] == _SPACE)]
    if len(lone):
        first, second = points[lone + 1], points[np.minimum(lone + 2, len(points) - 1)]
        size = np.isin(first, [ord(c) for c in "stmd"]).astype(np.int64)
        for pair in ("re", "ve", "ll"):
            size[(first == ord(pair[0])) & (second == ord(pair[1]))] = 2
        lone, size = lone[size > 0], size[size > 0]
        starts[lone + 1] = False
        starts[lone + 1 + size] = True
    return starts


class _Words:
    """Ids of words met so far, made where missing.  Beyond ``TABLE_ENTRIES`` words the half that was met
    in most blocks stays, so frequent ones stay and the size is bounded."""

    def __init__(self, make):
        self.make = make
        self._forget()

    def _forget(self) -> None:
        nothing = np.zeros(0, dtype=np.int64)
        self._set(pa.array([], type=pa.large_string()), nothing.astype("<u4"), nothing, nothing)

    def _set(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray, met: np.ndarray) -> None:
        self.words, self.ids, self.lengths, self.met = words, ids, lengths, met
        self.starts = np.cumsum(lengths) - lengths

    def _picked(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words of these numbers, one word after another."""
        lengths = self.lengths[numbers]
        shift = self.starts[numbers] - (np.cumsum(lengths) - lengths)
        return self.ids[np.arange(lengths.sum()) + np.repeat(shift, lengths)]

    def _bound(self) -> None:
        if len(self.words) <= TABLE_ENTRIES and self.words.nbytes <= TABLE_BYTES:
            return
        # Of words met equally often, the later ones stay.
        stay = np.sort(np.argsort(self.met, kind="stable")[max(0, len(self.met) - TABLE_ENTRIES // 2) :])
        words = self.words.take(pa.array(stay))
        if words.nbytes > TABLE_BYTES:
            self._forget()
        else:
            self._set(words, self._picked(stay), self.lengths[stay], self.met[stay] // 2)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, one after another; how many each has)."""
        self._bound()
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        missing = coded.dictionary.filter(pc.is_null(found))
        numbers = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if len(missing):
            numbers[numbers < 0] = len(self.words) + np.arange(len(missing))
            ids, lengths = self.make(missing)
            self._set(
                pa.concat_arrays([self.words, missing]),
                np.concatenate([self.ids, ids]),
                np.concatenate([self.lengths, lengths]),
                np.concatenate([self.met, np.zeros_like(lengths)]),
            )
        self.met[numbers] += 1
        each = numbers[coded.indices.to_numpy()]
        return self._picked(each), self.lengths[each]


class Encoder:
    """``encode_all(texts)`` -> ids of each as little-endian unsigned 32-bit bytes."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        rules = json.loads(definition)
        self.lower, self.split = _rules(rules)
        #: Are words those of ``_starts``?
        self.known = not self.lower or PLAIN_WORDS in _expressions(rules)
        self.added = _added(rules)
        self.letters = _byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.words = _Words(self._ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, one after another; how many each has), by the library's model."""
        words = pc.utf8_trim(words, characters="\0 \t\n\r" if self.lower else "\0")
        offsets, data = (np.frombuffer(buffer or b"", dtype=kind) for buffer, kind in zip(words.buffers()[1:], ("<i8", "u1"), strict=True))
        letters = _LETTERS[data].tobytes().decode("utf-16-le")
        ids, ends = [], []
        for start, end in pairwise(offsets[: len(words) + 1].tolist()):
            ids += map(_ID, self.tokenize(letters[start:end]))
            ends.append(len(ids))
        return np.array(ids, dtype="<u4"), np.diff(ends, prepend=0)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts, and how many of them lie before the end of each text."""
        if not self.known:
            found = [self.split.findall(text) for text in texts]
            return pa.array([word for words in found for word in words], type=pa.large_string()), np.cumsum([len(words) for words in found])
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kinds = _KINDS[points]
        at = np.flatnonzero(_starts(points, kinds, self.lower))
        raw = joined.encode()
        offsets = np.append(at, len(raw))
        if len(raw) > len(points):
            wide = points >= 0x80
            offsets[:-1] += np.cumsum(wide, dtype=np.int32)[at] - wide[at]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw))
        return words, np.flatnonzero(kinds[at] == _END)

    def _block(self, texts: list[str]) -> list[bytes]:
        words, last = self._cut(texts)
        ids, lengths = self.words.look(words)
        ends = 4 * np.concatenate([[0], np.cumsum(lengths)])[last]
        raw, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        ids: list[list[bytes]] = [[] for _ in texts]
        places, parts, size = [], [], 0

        def flush():
            for place, own in zip(places, self._block(parts), strict=True):
                ids[place].append(own)

        for place, text in enumerate(texts):
            if not text:
                continue
            if self.split is None or _UNUSUAL.search(text) or self.added and self.added.search(text):
                ids[place].append(self._whole(text))
                continue
            for part in _parts(text.lower() if self.lower else text):
                places.append(place)
                parts.append(part)
                size += len(part)
                if size >= BLOCK:
                    flush()
                    places, parts, size = [], [], 0
        if parts:
            flush()
        return [own[0] if len(own) == 1 else b"".join(own) for own in ids]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def _added(definition: dict) -> re.Pattern | None:
    """Finds the added tokens, which the library takes out of a text before all else."""
    contents = [re.escape(token["content"]) for token in definition.get("added_tokens") or []]
    return re.compile("|".join(contents)) if contents else None


def _expressions(definition: dict) -> list[str]:
    """The expressions of the pre-tokenizer's splits."""
    steps = (definition.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return [step["pattern"].get("Regex") for step in steps if step["type"] == "Split"]


def _rules(definition: dict):
    """(lower case?, word pattern) of a known pre-tokenizer; no pattern
    where only the library's own path is safe."""
    if any(token["normalized"] for token in definition.get("added_tokens") or []):
        return False, None  # they are met in the normalised text only
    kinds = [definition.get("normalizer"), definition.get("pre_tokenizer")]
    byte_level, words = json.dumps(kinds[1]), json.dumps(kinds[0])
    if kinds[0] is None and '"ByteLevel"' in byte_level and '"Split"' not in byte_level:
        if kinds[1].get("use_regex") and not kinds[1].get("add_prefix_space"):
            return False, _pattern(r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    if '"Lowercase"' in words and '"Split"' in byte_level and '"use_regex": false' in byte_level:
        split = next(x for x in kinds[1]["pretokenizers"] if x["type"] == "Split")
        if split["invert"] and split["behavior"] == "Removed" and "[^\\s" in split["pattern"]["Regex"]:
            return True, _pattern(split["pattern"]["Regex"])
    return False, None


def encoder(definition: str) -> Encoder:
    """One encoder per worker process and tokenizer; its table outlives a task.

    Tasks get this package by value, its globals anew with each; what is kept hangs on a module of the process.
    """
    kept = sys.modules.setdefault("twinscout_encoder", ModuleType("twinscout_encoder"))
    key = hash(definition)
    if getattr(kept, "key", None) != key:
        kept.encoder, kept.key = Encoder(definition), key
    return kept.encoder


def definition(path: str) -> str:
    """The tokenizer file's text, read on the driver and broadcast (a few MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()
