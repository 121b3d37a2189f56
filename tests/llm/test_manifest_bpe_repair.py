"""Operators 11 to 13: against the library, against SQL, and against plain recursion."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache
from types import SimpleNamespace

import compare
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from twinscout.llm import bpe, conversations, merkle
from twinscout.llm.oracles import ORACLES
from twinscout.llm.queries import REGISTRY

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, rank int, _at string"


def documents(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "c", 1, "a") for i, t, s in rows], DOCS)


def written(spark, tmp_path, frame, name):
    frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- 11 ------------------------------------------------------------------------------

ODD_TEXTS = [
    "Hello I<|endoftext|>x", None, "", " \t\n ", "日本語 Приветé é 👍🏽x don't  DON'T", "x " * 50_000, "a" * 300_000,
    "<|startoftext|><|endoftext|> é日<|endoftext|>", "Straße İstanbul ſ K", "12 345 ½ ²", "tab\tand\x0bvt\x1cfs nbsp　x",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("chunk_words", [1, 1000, bpe.CHUNK_WORDS])
def test_ids_and_decoded_texts_are_the_librarys(spark, name, chunk_words):
    rows = [(i // 2, text, "s") for i, text in enumerate(ODD_TEXTS + ODD_TEXTS[:3])] + [(None, "again again", None)] * 2
    found = bpe.encode_and_decode(documents(spark, rows), public_tokenizers.path(name), chunk_words).collect()
    library = Tokenizer.from_file(public_tokenizers.path(name))
    wanted = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(row)) for row in found)


def test_no_documents_no_ids(spark):
    assert bpe.encode_and_decode(documents(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_each_distinct_word_is_encoded_once_per_part(spark):
    """Equal words of many chunks meet in one task, which asks the model once."""
    calls = []

    class Model:
        def tokenize(self, word):
            calls.append(word)
            return []

    encoder = bpe.tokens.encoder(bpe.tokens.definition(public_tokenizers.path("word_bpe_49k.json")))
    ask, encoder.tokenize = encoder.tokenize, Model().tokenize
    try:
        rows = []
        for task in range(3):
            chunk = bpe._Chunk(bpe.Splitter(encoder), task)
            chunk.add([1, 2], ["one two one two three", "three one"])
            rows += chunk.close(True)
        rows.sort(key=lambda row: row[1])
        named = [dict(zip(bpe._EXCHANGED.names, row, strict=True)) for row in rows]
        batches = [bpe.pa.RecordBatch.from_pylist(named, schema=bpe._EXCHANGED)]
        shipped = SimpleNamespace(value=bpe.tokens.definition(public_tokenizers.path("word_bpe_49k.json")))
        assert sum(batch.num_rows for batch in bpe._encoding(shipped)(batches)) == len(rows)
    finally:
        encoder.tokenize = ask
    assert sorted(calls) == ["one", "three", "two"]


def test_plain_words_are_those_of_the_pattern():
    pick = random.Random(5)
    encoder = bpe.tokens.encoder(bpe.tokens.definition(public_tokenizers.path("word_bpe_49k.json")))
    alphabet = "ab stmdrevl'''é12²½ \t\n.,!-\"x"
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    texts += ["'", "a'", "'s", "''s", "x'll'd've", ""]
    words, counts = bpe.plain_words(texts)
    assert [word.decode() for word in words.to_pylist()] == [word for text in texts for word in encoder.split.findall(text)]
    assert counts.tolist() == [len(encoder.split.findall(text)) for text in texts]


def test_input_after_an_exchange_is_written_first(spark):
    rows = documents(spark, [(i, f"word{i % 7} and more", "s") for i in range(200)]).repartition(5, "doc_id")
    found = bpe.encode_and_decode(rows, public_tokenizers.path("word_bpe_49k.json"), 10)
    assert found.count() == 200
    assert found.where("n_tokens < 3").count() == 0


def test_texts_are_not_shuffled(spark, plan, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = plan(bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))).splitlines()
    below = [lines[i + 1 :] for i, line in enumerate(lines) if "Exchange" in line]
    assert below and all("MapInArrow" in "".join(rest[:4]) or "MapInArrow" in "".join(rest) for rest in below)


def test_op11_query_against_the_library(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = REGISTRY["op11_bpe"](spark, sf_dir).collect()
    assert {row.doc_id for row in found} == set(texts) and len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- 12 ------------------------------------------------------------------------------


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(row, text):
    def own(value):
        value = None if value is None else str(value)
        return "-" if value is None else f"{len(value.encode())}:{value}"

    return h([own(row.doc_id), own(row.source), own(row.lang), own(row.n_chars), own(text)])


def lowered(text):
    return text and re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain_manifest(rows):
    """By the definition, node by node: {doc: (leaf, subroot, root, proof, folded)} as a list."""
    groups = {}
    for row in rows:
        groups.setdefault(row.source, []).append(row)

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(last[i : i + 16]) for i in range(0, len(last), 16)])
        return levels

    def path(levels, at):
        steps = []
        for nodes in levels[:-1]:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            steps.append((run[: at % 16], run[at % 16 + 1 :]))
            at //= 16
        return steps

    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = [(row, row_digest(row, row.text)) for row in groups[source]]
        own.sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        trees.append((own, build([digest for _, digest in own])))
    top = build([levels[-1][0] for _, levels in trees])
    found = []
    for place, (own, levels) in enumerate(trees):
        for at, (row, leaf) in enumerate(own):
            steps = path(levels, at) + path(top, place)
            tampered = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0
            folded = row_digest(row, lowered(row.text)) if tampered else leaf
            for before, after in steps:
                folded = h([*before, folded, *after])
            proof = h([x for before, after in steps for x in [*before, *after]])
            root = top[-1][0]
            found.append((row.doc_id, leaf, levels[-1][0], root, proof, folded, folded == root))
    return found


def test_manifest_of_odd_rows(spark, tmp_path):
    """Sources of 1, 16, 17, 256, 257 and 300 rows, a null source, null and repeated ids, equal rows, a long text."""
    sizes = {"one": 1, "a16": 16, "é17": 17, "b256": 256, "Z257": 257, None: 300, "": 3}
    rows, at = [], 0
    for source, size in sizes.items():
        for i in range(size):
            rows.append((at if i % 40 else None, None if i % 7 == 3 else f"Text {i % 50}", source))
            at += 1
    rows += [(5, "Same", "é17")] * 3 + [(7, "LONG " * 400_000, "one")]
    docs = documents(spark, rows)
    sf = written(spark, tmp_path, docs, "documents")
    found = REGISTRY["op12_merkle"](spark, sf).collect()
    assert sorted(map(repr, plain_manifest(docs.collect()))) == sorted(repr(tuple(row)) for row in found)


def test_many_sources_make_a_tall_upper_tree(spark, tmp_path):
    docs = documents(spark, [(i, f"T{i}", f"source {i % 600}") for i in range(700)])
    sf = written(spark, tmp_path, docs, "documents")
    found = REGISTRY["op12_merkle"](spark, sf).collect()
    assert sorted(map(repr, plain_manifest(docs.collect()))) == sorted(repr(tuple(row)) for row in found)


@pytest.mark.parametrize("rows", [[], [(1, "Only", None)]])
def test_manifest_of_next_to_nothing(spark, rows):
    docs = documents(spark, rows)
    found = merkle.manifest(docs).collect()
    assert [row.verified for row in found] == [True] * len(rows)
    assert all(row.leaf == row.subroot == row.root and row.proof_sha256 == h([]) for row in found)


def test_op12_query_against_sql(spark, sf_dir):
    relation = compare.duck(sf_dir).sql(ORACLES["op12_merkle"])
    assert compare.differences(REGISTRY["op12_merkle"](spark, sf_dir), relation) is None


# --- 13 ------------------------------------------------------------------------------


def plain_repair(rows):
    """(cost, audit, repaired) of turns (role, text, must go, truncated), by trying every edit at every place."""

    def follow(state, initial):
        if initial == "s":
            return 1 if state == 0 else None
        if initial == "u":
            return 2 if state in (0, 1, 3) else None
        return 3 if initial == "a" and state == 2 else None

    @lru_cache(maxsize=None)
    def best(at, state, inserted):
        options = []
        if at == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (then := follow(state, role[0])) is not None:
                    cost, audit, out = best(at, then, inserted + 1)
                    options.append((cost + 3, "I" + audit, (f"{role}:", *out)))
        if at < len(rows):
            role, text, gone, truncated = rows[at]
            cost, audit, out = best(at + 1, state, 0)
            options.append((cost + 4, "D" + audit, out))
            if not gone:
                for new, paid in ((role, 0), ("user", 3), ("assistant", 3)):
                    if (then := follow(state, new[:1])) is not None:
                        cost, audit, out = best(at + 1, then, 0)
                        options.append((cost + paid + 3 * truncated, ("R" if paid else "K") + audit, (f"{new}:{text}", *out)))
        return min(options, default=(1 << 40, "", ()))

    sys.setrecursionlimit(20_000)
    cost, audit, out = best(0, 0, 0)
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_conversation(rows):
    """The contract's row of the turns (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, counts, marked = set(), [0, 0, 0], []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        marked.append((role, text, fault in (0, 1), fault == 2))
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *counts, illegal, *plain_repair(tuple(marked)))


def plain_damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        own = found.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return found


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_conversations(seed, number, longest):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "So", "", "  ", "Why?", None, "a\nb.", "x" * 30, "Fine. \t"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "USER"]
    rows = []
    for conv in range(number):
        for turn in range(pick.randint(1, longest)):
            if pick.random() < 0.9:
                rows.append((conv if conv else None, pick.choice([turn, turn, turn, turn + 3, None]), pick.choice(roles), pick.choice(texts)))
    return rows + rows[:9]


def test_op13_query_against_plain_recursion(spark, tmp_path):
    rows = random_conversations(1, 150, 14) + [(None, 0, "user", "Only.")]
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], "conv_id long, turn long, role string, text string, part int, segment string")
    sf = written(spark, tmp_path, frame.repartition(5), "conversations")
    found = {row.conv_id: tuple(row[name] for name in NAMES[1:]) for row in REGISTRY["op13_conversation_repair"](spark, sf).collect()}
    wanted = {conv: plain_conversation(own) for conv, own in plain_damage(rows).items()}
    assert found == wanted


def test_op13_query_on_the_given_table(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = REGISTRY["op13_conversation_repair"](spark, sf_dir)
    assert found.columns == NAMES
    assert {row.conv_id: tuple(row)[1:] for row in found.collect()} == {c: plain_conversation(own) for c, own in plain_damage(rows).items()}


def test_a_conversation_over_many_segments(spark, plan):
    """One conversation holds nearly all turns; it is cut into segments that are unrolled apart."""
    pick = random.Random(3)
    roles, texts = ["user", "assistant", "assistant", "tool", "system"], ["Yes.", "No", "", "Well.", "Hm?"]
    rows = [(1, turn, pick.choice(roles), f"{pick.choice(texts)}{'' if pick.random() < 0.3 else turn}{pick.choice(['', '.'])}", 1) for turn in range(700)]
    rows += [(conv, turn, "user", "Hi.", 1) for conv in (0, 2, 3) for turn in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    report, repaired = conversations.repair(frame)
    hashes = {row.conv_id: row.repaired_sha256 for row in conversations.transcript_digests(repaired).collect()}
    assert repaired.where("conv_id = 1").select("segment").distinct().count() > 2
    found = {row.conv_id: (*(row[name] for name in NAMES[1:8]), hashes[row.conv_id]) for row in report.collect()}
    own = {}
    for conv, turn, role, text, _ in rows:
        own.setdefault(conv, []).append((turn, role, text))
    assert found == {conv: plain_conversation(turns) for conv, turns in own.items()}


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string, copies int")
    report, repaired = conversations.repair(frame)
    assert report.count() == 0 and repaired.count() == 0


def test_powers_of_a_run_are_its_turns_one_by_one():
    for symbol in range(9):
        one = conversations.power(symbol, 0)
        step = one
        for turns in range(1, 40):
            assert np.array_equal(conversations.run_transition(symbol, turns), step)
            step = conversations._times(step, one)


def test_a_run_of_a_million_turns_takes_few_products():
    before = conversations.power.cache_info().currsize
    conversations.run_transition(3, 1_000_000)
    assert conversations.power.cache_info().currsize - before <= 20
