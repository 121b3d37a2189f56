"""The training-data operators on small tables with nulls, empty and repeated rows, ties, long
texts and clashing columns, against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import defaultdict

import compare
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from twinscout.llm import (
    exact_dedup, line_dedup, mixing, packing, quality, secrets, simhash, token_files, tokens, toxicity, url_filter,
)
from twinscout.llm.oracles import ORACLES
from twinscout.llm.queries import REGISTRY
from twinscout.sources.shared import new_shared_path

LINE = "A line of well over forty characters, found in many documents."
SCHEMA = "doc_id long, text string, source string, score double, size int, n_lines int, kept string, keep_id int"
TEXTS = [
    None, "", "  \n\t ", "one", "same  text\nhere", "same text here", *[f"own {n}\n {LINE.upper()} \nend {n}" for n in range(6)],
    "word " * 20_000, 'token = "abcdef123456" AKIA' + "Q" * 20 + " \U0001f600 " + "0f" * 14, "x" * 5000, LINE + "\n" + LINE,
]
ROWS = [(at, text, None if at % 5 == 0 else f"s{at % 3}") for at, text in enumerate(TEXTS)]
ROWS += [(3, "one", "s0"), (None, "null id", "s1"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, 0.5, 1, 2, "k", 3) for row in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(docs, empty):
    found = exact_dedup.exact_duplicates(docs)
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    expected = []
    for doc_id, text, _ in ROWS:
        own = groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")]
        keep = min((i for i in own if i is not None), default=None)
        expected.append((doc_id, keep, len(own), keep == doc_id))
    key = lambda row: (str(row[0]), str(row))
    assert sorted(map(tuple, found.select("doc_id", "keep_id", "group_size", "kept").collect()), key=key) == sorted(expected, key=key)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_lines(docs, empty):
    out = line_dedup.drop_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    holders = [i for i, text, _ in ROWS if text and LINE.lower() in text.lower()]
    for row in out.where("doc_id IS NOT NULL").collect():
        text = dict((i, t) for i, t, _ in ROWS)[row.doc_id] or ""
        lines = text.split("\n")
        kept = [x for x in lines if x.strip().lower() != LINE.lower() or row.doc_id == max(holders)]
        assert (row.text or "", row["_n_lines"], row.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert out.count() == len(ROWS)
    assert line_dedup.drop_lines(empty).count() == 0


def test_long_runs_are_merged_over_pieces(spark, monkeypatch):
    """Runs handed on in pieces count a document cut by a border once."""
    docs = spark.createDataFrame([(at // 2, LINE + f"\n{LINE}", "s") for at in range(8)], "doc_id long, text string, source string")
    for least, dropped in ((4, True), (5, False)):
        assert (line_dedup.dropped_lines(docs, 40, least).count() > 0) is dropped


def test_keep_bitmaps_round_trip():
    bits = line_dedup.kept_bits(line_dedup._pack([0, 9, 700]))
    assert [at for at, bit in enumerate(bits) if not bit] == [0, 9, 700]


def _fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[a : a + shingle]) for a in range(max(1, len(words) - shingle + 1))] if words else []
    counts = [0] * 64
    for part in parts:
        value = xxhash.xxh64_intdigest(part, 42)
        counts = [c + (value >> (63 - bit) & 1) for bit, c in enumerate(counts)]
    return int("".join("1" if 2 * c > len(parts) else "0" for c in counts), 2)


def test_simhash_components(spark, docs, empty):
    found = simhash.near_duplicates(docs, 3, 3, 3, 1, None).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("f"), "component_id")
    prints = [(i, _fingerprint(t, 3)) for i, t, _ in ROWS]
    labels = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 3:
                    labels[a] = labels[b] = min(labels[a], labels[b])
    least = {lab: min((prints[k][0] for k, m in enumerate(labels) if m == lab and prints[k][0] is not None), default=None) for lab in labels}
    expected = [(i, f"{x:016x}", least[labels[k]]) for k, (i, x) in enumerate(prints)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    assert simhash.near_duplicates(empty).count() == 0


def test_classes_are_rows_of_equal_words(spark):
    """Equal f0 alone links no rows that differ in more than ``total`` bits over all words."""
    words = [f"w{x}" for x in range(200)]
    texts = [" ".join([*words, f"end{at}"]) for at in range(300)]
    prints = defaultdict(list)
    for text in texts:
        first, *others = simhash.fingerprint(text.encode(), 5, 3)
        prints[first].append((others, text))
    one, other = next((a[1], b[1]) for own in prints.values() for a in own for b in own if a[0] != b[0])
    table = spark.createDataFrame([(0, one), (1, other), (2, other)], "doc_id long, text string")
    for total, expected in ((0, [0, 1, 1]), (64, [0, 0, 0])):
        rows = simhash.near_duplicates(table, total=total).orderBy("doc_id").collect()
        assert [row.component_id for row in rows] == expected


def test_thresholds_and_groups():
    rng = np.random.default_rng(1)
    groups = simhash.group_bits(np.corrcoef(rng.integers(0, 2, (500, 64)).T), 5)
    assert sorted(b for g in groups for b in g) == list(range(64))
    shares = [np.full(len(g) + 1, 1 / (len(g) + 1)) for g in groups]
    thresholds = simhash.allot(shares, groups, 1000, 12)
    assert sum(thresholds) == 12 - 5 + 1 and min(thresholds) >= -1


def test_one_of_each_near_duplicate_group_stays(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(4)]
    near = [text.replace(text.split()[50], "changed", 1) for text in base]
    rows = [(at, text, "s") for at, text in enumerate([*base, *near, base[0], base[1]])] + [(1, base[1], "s")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(row.doc_id for row in kept.collect()) == [0, 1, 2, 3]


def _pairs_alike(draw, pairs, words, shared):
    """Pairs of ``words`` different words each, of which the first ``shared`` are the same."""
    texts = []
    for _ in range(pairs):
        own = [f"w{x}" for x in draw.sample(range(10**6), 2 * words - shared)]
        texts += [" ".join(own[:words]), " ".join(own[:shared] + own[words:])]
    return texts


def test_near_duplicates_are_those_of_similarity_0_8(spark):
    """160 of 200 shingles in common are enough, 156 of 208 are not."""
    draw = random.Random(7)
    near, far = _pairs_alike(draw, 40, 184, 164), _pairs_alike(draw, 40, 186, 160)
    rows = [(at, text, "s") for at, text in enumerate([*near, *far])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(row.doc_id for row in kept.collect()) == [*range(0, 80, 2), *range(80, 160)]


def test_mix_takes_exact_budgets(docs, empty):
    taken = mixing.take(docs, bucket_rows=2)
    rows = taken.select("source", "size", "source_size", "target", "taken").collect()
    total = sum(len((t or "").split()) for _, t, _ in ROWS)
    by_source = defaultdict(list)
    for row in rows:
        assert row.taken <= 3 * row["size"]
        by_source[row.source].append(row)
    assert sum(own[0].target for own in by_source.values()) == pytest.approx(total)
    for own in by_source.values():
        assert own[0].target <= 3 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2
    again = mixing.take(docs, bucket_rows=50).select("source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mix.collect()) == sum(r.taken for r in rows)
    assert mixing.take(empty).count() == 0


def test_packing_round_trip(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(docs, path, pool_tokens=10_000).collect()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    found = defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
    for doc_id, text, _ in ROWS:
        if doc_id is None or doc_id == 3:
            continue
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        own = sorted(found[doc_id], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids and {p.doc_tokens for p in own} == {len(ids) // 4}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and (4096 - at <= 64 or at & (at - 1) == 0)
    assert packing.pack_documents(empty, path).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = [int(x) for x in np.random.default_rng(2).integers(1, 65, 300)]
    rooms, expected = [], []
    for item in sorted(range(300), key=lambda k: (-lengths[k], k)):
        fits = [k for k, room in enumerate(rooms) if room >= lengths[item]]
        if not fits:
            rooms.append(64)
            fits = [len(rooms) - 1]
        best = min(fits, key=lambda k: rooms[k])
        rooms[best] -= lengths[item]
    windows = packing.best_fit(lengths, 64)
    assert sorted(64 - sum(lengths[k] for k in w) for w in windows) == sorted(rooms)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 7)
    encoder = tokens.Encoder(tokens.definition(public_tokenizers.path(name)))
    texts = ["a  b", "   x", "\n\n y ", "don't ''s 12 3½ É", "a­b", "\x1cq", "I<|endoftext|>x", "İ ß ﬁ K", "a .b ! c,", "é,", " ", "", "日本 語"]
    texts += ["\n \tx", "a long line of plain words that is cut", "we're it'S 'tis ½²x 3¼9 ª º"]
    draw = random.Random(1)
    texts += ["".join(draw.choice("ab '\n\tsré½²9.,ĸŒ") for _ in range(60)) for _ in range(500)]
    for text in texts:
        assert encoder.encode(text) == encoder._whole(text) or not text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("bounds", [{}, {"PART": 5, "BLOCK": 90}, {"TABLE_ENTRIES": 40, "BLOCK": 200}, {"TABLE_BYTES": 600, "BLOCK": 200}, {"known": False}])
def test_many_texts_are_encoded_as_the_library_does(name, bounds, monkeypatch):
    encoder = tokens.Encoder(tokens.definition(public_tokenizers.path(name)))
    for bound, value in bounds.items():
        monkeypatch.setattr(encoder if bound == "known" else tokens, bound, value)
    draw = random.Random(7)
    texts = ["".join(draw.choice("ab stmdrevl STL''' \n\t\r12²½éĿ.,!-") for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", " ", "  ", "\n ", " \n", "a  ", "\n \n a", "'s", " 's", "''s", "x'll'd've're", "a'", "'", "\0", "a\0b", "日本 語", "x" * 700, "I<|endoftext|>x"]
    draw.shuffle(texts)
    assert encoder.encode_all(texts) == [encoder._whole(text) if text else b"" for text in texts]
    assert encoder.encode_all([]) == []
    encoder.words._bound()
    assert len(encoder.words.words) <= tokens.TABLE_ENTRIES and encoder.words.words.nbytes <= tokens.TABLE_BYTES


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_of_a_block_are_split_and_looked_up_together(name, monkeypatch):
    encoder = tokens.Encoder(tokens.definition(public_tokenizers.path(name)))
    look, tokenize, looked, made = encoder.words.look, encoder.tokenize, [], []
    monkeypatch.setattr(encoder.words, "look", lambda words: looked.append(len(words)) or look(words))
    monkeypatch.setattr(encoder, "tokenize", lambda word: made.append(word.removeprefix("Ġ")) or tokenize(word))
    texts = [f"one two {at % 9} three." for at in range(3000)]
    assert encoder.encode_all(texts) == [encoder._whole(text) for text in texts]
    encoder.encode_all(texts)
    assert len(looked) == 2 and len(made) <= 30
    monkeypatch.setattr(tokens, "TABLE_ENTRIES", 64)
    monkeypatch.setattr(tokens, "BLOCK", 2000)
    made.clear()
    encoder.encode_all([f"one two {'x' * (at % 50)}y{at} three." for at in range(3000)])
    assert len(made) > 1000 and not {"one", "two", "three"} & set(made)  # frequent words outlive rare ones


def test_the_encoder_outlives_a_task(spark):
    shipped = spark.sparkContext.broadcast(tokens.definition(public_tokenizers.path("byte_bpe_50k.json")))
    tokens.encoder(shipped.value)

    def met(batches):
        own = tokens.encoder(shipped.value)
        own.tasks = getattr(own, "tasks", 0) + 1
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "task": [own.tasks]})

    rows = spark.range(320).repartition(64).mapInArrow(met, "pid long, task long").collect()
    workers = {pid: sorted(row.task for row in rows if row.pid == pid) for pid in {row.pid for row in rows}}
    assert len(workers) < len(rows) == 64
    assert all(tasks == list(range(1, len(tasks) + 1)) for tasks in workers.values())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_takes_added_tokens_as_the_library_does(name):
    path = public_tokenizers.path(name)
    encoder, whole = tokens.Encoder(tokens.definition(path)), Tokenizer.from_file(path)
    for text in ["I<|endoftext|>x", "<|endoftext|>", "a <|startoftext|> b", "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext|>\n<|endoftext|>", "<|x|>"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    folder = new_shared_path(spark, "tokens")
    read = token_files.read_token_files(spark, folder, token_files.write_token_files(docs, folder, path)).collect()
    expected = sorted(
        (zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()), str(i)) for i, t, _ in ROWS
    )
    assert sorted((row.ids_crc32, str(row.doc_id)) for row in read) == expected
    at = 0
    for row in sorted(read, key=lambda row: row.start):
        assert row.start == at
        at += row.n_tokens
    ids = [row.doc_id for row in sorted(read, key=lambda row: row.start) if row.doc_id is not None]
    assert ids == sorted(ids)
    folder = new_shared_path(spark, "tokens")
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(empty, folder, path)).count() == 0


def test_secrets(docs, empty):
    row = secrets.find_secrets(docs).where("doc_id = 13").select(secrets.spans_text(F.col("secrets")).alias("s")).first()
    text = TEXTS[13]
    access = text.index("AKIA")
    assert row.s == f"assign:0:21,access:{access}:{access + 24},hex:{text.index('0f0f')}:{len(text)}"
    assert secrets.find_secrets(docs).count() == len(ROWS) and secrets.find_secrets(empty).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"(?i)AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert set(secrets.trigram_query(r"ab_?cd")) == {frozenset({"ab_", "b_c", "_cd"}), frozenset({"abc", "bcd"})}
    assert secrets.trigram_query(r"abc|x") is None


def test_quality(docs, empty):
    for row in quality.judge(docs).where("doc_id IS NOT NULL").collect():
        words = (dict((i, t) for i, t, _ in ROWS)[row.doc_id] or "").split()
        windows = list(zip(words, words[1:], words[2:], strict=False))
        covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(words) < 999 else set(range(len(words)))
        assert (row.n_words, row.n_repeat_words) == (len(words), len(covered))
        assert not (row.base_failed and row.kept)
    assert quality.judge(empty).count() == 0


def test_host_rates_shrink(spark):
    marked = spark.createDataFrame(
        [("big", at % 10 == 0) for at in range(1000)] + [("bad", True)] * 200 + [("tiny", True)], "host string, _fails_r boolean"
    )
    rates = {row.host: row.rate_r for row in quality.host_rates(marked, "host", ["r"]).collect()}
    assert rates["bad"] > 0.9 and rates["big"] < 0.15 and rates["tiny"] < rates["bad"]


def test_url_rules_need_the_same_rows_in_any_table(spark):
    """30 blocked pages of a host are a rule among 40,000 labelled pages, 10 are none; and what all
    pages share is none, however many are blocked."""
    hosts = [("bad", 30, True), ("rare", 10, True), ("fine", 39_960, False)]
    pages = [(f"{host}{at}", f"http://{host}.example.org/p/{at}", blocked) for host, n, blocked in hosts for at in range(n)]
    table = spark.createDataFrame(pages, "page_id string, url string, blocked boolean")
    rows = url_filter.judge_urls(table.select("page_id", "url"), table.select("page_id", "blocked")).where("verdict = 'block'")
    assert sorted(row.page_id for row in rows.collect()) == sorted(f"bad{at}" for at in range(30))
    same = [(["a"], at % 4 > 0) for at in range(4000)]
    assert url_filter.mine_rules(spark.createDataFrame(same, "tokens array<string>, blocked boolean")).count() == 0


def test_frequent_sets_are_all_of_them(spark):
    """Every set of tokens that enough blocked URLs hold, of any size, counted over all URLs."""
    pick = random.Random(12)
    names = [f"t{at}" for at in range(9)]
    rows = [(sorted(pick.sample(names, pick.randint(0, 6))), pick.random() < 0.4) for _ in range(200)]
    found, items = url_filter.frequent_sets(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 5)
    assert {r.token for r in items.collect()} == set(names)
    wanted = {}
    for size in range(1, 7):
        for own in itertools.combinations(names, size):
            hits = [blocked for tokens, blocked in rows if set(own) <= set(tokens)]
            if sum(hits) >= 5:
                wanted[own] = (len(hits), sum(hits))
    assert {tuple(r["items"]): (r.n, r.k) for r in found.collect()} == wanted and max(map(len, wanted)) >= 3


def test_rules_are_those_no_part_is_as_sure_as(spark):
    pick = random.Random(13)
    names = [f"t{at}" for at in range(7)]
    rows = []
    for _ in range(600):
        own = sorted(pick.sample(names, pick.randint(1, 5)))
        rows.append((own, pick.random() < (0.95 if {"t0", "t1"} <= set(own) else 0.8 if "t2" in own else 0.1)))
    rules = {tuple(r.tokens): r for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()}
    base, sure, all_sets = sum(b for _, b in rows) / len(rows), {}, {}
    for size in range(1, 6):
        for own in itertools.combinations(names, size):
            hits = [blocked for tokens, blocked in rows if set(own) <= set(tokens)]
            n, k = len(hits), sum(hits)
            if k < 20:
                continue
            all_sets[own] = share = k / n
            z = url_filter.DEVIATIONS
            bound = (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            part = max((all_sets[p] for s in range(1, size) for p in itertools.combinations(own, s)), default=-1)
            if share >= 0.6 and bound > base and part < share:
                sure[own] = share
    assert {t: round(r.confidence, 9) for t, r in rules.items()} == {t: round(c, 9) for t, c in sure.items()} and len(sure) > 1


def test_a_rule_of_four_tokens_blocks(spark):
    """No part of the four tokens tells more than another; together they do."""
    pages, at = [], 0
    parts = ["a", "b", "c", "d"]
    for kept in range(16):
        own = [p for i, p in enumerate(parts) if kept >> i & 1]
        for _ in range(40):
            pages.append((at, f"http://h{at}.example.org/" + "/".join([*own, f"x{'y' * (at % 17)}"]), kept == 15, "kept", 1))
            at += 1
    table = spark.createDataFrame(pages, "page_id int, url string, blocked boolean, _url string, rule int")
    judged = url_filter.judge_urls(table, table.select("page_id", "blocked"))
    assert judged.columns == ["page_id", "url", "blocked", "_url", "host", "path", "mined_rule", "rule", "verdict"]
    found = judged.collect()
    assert sum(r.verdict == "block" for r in found if r.blocked) == 40 and not any(r.verdict == "block" for r in found if not r.blocked)
    assert {r._url for r in found} == {"kept"}


def test_urls_of_any_kind(spark):
    """Repeated and null ids, null and very long URLs, no labels, no pages."""
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None), (None, "http://b.net/"), (2, "http://c.org/" + "seg/" * 200_000), (3, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (None, True), (2, None)], "page_id long, blocked boolean")
    for own in (labels, labels.limit(0)):
        assert sorted(str(r.verdict) for r in url_filter.judge_urls(pages, own, [("block", "net/")]).collect()) == ["allow"] * 5 + ["block"]
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_url_rules(spark):
    pages = [(at, f"http://spam.example.org/win/{at}?ref=a" if at % 3 == 0 else f"https://good.example.org/en/{at}") for at in range(300)]
    pages += [(900, None), (901, "no scheme"), (902, "HTTP://A.Example.NET?x"), (903, "http://x.net/p"), (904, "http://spam.example.org/win/7?ref=a")]
    labels = spark.createDataFrame([(at, at % 3 == 0) for at in range(300)], "page_id long, blocked boolean")
    rows = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, [("block", "net/")]).collect()
    verdicts = {row.page_id: (row.host, row.path, row.rule, row.verdict) for row in rows}
    assert all(verdicts[at][3] == ("block" if at % 3 == 0 else "allow") for at in range(300))
    assert verdicts[900] == ("", "", None, "allow") and verdicts[901] == ("", "", None, "allow")
    assert verdicts[902] == ("a.example.net", "", None, "allow") and verdicts[903] == ("x.net", "/p", "net/", "block")
    assert verdicts[904][3] == "block"
    none = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), labels.limit(0))
    assert none.where("verdict = 'block'").count() == 0


def test_toxicity_learns_words_and_keeps_clean_texts(spark, docs, empty):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeilnorst"), 6)) for _ in range(300)]
    rows = []
    for at in range(800):
        words = list(rng.choice(vocabulary, 60))
        if at % 4 == 0:
            words[5] = words[30] = "vuzgak" + str(rng.choice(["er", "ing", "s"]))
        rows.append((at, " ".join(words), "s", int(at % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, toxic int")
    seen = table.where("doc_id < 600")
    model = toxicity.learn(seen.drop("toxic"), seen.select("doc_id", "toxic"))
    scores = {row.doc_id: row.score for row in toxicity.score_documents(table, model, ["doc_id"]).collect()}
    toxic, clean = ([scores[at] for at in range(600, 800) if (at % 4 == 0) is kind] for kind in (True, False))
    assert np.mean([t > c for t in toxic for c in clean]) > 0.85
    assert np.mean([c < 0.3 for c in clean]) > 0.85
    assert {row.doc_id for row in toxicity.drop_toxic(table, model).collect()} == {at for at, s in scores.items() if s < 0.3}
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.drop_toxic(empty, model).count() == 0
    blank = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.drop_toxic(docs, blank).count() == len(ROWS)


def test_toxicity_keeps_grams_apart(spark):
    """'pid ' and ' is ' have the same remainder by 1,048,573."""
    rows = [("stupid you isle", True)] * 50 + [("this is it spider", False)] * 50
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic boolean"))
    value = {gram: model.differences(np.frombuffer(gram, dtype=np.uint8))[0] for gram in (b"pid ", b" is ")}
    assert value[b"pid "] > 1 and value[b" is "] < -1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare.differences(REGISTRY[name](spark, sf_dir), compare.duck(sf_dir).sql(ORACLES[name])) is None


def test_stages_and_pipeline(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


CLASHES = (
    "doc_id long, text string, source string, _id int, _key int, _kinds int, _map_id int, _map_key int, _map_bits int, _other_id int, "
    "_other_key int, score int, rank int, secrets int, kept int, _salt int, _host int, task int, size int, row int"
)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns with the names the operators use themselves, null ids, repeated rows, and a text of one long word."""
    texts = [None, "", LINE + "\n" + LINE, "a b c d e f g h " * 30, "a b c d e f g h " * 30 + "i", "x" * 10_000_000, "token = 'abcdef123456'"]
    rows = [(at, text, f"s{at % 2}") for at, text in enumerate(texts)] + [(None, "null id", None), (None, None, "s0"), (3, texts[3], "s1"), (3, texts[3], "s1")]
    return spark.createDataFrame([(*row, *range(17)) for row in rows], CLASHES)


def _as_pipeline_stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("run", [
    lambda docs: simhash.near_duplicates(docs).drop("component"),
    simhash.drop_near_duplicates, secrets.find_secrets, exact_dedup.exact_duplicates, line_dedup.drop_lines, quality.judge, mixing.take, mixing.mixed,
    lambda docs: packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
    lambda docs: toxicity.drop_toxic(docs, toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))),
], ids=["op1", "simhash stage", "op5", "op7", "op8", "op9", "op10", "mixing stage", "op4", "toxicity stage"])
def test_clashing_names_null_ids_long_words_and_no_rows(spark, clashing, run):
    found = run(clashing).collect()
    assert found and {row.doc_id for row in found} <= {None, *range(7)}
    assert run(clashing.limit(0)).count() == 0
    names = run(clashing).columns
    assert len(names) == len({name.lower() for name in names})


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "simhash", "mixing", "packing"])
def test_pipeline_stages_on_odd_rows(spark, clashing, sf_dir, name):
    stage = _as_pipeline_stage(name)
    docs = clashing.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    found = stage(spark, docs, sf_dir)
    assert name == "packing" or found.columns == docs.columns
    assert found.count() > 0 and stage(spark, docs.limit(0), sf_dir).count() == 0


def test_exact_duplicates_of_many_are_found_without_shuffling_texts(spark, monkeypatch, sf_dir):
    from twinscout.operators import sizing

    wanted = sorted(map(str, REGISTRY["op7_exact_dedup"](spark, sf_dir).collect()))
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = REGISTRY["op7_exact_dedup"](spark, sf_dir)
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        nodes = found._jdf.queryExecution().explainString(formatted).split("\n\n")
        exchanges = [node for node in nodes if ") Exchange" in node and "Input [" in node]
        assert exchanges and not any(", text#" in node or "[text#" in node for node in exchanges)
        assert sorted(map(str, found.collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_host_of_much_junk_is_rejected(spark):
    """Three in ten documents of one host break a rule that two in a hundred break elsewhere."""
    pick = random.Random(2)
    clean = " ".join(f"word{n}" for n in range(80))
    rows = []
    for at in range(6000):
        host = f"h{at % 12}"
        junk = pick.random() < (0.4 if host == "h3" else 0.02)
        rows.append((at, host, clean + (" #*$ %&" * 40 if junk else f" own{at}")))
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    found = {row.source: row.n for row in judged.where("kept").groupBy("source").agg(F.count("*").alias("n")).collect()}
    base = {row.source: row.n for row in judged.where("NOT base_failed").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert "h3" not in found and {h: n for h, n in base.items() if h != "h3"} == found and base["h3"] > 100


def test_every_labelled_row_is_counted(spark):
    """An expression that only one labelled row in eight holds, those that fit the curve, counts too."""
    rows = [(at, f"plain words number {at} here", 0) for at in range(400)]
    held = [at for at in range(1000, 2000) if zlib.crc32(str(at).encode()) // 4 % 8 == 0][:60]
    rows += [(at, "qzxvk qzxvk wjyzq", 1) for at in held] + [(3000 + at, f"other bad blorg {at}", 1) for at in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table.drop("toxic"), table.select("doc_id", "toxic"))
    ask = spark.createDataFrame([(1, "qzxvk qzxvk wjyzq"), (2, "plain words number 7 here")], "doc_id long, text string")
    scores = {row.doc_id: row.score for row in toxicity.score_documents(ask, model, ["doc_id"]).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_held_out_is_never_null(spark):
    from twinscout.llm.queries import held_out

    frame = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    assert [row.h for row in frame.select(held_out().alias("h")).collect()] == [False] + [zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2)]
