"""The vector index, set joins, groups, price bins, schedules, profiles and the title store."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscout.operators import bloom, cache, cells, groups, hot_words, matching, overlap, prices, profiles, ranking, report, rotations, schedule, sizing
from twinscout.operators import title_store, vectors
from twinscout.operators.cache import index_delta
from twinscout.operators.orientation import orientation_corr
from twinscout.plans.prepare import prepare_fetches, refresh_index
from twinscout.sources.shared import new_shared_path
from twinscout.workload import views

IMAGE = "image_id long, sku_key string, vector array<float>, path string, length long, mtime long"


def clustered(seed, rows, width=16, centres=40, spread=0.05):
    """Vectors around random centres, as images."""
    random_state = np.random.default_rng(seed)
    points = random_state.normal(size=(centres, width))
    vectors = points[random_state.integers(0, centres, rows)] + spread * random_state.normal(size=(rows, width))
    return [(i, f"K{i % 97}", [float(np.float32(x)) for x in v], f"images/{i}.jpg", 10, 1) for i, v in enumerate(vectors)]


def asked(spark, rows, number, seed=5):
    """Queries of two images each, near indexed ones."""
    pick = random.Random(seed)
    found = []
    for query in range(number):
        for position in range(2):
            found.append((query, position, [x * 1.1 for x in pick.choice(rows)[2]]))
    return spark.createDataFrame(found, "query_id long, position int, vector array<float>")


def as_rows(hits):
    return sorted((r.query_id, r.hit, r.image_id, r.sku_key, round(r.score, 9)) for r in hits.collect())


# --- index ---------------------------------------------------------------------------


@pytest.mark.parametrize("top_k", [1, 40, 5000])
@pytest.mark.parametrize("number", [1, 30])
def test_pruned_search_gives_the_rows_of_a_scan(spark, top_k, number):
    rows = clustered(1, 3000) + [(9000 + i, "same", [0.5] * 16, f"images/s{i}", 1, 1) for i in range(70)]
    images = spark.createDataFrame([*rows, (7777, "none", None, "images/x", 0, 0)], IMAGE)
    folder = new_shared_path(spark, "index")
    cells.build_cells(images, folder, 25)
    queries = asked(spark, rows, number)
    assert as_rows(cells.search_cells(spark, folder, queries, top_k)) == as_rows(matching.visual_search(images, queries, top_k))


def test_small_cuts_open_few_files(spark, monkeypatch):
    rows = clustered(2, 6000)
    images, folder = spark.createDataFrame(rows, IMAGE), new_shared_path(spark, "index")
    cells.build_cells(images, folder, 40)
    opened, listed = [], cells._cells_of

    def counting(session, place, manifest, wanted=None):
        found = listed(session, place, manifest, wanted)
        opened.extend(found.inputFiles())
        return found

    monkeypatch.setattr(cells, "_cells_of", counting)
    queries = asked(spark, rows, 1)
    hits = as_rows(cells.search_cells(spark, folder, queries, 20))
    size = {}
    for where, _, names in os.walk(f"{folder.removeprefix('file:')}/data"):
        size |= {f"{where}/{name}": os.path.getsize(f"{where}/{name}") for name in names if name.endswith(".parquet")}
    read = sum(size[name.removeprefix("file://")] for name in set(opened))
    assert read < 0.3 * sum(size.values())
    assert hits == as_rows(matching.visual_search(images, queries, 20))


def test_index_of_nothing(spark):
    folder = new_shared_path(spark, "index")
    cells.build_cells(spark.createDataFrame([], IMAGE), folder)
    queries = spark.createDataFrame([(1, 0, [1.0, 2.0])], "query_id long, position int, vector array<float>")
    assert cells.search_cells(spark, folder, queries, 5).count() == 0
    with pytest.raises(FileNotFoundError):
        cells.read_manifest(spark, new_shared_path(spark, "no-index"))


def test_delta_writes_only_touched_cells_and_equals_a_rebuild(spark):
    rows = clustered(3, 2000)
    images, folder = spark.createDataFrame(rows, IMAGE), new_shared_path(spark, "index")
    cells.build_cells(images, folder, 30)
    first = cells.read_manifest(spark, folder).collect()
    home = {r.path: r.cell for r in cells.indexed(spark, folder).select("path", "cell").collect()}
    emptied = home["images/0.jpg"]
    # One cell loses all its rows, one row changes, two are new.
    gone = {path for path, cell in home.items() if cell == emptied}
    changed = next(r for r in rows if r[3] not in gone)
    kept = [r for r in rows if r[3] not in gone and r != changed]
    now = kept + [(changed[0], changed[1], rows[50][2], changed[3], 11, 2), (5001, "N1", rows[60][2], "images/n1", 5, 5), (5002, "N2", changed[2], "images/n2", 5, 5)]
    present = spark.createDataFrame(now, IMAGE)
    queries = asked(spark, rows, 12)
    before = as_rows(cells.search_cells(spark, folder, queries, 30, version=1))
    delta = index_delta(present.select("path", "length", "mtime"), cells.indexed(spark, folder).select("path", "length", "mtime"))
    assert cells.apply_index_delta(spark, folder, delta, present) == 2
    second = cells.read_manifest(spark, folder).collect()
    touched = {r.cell for r in second if r.data_version == 2}
    assert 0 < len(touched) < 8 and {r.cell for r in first} == {r.cell for r in second}
    assert [r.rows for r in second if r.cell == emptied] == [0]
    assert sorted(r.path for r in cells.indexed(spark, folder).collect()) == sorted(r[3] for r in now)
    assert as_rows(cells.search_cells(spark, folder, queries, 30)) == as_rows(matching.visual_search(present, queries, 30))
    assert as_rows(cells.search_cells(spark, folder, queries, 30, version=1)) == before == as_rows(matching.visual_search(images, queries, 30))


def test_two_writers_of_one_version_do_not_both_win(spark):
    images, folder = spark.createDataFrame(clustered(4, 200), IMAGE), new_shared_path(spark, "index")
    cells.build_cells(images, folder, 4)
    manifest = cells.read_manifest(spark, folder)
    cells._publish(manifest, folder, 2)
    with pytest.raises(Exception, match="exist"):
        cells._publish(manifest, folder, 2)
    assert cells.versions(spark, folder) == [1, 2]


def test_putting_rows_into_many_cells_takes_little_memory(spark):
    """Tiles of a few MB at the most cells there may be; the cell is a nearest one and the distance exact."""
    state = np.random.default_rng(3)
    points = state.normal(size=(4096, 16))
    assert cells.TILE_BYTES // (4 * len(points)) * len(points) * 4 <= 4 << 20
    rows = [(i, [float(v) for v in state.normal(size=16)]) for i in range(500)]
    frame = spark.createDataFrame(rows, "image_id long, vector array<float>").withColumn("sku_key", F.lit("s"))
    found = {r.image_id: r for r in cells.assigned(frame, np.arange(4096, dtype=np.int32), points).collect()}
    for i, vector in rows:
        apart = np.sqrt(((points - np.array(vector, dtype=np.float32)) ** 2).sum(axis=1))
        assert apart[found[i].cell] <= apart.min() + 1e-4 and abs(found[i].distance - apart[found[i].cell]) < 1e-9


# --- overlap -------------------------------------------------------------------------


def plain_pairs(left, right, threshold, same):
    found = set()
    for (a, x), (b, y) in itertools.product(left.items(), right.items()):
        if x and y and not (same and a >= b):
            both = len(x & y)
            if both / min(len(x), len(y)) >= threshold:
                found.add((a, b, both))
    return found


def word_sets(seed, rows, words=30, longest=9):
    pick = random.Random(seed)
    return {i: {f"w{min(pick.randrange(words), pick.randrange(words))}" for _ in range(pick.randint(1, longest))} | {"common"} for i in range(rows)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_overlap_pairs_are_all_pairs(spark, threshold):
    sets = word_sets(1, 250)
    frame = spark.createDataFrame([(i, sorted(words)) for i, words in sets.items()], "class_id long, words array<string>")
    found = {(r.left_id, r.right_id, r.shared) for r in overlap.overlap_pairs(frame, threshold).collect()}
    assert found == plain_pairs(sets, sets, threshold, True)


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_overlap_join_is_all_pairs_of_two_tables(spark, threshold):
    left, right = word_sets(2, 80), word_sets(3, 150, longest=25)
    frames = [spark.createDataFrame([(i, sorted(w)) for i, w in s.items()], "class_id long, words array<string>") for s in (left, right)]
    rows = overlap.overlap_join(*frames, threshold).collect()
    assert len(rows) == len({(r.left_id, r.right_id) for r in rows})
    assert {(r.left_id, r.right_id, r.shared) for r in rows} == plain_pairs(left, right, threshold, False)


def test_a_word_of_every_title_proposes_few_pairs(spark):
    """Titles share one word and two of many others; only their rare words meet."""
    rows = [(i, ["common", f"a{i % 400}", f"b{i}", f"c{i}"]) for i in range(800)]
    frame = spark.createDataFrame(rows, "class_id long, words array<string>")
    (places,) = overlap._ordered(frame)
    met = overlap._proposed(places, places, 0.8, strictly=False).where("small_id <> large_id")
    assert met.count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_titles_of_few_frequent_words_propose_only_results(spark, threshold):
    """No word is rare, so the prefixes of hundreds of titles meet; equal subsets are met by pairs of the result alone."""
    pick = random.Random(4)
    sets = {i: {"common", f"a{pick.randrange(4)}", f"b{pick.randrange(4)}", f"c{pick.randrange(5)}", f"d{pick.randrange(20)}", *(["pro"] if i % 4 else [])} for i in range(300)}
    sets = {i: words for i, words in sets.items() if words not in [sets[j] for j in range(i)]}
    frame = spark.createDataFrame([(i, sorted(w)) for i, w in sets.items()], "class_id long, words array<string>")
    wanted = plain_pairs(sets, sets, threshold, True)
    met = overlap._small_pairs(frame, frame, threshold, strictly=True).select("small_id", "large_id")
    assert met.count() == met.distinct().count() == sum(len(sets[a]) != len(sets[b]) for a, b, _ in wanted)
    found = overlap.overlap_pairs(frame, threshold)
    assert {(r.left_id, r.right_id, r.shared) for r in found.collect()} == wanted and found.count() == len(wanted)


def test_titles_of_equal_words_are_one_class(spark):
    rows = [(3, "Red ring"), (1, "ring RED!"), (2, "Blue ring"), (4, ""), (5, None), (6, "the and"), (7, "Red ring")]
    listings = spark.createDataFrame(rows, "row_id long, title string")
    classes, members = overlap.keyword_classes(listings)
    found = {r.row_id: r.class_id for r in members.collect()}
    assert found[1] == found[3] == found[7] == 1 and found[2] == 2 and 4 not in found and 5 not in found
    assert classes.count() == len(set(found.values()))


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_overlap_join_of_rows_names_their_classes(spark, threshold):
    """Rows of equal words, smaller and larger than the other side's, are one class named by the least row."""
    left, right = word_sets(5, 60, longest=12), word_sets(6, 120, longest=25)
    rows = {**right, **{500 + i: words for i, words in right.items()}, **{-1 - i: words for i, words in right.items() if i % 3 == 0}}
    least = {}
    for i, words in rows.items():
        least[frozenset(words)] = min(i, least.get(frozenset(words), i))
    frame = spark.createDataFrame([(i, sorted(w)) for i, w in left.items()], "class_id long, words array<string>")
    titles = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "row_id long, title string")
    found = overlap.overlap_join_rows(frame, overlap.keyword_rows(titles), threshold).collect()
    assert len(found) == len({(r.left_id, r.right_id) for r in found})
    wanted = plain_pairs(left, {i: set(words) for words, i in least.items()}, threshold, False)
    assert {(r.left_id, r.right_id, r.shared) for r in found} == wanted


@pytest.mark.parametrize("threshold", [0, -1, 1.5])
def test_thresholds_that_mean_nothing(spark, threshold):
    frame = spark.createDataFrame([], "class_id long, words array<string>")
    with pytest.raises(ValueError):
        overlap.overlap_pairs(frame, threshold)


# --- groups --------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    pick = random.Random(9)
    edges = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(1000, i) for i in range(300)],
        "random": [(pick.randrange(400), pick.randrange(400)) for _ in range(220)],
        "none": [],
    }[kind]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = {r.id: r.root for r in groups.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e} | {k: v for k, v in found.items() if k == v}


def test_strict_rules_keep_groups_apart(spark):
    rows = [
        (1, "Canon camera x100 black", 9.0, "a"), (2, "canon CAMERA x100, black", 7.0, "b"), (3, "Canon camera x200 black", 5.0, "a"),
        (4, "Canon camera black", None, "c"), (5, None, 1.0, "c"), (6, "Other thing", float("nan"), "c"),
    ]
    listings = spark.createDataFrame(rows, "row_id long, title string, price double, source_file string").withColumn("sku", F.concat(F.lit("S"), "row_id"))
    found = groups.duplicate_groups(listings)
    assert {r.row_id: r.group_id for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6}  # 4 links 1 and 3
    pairs = {tuple(sorted((r.a, r.b))) for r in groups.duplicate_links(groups.title_nodes(listings)[0]).collect()}
    assert pairs == {(1, 4), (3, 4)}
    report = {r.group_id: r for r in groups.group_report(listings, found).collect()}
    assert (report[1].listings, report[1].representative, report[1].least_price, report[1].most_price, report[1].sources) == (4, 3, 5.0, 9.0, 3)
    assert (report[6].listings, report[6].representative, report[6].least_price) == (1, 6, None)


def test_titles_of_one_split_are_parsed_by_all_tasks(spark, sf_dir):
    rows = views.dealt_titles(spark, sf_dir)
    assert rows.groupBy(F.spark_partition_id()).count().count() == 8 and rows.count() == views.listings(spark, sf_dir).count()


# --- prices --------------------------------------------------------------------------


@pytest.mark.parametrize("width", [0.3, 1.0, 1000.0])
def test_price_join_equals_single_queries(spark, width):
    pick = random.Random(4)
    odd = [None, float("nan"), 0.0, -7.25, 1e300, float("inf"), 10.0, 10.000000001]
    listings = [(i, pick.choice([pick.uniform(-50, 400), float(pick.randrange(50)), pick.choice(odd)])) for i in range(500)]
    bounds = [None, None, 0.0, 10.0, 10.0, 25.5, -3.0, 399.0, 1e300]
    queries = [(q, pick.choice(bounds), pick.choice(bounds)) for q in range(60)] + [(100, 5.0, 4.0), (101, None, None)]
    frame = spark.createDataFrame(listings, "row_id long, price double")
    asked_for = spark.createDataFrame(queries, "query_id long, min_price double, max_price double")
    found = prices.price_join(frame, asked_for, width).collect()
    wanted = [
        (q, i) for q, low, high in queries if low is not None or high is not None for i, p in listings
        if p is not None and not math.isnan(p) and (low is None or p >= low) and (high is None or p <= high)
    ]
    assert sorted((r.query_id, r.row_id) for r in found) == sorted(wanted)


def test_wide_ranges_meet_few_bins(spark):
    queries = spark.createDataFrame([(1, 3.0, 1_000_000.0)], "query_id long, min_price double, max_price double")
    assert prices.query_bins(queries, 0.01).count() <= 2 * (prices.POWERS + 2)


def test_prices_without_queries(spark):
    listings = spark.createDataFrame([(1, 2.0)], "row_id long, price double")
    assert prices.price_join(listings, spark.createDataFrame([(1, None, None)], "query_id long, min_price double, max_price double")).count() == 0


# --- ranks and schedules -------------------------------------------------------------


def test_ranks_in_a_group_that_holds_most_rows(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1000) for i in range(1000)] + [(None, 5), (None, 4)]
    found = ranking.ranked(spark.createDataFrame(rows, "name string, value long"), ["name"], ["value"]).collect()
    own = {}
    for name, value in rows:
        own.setdefault(name, []).append(value)
    for row in found:
        assert sorted(own[row.name])[row["rank"]] == row.value and row.rows == len(own[row.name])
    assert len({(row.name, row["rank"]) for row in found}) == len(rows)


def test_no_slot_over_its_limits(spark):
    hosts = ["a.example", "A.example", "b.example", "c.example", None]
    rows = [(f"S{i}", None if hosts[h] is None else f"https://{hosts[h]}/{i}", f"d{i}") for i in range(400) for h in [0 if i % 2 else i % 5]]
    plan = spark.createDataFrame(rows, "sku string, image_url string, dest string")
    found = schedule.fetch_schedule(plan, workers=5, per_host=2)
    assert found.count() == len(rows)
    slots = found.groupBy("round", "slot")
    assert slots.count().agg(F.max("count")).first()[0] <= 5
    assert slots.agg(F.count_distinct("worker").alias("w"), F.count("*").alias("n")).where("w <> n").count() == 0
    assert found.groupBy("round", "slot", "host").count().agg(F.max("count")).first()[0] <= 2
    assert {r.host for r in found.select("host").distinct().collect()} == {"a.example", "b.example", "c.example", ""}
    with pytest.raises(ValueError):
        schedule.fetch_schedule(plan, workers=0)


# --- profiles and titles -------------------------------------------------------------


def test_a_file_profiled_again_counts_once(spark):
    def rows(name, first, n):
        return spark.createDataFrame([(f"S{(first + i) % 900}", float(i), name) for i in range(n)] + [(None, None, name), (" ", float("nan"), name)], "sku string, price double, source_file string")

    store = new_shared_path(spark, "profiles")
    profiles.store_profiles(profiles.file_profiles(rows("a", 0, 500)), store)
    profiles.store_profiles(profiles.file_profiles(rows("b", 400, 800)), store)
    profiles.store_profiles(profiles.file_profiles(rows("a", 0, 100)), store)
    found = profiles.catalog_profile(profiles.stored_profiles(spark, store)).first()
    exact = len({f"S{i}" for i in range(100)} | {f"S{(400 + i) % 900}" for i in range(800)})
    assert found.total_rows == 100 + 800 + 4 and (found.least_price, found.most_price) == (0.0, 799.0)
    assert abs(found.distinct_skus - exact) <= 0.03 * exact
    assert found.duplicate_rows == found.total_rows - found.distinct_skus
    values = sorted([*range(100), *range(800)])
    for rank, got in ((0.25, found.price_q25), (0.5, found.price_q50), (0.75, found.price_q75)):
        assert abs(np.searchsorted(values, got) / len(values) - rank) <= 0.03


def test_each_title_is_encoded_once_over_runs(spark):
    def make():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return encode

    store = new_shared_path(spark, "titles")
    first = spark.createDataFrame([(1, "one"), (2, "one"), (3, None), (4, "")], "row_id long, title string")
    second = spark.createDataFrame([(1, "one"), (5, "three"), (6, "three"), (7, "seven")], "row_id long, title string")
    assert title_store.encode_missing(first, store, make, 2) == 1
    assert title_store.encode_missing(second, store, make, 2) == 2
    assert title_store.encode_missing(second, store, make, 2) == 0
    assert title_store.stored_titles(spark, store).count() == 3
    listings, vectors = title_store.with_text_vectors(first.unionByName(second), store)
    found = {r.row_id: r.vector for r in listings.join(vectors, "text_vec_id", "left").collect()}
    assert found[2] == [3.0, 1.0] and found[6] == [5.0, 1.0] and found[3] is None and found[4] is None
    bad = spark.createDataFrame([(9, "bad title")], "row_id long, title string")
    assert title_store.encode_missing(bad, store, make, 2) == 1 and title_store.encode_missing(bad, store, make, 2) == 1
    assert tuple(title_store.encoded_share(bad.unionByName(second), store).first()) == (4, 3, 1)


# --- filters, hot words, turned copies -----------------------------------------------


def test_few_rows_without_a_partner_pass_the_filter(spark):
    large = spark.range(200_000).select(F.col("id").cast("string").alias("sku_key"), F.col("id").alias("value"), F.lit("x").alias("hash"))
    small = spark.range(0, 200_000, 100).select(F.col("id").cast("string").alias("sku_key"), (F.col("id") + 1).alias("score"))
    bitmap, bits = bloom.build_filter(small, ["sku_key"])
    passed = bloom.maybe_in(large, bitmap, bits, ["sku_key"])
    assert passed.columns == large.columns
    assert 2000 <= passed.count() <= 2000 + 0.05 * 198_000
    found = bloom.filtered_join(large, small, ["sku_key"])
    assert found.count() == 2000 and found.where("score <> value + 1").count() == 0
    assert bloom.filtered_join(large, small, ["sku_key"], how="left_semi").columns == large.columns


def test_the_filter_stands_before_the_exchange(spark, plan):
    large = spark.range(1000).select(F.col("id").alias("k"))
    lines = [line for line in plan(bloom.filtered_join(large, spark.range(10).select(F.col("id").alias("k")), ["k"])).splitlines() if "Exchange" in line or "MapInArrow" in line]
    assert any("Exchange" in a and "MapInArrow" in b for a, b in zip(lines, lines[1:], strict=False))


def test_filters_of_nulls_nothing_and_too_much(spark):
    frame = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    empty = frame.limit(0)
    assert bloom.filtered_join(frame, empty.select("k"), ["k"]).count() == 0
    assert bloom.filtered_join(empty, frame.select("k"), ["k"]).count() == 0
    assert [r.v for r in bloom.filtered_join(frame, frame.select("k"), ["k"]).orderBy("v").collect()] == [2, 3]
    assert bloom.filter_size(10**12)[0] <= bloom.BROADCAST_BYTES and bloom.filter_size(10**12)[1] == 1
    with pytest.raises(ValueError):
        bloom.filtered_join(frame, frame.select("k"), ["k"], how="left")
    with pytest.raises(ValueError):
        bloom.filtered_join(frame, frame.select(F.length("k").alias("k")), ["k"])


def titles_with_hot_words(spark, rows, number):
    pick = random.Random(8)
    colours = ["red", "blue", "green"]
    listings = [(i, f"universal {pick.choice(colours)} w{pick.randrange(500)} w{pick.randrange(500)}") for i in range(rows)]
    queries = [(q, pick.choice(["universal thing", f"w{q} lamp", f"red w{q}", "nothing shared", "", None])) for q in range(number)]
    return spark.createDataFrame(listings + [(-1, None), (-2, "")], "row_id long, title string"), spark.createDataFrame(queries, "query_id long, reference_title string")


@pytest.mark.parametrize("number", [3, 150])
@pytest.mark.parametrize("share", [None, 0.0001, 1.0])
def test_hot_words_give_the_same_pairs(spark, number, share):
    listings, queries = titles_with_hot_words(spark, 400, number)
    found = [tuple(r) for r in hot_words.keyword_pairs(listings, queries, share).collect()]
    wanted = [tuple(r) for r in matching.keyword_prefilter(listings, queries).select("query_id", "row_id").collect()]
    assert sorted(found) == sorted(wanted) and len(set(found)) == len(found)


def test_pairs_are_made_after_the_last_exchange(spark, plan):
    """One row per listing and 64 queries is shuffled, so no exchange stands above the one that makes pairs."""
    listings, _ = titles_with_hot_words(spark, 300, 1)
    queries = spark.range(-70, 130).select(F.col("id").alias("query_id"), F.lit("universal red").alias("reference_title"))
    pairs = matching.keyword_prefilter(listings, queries.unionAll(queries))
    assert pairs.count() == pairs.distinct().count() == 300 * 200
    steps = [line for line in plan(pairs).splitlines() if "Generate" in line or "Exchange hashpartitioning" in line]
    assert "Generate" in steps[0]


def test_titles_are_parsed_once_and_no_pair_is_shuffled(spark, plan):
    listings, queries = titles_with_hot_words(spark, 300, 70)
    steps = plan(hot_words.keyword_pairs(listings, queries))
    lines = [line for line in steps.splitlines() if "Generate" in line or "Exchange hashpartitioning" in line]
    assert "Generate" in lines[0] and "regexp_replace" not in steps


def test_a_word_of_every_title_is_hot(spark):
    listings, _ = titles_with_hot_words(spark, 5000, 1)
    words = listings.where("title <> ''").select(F.explode(F.split("title", " ")).alias("word"))
    assert set(hot_words.hot_words(words, 1 / 32)) == {"universal", "red", "blue", "green"}
    # What is left to the join is dealt out evenly.
    left = words.where(~F.col("word").isin("universal", "red", "blue", "green")).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(hot_words.SALTS)))
    sizes = sorted(r["count"] for r in left.repartition(8, "word", "salt").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_no_queries_no_pairs(spark):
    listings, queries = titles_with_hot_words(spark, 10, 2)
    assert hot_words.keyword_pairs(listings, queries.limit(0)).count() == 0
    assert hot_words.keyword_pairs(listings.limit(0), queries).count() == 0


def test_turned_copies_are_found(spark):
    side, state = 8, np.random.default_rng(6)
    base = state.normal(size=(400, side, side))
    images, planted = [(i, x) for i, x in enumerate(base)], set()
    turns = [lambda x: np.rot90(x), lambda x: np.rot90(x, 2), np.fliplr, np.flipud, lambda x: x, lambda x: x.T]
    for i in range(0, 400, 2):
        copy = turns[i // 2 % len(turns)](base[i]) + state.normal(scale=0.08, size=(side, side))
        images.append((1000 + i, copy))
        planted.add((i, 1000 + i))
    images += [(2000 + i, np.rot90(base[1], i)) for i in range(4)] + [(3000, np.zeros((side, side))), (3001, np.zeros((side, side)))]
    rows = [(i, [float(v) for v in x.ravel()]) for i, x in images]
    frame = spark.createDataFrame([*rows, (4000, None)], "image_id long, vector array<double>")
    pairs, members = rotations.turned_copies(frame, side, 0.9)
    found = {(r.id_a, r.id_b): r for r in pairs.collect()}
    # Brute force: all pairs of classes, correlated.
    home = {r.image_id: r.class_id for r in members.collect()}
    assert {home[2000 + i] for i in range(4)} == {1} and home[3001] == 3000 and 4000 not in home
    reps = frame.where(F.col("image_id").isin(sorted(set(home.values()))))
    every = reps.select(F.col("image_id").alias("id_a"), F.col("vector").alias("a")).join(
        reps.select(F.col("image_id").alias("id_b"), F.col("vector").alias("b")), F.col("id_a") < F.col("id_b")
    )
    brute = {(r.id_a, r.id_b) for r in orientation_corr(every, side).where("correlation >= 0.9").select("id_a", "id_b").distinct().collect()}
    assert set(found) <= brute and len(found) >= 0.9 * len(brute) and len(set(found) & planted) >= 0.9 * len(planted)


@pytest.mark.parametrize("side", [2, 5, 8])
def test_all_turned_copies_are_found_near_the_threshold(spark, side):
    """Clusters whose members correlate about as much as is asked for: none of the pairs may be lost."""
    state, maps = np.random.default_rng(12), rotations.symmetries(side)
    base = state.normal(size=(60, side * side))
    own = [base[i % 60][maps[i % 8]] + state.normal(scale=0.2, size=side * side) for i in range(420)]
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(own)], "image_id long, vector array<double>")
    pairs, _ = rotations.turned_copies(frame, side, 0.95)
    unit = np.array(own) - np.mean(own, axis=1, keepdims=True)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    best = np.max([unit @ unit[:, order].T for order in maps[:7]], axis=0)
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {(int(a), int(b)) for a, b in zip(*np.nonzero(best >= 0.95), strict=True) if a < b}


def test_many_near_copies_do_not_make_all_pairs(spark):
    side, state = 8, np.random.default_rng(7)
    one = state.normal(size=side * side)
    rows = [(i, [float(v) for v in one + state.normal(scale=1e-6, size=side * side)]) for i in range(600)]
    codes = rotations.codes_of(spark.createDataFrame(rows, "image_id long, vector array<double>"), side).select(F.col("image_id").alias("class_id"), "codes")
    assert rotations.proposed_pairs(codes).count() <= 30 * len(rows)


# --- hot SKUs, wide vectors, preparation ---------------------------------------------


def hot_skus(spark, rows=30_000):
    """Two thirds of the rows have one SKU."""
    sku = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
    return spark.range(rows).select(sku.alias("sku"), F.col("id").alias("row_id"))


def largest_share(frame):
    sizes = sorted(row["count"] for row in frame.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1] / sum(sizes)


@pytest.mark.parametrize("bound", [None, 0])
def test_a_hot_sku_is_spread_without_a_bound(spark, monkeypatch, bound):
    matches = hot_skus(spark)
    attributes = hot_skus(spark).select("sku", "row_id", (F.col("row_id") * 2).alias("Best_Stock"))
    names = hot_skus(spark).select(F.concat("sku", F.lit(".png")).alias("file_name"))
    if bound is not None:
        monkeypatch.setattr(sizing, "BROADCAST_BYTES", bound)
    enriched = report.enrich_attributes(matches, attributes)
    paths = cache.local_image_path(matches, names, "images")
    if bound is not None:
        # Small neighbours stay apart, so that a task is what one key makes of it.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert largest_share(enriched) < 0.35 and largest_share(paths) < 0.35
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert enriched.count() == paths.count() == 30_000
    assert enriched.where("sku = 'hot' AND Best_Stock <> 59998").count() == 0 and enriched.where("Best_Stock IS NULL").count() == 0
    assert paths.where("image_path <> concat('images/', sku, '.png')").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_spread_joins_are_joins(spark, monkeypatch, how, bound):
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", bound)
    large = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, _salt int")
    small = spark.createDataFrame([("a", "x"), (None, "n"), ("c", "y")], "k string, v string")
    wanted = sorted(map(str, large.join(small, "k", how).collect()))
    assert sorted(map(str, sizing.join_spread(large, small, ["k"], how).collect())) == wanted


def test_wide_vectors_are_multiplied_in_bounded_pieces(monkeypatch):
    seen = []
    dots = vectors.exact_dots
    monkeypatch.setattr(vectors, "exact_dots", lambda a, b: seen.append(a.nbytes + b.nbytes) or dots(a, b))
    monkeypatch.setattr(vectors, "BYTES_AT_ONCE", 1 << 20)
    state = np.random.default_rng(1)
    queries, images = state.normal(size=(64, 512)), state.normal(size=(900, 512))
    best = vectors.RunningBest(queries, 900)
    best.add(images, np.arange(900), np.array(["k"] * 900))
    cols, scores, ids, _ = best.cut()
    assert max(seen) <= 1 << 20 and len(cols) == 64 * 900
    assert np.allclose(scores, (queries[cols] * images[ids]).sum(axis=1))


def test_damaged_and_absent_files_are_fetched(spark):
    listings = spark.createDataFrame(
        [(i, f"S{i}", "red ring" if i < 6 else "blue lamp", 5.0, f"https://h{i % 2}/x") for i in range(1, 9)],
        "row_id long, sku string, title string, price double, image_url string",
    ).withColumn("text_vec_id", F.lit(None).cast("long"))
    manifest = spark.createDataFrame([(f"S{i}.jpg", f"images/S{i}.jpg", 0 if i == 2 else 9, 1) for i in range(1, 5)] + [(".x.jpg", "p", 1, 1)], "file_name string, path string, length long, mtime long")
    scan = spark.createDataFrame([("S1.jpg", 4), ("S4.jpg", 4)], "file_name string, width int")
    validity, slots = prepare_fetches(listings, manifest, scan, "images", workers=2, per_host=1, title="ring")
    assert {r.file_name: r.status for r in validity.collect()} == {"S1.jpg": "ok", "S2.jpg": "empty", "S3.jpg": "corrupt", "S4.jpg": "ok"}
    found = {r.sku: (r.reason, r.host) for r in slots.collect()}
    assert found == {"S2": ("damaged", "h0"), "S3": ("damaged", "h1"), "S5": ("absent", "h1")}
    assert slots.groupBy("round", "slot", "host").count().where("count > 1").count() == 0


def test_an_index_is_refreshed_only_where_something_changed(spark):
    rows = clustered(6, 400)
    images, folder = spark.createDataFrame(rows, IMAGE), new_shared_path(spark, "index")
    more = spark.createDataFrame([*rows, (900, "N", rows[0][2], "images/new", 1, 1), (901, "X", None, "images/none", 1, 1)], IMAGE)
    assert [refresh_index(spark, folder, own) for own in (images, images, more, more)] == [1, 1, 2, 2]
    assert refresh_index(spark, folder, images, no_indexing=True) == 2
    assert cells.indexed(spark, folder).count() == 401
