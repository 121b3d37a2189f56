"""Image cache, fetch planning and report."""

import zlib
import struct

import pytest
from pyspark.sql import functions as F

from twinscout.operators import cache, report
from twinscout.sources.images import image_listing, image_scan


def png(width, height):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\x00" + b"\x7f" * width for _ in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture()
def folder(tmp_path):
    files = {"z1.png": png(3, 2), "empty.jpg": b"", "broken.jpg": b"<html>", "_z2.png": png(1, 1), "a b+c.png": png(4, 4)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path, files


def test_image_status(spark, folder):
    path, files = folder
    scan = image_scan(spark, str(path))
    sizes = {r.file_name: (r.sku_key, r.width, r.height) for r in scan.collect()}
    assert sizes["z1.png"] == ("Z1", 3, 2) and sizes["broken.jpg"] == ("BROKEN", None, None)
    assert sizes["a b+c.png"] == ("A B+C", 4, 4)
    manifest = spark.createDataFrame(
        [(n, len(c)) for n, c in files.items()] + [(".hidden", 5)], "file_name string, length bigint"
    )
    status = {r.file_name: r.status for r in cache.image_validity(manifest, scan).collect()}
    # Spark's readers pass over the name with the underscore; the manifest still lists it.
    assert status == {"z1.png": "ok", "empty.jpg": "empty", "broken.jpg": "corrupt", "_z2.png": "corrupt", "a b+c.png": "ok"}
    listed = {r.file_name for r in image_listing(spark, str(path)).collect()}
    assert "z1.png" in listed and "empty.jpg" not in listed
    listing = image_listing(spark, str(path))
    assert cache.index_delta(listing, listing.where("file_name <> 'z1.png'")).first().action == "add"


def test_fetch_plan(spark):
    rows = [
        (3, "a", "u3"), (1, " a ", "u1"), (2, "b", "NaN"), (4, "", "u4"), (5, "c", " "), (6, None, "u6"),
        (7, "d", None), (8, "e", "u8"), (9, "E", "u9"),
    ]
    catalog = spark.createDataFrame(rows, "row_id int, sku string, image_url string")
    have = spark.createDataFrame([("e.jpg",), ("a.png",)], "file_name string")
    plan = {r.sku: (r.image_url, r.dest) for r in cache.missing_images(catalog, have, "img/").collect()}
    assert plan == {"a": ("u1", "img/a.jpg"), "E": ("u9", "img/E.jpg")}


def test_progress_truncates_the_floating_percentage(spark):
    log = spark.range(100).select(
        F.lit(1).alias("run_id"), F.when(F.col("id") < 29, F.lit(200)).alias("status"),
        F.lit("image/png").alias("content_type"), F.lit(None).cast("string").alias("error"),
    )
    assert tuple(cache.fetch_progress(log).first()) == (1, 29, 100, 28)


def scope(spark, titles, *wanted):
    catalog = spark.createDataFrame(list(enumerate(titles)), "row_id int, title string")
    asked = spark.createDataFrame(list(enumerate(wanted)), "query_id int, reference_title string")
    return sorted(r.row_id for r in cache.keyword_fetch_scope(catalog, asked).collect())


def test_fetch_scope(spark):
    titles = ["red ring", "blue plate", None, "", "gold RING"]
    assert scope(spark, titles, "ring x6") == [0, 4]
    assert scope(spark, titles, "spoon") == [0, 1, 2, 3, 4]
    assert scope(spark, titles, "") == [0, 1, 2, 3, 4]
    assert scope(spark, titles, "ring", "plate") == [0, 1, 4]
    assert scope(spark, titles, "ring", "spoon") == [0, 1, 2, 3, 4]


def test_index_delta(spark):
    kind = "path string, length bigint, mtime bigint"
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 5), ("n", 1, 1)], kind)
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 4), ("g", 1, 1)], kind)
    delta = {r.path: r.action for r in cache.index_delta(now, old).collect()}
    assert delta == {"b": "update", "c": "update", "n": "add", "g": "remove"}
    assert cache.index_delta(now, old, no_indexing=True).count() == 0


def test_local_image_path(spark):
    rows = spark.createDataFrame([("a",), (" b",), ("c",)], "sku string")
    files = spark.createDataFrame([("a.jpg",), ("a.png",), ("b.png",), ("z.jpg",)], "file_name string")
    got = {r.sku: r.image_path for r in cache.local_image_path(rows, files, "img").collect()}
    assert got == {"a": "img/a.jpg", " b": "img/b.png", "c": cache.PLACEHOLDER}


def test_attribute_lookup_takes_first_spelling_and_last_row(spark):
    attributes = spark.createDataFrame(
        [("a1", 1, "one"), ("A1", 2, "two"), ("a1", 3, "three"), (None, 4, "none")],
        "sku string, row_id int, Best_Color string",
    )
    matches = spark.createDataFrame([(1, "A1"), (2, "b2"), (3, None)], "rank int, sku string")
    got = {r["rank"]: r.Best_Color for r in report.enrich_attributes(matches, attributes).collect()}
    assert got == {1: "three", 2: None, 3: None}


def test_card_defaults(spark):
    bare = spark.createDataFrame([("S1", 2.5, "p.jpg")], "sku string, price double, image_path string")
    card = report.card_fields(bare).first()
    assert (card.zsku, card.brand, card.tags, card.image_count) == ("S1", "Generic", ["Generic"], 0)
    assert (card.thumbnails, card.match_badge, card.price_label) == (["p.jpg"], "1 SKU", "AED 2")
    full = spark.createDataFrame(
        [("S1", 0.0, "", "red", 0, "a,b", "Z")],
        "sku string, price double, Best_Brand string, Best_Color string, Best_Stock int, "
        "Combined_All_Image_URLs string, Best_ZSKU string",
    )
    card = report.card_fields(full).first()
    assert (card.zsku, card.tags, card.image_count, card.price_label) == ("Z", ["", "red"], 2, "N/A")


def cards(spark):
    rows = [(1, 1, None), (1, 2, 0.0), (1, 3, 5.0), (1, 4, 7.0)]
    return spark.createDataFrame(rows, "query_id int, rank int, shown_price double")


@pytest.mark.parametrize(
    "order,expected", [("rank", [1, 2, 3, 4]), ("price-desc", [4, 3, 1, 2]), ("price-asc", [2, 3, 4, 1])]
)
def test_page_orders(spark, order, expected):
    rows = report.sort_report(cards(spark), order).orderBy("position").collect()
    assert [r["rank"] for r in rows] == expected
    with pytest.raises(ValueError):
        report.report_order("name")


def test_price_facet(spark):
    assert [r["rank"] for r in report.facet_price(cards(spark), None, 6).collect()] == [1, 2, 3]
    assert [r["rank"] for r in report.facet_price(cards(spark), 5, 0).collect()] == [3, 4]


def test_bounds_and_summary(spark):
    rows = spark.createDataFrame(
        [(1, 2.9, 0.5, 0.25), (1, 9.9, 0.0625, 0.7), (2, None, -0.5, 0.0)],
        "query_id int, price double, ai_score double, text_similarity double",
    )
    assert sorted(map(tuple, report.price_bounds(rows).collect())) == [(1, 2, 9), (2, 0, 999)]
    asked = spark.createDataFrame([(1,), (3,)], "query_id int")
    assert sorted(map(tuple, report.price_bounds(rows, asked).collect())) == [(1, 2, 9), (3, 0, 999)]
    assert sorted(map(tuple, report.result_summary(rows, asked).collect()))[1] == (3, 0, "N/A", "N/A")
    assert sorted(map(tuple, report.result_summary(rows).collect())) == [
        (1, 2, "0.500", "0.700"), (2, 1, "N/A", "N/A"),
    ]


def test_selection(spark):
    rows = spark.createDataFrame(
        [(1, 3, "c", "z1"), (1, 1, "a", "z1"), (1, 2, "b", "z2"), (1, 4, "d", "z9")],
        "query_id int, rank int, sku string, zsku string",
    )
    chosen = spark.createDataFrame([(1, "c"), (1, "a"), (1, "b"), (1, "a")], "query_id int, sku string")
    row = report.selection_export(rows, chosen).first()
    assert (row.sku_text, row.sku_count, row.zsku_text) == ("a\nb\nc", 3, "z1\nz2")
