"""Paths, lists, prices and labels."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscout.functions import fields
from twinscout.functions.text import sku_key, strip


def one(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in rows.select(expression).collect()]


def test_file_stem(spark):
    paths = ["dir/a.b.jpg", "dir/.jpg", "d.x/Z1", "Z2.png", "a..jpg", "..jpg", ""]
    assert one(spark, paths, fields.file_stem(F.col("x"))) == ["a.b", ".jpg", "Z1", "Z2", "a.", "..jpg", ""]


def test_strip_and_key(spark):
    assert one(spark, [" \tz1\n", " z2\x1f"], strip(F.col("x"))) == ["z1", "z2"]
    assert one(spark, [" z1\t"], sku_key(F.col("x"))) == ["Z1"]


def test_query_images(spark):
    assert one(spark, [" a.jpg ; ;b.jpg;", "", ";"], fields.query_image_list(F.col("x"))) == [["a.jpg", "b.jpg"], [], []]


def test_image_urls(spark):
    urls = ["a; b ;;c", "a,b", "a,b;c", "", None]
    assert one(spark, urls, F.size(fields.image_url_list(F.col("x")))) == [3, 2, 2, 0, 0]


def test_price_label_rounds_half_to_even(spark):
    prices = [2.5, 3.5, 0.0, None, 1234.4, 0.4]
    labels = ["AED 2", "AED 4", "N/A", "N/A", "AED 1234", "AED 0"]
    assert one(spark, prices, fields.price_label(F.col("x")), "double") == labels
    assert one(spark, prices, fields.shown_price(F.col("x")), "double") == [2.0, 4.0, None, None, 1234.0, 0.0]


def test_price_parsing(spark):
    cells = [" 12 ", "12d", "1,000", "nan", None, "12.0", ".5", "+5", "inf", "1e3", "AED 5", "", "1f"]
    expected = [12.0, None, None, None, None, 12.0, 0.5, 5.0, float("inf"), 1000.0, None, None, None]
    assert one(spark, cells, fields.parse_price(F.col("x"), T.StringType())) == expected
    assert one(spark, [float("nan"), 3.0], fields.parse_price(F.col("x"), T.DoubleType()), "double") == [None, 3.0]


def test_whole_numbers_as_text(spark):
    assert one(spark, [1.0, 1e7, 2.5], fields.as_text(F.col("x"), T.DoubleType()), "double") == ["1", "10000000", "2.5"]


def test_match_count_label(spark):
    assert one(spark, ["3.0", "", None, "12"], fields.match_count_label(F.col("x"), T.StringType())) == [
        "3 SKU", "1 SKU", "1 SKU", "12 SKU",
    ]
    assert one(spark, [3.0, 0.0, None], fields.match_count_label(F.col("x"), T.DoubleType()), "double") == [
        "3 SKU", "0 SKU", "1 SKU",
    ]
