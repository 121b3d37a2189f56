"""Layouts, union, row numbers and file sources."""

import pytest
from pyspark.sql import functions as F

from twinscout.operators import listings as tables
from twinscout.sources import listings as source
from twinscout.sources.matches import read_matches


def frame(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_alias_precedence(spark):
    both = tables.normalize_columns(frame(spark, Input_SKU="i", Best_ZSKU="z"))
    assert both.columns == ["SKU", "Best_ZSKU"] and both.first().SKU == "i"
    assert tables.normalize_columns(frame(spark, Best_ZSKU="z")).columns == ["SKU"]
    assert tables.normalize_columns(frame(spark, SKU="s", Input_SKU="i")).columns == ["SKU", "Input_SKU"]


def test_columns_differing_in_case_are_refused(spark):
    pair = spark.createDataFrame([("a", "b")], "SKU string, sku string")
    with pytest.raises(ValueError, match="differ only in case"):
        tables.normalize_columns(pair)


def test_union_of_differing_types(spark):
    first = spark.createDataFrame([(1,), (2,)], "SKU int")
    second = spark.createDataFrame([("z3", "red")], "SKU string, Color string")
    rows = tables.union_evolving([first, second]).collect()
    assert sorted((r.SKU, r.Color) for r in rows) == [("1", None), ("2", None), ("z3", "red")]
    with pytest.raises(ValueError):
        tables.union_evolving([])


def test_sku_profile_counts_null_skus_as_duplicates(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "SKU string")
    assert tuple(tables.sku_profile(rows).first()) == (3, 1, 2)


def test_last_row_per_sku_with_a_hot_sku(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("sku"),
        F.col("id").alias("row_id"), (F.col("id") * 2).alias("value"),
    )
    last = tables.last_row_per_sku(rows)
    assert last.count() == 20_001
    assert last.where("sku = 'hot'").first().value == 2 * 29_997


@pytest.fixture()
def folder(spark, tmp_path):
    rows = spark.range(0, 1000).select(
        F.concat(F.lit("s"), "id").alias("SKU"), F.col("id").cast("double").alias("Price"), F.lit("ring").alias("Title")
    )
    rows.repartitionByRange(4, "Price").sortWithinPartitions("Price").write.parquet(f"{tmp_path}/b.parquet")
    rows.limit(3).coalesce(1).write.option("header", True).csv(f"{tmp_path}/a.csv")
    rows.select(F.col("SKU").alias("Best_ZSKU"), F.col("Title").alias("Best_Title")).limit(2).coalesce(1).write.json(
        f"{tmp_path}/c.json"
    )
    (tmp_path / "d.parquet").write_bytes(b"this is no parquet file")
    (tmp_path / "notes.txt").write_text("not a table")
    return str(tmp_path)


def test_load_listings(spark, folder):
    with pytest.warns(UserWarning, match="d.parquet"):
        loaded = source.load_listings(spark, folder)
    rows = {r.row_id: r for r in loaded.collect()}
    assert sorted(rows) == list(range(1, 1006))
    assert [rows[i].source_file for i in (1, 3, 4, 1003, 1004)] == ["a.csv", "a.csv", "b.parquet", "b.parquet", "c.json"]
    assert all(rows[i + 4].sku == f"s{i}" for i in range(1000))
    assert rows[1].price == 0.0 and rows[1005].sku == "s1" and rows[1005].title == "ring"


def test_price_filter_reaches_the_scan(spark, folder, plan):
    from twinscout.operators.matching import price_range

    kept = price_range(spark.read.parquet(f"{folder}/b.parquet").withColumnRenamed("Price", "price"), 10, 20)
    assert kept.count() == 11
    assert "GreaterThanOrEqual(Price,10.0)" in plan(kept) and "LessThanOrEqual(Price,20.0)" in plan(kept)


def test_row_ids_do_not_depend_on_filters(spark, folder):
    loaded = source.load_listings(spark, f"{folder}/b.parquet").where("price >= 500")
    assert loaded.agg(F.min("row_id"), F.count("*")).first() == (501, 500)


def test_text_table_split_over_blocks_keeps_its_order(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("SKU,Title\n" + "".join(f"k{i},{'x' * 50}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        loaded = source.load_listings(spark, str(path))
        assert loaded.where("sku <> concat('k', row_id - 1)").count() == 0
        assert loaded.agg(F.countDistinct("row_id"), F.max("row_id")).first() == (20_000, 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_workbook_falls_back_to_its_first_table(spark, tmp_path):
    book = tmp_path / "book"
    spark.createDataFrame([("a", "ring")], "Best_ZSKU string, Title string").write.parquet(f"{book}/All.parquet")
    (book / f"{source.CURATED_TABLE}.parquet").write_bytes(b"broken")
    with pytest.warns(UserWarning, match="skipped"):
        assert source.prefer_curated_table(spark, str(book)).first().SKU == "a"
    assert source.combine_listings(spark, str(tmp_path)).columns == ["Best_ZSKU", "Title", "Source File"]
    with pytest.warns(UserWarning, match="skipped"):
        rows = source.load_listings(spark, str(tmp_path)).collect()
    assert [(r.row_id, r.sku, r.source_file) for r in rows] == [(1, "a", "book")]


def test_empty_and_unreadable_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        source.load_listings(spark, str(tmp_path))
    (tmp_path / "d.parquet").write_bytes(b"broken")
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        source.load_listings(spark, str(tmp_path))


def test_pattern_ignores_case_beyond_ascii(spark):
    from twinscout.operators.matching import title_contains

    rows = spark.createDataFrame([("CAFÉ Massager",), (None,), ("other",)], "title string")
    assert title_contains(rows, "café").count() == 1 and title_contains(rows, "massager").count() == 1


def test_missing_matches_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        read_matches(spark, f"{tmp_path}/none").count()
