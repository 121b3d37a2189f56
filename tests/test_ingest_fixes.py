"""Cells that ingest must not change, prices that are not numbers, and the shared folder."""

import csv

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscout.functions.fields import as_text, match_count_label
from twinscout.operators.matching import in_price_range
from twinscout.sources import shared
from twinscout.sources.listings import _layouts, find_tables, list_entries, load_listings, read_table
from twinscout.sources import images as image_source


def test_csv_keeps_quotes_commas_and_line_breaks(spark, tmp_path):
    titles = ['5" ring, blue', 'TV 55"', "two\nlines", 'a "quoted" word']
    path = tmp_path / "t.csv"
    with path.open("w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(["SKU", "Title", "Price"])
        writer.writerows([str(at), title, "10"] for at, title in enumerate(titles))
    rows = read_table(spark, [str(path)]).orderBy("SKU").collect()
    assert [(row.Title, row.Price) for row in rows] == [(title, "10") for title in titles]


def test_tables_with_an_underscore_are_reported(spark, tmp_path):
    (tmp_path / "_hidden.csv").write_text("SKU\n1\n")
    with pytest.warns(UserWarning, match="_hidden.csv"):
        assert list_entries(spark, str(tmp_path)) == []


def test_numbers_as_text_have_no_exponent(spark):
    values = [1000000000000001.0, 12345678.5, 2.0, 0.5, -1e16, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        as_text(F.col("v"), T.DoubleType()).alias("t"), match_count_label(F.col("v"), T.DoubleType()).alias("m")
    ).collect()
    assert [row.t for row in rows] == ["1000000000000001", "12345678.5", "2", "0.5", "-10000000000000000", None]
    assert rows[1].m == "12345678 SKU"


def test_nan_price_fails_a_set_bound(spark):
    df = spark.createDataFrame([(float("nan"), 10.0, None), (float("nan"), None, None), (11.0, 10.0, None)], "p double, a double, b double")
    kept = df.select(in_price_range(F.col("p"), F.col("a"), F.col("b")).alias("k")).collect()
    assert [row.k for row in kept] == [False, True, True]


def test_shared_folder_needs_a_shared_place(spark, monkeypatch):
    assert shared.shared_folder(spark)

    class Conf:
        def get(self, *_):
            return None

    class Empty:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Empty)})

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(session)


def test_a_table_is_cut_into_pieces_unless_a_cell_has_a_line_break(spark, tmp_path):
    def table(name, rows):
        with (tmp_path / name).open("w", newline="") as file:
            writer = csv.writer(file)
            writer.writerow(["SKU", "Title"])
            writer.writerows(rows)

    table("a.csv", [(f"a{at}", 'say "hi", you') for at in range(4000)])
    table("b.csv", [(f"b{at}", "two\nlines" if at == 3000 else "one") for at in range(4000)])
    table("c.csv", [(f"c{at}", "x") for at in range(4000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        loaded = load_listings(spark, str(tmp_path))
        found = loaded.select("source_file", "sku", "title", F.spark_partition_id().alias("task")).collect()
        for name, kept in (("a.csv", 'say "hi", you'), ("b.csv", "one"), ("c.csv", "x")):
            own = [row for row in found if row.source_file == name]
            assert len(own) == 4000 and sum(row.title == kept for row in own) >= 3999
        assert [row.title for row in found if row.sku == "b3000"] == ["two\nlines"]
        in_pieces = read_table(spark, [str(tmp_path / "a.csv")], multi_line=False)
        assert in_pieces.rdd.getNumPartitions() > 1
        layouts = {name for pieces, _, group in _layouts(spark, find_tables(spark, str(tmp_path)), None) if pieces for name, _ in group}
        assert layouts == {"a.csv", "c.csv"}
        assert loaded.agg(F.count_distinct("row_id"), F.max("row_id")).first() == (12_000, 12_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_jobs_do_not_grow_with_the_number_of_tables(spark, tmp_path):
    def jobs(count):
        folder = tmp_path / f"with{count}"
        for at in range(count):
            spark.range(3).selectExpr(f"concat('p{at}-', id) AS SKU", "'t' AS Title").coalesce(1).write.parquet(f"{folder}/p{at}.parquet")
            (folder / f"c{at}.csv").write_text("SKU,Title\nk,v\n")
            (folder / f"j{at}.json").write_text('{"SKU": "j", "Best_Title": "t"}\n')
        tracker, group = spark.sparkContext.statusTracker(), f"load{count}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            loaded = load_listings(spark, str(folder), row_ids=False)
            return len(tracker.getJobIdsForGroup(group)), loaded
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    few, _ = jobs(2)
    many, loaded = jobs(12)
    assert many <= few + 1
    assert {row.source_file: row.n for row in loaded.groupBy("source_file").agg(F.count("*").alias("n")).collect()} == {
        f"{kind}{at}.{ending}": n for kind, ending, n in (("p", "parquet", 3), ("c", "csv", 1), ("j", "json", 1)) for at in range(12)
    }
    assert "map(" not in loaded._jdf.queryExecution().analyzed().toString()


def test_small_images_are_many_to_a_task(spark, sf_dir, tmp_path):
    """400 files are scanned by as many tasks as there are cores, and the session's setting is what it was."""
    for at in range(400):
        (tmp_path / f"z{at}.jpg").write_bytes(b"no image")
    before = spark.conf.get(image_source.OPEN_COST)
    scan = image_source.image_scan(spark, str(tmp_path))
    assert spark.conf.get(image_source.OPEN_COST) == before
    assert scan.count() == 400 and scan.where("width IS NULL").count() == 400
    assert len(scan.inputFiles()) <= 10
