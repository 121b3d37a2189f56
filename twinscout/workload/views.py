"""Listing-shaped views over the supplied tables.  Every view covers its whole table."""

from __future__ import annotations

import re
import struct

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscout.operators.sizing import dealt
from twinscout.plans.search import one_query
from twinscout.sources.shared import materialized, new_shared_path

IMAGE_DIR = "images"
VECTOR_WIDTH = 64
VECTOR_SIDE = 8

# The flagship query.
FLAGSHIP_TITLE = "small ring X1"
FLAGSHIP_IMAGES = (0, 365)
FLAGSHIP_TITLE_VECTOR = 3
FLAGSHIP = {
    "images": "query/front.jpg; query/back.jpg",
    "title": FLAGSHIP_TITLE,
    "top": 500,
    "min_score": 0.10,
    "min_text_sim": 0.05,
    "min_price": 900.0,
    "max_price": 960.0,
}


# Declared, so that no job has to look the schema up first.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string",
    "events": "event_id bigint, user_id bigint, event_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def title_column() -> Column:
    model = F.concat(F.lit("X"), (F.col("p_size") % 5).cast("string"))
    pro = F.when(F.col("p_size") % 4 == 0, F.lit("Pro"))
    return F.concat_ws(" ", "p_name", model, "p_brand", "p_type", pro)


def sku_column(number: str) -> Column:
    return F.concat(F.lit("Z"), F.col(number).cast("string"))


def image_url_column() -> Column:
    """Mostly a URL; some sizes stand for a missing one in its three forms."""
    return (
        F.when(F.col("p_size") == 1, F.lit("nan"))
        .when(F.col("p_size") == 2, F.lit(" "))
        .when(F.col("p_size") != 3, F.concat(F.lit("https://img.example/"), sku_column("p_partkey")))
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a catalog."""
    vectors = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key + 1).alias("row_id"),
        sku_column("p_partkey").alias("sku"),
        title_column().alias("title"),
        F.col("p_retailprice").alias("price"),
        image_url_column().alias("image_url"),
        F.col("p_type").alias("source_file"),
        F.col("p_brand").alias("brand"),
        (key % vectors).alias("image_vec_id"),
        ((key * 7 + 3) % vectors).alias("text_vec_id"),
    )


def dealt_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers and titles of the catalog, spread over all tasks: a million of them is one split of the table."""
    return dealt(listings(spark, sf_dir).select("row_id", "title"), "row_id")


def document_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a catalog whose titles are whole texts."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("row_id"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("sku"),
        F.col("text").alias("title"),
        F.col("source").alias("source_file"),
    )


def neighbours(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every row's ``value`` as ``mine`` next to that of its successor as ``theirs``."""
    here = df.select(key, F.col(value).alias("mine"))
    after = df.select((F.col(key) - 1).alias(key), F.col(value).alias("theirs"))
    return here.join(after, key)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cached image with its vector per listing."""
    catalog = listings(spark, sf_dir).select(
        F.col("row_id").alias("image_id"), F.upper("sku").alias("sku_key"), "image_vec_id"
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_vec_id"), F.col("embedding").alias("vector")
    )
    return catalog.join(vectors, "image_vec_id").select("image_id", "sku_key", "vector")


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("text_vec_id"), F.col("embedding").alias("vector")
    )


def flagship_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the flagship's two query images."""
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*FLAGSHIP_IMAGES))
    return vectors.select(
        F.lit(1).cast("bigint").alias("query_id"),
        F.col("vec_id").alias("position"),
        F.col("embedding").alias("vector"),
    )


def flagship_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == FLAGSHIP_TITLE_VECTOR)
    title_vector = vector.select(F.col("embedding").cast("array<double>")).first()[0]
    return one_query(spark, **FLAGSHIP, title_vector=title_vector)


def lead_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last listing of every brand and source: the batch's queries."""
    catalog = listings(spark, sf_dir)
    facts = F.struct("row_id", "sku", "title", "image_vec_id", "text_vec_id")
    return catalog.groupBy("brand", "source_file").agg(
        F.min_by(facts, "row_id").alias("lead"), F.max_by(facts, "row_id").alias("last")
    )


def batch_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, query vectors): one query per brand and source of the catalog, with
    knobs that differ by source.

    PROMO queries give no title but name a cached SKU; LARGE ones give neither, so
    their title is that of the best visual hit; SMALL ones ask for few matches,
    STANDARD ones are strict, ECONOMY ones have price bounds and the default text
    threshold.
    """
    leads = materialized(lead_listings(spark, sf_dir))
    kind = F.col("source_file")
    named = F.concat(
        F.lit("query/"), F.col("lead.sku"), F.lit(".jpg; query/"), F.col("last.sku"), F.lit(".png")
    )
    upload = F.concat(F.lit("query/upload-"), F.col("lead.row_id").cast("string"), F.lit(".jpg"))
    untitled = kind.isin("PROMO", "LARGE")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    titled = leads.join(
        vectors.select(
            F.col("vec_id").alias("_vec"), F.col("embedding").cast("array<double>").alias("_title")
        ),
        F.col("lead.text_vec_id") == F.col("_vec"),
    )
    queries = titled.select(
        F.col("lead.row_id").alias("query_id"),
        F.when(kind == "LARGE", upload).otherwise(named).alias("images"),
        F.when(untitled, F.lit("")).otherwise(F.col("lead.title")).alias("title"),
        F.when(~untitled, F.col("_title")).alias("title_vector"),
        F.when(kind == "SMALL", F.lit(5)).otherwise(F.lit(500)).alias("top"),
        F.lit(0.10).alias("min_score"),
        F.when(kind == "ECONOMY", F.lit(0.0)).otherwise(F.lit(0.05)).alias("min_text_sim"),
        (kind == "STANDARD").alias("strict"),
        F.when(kind == "ECONOMY", F.lit(900.0)).alias("min_price"),
        F.when(kind == "ECONOMY", F.lit(1500.0)).alias("max_price"),
    )
    shown = leads.select(
        F.col("lead.row_id").alias("query_id"),
        F.posexplode(F.array_distinct(F.array("lead.image_vec_id", "last.image_vec_id"))).alias(
            "position", "vec_id"
        ),
    )
    query_vectors = shown.join(vectors, "vec_id").select(
        "query_id", "position", F.col("embedding").alias("vector")
    )
    return materialized(queries), materialized(query_vectors)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` passages as reference titles."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("reference_title")
    )


def batch_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leads' titles as reference titles."""
    return lead_listings(spark, sf_dir).select(
        F.col("lead.row_id").alias("query_id"), F.col("lead.title").alias("reference_title")
    )


def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached files: none for PROMO listings, ``.png`` for SMALL ones, empty for one
    brand."""
    parts = table(spark, sf_dir, "part").where(F.col("p_type") != "PROMO")
    ending = F.when(F.col("p_type") == "SMALL", F.lit(".png")).otherwise(F.lit(".jpg"))
    name = F.concat(sku_column("p_partkey"), ending)
    length = F.when(F.col("p_brand") == "Brand#13", F.lit(0)).otherwise(F.col("p_size") * 1000)
    return parts.select(
        name.alias("file_name"),
        F.concat(F.lit(IMAGE_DIR + "/"), name).alias("path"),
        length.cast("bigint").alias("length"),
        (F.col("p_size") + 1_700_000_000).cast("bigint").alias("mtime"),
        F.col("p_brand").alias("brand"),
    )


def indexed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector index as of an earlier state: PROMO files still there, Brand#1 not yet,
    Brand#2 with older times, Brand#3 with other lengths."""
    parts = table(spark, sf_dir, "part").where(F.col("p_brand") != "Brand#1")
    ending = F.when(F.col("p_type") == "SMALL", F.lit(".png")).otherwise(F.lit(".jpg"))
    length = F.when(F.col("p_brand") == "Brand#13", F.lit(0)).otherwise(F.col("p_size") * 1000)
    older = F.when(F.col("p_brand") == "Brand#2", F.lit(1)).otherwise(F.lit(0))
    longer = F.when(F.col("p_brand") == "Brand#3", F.lit(1)).otherwise(F.lit(0))
    return parts.select(
        F.concat(F.lit(IMAGE_DIR + "/"), sku_column("p_partkey"), ending).alias("path"),
        (length + longer).cast("bigint").alias("length"),
        (F.col("p_size") + 1_700_000_000 - older).cast("bigint").alias("mtime"),
    )


def _vectors_of_files(files: DataFrame, vectors: DataFrame) -> DataFrame:
    stem = F.upper(F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1))
    return files.select("path", "length", "mtime", stem.alias("sku_key")).join(vectors, "sku_key")


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cached file with its vector."""
    return _vectors_of_files(image_manifest(spark, sf_dir), images(spark, sf_dir))


def earlier_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the index's earlier state; those changed since had another vector."""
    now = image_manifest(spark, sf_dir).select("path", F.col("length").alias("now_length"), F.col("mtime").alias("now_mtime"))
    rows = _vectors_of_files(indexed_images(spark, sf_dir), images(spark, sf_dir)).join(now, "path", "left")
    same = (F.col("length") == F.col("now_length")) & (F.col("mtime") == F.col("now_mtime"))
    vector = F.when(F.coalesce(same, F.lit(True)), F.col("vector")).otherwise(F.reverse("vector"))
    return rows.withColumn("vector", vector).drop("now_length", "now_mtime")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as answers to fetches; a sign-up stands for one still open."""
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click"), F.lit(200)).when(kind == "purchase", F.lit(404))
    content = F.when(kind == "view", F.lit("image/jpeg")).when(kind == "click", F.lit("text/HTML; charset=utf-8"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("user_id").alias("run_id"),
        sku_column("event_id").alias("sku"),
        status.alias("status"),
        content.alias("content_type"),
        F.when(kind == "error", F.lit("timed out")).alias("error"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as attribute rows: several per SKU, in two spellings."""
    status = F.col("o_orderstatus")
    sku = sku_column("o_custkey")
    separator = F.when(status == "O", F.lit(" ; ")).otherwise(F.lit(", "))
    url = F.concat(F.lit("https://img.example/"), F.col("o_orderkey").cast("string"), separator)
    return table(spark, sf_dir, "orders").select(
        F.when(status == "F", F.lower(sku)).otherwise(sku).alias("sku"),
        (F.col("o_orderkey") + 1).alias("row_id"),
        F.when(status == "P", F.concat(F.lit("ZZ"), F.col("o_orderkey").cast("string"))).alias("Best_ZSKU"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("Best_Brand"),
        F.when(status != "O", status).alias("Best_Color"),
        (F.col("o_orderkey") % 4).cast("int").alias("Best_Stock"),
        F.col("o_totalprice").alias("Match_Count"),
        F.expr("nullif(o_orderstatus, 'F')").alias("Best_Product_URL"),
        F.repeat(url, (F.col("o_orderkey") % 9).cast("int")).alias("Combined_All_Image_URLs"),
    )


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector next to its successor, read as 8 x 8 images."""
    here = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id_a"), F.col("embedding").alias("a")
    )
    after = here.select(
        (F.col("id_a") - 1).alias("id_a"), F.col("id_a").alias("id_b"), F.col("a").alias("b")
    )
    return here.join(after, "id_a")


def turned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as an image, and a copy that is turned by 180 degrees, mirrored or as it is, by label, with some
    of the second half of its elements mixed in."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    turned = F.when(F.col("label") % 3 == 0, F.reverse("vector")).when(
        F.col("label") % 3 == 1,
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(VECTOR_SIDE - 1)), lambda row: F.reverse(F.slice("vector", row * VECTOR_SIDE + 1, VECTOR_SIDE)))),
    ).otherwise(F.col("vector"))
    mixed = F.zip_with(turned, F.col("vector"), lambda own, other: own + other / 50)
    copies = rows.select((F.col("vec_id") + 1_000_000).alias("image_id"), mixed.alias("vector"))
    return rows.select(F.col("vec_id").alias("image_id"), "vector").unionByName(copies)


def bitmap_content() -> Column:
    """An embedding drawn as a small gray BMP; two labels stand for an empty file and
    for one that is not an image."""
    side = VECTOR_SIDE
    header = struct.pack("<2sIHHI", b"BM", 54 + side * side * 3, 0, 0, 54)
    header += struct.pack("<IiiHHIIiiII", 40, side, side, 1, 24, 0, side * side * 3, 2835, 2835, 0, 0)
    gray = F.transform("embedding", lambda x: F.repeat(F.lpad(F.hex(((x + 1) * 127).cast("int")), 2, "0"), 3))
    bitmap = F.unhex(F.concat(F.lit(header.hex()), F.array_join(gray, "")))
    return (
        F.when(F.col("label") == 0, F.lit(b""))
        .when(F.col("label") == 1, F.lit(b"<html>not found</html>"))
        .otherwise(bitmap)
    )


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write every embedding as an image file into the shared folder, one file per row,
    from the tasks that hold the rows."""
    folder = re.sub("^file:/+", "/", new_shared_path(spark, "images"))

    def write(rows) -> None:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{root}/{row.file_name}") as out:
                out.write(row.content)

    files = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("z"), F.col("vec_id").cast("string"), F.lit(".bmp")).alias("file_name"),
        bitmap_content().alias("content"),
    )
    dealt(files, "file_name").foreachPartition(write)
    return folder


def image_folder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("z"), F.col("vec_id").cast("string"), F.lit(".bmp")).alias("file_name"),
        F.length(bitmap_content()).cast("bigint").alias("length"),
    )


def listing_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write the catalog as one table per source, in differing layouts and formats, rows
    in key order."""
    folder = new_shared_path(spark, "listings")
    catalog = listings(spark, sf_dir).select(
        F.col("sku").alias("Input_SKU"),
        F.concat(F.lit("B"), "sku").alias("Best_ZSKU"),
        F.col("title").alias("Best_Title"),
        F.col("price").alias("Best_Price"),
        F.col("brand").alias("Best_Brand"),
        "source_file",
        "row_id",
    )
    layouts = {
        "ECONOMY.parquet": {},
        "LARGE.parquet": {},
        "MEDIUM.csv": {"Best_Title": "Title", "Best_Price": "Standard_Price"},
        "PROMO.json": {"Input_SKU": "SKU", "Best_Title": "Standard_Title"},
        "SMALL.parquet": {"Input_SKU": "Standard_ZSKU", "Best_Price": "Price"},
        "STANDARD.csv": {},
    }
    for name, renames in layouts.items():
        part = catalog.where(F.col("source_file") == name.split(".")[0])
        ordered = part.repartitionByRange("row_id").sortWithinPartitions("row_id")
        writer = ordered.drop("row_id", "source_file").withColumnsRenamed(renames).write
        kind = name.split(".")[1]
        if kind == "csv":
            writer = writer.option("header", True)
        writer.format(kind).save(f"{folder}/{name}")
    return folder
