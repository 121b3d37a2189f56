"""Listing files: discovery, reading with lineage, and row numbers."""

from __future__ import annotations

import csv
import json
import re
import warnings
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscout.operators.listings import (
    SOURCE_FILE, assign_row_id, normalize_columns, to_listings, union_evolving,
)
from twinscout.operators.sizing import broadcast_measured

# The table preferred inside a multi-table workbook.
CURATED_TABLE = "Best_One_Row_Per_SKU"
FORMATS = ("parquet", "csv", "json")
# Table footers looked up at a time.
LOOKUPS = 16

_SCHEME = "^[a-z0-9]+:/+"


def list_entries(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, full path, is directory) of a directory's entries in name order.  Reads
    the file system's listing only."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(conf).listStatus(folder)
    entries = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in found]
    for name, _, _ in entries:
        if name.startswith((".", "_")) and table_format(name):
            warnings.warn(f"skipped {name!r}: Spark reads no table whose name begins so; rename it", stacklevel=3)
    return sorted(e for e in entries if not e[0].startswith((".", "_")))


def table_format(name: str) -> str | None:
    """The format a file or directory name announces."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return suffix if suffix in FORMATS else None


def workbook_choices(spark: SparkSession, workbook: str, curated_first: bool = True) -> list[str]:
    """The tables of a workbook directory to try, best first: the curated one (if
    wanted), then the first by name."""
    tables = [(name, path) for name, path, _ in list_entries(spark, workbook) if table_format(name)]
    if not tables:
        raise FileNotFoundError(f"no tables in {workbook!r}")
    curated = [path for name, path in tables if name.rsplit(".", 1)[0] == CURATED_TABLE]
    return [*curated, tables[0][1]] if curated_first else [tables[0][1]]


def prefer_curated_table(spark: SparkSession, workbook: str) -> DataFrame:
    """The curated table of a workbook; if there is none or it cannot be read, the first
    by name.  Columns get their canonical names."""
    _, path, _, names, pieces = _readable(spark, [(workbook, workbook_choices(spark, workbook))])[0]
    return normalize_columns(read_table(spark, [path], not pieces, names))


def read_table(spark: SparkSession, paths: list[str], multi_line: bool = True, names: list[str] | None = None) -> DataFrame:
    """Read tables of one format and layout.  Text formats give text columns; with their ``names`` no job looks
    for them.

    CSV cells may hold doubled quotes, commas and line breaks.  A file whose cells hold no line
    break can be read in parallel pieces with ``multi_line=False``.
    """
    kind = table_format(_name(paths[0]))
    reader = spark.read
    if names is not None:
        reader = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in names]))
    if kind == "parquet":
        return reader.parquet(*paths)
    if kind == "csv":
        return reader.options(header=True, multiLine=multi_line, quote='"', escape='"').csv(paths)
    if kind == "json":
        return reader.option("primitivesAsString", True).json(paths)
    raise ValueError(f"unknown table format: {paths[0]!r}")


def find_tables(
    spark: SparkSession, path: str, curated_first: bool = True
) -> list[tuple[str, list[str]]]:
    """(source name, paths to try) of a single table, or of every table and workbook of
    a directory, in name order."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if table_format(name):
        return [(name, [path])]
    tables = []
    for entry, full, directory in list_entries(spark, path):
        if table_format(entry):
            tables.append((entry, [full]))
        elif directory:
            tables.append((entry, workbook_choices(spark, full, curated_first)))
    if not tables:
        raise FileNotFoundError(f"no listing tables in {path!r}")
    return tables


def _footer(spark: SparkSession, path: str) -> str:
    """The schema of a Parquet table as its first data file's footer has it.  No job: one small read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    if system.getFileStatus(where).isDirectory():
        names = sorted(s.getPath().toString() for s in system.listStatus(where) if not s.getPath().getName().startswith((".", "_")))
        if not names:
            raise ValueError("no data file")
        where = jvm.org.apache.hadoop.fs.Path(names[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        return reader.getFooter().getFileMetaData().getSchema().toString()
    finally:
        reader.close()


def _file_column():
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(encoded), _SCHEME, "/")


def _is_directory(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _header(line: str) -> list[str] | None:
    """The column names of a CSV header; none where Spark has to make them up."""
    names = next(csv.reader([line]), [])
    return names if all(names) and len({name.lower() for name in names}) == len(names) else None


def _text_facts(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, list[str] | None, bool]]:
    """{plain path: (layout, its column names, whether no cell has a line break)} of text tables, in one job per
    format and kind of path over pieces of all of them.

    A quoted cell that goes on in the next line leaves an odd number of quotes behind, so a table without such
    lines can be read in pieces.
    """
    found = {}
    groups: dict[tuple[str, bool], list[str]] = {}
    for path in paths:
        groups.setdefault((table_format(_name(path)), _is_directory(spark, path)), []).append(path)
    for (kind, directory), own in groups.items():
        lines = spark.read.text(own).select("value", _file_column().alias("_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        if directory:
            lines = lines.withColumn("_path", F.regexp_replace("_path", "/[^/]*$", ""))
        if kind == "csv":
            odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
            facts = lines.groupBy("_path").agg(F.min_by("value", F.struct("block", "at")).alias("header"), F.bool_or(odd).alias("broken"))
            for row in facts.collect():  # one row per table
                names = None if row.broken else _header(row.header.removeprefix("\ufeff"))
                found[row._path] = (row.header, names, not row.broken)
        else:
            keys = F.array_sort(F.json_object_keys("value"))
            facts = lines.groupBy("_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(keys)))).alias("keys"))
            for row in facts.where(F.size("keys") > 0).collect():
                found[row._path] = (json.dumps(row["keys"]), row["keys"], True)
    return found


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _readable(
    spark: SparkSession, tables: list[tuple[str, list[str]]], multi_line: bool | None = None
) -> list[tuple[str, str, str, list[str] | None, bool]]:
    """(name, path, layout, column names where known, whether it can be read in pieces) of the tables whose schema can
    be read.  The others are left out with a warning; none at all is an error.

    Layouts come from footers of Parquet tables and from one job over all text tables of a format, so jobs do not grow
    with the number of tables.  With ``multi_line`` False CSV tables are taken to have no line break in a cell.
    """
    every = [path for _, paths in tables for path in paths]
    texts = [path for path in every if table_format(_name(path)) in ("csv", "json")]
    broken: dict[str, Exception] = {}

    def footer(path: str):
        try:
            return _footer(spark, path)
        except (PySparkException, Py4JJavaError, ValueError) as error:
            return error

    footers = [path for path in every if table_format(_name(path)) == "parquet"]
    with ThreadPoolExecutor(LOOKUPS) as pool:
        layouts = dict(zip(footers, pool.map(footer, footers), strict=True))
    broken |= {path: found for path, found in layouts.items() if isinstance(found, Exception)}
    facts = _text_facts(spark, texts)
    found = []
    for name, paths in tables:
        for path in paths:
            kind = table_format(_name(path))
            error = broken.get(path)
            if kind is None:
                error = ValueError(f"unknown table format: {path!r}")
            elif kind != "parquet" and _plain(path) not in facts:
                error = ValueError("no rows and no columns")
            if error is not None:
                reason = str(getattr(error, "java_exception", error)).strip().split("\n", 1)[0]
                warnings.warn(f"skipped unreadable table {path!r}: {reason}", stacklevel=3)
                continue
            layout, names, pieces = (layouts[path], None, True) if kind == "parquet" else facts[_plain(path)]
            pieces = pieces if multi_line is None else not multi_line
            found.append((name, path, json.dumps([kind, layout, pieces]), names, pieces))
            break
    if not found:
        raise ValueError("none of the listing tables could be read")
    return found


def _layouts(
    spark: SparkSession, tables: list[tuple[str, list[str]]], multi_line: bool | None
) -> list[tuple[bool, list[str] | None, list[tuple[str, str]]]]:
    """(whether to read in pieces, column names where known, tables) by equal format and columns, so plan and jobs grow
    with the number of layouts and not with the number of files."""
    groups: dict[str, tuple[bool, list[str] | None, list[tuple[str, str]]]] = {}
    for name, path, layout, names, pieces in _readable(spark, tables, multi_line):
        groups.setdefault(layout, (pieces, names, []))[2].append((name, path))
    return list(groups.values())


def _read_layout(spark: SparkSession, tables: list[tuple[str, str]], pieces: bool, names: list[str] | None) -> DataFrame:
    """One scan over all tables of a layout, with ``_order`` columns for row numbers."""
    df = read_table(spark, [path for _, path in tables], not pieces, names)
    parquet = table_format(_name(tables[0][1])) == "parquet"
    rows = df.select(
        "*",
        _file_column().alias("_file"),
        (F.lit(0) if parquet else F.col("_metadata.file_block_start")).cast("bigint").alias("_block"),
        (F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()).alias("_at"),
    )
    order = ["_file", "_block", "_at"]
    if len(tables) == 1:
        return rows.select(*df.columns, F.lit(tables[0][0]).alias(SOURCE_FILE), *order)
    # A table is the file itself or the directory right above its part files; names are joined, not written into the plan.
    named = spark.createDataFrame([(_plain(path), name) for name, path in tables], "_path string, _name string")
    sides = []
    for at, key in enumerate((F.col("_file"), F.regexp_replace("_file", "/[^/]*$", ""))):
        side = broadcast_measured(named.toDF(f"_path{at}", f"_name{at}"), F.octet_length(f"_path{at}") * 2 + F.lit(64))
        rows = rows.join(side, key == F.col(f"_path{at}"), "left")
        sides.append(f"_name{at}")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(*sides).alias(SOURCE_FILE), *order)


def _plain(path: str) -> str:
    return re.sub(_SCHEME, "/", path).rstrip("/")


def unite(
    spark: SparkSession, tables: list[tuple[str, list[str]]], normalize: bool = True, multi_line: bool | None = None
) -> DataFrame:
    """The given tables (source name, paths to try) united by column name, with lineage
    and hidden order columns."""
    frames = [_read_layout(spark, group, pieces, names) for pieces, names, group in _layouts(spark, tables, multi_line)]
    if normalize:
        frames = [normalize_columns(frame) for frame in frames]
    return union_evolving(frames)


def load_listings(spark: SparkSession, path: str, row_ids: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Canonical listings of a table, workbook or directory, numbered in file order.

    CSV tables are read in parallel pieces unless a cell holds a line break, which one pass over the text tells;
    ``multi_line`` says so beforehand for all of them.
    Set ``spark.sql.files.ignoreCorruptFiles`` to also pass over files that turn out
    damaged while being read.
    """
    return number_rows(unite(spark, find_tables(spark, path), multi_line=multi_line), row_ids)


def number_rows(df: DataFrame, row_ids: bool = True) -> DataFrame:
    listings = to_listings(df)
    if row_ids:
        listings = assign_row_id(listings, "_file", "_at", ["_block"])
    return listings.drop("_file", "_block", "_at")


def combine_listings(spark: SparkSession, path: str) -> DataFrame:
    """All tables as they are, columns not renamed and of a workbook simply its first
    table, plus their source."""
    tables = find_tables(spark, path, curated_first=False)
    return unite(spark, tables, normalize=False).drop("_file", "_block", "_at")


def write_combined(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
