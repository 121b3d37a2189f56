"""A versioned vector index in cells, searched exactly.

Vectors lie by nearest centroid: ``data/v=<version>/cell=<cell>``, sorted by distance from it.  A
version is a manifest, ``manifest/v=<version>``: for each cell its centroid, radius, rows and the data
version that holds it.  Files are never changed; a new version writes the touched cells anew and
takes over the others, and exists from the moment its manifest is renamed into place.

A dot product with any vector of a cell is at most ``query x centroid + |query| x radius``.  A search
first reads, for each query, the cells of greatest bound that hold ``top_k`` vectors; their k-th
best score is a floor, and of the other cells only those whose bound reaches it are read.  A
cell that is not read is not listed either: its files are never opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscout.operators.sizing import broadcast_measured, shuffle_partitions, top_per_group
from twinscout.operators.vectors import RunningBest, _margin, pair_dots, query_blocks, rows_at_once, vector_matrix
from twinscout.sources.shared import materialized

#: Centroids are fitted on about this many vectors; all vectors are indexed.
SAMPLE_ROWS = 100_000
MOST_CELLS = 4096
#: Distances that a task holds at a time while rows are put into cells.
TILE_BYTES = 4 << 20
#: Kept beside a vector; all but ``vector`` may be null.
KEPT = "image_id bigint, sku_key string, path string, length bigint, mtime bigint, vector array<float>, distance double"
MANIFEST = "cell int, centroid array<double>, radius double, rows bigint, data_version int"


# --- versions ------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.java.net.URI.create(path if "://" in path or path.startswith("file:") else f"file:{path}"), spark._jsc.hadoopConfiguration()
    )
    return context, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions in order; a manifest that is being written is not one."""
    context, path = _files(spark, folder)
    at = path(f"{folder}/manifest")
    if not context.util().exists(at):
        return []
    names = [status.getPath().getName() for status in context.util().listStatus(at)]
    return sorted(int(name[2:]) for name in names if name.startswith("v="))


def read_manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    if version is None:
        found = versions(spark, folder)
        if not found:
            raise FileNotFoundError(f"no index in {folder}")
        version = found[-1]
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/v={version}")


def _publish(manifest: DataFrame, folder: str, version: int) -> None:
    """Write the manifest aside and rename it; fails where the version was published meanwhile."""
    spark = manifest.sparkSession
    aside = f"{folder}/aside-{uuid.uuid4().hex}"
    manifest.coalesce(1).write.parquet(aside)
    context, path = _files(spark, folder)
    nothing = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    permission = spark._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault()
    context.mkdir(path(f"{folder}/manifest"), permission, True)
    context.rename(path(aside), path(f"{folder}/manifest/v={version}"), nothing)


def _cells_of(spark: SparkSession, folder: str, manifest: DataFrame, cells: list[int] | None = None) -> DataFrame:
    """Rows of the cells (all of them by default) with ``cell``; only their folders are listed."""
    own = manifest.where("rows > 0")
    if cells is not None:
        own = own.where(F.col("cell").isin(cells))
    places = [f"{folder}/data/v={row.data_version}/cell={row.cell}" for row in own.select("cell", "data_version").collect()]
    schema = f"{KEPT}, v int, cell int"
    if not places:
        return spark.createDataFrame([], schema).drop("v")
    return spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*places).drop("v")


# --- building and changing -----------------------------------------------------------


def fit_centroids(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> DataFrame:
    """(cell, centroid) of ``vectors`` (vector) by k-means over about ``SAMPLE_ROWS`` of them.

    By default the square root of the number of vectors, ``MOST_CELLS`` at most.  Any centroids give
    exact results; good ones make small cells.
    """
    have = vectors.where("vector IS NOT NULL")
    rows = have.count()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "cell int, centroid array<double>")
    cells = max(1, min(MOST_CELLS, rows, cells or round(rows**0.5)))
    picked = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / rows))
    points = have.where(picked).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    if points.isEmpty():
        points = have.limit(cells).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, initSteps=2).fit(materialized(points, "sample"))
    rows = [(at, center.tolist()) for at, center in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cell numbers, centroids): ``MOST_CELLS`` rows at most."""
    rows = centroids.select("cell", "centroid").orderBy("cell").collect()
    return np.array([row.cell for row in rows], dtype=np.int32), np.array([row.centroid for row in rows], dtype=np.float64)


def assigned(images: DataFrame, cells: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """Rows with the number of their nearest centroid and their distance from it; null vectors go."""
    schema = f"{KEPT}, cell int"
    names = [field.split()[0] for field in KEPT.split(", ")]
    spark = images.sparkSession
    shipped = spark.sparkContext.broadcast((cells, centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, points = shipped.value
        # Which cell is nearest may be off by single precision: any cell is right, as its radius comes from exact distances.
        # A small tile stays in the cache, and is the one large array here, however many cells there are.
        turned = np.ascontiguousarray(-2 * points.T, dtype=np.float32)
        squares = (points**2).sum(axis=1).astype(np.float32)
        step = max(1, TILE_BYTES // (4 * len(points)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                own = vector_matrix(batch.column("vector"), points.shape[1])
                apart = own.astype(np.float32) @ turned
                apart += squares
                near = apart.argmin(axis=1)
                distance = np.sqrt(((own - points[near]) ** 2).sum(axis=1))
                columns = [batch.column(name) for name in names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(distance), pa.array(numbers[near])], names=[*names, "cell"])

    have = [F.col(n) if n in images.columns else F.lit(None) for n in names[:-1]]
    kinds = dict(field.split() for field in KEPT.split(", "))
    rows = images.where("vector IS NOT NULL").select(*[c.cast(kinds[n]).alias(n) for c, n in zip(have, names[:-1], strict=True)])
    return rows.mapInArrow(assign, schema)


def _write_cells(rows: DataFrame, folder: str, version: int, centroids: DataFrame, taken_over: DataFrame | None) -> None:
    """Write rows (``KEPT``, cell) as the version's own cells and publish its manifest."""
    spark = rows.sparkSession
    place = f"{folder}/data/v={version}"
    # By distance too, so a cell that holds a third of all rows is many files.
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "cell", "distance").sortWithinPartitions("cell", "distance")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(place)
    own = spark.read.schema(f"{KEPT}, cell int").parquet(place)
    # Rounding of the distance and of later sums stays far below this part of it.
    facts = own.groupBy("cell").agg((F.max("distance") * (1 + 1e-9)).alias("radius"), F.count("*").alias("rows"))
    listed = centroids.join(facts, "cell").select("cell", "centroid", "radius", "rows", F.lit(version).alias("data_version"))
    _publish(listed if taken_over is None else listed.unionByName(taken_over), folder, version)


def build_cells(images: DataFrame, folder: str, cells: int | None = None) -> int:
    """Index ``images`` (image_id, sku_key, vector, and path, length, mtime where there are) as the next version.
    Every row with a vector is indexed."""
    spark = images.sparkSession
    centroids = materialized(fit_centroids(images.select("vector"), cells), "centroids")
    numbers, points = _centroid_matrix(centroids)
    version = max(versions(spark, folder), default=0) + 1
    if len(points):
        rows = assigned(images, numbers, points)
    else:
        rows = spark.createDataFrame([], f"{KEPT}, cell int")
    _write_cells(rows, folder, version, centroids, None)
    return version


def apply_index_delta(spark: SparkSession, folder: str, delta: DataFrame, images: DataFrame) -> int:
    """Bring the index to a new version by ``delta`` (path, action: add, update or remove) and return it.

    ``images`` holds the rows of added and updated paths (others are not read into the index).  Only cells
    that lose or gain a row are written anew, all others are taken over as they lie.  Readers of
    an older version are not disturbed.  An update of a path that is not there adds it.
    """
    manifest = materialized(read_manifest(spark, folder), "manifest")
    version = versions(spark, folder)[-1] + 1
    delta = materialized(delta.select("path", "action").distinct(), "delta")
    bytes_of_path = F.octet_length("path") + F.lit(32)
    gone = broadcast_measured(delta.where("action IN ('update', 'remove', 'add')").select("path").distinct(), bytes_of_path)
    wanted = broadcast_measured(delta.where("action IN ('update', 'add')").select("path").distinct(), bytes_of_path)
    everywhere = read_manifest(spark, folder).select("cell", "centroid")
    numbers, points = _centroid_matrix(everywhere)
    if len(points):
        fresh = materialized(assigned(images.join(wanted, "path", "left_semi"), numbers, points), "fresh")
    else:
        return build_cells(images.join(wanted, "path", "left_semi"), folder)
    losing = _cells_of(spark, folder, manifest).select("path", "cell").join(gone, "path", "left_semi").select("cell")
    touched = [row.cell for row in losing.union(fresh.select("cell")).distinct().collect()]
    staying = _cells_of(spark, folder, manifest, touched).join(gone, "path", "left_anti")
    same = manifest.where(~F.col("cell").isin(touched)) if touched else manifest
    emptied = manifest.where(F.col("cell").isin(touched)) if touched else manifest.limit(0)
    rows = staying.unionByName(fresh)
    place = materialized(rows, "touched")
    left = [row.cell for row in place.select("cell").distinct().collect()]
    # A cell that lost its last row keeps its centroid, for rows to come.
    emptied = emptied.where(~F.col("cell").isin(left)) if left else emptied
    empty = emptied.select("cell", "centroid", F.lit(0.0).alias("radius"), F.lit(0).cast("bigint").alias("rows"), "data_version")
    _write_cells(place, folder, version, everywhere, same.unionByName(empty))
    return version


def indexed(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """All rows of a version."""
    return _cells_of(spark, folder, read_manifest(spark, folder, version))


# --- searching -----------------------------------------------------------------------


class CellBest(RunningBest):
    """The best ``k`` per query, where a cell's rows meet only the queries whose bound reaches their floor."""

    def __init__(self, queries: np.ndarray, k: int, floors: np.ndarray):
        super().__init__(queries, k)
        self.floor = floors.copy()

    def add_for(self, only: np.ndarray, vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        asked = self.queries[only]
        step = rows_at_once(len(asked), vectors.shape[1])
        for start in range(0, len(vectors), step):
            part = slice(start, start + step)
            own = vectors[part]
            rough = own @ asked.T
            rows, cols = np.nonzero(rough >= self.floor[only] - _margin(own, asked))
            exact = pair_dots(own, asked, rows, cols)
            self.waiting.append((only[cols], exact, ids[part][rows], keys[part][rows]))
            self.waiting_rows += len(rows)
            if self.waiting_rows > self.k * len(self.queries):
                self.cut()


def _bounds(matrix: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(queries, cells): no dot product with a vector of the cell is greater."""
    length = np.sqrt((matrix**2).sum(axis=1))
    far = length[:, None] * (radii + np.sqrt((centroids**2).sum(axis=1)))[None, :]
    return matrix @ centroids.T + length[:, None] * radii[None, :] + 1e-9 * far


def _scan(rows: DataFrame, manifest, ids: np.ndarray, matrix: np.ndarray, floors: np.ndarray, k: int) -> DataFrame:
    """Per task, the best ``k`` of ``rows`` for each query."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = CellBest(matrix, k, floors)
        numbers, centroids, radii = manifest.value
        for batch in batches:
            own = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(own):
                at = np.searchsorted(numbers, cell)
                only = np.nonzero(_bounds(matrix, centroids[at : at + 1], radii[at : at + 1])[:, 0] >= best.floor)[0]
                part = batch.filter(pa.array(own == cell))
                if len(only):
                    best.add_for(
                        only, vector_matrix(part.column("vector"), matrix.shape[1]),
                        part.column("image_id").to_numpy(zero_copy_only=False), part.column("sku_key").to_numpy(zero_copy_only=False),
                    )
        if best.kept or best.waiting:
            cols, scores, found, keys = best.cut()
            arrays = [pa.array(ids[cols], pa.int64()), pa.array(found, pa.int64()), pa.array(keys, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "image_id", "sku_key", "score"])

    return rows.select("cell", "image_id", "sku_key", "vector").mapInArrow(score, "query_id bigint, image_id bigint, sku_key string, score double")


def cells_to_read(manifest: DataFrame, ids: np.ndarray, matrix: np.ndarray, floors: np.ndarray) -> DataFrame:
    """(query_id, cell, rows, bound) where a query's bound reaches its floor."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                points = vector_matrix(batch.column("centroid"), matrix.shape[1])
                bounds = _bounds(matrix, points, batch.column("radius").to_numpy(zero_copy_only=False))
                query, cell = np.nonzero(bounds >= floors[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[query]), batch.column("cell").take(pa.array(cell)), batch.column("rows").take(pa.array(cell)), pa.array(bounds[query, cell])],
                    names=["query_id", "cell", "rows", "bound"],
                )

    return manifest.where("rows > 0").mapInArrow(meet, "query_id bigint, cell int, rows bigint, bound double")


def search_cells(spark: SparkSession, folder: str, query_vectors: DataFrame, top_k: int, version: int | None = None) -> DataFrame:
    """Best ``top_k`` indexed images of every query (query_id, position, vector) with their 1-based ``hit``: the same
    rows as a scan of all vectors, in the same order (score, then image_id).

    Queries go in blocks, as in a scan; the driver sees cell numbers and one floor per query of a block.
    """
    manifest = materialized(read_manifest(spark, folder, version), "manifest")
    known = manifest.where("rows > 0").orderBy("cell").collect()
    points = np.array([row.centroid for row in known], dtype=np.float64)
    shipped = spark.sparkContext.broadcast((np.array([row.cell for row in known]), points, np.array([row.radius for row in known])))
    order = [F.col("score").desc(), F.col("image_id").asc()]
    found = []
    for ids, matrix, _ in query_blocks(query_vectors.select("*", F.lit(0.0).alias("floor"))) if known else ():
        open_floor = np.full(len(ids), -np.inf)
        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
        before = F.coalesce(F.sum("rows").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = cells_to_read(manifest, ids, matrix, open_floor).withColumn("before", before).where(F.col("before") < top_k)
        first = [row.cell for row in seeds.select("cell").distinct().collect()]
        seen = _scan(_cells_of(spark, folder, manifest, first), shipped, ids, matrix, open_floor, top_k)
        seen = materialized(top_per_group(seen, ["query_id"], order, top_k, ["image_id"], "hit"), "seen")
        kth = {row.query_id: row.score for row in seen.where(F.col("hit") == top_k).select("query_id", "score").collect()}
        floors = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
        rest = cells_to_read(manifest, ids, matrix, floors).select("cell").distinct().where(~F.col("cell").isin(first))
        second = [row.cell for row in rest.collect()]
        parts = [seen.drop("hit")]
        if second:
            parts.append(_scan(_cells_of(spark, folder, manifest, second), shipped, ids, matrix, floors, top_k))
        found.append(reduce(DataFrame.unionByName, parts))
    if not found:
        return spark.createDataFrame([], "query_id bigint, image_id bigint, sku_key string, score double, hit int")
    return top_per_group(reduce(DataFrame.unionByName, found), ["query_id"], order, top_k, ["image_id"], "hit")
