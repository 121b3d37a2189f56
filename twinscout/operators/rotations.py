"""Finding turned and mirrored copies of images in a whole catalog.

All pairs are looked at, by a bound that one short row per image gives for all orientations at once.  The symmetries of a
square split an image into five parts that they never mix.  Turning does not change the first part, changes no more than the sign of the
next three and not the length of the last, so ``dot(a0, b0) + |dot(a1, b1)| + |dot(a2, b2)| + |dot(a3, b3)| + |a4| |b4|`` is at
least the correlation in any orientation.  Images are dealt into blocks, every two blocks meet in one task, and pairs whose
bound reaches the threshold are correlated pixel by pixel.  The work grows with the square of the number of images (some
nanoseconds a pair), the memory of a task does not.

``codes_of`` and ``proposed_pairs`` are a cheaper way that loses pairs, for catalogs where that square is too much: every image gets
codes that do not change when it is turned or mirrored, the least, over the eight
symmetries, of the signs of random projections.  Images that agree in the first bits of a code in one of
``TABLES`` tables are compared.  A bucket of many images is cut by further bits of its code until it is
small; images that agree in all bits are compared with the first of them.

Exact copies under any symmetry are one class, so a picture that is copied a million times is one image here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscout.operators.orientation import orientation_corr, orientation_maps
from twinscout.operators.sizing import broadcast_measured, shuffle_partitions
from twinscout.operators.vectors import vector_matrix
from twinscout.sources.shared import materialized

TABLES = 24
#: Bits of a code that name a bucket, tried one after another.
PREFIXES = (10, 16, 24, 40)
CODE_BITS = PREFIXES[-1]
#: Images of a bucket that are compared with one another.
MOST_TOGETHER = 40
SEED = 11
ROWS_AT_ONCE = 1024
#: Images of a block, and rows and columns of the products of two blocks that a task makes at a time.
BLOCK_ROWS = 1 << 16
TILE = (512, 512)
#: More than single precision is off in a bound.
ROUNDING = 1e-4


def symmetries(side: int) -> np.ndarray:
    """The seven orientations and the one mirroring that is not among them."""
    maps = orientation_maps(side)
    r, c = np.indices((side, side))
    other = ((side - 1 - c) * side + (side - 1 - r)).ravel()
    return np.vstack([maps, other])


def _digests(own: np.ndarray, maps: np.ndarray) -> list[bytes]:
    """Equal for exact copies under any symmetry."""
    turned = own[:, maps] + 0.0  # no negative zero
    return [min(image.tobytes() for image in row) for row in turned]


def parts(side: int) -> list[np.ndarray]:
    """Orthonormal rows that span the five parts: what no symmetry changes, what some of them negate (three), the rest."""
    turns = np.eye(side * side)[symmetries(side)]
    signs = [(1, 1, 1, 1, 1, 1, 1, 1), (1, 1, 1, 1, -1, -1, -1, -1), (1, -1, 1, -1, 1, 1, -1, -1), (1, -1, 1, -1, -1, -1, 1, 1), (4, 0, -4, 0, 0, 0, 0, 0)]
    found = []
    for sign in signs:
        # A projection: its eigenvalues are 0 and 1.
        values, rows = np.linalg.eigh(np.tensordot(np.array(sign), turns, 1) / 8)
        found.append(rows.T[values > 0.5])
    return found


def invariants_of(images: DataFrame, side: int) -> DataFrame:
    """(image_id, digest, parts array<float>) of images (image_id, vector): ``parts`` has the first four parts of the centred image of
    length 1 and the length of its fifth, and is null for flat images.  Null vectors are left out."""
    maps, bases = symmetries(side), parts(side)
    flat_basis = np.vstack(bases[:4])

    def invariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                own = vector_matrix(batch.column("vector"), side * side)
                centred = own - own.mean(axis=1, keepdims=True)
                length = np.sqrt((centred * centred).sum(axis=1))
                unit = centred / np.where(length > 0, length, 1.0)[:, None]
                last = np.sqrt(((unit @ bases[4].T) ** 2).sum(axis=1))
                rows = np.column_stack([unit @ flat_basis.T, last]).astype(np.float32)
                found = [row if full else None for row, full in zip(rows, length > 0, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("image_id"), pa.array(_digests(own, maps), pa.binary()), pa.array(found, pa.list_(pa.float32()))],
                    names=["image_id", "digest", "parts"],
                )

    rows = images.where("vector IS NOT NULL").select("image_id", "vector")
    found = rows.mapInArrow(invariants, "image_id bigint, digest binary, parts array<float>")
    return found.withColumn("digest", F.unhex(F.sha2("digest", 256)))


def bounded_pairs(classes: DataFrame, side: int, min_correlation: float) -> DataFrame:
    """(id_a, id_b) of all classes (class_id, parts) whose bound reaches ``min_correlation``, the smaller number first."""
    have = classes.where("parts IS NOT NULL").select("class_id", "parts")
    rows, tasks = have.count(), shuffle_partitions(classes.sparkSession)
    # Blocks of a bounded size, and of small tables so many that each task gets some pairs of them.
    blocks = max(-(-rows // BLOCK_ROWS), min(-(-rows // ROWS_AT_ONCE), round((8 * tasks) ** 0.5)), 1)
    edges = np.cumsum([0, *(len(basis) for basis in parts(side)[:4])])
    floor = min_correlation - ROUNDING

    def split(rows: np.ndarray) -> list[np.ndarray]:
        """The part that is never negated with the last length, then the others, each in one piece."""
        first = np.column_stack([rows[:, : edges[1]], rows[:, -1:]])
        return [first, *(np.ascontiguousarray(rows[:, low:high]) for low, high in zip(edges[1:-1], edges[2:], strict=True))]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, second = table["class_id"].to_numpy(), table["second"].to_numpy().astype(bool)
        whole = table["parts"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        same = not second.any()
        a, b = (slice(None), slice(None)) if same else (~second, second)
        ids_a, ids_b, parts_a, parts_b = ids[a], ids[b], split(whole[a]), split(whole[b])
        for down in range(0, len(ids_a), TILE[0]):
            rows_a = [part[down : down + TILE[0]] for part in parts_a]
            for across in range(0, len(ids_b), TILE[1]):
                bound = rows_a[0] @ parts_b[0][across : across + TILE[1]].T
                for own, others in zip(rows_a[1:], parts_b[1:], strict=True):
                    more = own @ others[across : across + TILE[1]].T
                    bound += np.abs(more, out=more)
                hits = bound >= floor
                if hits.any():
                    at, to = np.nonzero(hits)
                    left, right = ids_a[down + at], ids_b[across + to]
                    once = left < right if same else slice(None)
                    low, high = np.minimum(left, right)[once], np.maximum(left, right)[once]
                    yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["id_a", "id_b"])

    block = F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = have.withColumn("block", block).withColumn("other", other)
    pair = F.least("block", "other") * blocks + F.greatest("block", "other")
    dealt = dealt.select("class_id", "parts", (F.col("block") > F.col("other")).alias("second"), pair.alias("pair"))
    return dealt.repartition(blocks * (blocks + 1) // 2, "pair").groupBy("pair").applyInArrow(meet, "id_a bigint, id_b bigint")


def codes_of(images: DataFrame, side: int) -> DataFrame:
    """(image_id, digest, codes array<long>) of images (image_id, vector): ``digest`` is equal for exact copies under any
    symmetry, ``codes`` has one code a table.  Null vectors are left out."""
    planes = np.random.default_rng(SEED).normal(size=(TABLES * CODE_BITS, side * side))
    weights = (1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = symmetries(side)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                own = vector_matrix(batch.column("vector"), side * side)
                centred = own - own.mean(axis=1, keepdims=True)
                least = np.full((len(own), TABLES), np.iinfo(np.int64).max)
                for order in maps:
                    signs = (centred[:, order] @ planes.T > 0).reshape(len(own), TABLES, CODE_BITS)
                    least = np.minimum(least, signs @ weights)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("image_id"), pa.array(_digests(own, maps), pa.binary()), pa.array(list(least), pa.list_(pa.int64()))],
                    names=["image_id", "digest", "codes"],
                )

    rows = images.where("vector IS NOT NULL").select("image_id", "vector")
    found = rows.mapInArrow(code, "image_id bigint, digest binary, codes array<bigint>")
    return found.withColumn("digest", F.unhex(F.sha2("digest", 256)))


def _buckets(codes: DataFrame) -> DataFrame:
    """(class_id, place, bucket, small): the bucket of each class in each table."""
    rows = codes.select("class_id", F.posexplode("codes").alias("place", "code"))
    level, known = F.lit(None).cast("int"), rows
    for at, bits in enumerate(PREFIXES):
        prefix = F.shiftright("code", CODE_BITS - bits)
        many = rows.groupBy("place", prefix.alias(f"prefix{at}")).agg(F.count("*").alias(f"count{at}")).where(F.col(f"count{at}") > MOST_TOGETHER)
        many = broadcast_measured(materialized(many, "buckets"), F.lit(32))
        known = known.withColumn(f"prefix{at}", prefix).join(many, ["place", f"prefix{at}"], "left")
    for at in reversed(range(len(PREFIXES))):
        level = F.when(F.col(f"count{at}").isNull(), F.lit(at)).otherwise(level)
    last = len(PREFIXES) - 1
    chosen = F.coalesce(*[F.when(F.col("level") == at, F.struct(F.lit(at).alias("level"), F.col(f"prefix{at}").alias("prefix"))) for at in range(last + 1)])
    whole = F.struct(F.lit(last).alias("level"), F.col(f"prefix{last}").alias("prefix"))
    return known.withColumn("level", level).select("class_id", "place", F.coalesce(chosen, whole).alias("bucket"), F.col("level").isNotNull().alias("small"))


def proposed_pairs(codes: DataFrame) -> DataFrame:
    """(id_a, id_b) of classes (class_id, codes) that share a bucket, the smaller number first."""
    rows = materialized(_buckets(codes), "placed")
    lists = rows.where("small").groupBy("place", "bucket").agg(F.sort_array(F.collect_list("class_id")).alias("ids")).where(F.size("ids") > 1)
    lists = lists.select(F.posexplode("ids").alias("at", "id_a"), "ids")
    pairs = lists.select("id_a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("id_b"))
    full = rows.where("NOT small")
    first = full.groupBy("place", "bucket").agg(F.min("class_id").alias("id_a"))
    linked = full.join(broadcast_measured(materialized(first, "first"), F.lit(48)), ["place", "bucket"]).where("id_a <> class_id")
    return pairs.unionByName(linked.select("id_a", F.col("class_id").alias("id_b"))).distinct()


def turned_copies(images: DataFrame, side: int, min_correlation: float = 0.95, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """((id_a, id_b, orientation, correlation), (image_id, class_id)) of images (image_id, vector).

    Pairs are pairs of classes, each named by its least image, whose best orientation correlates by
    ``min_correlation`` or more; ties go to the orientation tried first.  All such pairs are found, or where not ``every`` those
    that agree in a code.  Flat images correlate with
    nothing; equal ones are still one class.
    """
    facts = "parts" if every else "codes"
    coded = materialized(invariants_of(images, side) if every else codes_of(images, side), "codes")
    classes = coded.groupBy("digest").agg(F.min("image_id").alias("class_id"), F.first(facts).alias(facts))
    classes = materialized(classes, "classes")
    members = coded.select("image_id", "digest").join(broadcast_measured(classes.select("digest", "class_id"), F.lit(64)), "digest")
    pairs = materialized(bounded_pairs(classes, side, min_correlation) if every else proposed_pairs(classes), "proposed")
    vectors = images.join(broadcast_measured(classes.select(F.col("class_id").alias("image_id")), F.lit(16)), "image_id", "left_semi")
    vectors = materialized(vectors.select("image_id", "vector"), "vectors")
    mine = vectors.select(F.col("image_id").alias("id_a"), F.col("vector").alias("a"))
    theirs = vectors.select(F.col("image_id").alias("id_b"), F.col("vector").alias("b"))
    scored = orientation_corr(pairs.join(mine, "id_a").join(theirs, "id_b"), side)
    best = scored.where(F.col("correlation") >= min_correlation).withColumn("first", F.monotonically_increasing_id())
    found = best.groupBy("id_a", "id_b").agg(F.max_by(F.struct("orientation", "correlation"), F.struct("correlation", -F.col("first"))).alias("best"))
    return found.select("id_a", "id_b", "best.orientation", "best.correlation"), members.select("image_id", "class_id")
