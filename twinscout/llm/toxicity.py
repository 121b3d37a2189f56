"""Toxicity by two Kneser-Ney character models, one of toxic and one of ordinary texts.

A text is scored by the difference of its two log-likelihoods per character.  Both models
predict a character (UTF-8 byte of the lower-cased text, runs of anything but letters as one
space) from the three before it, so inflected and unseen words of a known stem count too.
Four-grams are discounted per class by the counts of counts; what that takes away, and
``STRENGTH`` more, goes to a Kneser-Ney model *shared* by both classes (four-grams of both,
three- and two-grams by the number of different letters in front of them).  Where a class has
seen little, both models agree and the difference is near zero.

Counting is one distributed pass over all labelled texts: tasks emit partial counts, Spark
sums them by the four-gram itself.  The model holds every four-gram that occurs, as sorted
arrays that grow with their number: 8 bytes each on the executors, some 100 on the driver while
it fits.  A logistic curve over the difference is fitted on a part of the labelled rows kept
out of the models (at most ``calibration_rows`` of them, by hash).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from twinscout.llm.common import bound_batches, free_name, in_slices
from twinscout.operators.sizing import broadcast_measured

#: Pseudo-counts of the shared model in every context of a class.
STRENGTH = 3.0
#: Pseudo-characters without difference in every text, so that a few letters prove little.
PRIOR_CHARS = 200
CHUNK_CHARS = 2_000_000
THRESHOLD = 0.3
PAD = b"    "
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def _plain(text: str | None) -> bytes:
    """Lower case, letters only, single spaces; one space at both ends."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def _grams(data: np.ndarray) -> np.ndarray:
    """The four-grams that end at every position from the fourth on, as integers."""
    wide = data.astype(np.uint32)
    return wide[3:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24


def _chunks(batches, columns):
    """Rows gathered to about ``CHUNK_CHARS``: one byte array, the start of each row in it, and
    the other columns.  Every row is followed by padding, so no gram crosses two rows."""
    texts, others, size = [], [], 0
    for whole in batches:
        for batch in in_slices(whole):
            rest = [batch.column(name).to_pylist() for name in columns]
            for at, text in enumerate(batch.column("text").to_pylist()):
                texts.append(_plain(text) + PAD)
                others.append(tuple(values[at] for values in rest))
                size += len(texts[-1])
                if size >= CHUNK_CHARS:
                    yield _joined(texts, others)
                    texts, others, size = [], [], 0
    if texts:
        yield _joined(texts, others)


def _joined(texts, others):
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    return np.frombuffer(PAD[:3] + b"".join(texts), dtype=np.uint8), starts, others


def _count_grams(batches):
    for data, starts, labels in _chunks(batches, ["toxic"]):
        grams = _grams(data)
        toxic = np.repeat(np.array([row[0] for row in labels], dtype=bool), np.diff([*starts, len(data) - 3]))
        inside = (grams & 0xFFFF) != 0x2020  # all but the padding
        for label in (False, True):
            found, counts = np.unique(grams[inside & (toxic == label)], return_counts=True)
            zeros = np.zeros(len(found), dtype=np.int64)
            pair = (zeros, counts) if label else (counts, zeros)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int64)), pa.array(pair[0]), pa.array(pair[1])], names=["gram", "c0", "c1"]
            )


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted, not empty ``keys`` each of ``wanted`` would be, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """Toxic minus ordinary log-probability of every four-gram that a class has, and of every
    context for the other four-grams, each under sorted keys; and the fitted curve."""

    grams: np.ndarray
    gram_values: np.ndarray
    contexts: np.ndarray
    context_values: np.ndarray
    slope: float = 0.0
    offset: float = -20.0

    def differences(self, data: np.ndarray) -> np.ndarray:
        grams = _grams(data)
        found = np.zeros(len(grams), dtype=np.float32)
        if len(self.grams):
            at, seen = _find(self.grams, grams)
            found[seen] = self.gram_values[at[seen]]
            unseen = np.flatnonzero(~seen)
            at, seen = _find(self.contexts, grams[unseen] >> 8)
            found[unseen[seen]] = self.context_values[at[seen]]
        found[(grams & 0xFFFF) == 0x2020] = 0.0
        return found

    def means(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Difference per character of every text in ``data``; 0 for an empty one."""
        if not len(starts):
            return np.zeros(0)
        lengths = np.diff([*starts, len(data) - 3]) - len(PAD)
        return np.add.reduceat(self.differences(data).astype(np.float64), starts) / (lengths + PRIOR_CHARS)


def _discount(counts: np.ndarray) -> float:
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    return float(min(max(ones / (ones + 2 * twos), 0.1), 0.95)) if ones else 0.5


def _shared(grams: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each gram's last letter, from counts of distinct
    grams of ``order`` letters.  Shorter grams are counted by the letters seen before them."""
    if order == 1:
        return (counts + 0.5) / (counts.sum() + 128)
    shorter, at, kinds = np.unique(grams & ((1 << 8 * (order - 1)) - 1), return_inverse=True, return_counts=True)
    below = _shared(shorter, kinds.astype(np.float64), order - 1)[at]
    _, context = np.unique(grams >> 8, return_inverse=True)
    total, types = np.bincount(context, weights=counts), np.bincount(context)
    discount = _discount(counts)
    return (np.maximum(counts - discount, 0) + discount * types[context] * below) / total[context]


def train(labelled: DataFrame) -> Model:
    """Models from rows (text, toxic boolean).  A row for each distinct four-gram reaches the driver."""
    bound_batches(labelled.sparkSession)
    partial = labelled.select("text", "toxic").mapInArrow(_count_grams, "gram long, c0 long, c1 long")
    rows = partial.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow().sort_by("gram")
    return _model(rows["gram"].to_numpy(), [rows[name].to_numpy() for name in ("c0", "c1")])


def _model(grams: np.ndarray, classes: list[np.ndarray]) -> Model:
    """The model of sorted four-grams and their counts in both classes, not both 0."""
    contexts, context = np.unique(grams >> 8, return_inverse=True)
    values, context_values = np.zeros(len(grams)), np.zeros(len(contexts))
    if len(grams):
        shared = _shared(grams, (classes[0] + classes[1]).astype(np.float64), 4)
        for sign, counts in ((-1, classes[0]), (1, classes[1])):
            discount = _discount(counts)
            total = np.bincount(context, weights=counts)
            types = np.bincount(context, weights=counts > 0)
            backoff = (discount * types + STRENGTH) / (total + STRENGTH)
            values += sign * np.log(np.maximum(counts - discount, 0) / (total + STRENGTH)[context] + backoff[context] * shared)
            context_values += sign * np.log(backoff)
    return Model(grams.astype(np.uint32), values.astype(np.float32), contexts.astype(np.uint32), context_values.astype(np.float32))


def _scores(broadcast, columns):
    def score(batches):
        for data, starts, others in _chunks(batches, columns):
            arrays = [pa.array([row[at] for row in others], type=pa.int64()) for at in range(len(columns))]
            means = pa.array(broadcast.value.means(data, starts), type=pa.float64())
            yield pa.RecordBatch.from_arrays([*arrays, means], names=[*columns, "difference"])

    return score


def log_likelihood_difference(docs: DataFrame, model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``difference`` per row of ``docs``.  ``keys`` are long columns; ``model`` is
    a broadcast ``Model``."""
    bound_batches(docs.sparkSession)
    schema = ", ".join(f"`{name}` long" for name in keys)
    chosen = docs.select(*[F.col(name).cast("long").alias(name) for name in keys], F.col(text).alias("text"))
    return chosen.mapInArrow(_scores(model, keys), f"{schema}, difference double")


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one scaled feature by damped Newton steps, slightly ridged."""
    scale = float(np.std(x)) or 1.0
    features = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - y) + 0.01 * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, calibration_rows: int = 20_000) -> Model:
    """Fit models and curve on ``docs`` rows that ``labels`` (doc_id, toxic) covers.

    One labelled row in eight (by CRC-32 of the id) fits the curve, under models of the other seven; of those, at most
    ``calibration_rows`` lowest hashes are used.  The models returned count all labelled rows.  Null or
    missing labels are skipped; an id labelled twice counts as toxic if one label says so.
    Without rows of both labels the model gives every text the score of its curve at zero,
    practically 0.
    """
    marks = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") == 1).alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    marks = broadcast_measured(marks, F.lit(24))  # else texts would be shuffled for a few labels
    rows = texts.join(marks, "_id").withColumn(
        "fold", F.pmod(F.floor(F.crc32(F.col("_id").cast("string").cast("binary")) / 4), F.lit(8))
    )
    model = train(rows.where("fold > 0").select("text", "toxic"))
    session = docs.sparkSession
    held = rows.where("fold = 0").select(F.col("toxic").cast("long").alias("label"), F.xxhash64("_id", "text").alias("at"), "text")
    shipped = session.sparkContext.broadcast(model)
    found = (
        log_likelihood_difference(held, shipped, ["label", "at"])
        .orderBy("at").limit(calibration_rows).select("label", "difference").toPandas()
    )
    y = found["label"].to_numpy(np.float64)
    whole = train(rows.select("text", "toxic"))
    if 0 < y.sum() < len(y):
        whole.slope, whole.offset = _fit_curve(found["difference"].to_numpy(), y)
    return whole


def score_documents(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``score`` (0 to 1, higher: likelier toxic) per row.

    Whole texts are read.  Null and empty texts have no characters, so the difference is 0 and
    the score is the curve's value there.  Repeated rows are scored each.
    """
    session = docs.sparkSession
    found = log_likelihood_difference(docs, session.sparkContext.broadcast(model), keys, text)
    logit = F.lit(model.slope) * F.col("difference") + F.lit(model.offset)
    return found.withColumn("score", 1 / (1 + F.exp(-logit))).drop("difference")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns kept.

    Rows go through the scorer whole, so no join is needed and rows with repeated or null ids
    are judged one by one.
    """
    bound_batches(docs.sparkSession)
    mark = free_name(docs, "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        scorer = shipped.value
        for whole in batches:
            for batch in in_slices(whole):
                texts = [_plain(text) + PAD for text in batch.column("text").to_pylist()]
                data, starts, _ = _joined(texts, [])
                x = scorer.slope * scorer.means(data, starts) + scorer.offset
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(x, -700, 700))))], names=[*batch.schema.names, mark]
                )

    kept = docs.mapInArrow(judge, StructType([*docs.schema.fields, StructField(mark, DoubleType())]))
    return kept.where(F.col(mark) < threshold).drop(mark)
