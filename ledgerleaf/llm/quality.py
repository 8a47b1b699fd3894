"""Quality by compression: how much better a dictionary of good texts compresses a text than one of bad texts.

Two zstandard dictionaries are trained on labelled texts. A text is cut into stretches of ``STRETCH`` bytes, all of
which are compressed with each dictionary. Two differences of sizes, each over the text's length, go through a logistic
curve that other labelled texts calibrate: what the good dictionary saves against the bad one, and against the bare text.
The second finds texts that neither dictionary fits, or that repeat themselves.

Fitting takes a bounded sample: at most ``per_class`` labelled texts of each class for the dictionaries and as many for
the curve; of a text longer than ``longest`` bytes stretches at even distances, of so many bytes together. Scoring reads
every text whole. Class shares come from all labels.

Defined cases: a null or empty text has a score like any other (difference 0); without labels of both classes the score
is the share of good labels, or 0.5 without any; repeated texts score alike; a text without
an id is scored and never learned from; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_bytes

STRETCH, LEVEL, DICTIONARY = 2048, 3, 1 << 16
SCHEMA = "doc_id long, score double"


def stretches(text: bytes) -> list[bytes]:
    return [text[i : i + STRETCH] for i in range(0, len(text), STRETCH)]


def trained(texts: list[bytes]) -> bytes:
    """A dictionary of at most ``DICTIONARY`` bytes: zstandard's own, or the texts themselves if they are too few."""
    samples = [s for t in texts for s in stretches(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    def __init__(self, dictionary: bytes):
        kind = zstandard.ZstdCompressionDict(dictionary or b"\0" * 8)
        kind.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress

    def of(self, text: bytes) -> int:
        return sum(len(self.compress(s)) for s in stretches(text))


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    means: list[float]
    scales: list[float]
    share: float

    def scorer(self):
        if not self.weights:
            return lambda text: self.share
        good, bad = Sizes(self.good), Sizes(self.bad)

        def score(text: bytes) -> float:
            x = features(text, good, bad)
            z = self.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(self.weights[1:], x, self.means, self.scales))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def features(text: bytes, good: Sizes, bad: Sizes) -> tuple[float, float]:
    g, b, n = good.of(text), bad.of(text), max(1, len(text))
    return (b - g) / n, (n - g) / n


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the first weight is the intercept."""
    x = np.c_[np.ones(len(x)), x]
    t = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-9] + [1.0] * (len(t) - 1))

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float(w @ (np.logaddexp(0, z) - y * z) + t @ penalty @ t / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -500, 500)))
        slope = x.T @ (w * (p - y)) + penalty @ t
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(t)), slope)
        size = 1.0
        while loss(t - size * step) > loss(t) and size > 1e-4:
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return t


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, per_class: int = 1200, longest: int = 1 << 16,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """A model from the labelled rows that ``training``, a condition on ``doc_id``, admits."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label in (0, 1)").where(training)
    counts = dict(rows.groupBy("label").count().collect())
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(b"", b"", [], [], [], share)
    order = F.xxhash64("doc_id")
    picked = [rows.where(F.col("label") == k).distinct().orderBy(order, "doc_id").limit(2 * per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    # at most 4 * per_class ids: a bounded broadcast
    n, parts = F.length("text"), longest // STRETCH
    even = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(F.col("text"), F.floor(i * (n / parts)).cast("int") + 1, F.lit(STRETCH)))
    sample = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    sample = sample.withColumn("text", F.when(n <= longest, F.col("text")).otherwise(F.unhex(F.array_join(F.transform(even, lambda t: F.hex(t)), ""))))
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = sorted(((bytes(r.text), r.label, r.rank) for r in sample.withColumn("rank", order).collect()), key=lambda r: r[2])
    by_class = {k: [t for t, label, _ in found if label == k] for k in (0, 1)}
    if not by_class[0] or not by_class[1]:
        return Model(b"", b"", [], [], [], share)
    halves = {k: ((v[::2], v[1::2]) if len(v) > 1 else (v, v)) for k, v in by_class.items()}
    good, bad = trained(halves[1][0]), trained(halves[0][0])
    g, b = Sizes(good), Sizes(bad)
    x = np.array([features(t, g, b) for k in (0, 1) for t in halves[k][1]])
    y = np.array([k for k in (0, 1) for _ in halves[k][1]], dtype=float)
    means, scales = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    return Model(good, bad, logistic((x - means) / scales, y, w).tolist(), means.tolist(), scales.tolist(), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the calibrated probability of label 1 for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = [of(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more; neither a join nor a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            good = [of((text or "").encode()) >= least for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
