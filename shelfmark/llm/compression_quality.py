"""Quality classifier by compression: zstandard dictionaries of good and bad text.

Two dictionaries are built from labelled text, one per class.  Each document is compressed with both; a text like the
good ones gets smaller with the good dictionary.  The size difference is normalised by the compressed sizes and by the
length, and a logistic fit on labelled documents that no dictionary has seen turns it into a calibrated score.

Fitting uses a bounded sample of the labelled rows (``MAX_PER_CLASS`` of each class for the dictionaries and as many for
the calibration, texts up to ``MAX_TRAIN_CHARS``; the rows with the smallest hash of their id); scoring covers every
document.  Labels, language, source and id never enter a score.

Defined results: null texts count as empty; an empty text has size differences 0 and so the score that the fit gives to
that; without labelled texts of both classes the score is the smoothed share of good labels (0.5 without any); documents
with several labels take part in the fit once for each; of a repeated id the least text is fitted; equal rows stay; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, text_slices

MAX_PER_CLASS = 1500
MAX_TRAIN_CHARS = 60_000
DICT_BYTES = 32_768
SAMPLE_BYTES = 2_048
LEVEL = 3
#: Bytes of text that are Python strings at once.
SLICE_BYTES = 500_000
#: Below so many texts of a class the ridge grows with the square of what is missing.
FEW = 16


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    prior: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x = (features(texts, self.good, self.bad) - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(expand(x) @ np.array(self.weights), -35, 35)))


_compressors: dict[tuple[bytes, bytes], tuple] = {}


def _pair(good: bytes, bad: bytes) -> tuple:
    """The two compressors, made once in a process."""
    if (good, bad) not in _compressors:
        _compressors.clear()
        _compressors[good, bad] = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (good, bad))
    return _compressors[good, bad]


def features(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Size difference over compressed sizes, over the length, and the compressed share of the length."""
    with_good, with_bad = _pair(good, bad)
    out = np.empty((len(texts), 3))
    for k, text in enumerate(texts):
        raw = text.encode()
        a, b, n = len(with_good.compress(raw)), len(with_bad.compress(raw)), len(raw)
        out[k] = (b - a) / (a + b), (b - a) / (n + 300), (a + b) / (2 * n + 300)
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Intercept, linear and quadratic terms."""
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - y)) + ridge @ w
        hessian = (x.T * (weight * p * (1 - p))) @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(documents: DataFrame, labelled: DataFrame, max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """``labelled``: doc_id, label (0 or 1; other rows are ignored).  At most 4 * max_per_class texts reach the driver."""
    labelled = labelled.where("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    if len(counts) < 2:
        return Model(b"", b"", (), (), (), prior)
    sized = documents.where(F.length("text") <= max_chars).select("doc_id", F.col("text"))
    ids = [labelled.where(F.col("label") == c).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(2 * max_per_class) for c in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # 4 * max_per_class narrow rows
    # One text per chosen id, however many rows it has.
    single = sized.join(chosen, "doc_id").groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted((r["h"], r["label"], r["text"]) for r in single.collect())
    halves = {c: [t for _, label, t in rows if label == c] for c in (0, 1)}
    fewest = min(len(h) for h in halves.values())
    if not fewest:
        return Model(b"", b"", (), (), (), prior)
    dictionaries = []
    for c in (1, 0):
        raw = [t.encode() for t in halves[c][::2]]
        cuts = [r[i : i + SAMPLE_BYTES] for r in raw for i in range(0, len(r), SAMPLE_BYTES)]
        total = sum(map(len, cuts))
        try:
            dictionaries.append(zstandard.train_dictionary(max(1024, min(DICT_BYTES, total // 4)), cuts).as_bytes())
        except zstandard.ZstdError:  # too little or too uniform text for a trained one: its text itself serves
            dictionaries.append(b"".join(cuts)[:DICT_BYTES])
    held = [(t, c) for c in (0, 1) for t in halves[c][1::2] or halves[c]]  # a single text serves for both
    x = features([t for t, _ in held], *dictionaries)
    y = np.array([c for _, c in held])
    share = {c: counts[c] / (counts[0] + counts[1]) for c in (0, 1)}
    weight = np.array([share[c] * len(y) / max(1, (y == c).sum()) for c in y])  # calibrated to the share of all labels
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = fit_logistic(expand((x - mean) / scale), y, weight, max(1.0, (FEW / fewest) ** 2))
    return Model(*dictionaries, tuple(w), tuple(mean), tuple(scale), prior)


def score(documents: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, then score."""
    narrow = documents.select(*columns, F.coalesce("text", F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_slices(batch.column("__text"), SLICE_BYTES):
                own = [batch.column(c).slice(begin, len(texts)) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(model.scores(texts))], [*columns, "score"])

    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["score double"]))


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """Model of ``labels.quality`` from the rows that are not held out."""
    return train(documents, labels.where(crc32_mod(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label")))


def op3_quality_classifier(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, learn(documents, labels))
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Documents whose score reaches the threshold, with their columns as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_slices(batch.column("text"), SLICE_BYTES):
                yield batch.slice(begin, len(texts)).filter(pa.array(model.scores(texts) >= threshold))

    return documents.mapInArrow(run, documents.schema)


def held_out_accuracy(scored: DataFrame, labels: DataFrame) -> float:
    """Share of held-out labelled documents whose prediction is right."""
    both = scored.where("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    value = both.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    return math.nan if value is None else value
