"""Linear probe on stored vectors: fit, cross-validate, score, calibrate a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPOCHS, RATE = 200, 0.01
MIN_PER_CLASS = 5
#: Hash buckets in which the rows of a class are numbered.
BUCKETS = 1024
#: Values (rows x dimensions) up to which one task takes all steps on rows held in its memory; beyond it each step is a
#: pass over the rows.  The steps, and so the fit, are the same.
HELD_VALUES = 16_000_000


@dataclass(frozen=True)
class Probe:
    weights: list[float]
    bias: float
    accuracy: float
    scheme: str


def fit_local(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the logistic loss."""
    w = _adam((1, x.shape[1] + 1), epochs, lambda w, xb=np.column_stack([x, np.ones(len(x))]): _gradient(xb, y, np.zeros(len(y)), np.array([-1]), w) / len(y))
    return w[0, :-1], float(w[0, -1])


def _adam(shape: tuple[int, int], epochs: int, gradient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights (a row for each fit) after the steps from zero."""
    w, m, v = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for t in range(1, epochs + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _gradient(x: np.ndarray, y: np.ndarray, fold: np.ndarray, held: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Summed gradient of each fit over these rows, without those of the fold that the fit holds out."""
    return ((1 / (1 + np.exp(-(x @ w.T))) - y[:, None]) * (fold[:, None] != held)).T @ x


def _right(x: np.ndarray, y: np.ndarray, fold: np.ndarray, held: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of each fit's held-out fold that it gets right."""
    return (((x @ w.T >= 0) == (y == 1)[:, None]) & (fold[:, None] == held)).sum(axis=0)


def _folded(examples: DataFrame, folds: int, seed: int) -> DataFrame:
    """embedding, label, fold: the rows of each class are dealt to the folds in the order of a hash.

    Rows are numbered inside hash buckets, whose counts alone reach the driver, so no class is gathered in one task.
    """
    spark = examples.sparkSession
    h = F.xxhash64("id", F.lit(seed))
    keyed = examples.select("id", "embedding", F.col("label").cast("int").alias("label"), F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"))
    at, begins = {}, []
    for label, bucket, n in sorted(keyed.groupBy("label", "bucket").count().collect()):
        begins.append((label, bucket, at.get(label, 0)))
        at[label] = at.get(label, 0) + n
    begin = spark.createDataFrame(begins, "label int, bucket int, begin long")
    k = F.row_number().over(W.partitionBy("label", "bucket").orderBy(h, "id", "embedding")) - 1
    numbered = keyed.withColumn("k", k).join(F.broadcast(begin), ["label", "bucket"])
    return numbered.select("embedding", "label", F.pmod(F.col("begin") + F.col("k"), F.lit(folds)).cast("int").alias("fold"))


def _packed(folded: DataFrame) -> DataFrame:
    """One row per Arrow batch: matrix (with a column of ones), labels and folds as bytes, so that a step only multiplies."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
                values = [np.column_stack([x, np.ones(len(x))]), y.astype(np.float64), fold.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["x", "y", "fold"])

    return folded.mapInArrow(pack, "x binary, y binary, fold binary").persist()


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for x, y, fold in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "fold")), strict=True):
        y = np.frombuffer(y)
        yield np.frombuffer(x).reshape(len(y), -1), y, np.frombuffer(fold, np.int32)


def _summed(packed: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part`` (x, y, fold) over all rows: a row per task and number, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x, y, fold in _matrices(batch):
                total += part(x, y, fold).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "g"])

    out = np.zeros(size)
    for i, g in packed.mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g")).collect():
        out[i] = g
    return out


def _fit_in_one_task(packed: DataFrame, shape: tuple[int, int], held: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, right rows) of all fits, worked out by a task that holds the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for batch in batches for p in _matrices(batch)]
        if parts:
            x, y, fold = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.lexsort((*x.T[::-1], fold, y))  # the sums do not depend on how the rows came
            x, y, fold = x[order], y[order], fold[order]
            used = (fold[:, None] != held).sum(axis=0)[:, None]
            w = _adam(shape, epochs, lambda w: _gradient(x, y, fold, held, w) / used)
            yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()]), pa.array([_right(x, y, fold, held, w).tolist()])], ["w", "right"])

    row = packed.coalesce(1).mapInArrow(run, "w array<double>, right array<long>").first()
    return np.array(row["w"]).reshape(shape), np.array(row["right"])


def fit(examples: DataFrame, seed: int = 0, epochs: int = EPOCHS) -> Probe:
    """``examples``: id, embedding, label (0/1).  Stratified 80/20 with ten of each class, else up to five folds; then all.

    At every size the same full-batch Adam as ``fit_local``; the fits with a fold held out and the one on all rows take
    their steps together, in one task up to ``HELD_VALUES`` and beyond it in passes whose gradients are summed by Spark.
    """
    counts = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < MIN_PER_CLASS:
        raise ValueError(f"at least {MIN_PER_CLASS} examples of each class are needed")
    enough = min(counts.values()) >= 10
    folds = 5 if enough else min(5, *counts.values())
    held = np.array([*([0] if enough else range(folds)), -1])  # -1: no fold is held out
    folded = _folded(examples, folds, seed)
    shape = (len(held), len(examples.select("embedding").first()[0]) + 1)
    packed = _packed(folded)
    used = _summed(packed, len(held), lambda x, y, fold: (fold[:, None] != held).sum(axis=0))
    if sum(counts.values()) * shape[1] <= HELD_VALUES:
        w, right = _fit_in_one_task(packed, shape, held, epochs)
    else:
        w = _adam(shape, epochs, lambda w: _summed(packed, w.size, lambda x, y, fold: _gradient(x, y, fold, held, w)).reshape(shape) / used[:, None])
        right = _summed(packed, len(held), lambda x, y, fold: _right(x, y, fold, held, w))
    packed.unpersist()
    accuracy = float((right[:-1] / (used[-1] - used[:-1])).mean())
    return Probe(w[-1, :-1].tolist(), float(w[-1, -1]), accuracy, "80/20" if enough else f"{folds}-fold")


def score(vectors: DataFrame, probe: Probe) -> DataFrame:
    """(id, score): the logistic function of w.x + b, as a column expression."""
    weights = F.array(*map(F.lit, probe.weights))
    z = F.aggregate(F.zip_with("embedding", weights, lambda x, w: x.cast("double") * w), F.lit(probe.bias), lambda acc, x: acc + x)
    return vectors.select("id", (1 / (1 + F.exp(-z))).alias("score"))


def suggest(vectors: DataFrame, probe: Probe, decided: DataFrame, excluded: DataFrame, count: int) -> DataFrame:
    """(id, checksum, score): the rows that a probe scores best, without those decided (checksum) or already shown (id)."""
    open_rows = vectors.join(decided.select("checksum"), "checksum", "left_anti").join(excluded.select("id"), "id", "left_anti")
    best = score(open_rows, probe).orderBy(F.desc("score"), "id").limit(count)
    return best.join(vectors.select("id", "checksum"), "id")


def training_state(tags: DataFrame, boxes: DataFrame, status: DataFrame, alive: DataFrame, min_boxes: int = 10) -> DataFrame:
    """(label, n_positive, n_negative, n_boxes, can_fit, can_detect, status, error) of each label that has a decision.

    ``tags``: label, polarity of whole images and regions; ``boxes``: label, a row per positive box; ``status``: label,
    status, pid, error of the last training; ``alive``: pid of the processes that run.  A training that is said to run but
    whose process is gone has failed; one without a process yet has not.
    """
    counted = tags.groupBy("label").agg(F.count_if(F.col("polarity") == "positive").alias("n_positive"), F.count_if(F.col("polarity") != "positive").alias("n_negative"))
    n = boxes.groupBy("label").agg(F.count("*").alias("n_boxes"))
    running = status.join(F.broadcast(alive.select("pid").distinct().withColumn("__alive", F.lit(True))), "pid", "left")
    died = (F.col("status") == "running") & F.col("pid").isNotNull() & F.col("__alive").isNull()
    told = running.select("label", F.when(died, "failed").otherwise(F.col("status")).alias("status"), F.when(died, "the training process is gone").otherwise(F.col("error")).alias("error"))
    both = counted.join(n, "label", "left").join(told, "label", "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))
    enough = (F.col("n_positive") >= MIN_PER_CLASS) & (F.col("n_negative") >= MIN_PER_CLASS)
    return both.select("label", "n_positive", "n_negative", "n_boxes", enough.alias("can_fit"), (F.col("n_boxes") >= min_boxes).alias("can_detect"), "status", "error")


def calibrate(scored: DataFrame, is_clean, low: float = 0.10, high: float = 0.95, epsilon: float = 0.03, rounds: int = 8, batch: int = 5) -> float:
    """Threshold by bisection: the lowest scores in [test, safe) are reviewed; a clean batch lowers safe, a dirty one lifts risky.

    ``is_clean`` judges one (id, score) row.  Only ``batch`` rows a round reach the driver.
    """
    risky, safe = low, high
    for _ in range(rounds):
        if safe - risky < epsilon:
            break
        test = (risky + safe) / 2
        rows = scored.where((F.col("score") >= test) & (F.col("score") < safe)).orderBy("score", "id").limit(batch).collect()
        if all(is_clean(r) for r in rows):
            safe = test
        else:
            risky = test
    return safe
