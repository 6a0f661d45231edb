"""Exact nearest reference with pruning by pivots.  Tables as in ``vectors``: (id, embedding, ...).

A few references far from each other, at most ``MAX_PIVOTS``, are pivots; every reference belongs to the pivot at the least angle, and a pivot
keeps the greatest angle of its references (its radius) and their least and greatest length.  A vector x at angle a to a
pivot of radius r scores at most |x| m cos(max(0, a - r)) with the references of that pivot, where m is their greatest
length (the least, if the cosine is negative).  References whose bound lies below what is wanted are never met.

Two rounds: each vector meets the references of its nearest pivot; then those of all pivots whose bound still reaches the best
score found so far, or the threshold.  References are packed, a row per block, which holds those of pivots that lie near each
other; a pivot with more than a block has several.  Vectors go to a block in packed chunks, once however many of its pivots
they want, with a bit for each of these, so a task holds one block and one chunk.  Blocks grow with the references, so that
there are some ``COPIES`` of them and what is shuffled grows as the vectors do even if no pivot can be ruled out; only beyond
``COPIES`` blocks of ``LARGE_BLOCK`` rows are there more.  To the driver go the pivots and a few numbers for each, nothing that
grows with the references.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIVOTS, SAMPLE = 1024, 4
#: References of a block at least and at most, between them a share of ``COPIES`` of all; vectors of a chunk.
BLOCK, LARGE_BLOCK, COPIES, CHUNK = 2048, 65_536, 24, 8192
#: Vectors whose bounds are worked out at once, and scores that a task holds at once.
SLICE, SCORES = 512, 4_000_000
#: Room for rounding in angles and scores.
SLACK = 1e-6


@dataclass
class Pivots:
    """Directions (a row each, of length 1), and of each pivot's references: the first block, blocks, radius, least and
    greatest length.  Pivots with one block may share it."""

    directions: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    radius: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray

    def bounds(self, matrix: np.ndarray) -> np.ndarray:
        """(vectors x pivots): what a score with a reference of the pivot can be at most."""
        angle, length = angles(matrix, self.directions)
        cosine = np.cos(np.maximum(0.0, angle - self.radius - SLACK))
        return length[:, None] * np.where(cosine >= 0, self.longest, self.shortest) * cosine + SLACK * (1 + length[:, None] * self.longest)


@dataclass
class Blocks:
    """References by block, a row each, in order of pivot and label: block, n, pivots (those it has, and where the rows of each
    end: ends), ids, labels, matrix (floats or doubles, as the vectors are).  ``label`` is what the labels are."""

    rows: DataFrame
    pivots: Pivots
    label: str
    kind: str


def angles(matrix: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each vector to each direction (a right one for the zero vector), and the vectors' lengths."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    unit = matrix / np.where(length > 0, length, 1.0)[:, None]
    return np.arccos(np.clip(unit @ directions.T, -1.0, 1.0)), length


def packed(vectors: np.ndarray, kind: str) -> bytes:
    return vectors.astype(np.float32 if kind == "array<float>" else np.float64).tobytes()


def unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    """Doubles; what was packed is told by the size."""
    return np.frombuffer(data, np.float32 if len(data) == 4 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def choose(references: DataFrame, count: int | None = None) -> np.ndarray:
    """Directions of the pivots: as many as the root of the references, at most ``MAX_PIVOTS``.

    Of the ``SAMPLE`` times as many references of least hash, each pivot is the one furthest from those chosen before it, so
    that every cluster of the sample gets one and radii stay small.
    """
    if count is None:
        count = math.ceil(math.sqrt(references.count()))
    count = min(count, MAX_PIVOTS)
    few = references.select("embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE * count).collect()
    some = np.array([r["embedding"] for r in few], np.float64)
    length = np.sqrt((some * some).sum(axis=1)) if len(some) else np.zeros(0)
    if not (length > 0).any():
        return np.zeros((0, 0))
    some = some[length > 0] / length[length > 0, None]
    chosen, closest = [0], some @ some[0]
    while len(chosen) < min(count, len(some)) and closest.min() < 1 - 1e-9:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, some @ some[chosen[-1]])
    return some[chosen]


def laid_out(directions: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each pivot that has ``n`` references.

    Pivots are taken by the nearest of the first few, which lie far from each other, and fill blocks in that order.
    """
    most = min(max(BLOCK, math.ceil(n.sum() / COPIES)), max(BLOCK, LARGE_BLOCK))
    parts = np.ceil(n / most).astype(np.int64)
    regions = (directions @ directions[: max(1, math.ceil(n.sum() / most))].T).argmax(axis=1)
    first, block, held = np.zeros(len(n), np.int64), 0, 0
    for pivot in np.argsort(regions, kind="stable"):
        if held and held + n[pivot] > most:
            block, held = block + 1, 0
        first[pivot] = block
        if parts[pivot] > 1:
            block, held = block + parts[pivot], 0
        else:
            held += n[pivot]
    return first, parts


def build(references: DataFrame, label: str, count: int | None = None) -> Blocks | None:
    """Blocks of the references (id, ``label``, embedding); None if no reference has a direction."""
    directions = choose(references, count)
    if not len(directions):
        return None
    kind = dict(references.dtypes)[label]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle, length = angles(matrix_of(batch.column("embedding")), directions)
                pivot = angle.argmin(axis=1)
                own = [pa.array(pivot), pa.array(angle[np.arange(len(pivot)), pivot]), pa.array(length)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "pivot", "angle", "length"])

    id_kind, vector_kind = (dict(references.dtypes)[c] for c in ("id", "embedding"))
    placed = references.select("id", F.col(label).alias("label"), "embedding")
    placed = placed.mapInArrow(nearest, f"id {id_kind}, label {kind}, embedding {vector_kind}, pivot long, angle double, length double")
    heads = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("length").alias("shortest"), F.max("length").alias("longest")).collect()
    n, radius, shortest, longest = (np.zeros(len(directions)) for _ in range(4))
    for r in heads:
        n[r["pivot"]], radius[r["pivot"]] = r["n"], r["radius"]
        shortest[r["pivot"]], longest[r["pivot"]] = r["shortest"], r["longest"]
    pivots = Pivots(directions, *laid_out(directions, n), radius, shortest, longest)
    of_pivot = lambda numbers: F.array(*map(F.lit, numbers.tolist()))[F.col("pivot").cast("int")]
    block = (of_pivot(pivots.first) + F.pmod(F.xxhash64("id"), of_pivot(np.maximum(pivots.parts, 1)))).cast("long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        # By label, so that of equal scores the first of a pivot is the least label.
        pdf = pdf.sort_values(["pivot", "label"], kind="stable")
        own, begins = np.unique(pdf["pivot"].to_numpy(), return_index=True)
        matrix = packed(np.stack(pdf["embedding"].to_numpy()), vector_kind)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [len(pdf)], "pivots": [own.tolist()], "ends": [[*begins[1:].tolist(), len(pdf)]], "ids": [pdf["id"].tolist()], "labels": [pdf["label"].tolist()], "matrix": [matrix]})

    rows = placed.withColumn("block", block).select("block", "pivot", "id", "label", "embedding")
    packs = rows.groupBy("block").applyInPandas(pack, f"block long, n long, pivots array<long>, ends array<long>, ids array<{id_kind}>, labels array<{kind}>, matrix binary")
    return Blocks(packs, pivots, label, kind)


def chunks(vectors: DataFrame, pivots: Pivots, threshold: float, round_: int) -> DataFrame:
    """(block, ids, homes, matrix, asked, wanted): the vectors that meet a block, in packed chunks.

    ``wanted`` has a bit for each vector and each of the pivots ``asked``.  Round 0: the nearest pivot of a vector, its home;
    round 1: all pivots but ``home`` whose bound reaches ``floor``, the best score of the vector so far (null: none), and the
    threshold.
    """
    of_block = {}
    for pivot in np.flatnonzero(pivots.parts > 0):
        for block in range(pivots.first[pivot], pivots.first[pivot] + pivots.parts[pivot]):
            of_block.setdefault(block, []).append(pivot)
    of_block = {block: np.array(own) for block, own in of_block.items()}
    dtypes = dict(vectors.dtypes)

    def wants(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        matrix = matrix_of(some.column("embedding"))
        bound = np.where(pivots.parts > 0, pivots.bounds(matrix), -np.inf)
        wanted = bound >= threshold
        if round_ == 0:
            home = bound.argmax(axis=1)
            wanted &= np.arange(bound.shape[1])[None, :] == home[:, None]
        else:
            home = some.column("home").fill_null(-1).to_numpy()
            wanted &= np.arange(bound.shape[1])[None, :] != home[:, None]
            wanted &= bound >= some.column("floor").fill_null(-math.inf).to_numpy()[:, None] - SLACK
        return matrix, home, wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                some = batch.slice(begin, CHUNK)
                matrix, home, wanted = map(np.concatenate, zip(*[wants(some.slice(k, SLICE)) for k in range(0, some.num_rows, SLICE)], strict=True))
                for block, own in of_block.items():
                    use = np.flatnonzero(wanted[:, own].any(axis=1))
                    if len(use):
                        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                        bits = np.packbits(wanted[np.ix_(use, own)], axis=1).tobytes()
                        columns = [pa.array([block], pa.int64()), listed(some.column("id").take(pa.array(use))), listed(pa.array(home[use], pa.int64())), pa.array([packed(matrix[use], dtypes["embedding"])], pa.binary()), listed(pa.array(own, pa.int64())), pa.array([bits], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "homes", "matrix", "asked", "wanted"])

    columns = ["id", "embedding"] if round_ == 0 else ["id", "embedding", "floor", "home"]
    return vectors.select(*columns).mapInArrow(run, f"block long, ids array<{dtypes['id']}>, homes array<long>, matrix binary, asked array<long>, wanted binary")


def _best_of_block(row: dict, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the best reference or -1, score, scores worked out) of each vector of a chunk, in the pivots that it wants."""
    count, asked = len(row["ids"]), np.array(row["asked"])
    own, theirs = unpacked(row["matrix"], count, dim), unpacked(row["against"], row["n"], dim)
    bits = np.unpackbits(np.frombuffer(row["wanted"], np.uint8).reshape(count, -1), axis=1, count=len(asked)).astype(bool)
    rank, _ = pd.factorize(pd.Series(row["labels"]), sort=True)
    rank = np.where(rank < 0, len(rank), rank)  # null labels last
    ids, ref_ids = pd.Series(row["ids"]), pd.Series(row["ref_ids"])
    shared, ids, ref_ids = ids.isin(ref_ids).to_numpy(), ids.to_numpy(), ref_ids.to_numpy()
    best, top, pairs = np.full(count, -1), np.full(count, -np.inf), np.zeros(count, np.int64)
    for pivot, begin, end in zip(row["pivots"], [0, *row["ends"]], row["ends"], strict=False):
        members = np.flatnonzero(bits[:, np.searchsorted(asked, pivot)])
        pairs[members] += end - begin
        step = max(1, SCORES // (end - begin))
        for k in range(0, len(members), step):
            use = members[k : k + step]
            scores = own[use] @ theirs[begin:end].T
            same = np.flatnonzero(shared[use])
            at, col = np.nonzero(ids[use[same], None] == ref_ids[None, begin:end])
            scores[same[at], col] = -np.inf
            place = scores.argmax(axis=1)
            score, place = scores[np.arange(len(use)), place], place + begin
            better = (score >= threshold) & ((score > top[use]) | ((score == top[use]) & (rank[place] < rank[best[use]])))
            best[use[better]], top[use[better]] = place[better], score[better]
    return best, top, pairs


def met(sent: DataFrame, blocks: Blocks, threshold: float, id_kind: str) -> DataFrame:
    """(id, label, score, pairs, home): the best reference of each block that a vector met, and the scores it took.

    ``pairs`` counts for a vector also where no score reaches the threshold: then label and score are null.
    """
    dim = blocks.pivots.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                best, top, pairs = _best_of_block(row, dim, threshold)
                names = pa.array([row["labels"][b] if b >= 0 else None for b in best.tolist()], batch.schema.field("labels").type.value_type)
                score = pa.array(np.where(best >= 0, top, np.nan), from_pandas=True)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], batch.schema.field("ids").type.value_type), names, score, pa.array(pairs), pa.array(row["homes"], pa.int64())], ["id", "label", "score", "pairs", "home"])

    # One row of packed references for each block: no block is hot on that side, and a hot one on the other is split.
    both = sent.join(blocks.rows.select("block", "n", "pivots", "ends", F.col("ids").alias("ref_ids"), "labels", F.col("matrix").alias("against")), "block")
    return both.drop("block").mapInArrow(run, f"id {id_kind}, label {blocks.kind}, score double, pairs long, home long")


def _best(rows: DataFrame) -> DataFrame:
    least = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("minus"), "label")))
    return rows.groupBy("id").agg(least.alias("b"), F.sum("pairs").alias("pairs"), F.max("home").alias("home"))


def nearest_with_counts(vectors: DataFrame, blocks: Blocks | None, threshold: float) -> DataFrame:
    """(id, label, score, pairs) of every vector that met a block: its nearest reference at or above the threshold (else
    null; ties to the least label) and the number of scores that were worked out for it."""
    if blocks is None:
        return vectors.select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("pairs")).where(F.lit(False))
    id_kind = dict(vectors.dtypes)["id"]
    near = _best(met(chunks(vectors, blocks.pivots, threshold, 0), blocks, threshold, id_kind))
    floors = vectors.join(near.select("id", (-F.col("b.minus")).alias("floor"), "home"), "id", "left")
    far = _best(met(chunks(floors, blocks.pivots, threshold, 1), blocks, threshold, id_kind))
    both = near.unionByName(far).groupBy("id").agg(F.min("b").alias("b"), F.sum("pairs").alias("pairs"))
    return both.select("id", F.col("b.label").alias("label"), (-F.col("b.minus")).alias("score"), "pairs")


def nearest_label(vectors: DataFrame, references: DataFrame | Blocks, label: str, threshold: float) -> DataFrame:
    """The rows of ``vectors.nearest_label`` (id, label, score); references are built into blocks unless they are."""
    blocks = references if isinstance(references, Blocks) or references is None else build(references, label)
    found = nearest_with_counts(vectors, blocks, threshold)
    return found.where("score IS NOT NULL").select("id", F.col("label").alias(label), "score")
