"""Vector operators.  Tables: (id, embedding array<float>, ...); stored vectors have unit length, so dot is cosine.

Ragged vectors (empty or of another size) are dropped by ``usable``.  Scores of one vector against a table are column
expressions.  Scores of two tables run as matrix products in Arrow batches: references of one block's size, counted first,
go out with the tasks; more are split into blocks like the vectors themselves, and each pair of blocks meets in one task.
Each batch gives only what can still be wanted, so neither pairs nor tables are gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: As many references go out with the tasks at most; beyond it both sides are split into blocks.  A row is copied once for
#: each block of the other side, so there are at most ``MOST_BLOCKS`` until a block holds ``LARGE_BLOCK`` rows.
BLOCK, MOST_BLOCKS, LARGE_BLOCK = 8192, 8, 32768
#: Vectors that are scored at once against a block (fewer, if that makes more than ``SLICE_SCORES``), and rows of a block of a cohort.
SLICE, SLICE_SCORES, COHORT_BLOCK = 512, 4_000_000, 2048
#: Rows of found scores that a task holds before it cuts them to the best.
HELD_ROWS = 500_000
AUTO_MATCH, SUGGEST_FACE, SUGGEST_TAG, SUGGEST_SET, BODY_MATCH, FACE_SEARCH = 0.6, 0.45, 0.45, 0.75, 0.5, 0.3


def usable(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return vectors.where(F.size(column) == dim)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for the zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def centroids(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unit mean per group; null where the mean is zero.  Sums are combined map-side per dimension."""
    by = by or []
    spread = vectors.select(*by, F.posexplode("embedding").alias("pos", "x"))
    means = spread.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return rows.select(*by, unit(F.transform("v", lambda x: x["m"])).alias("centroid"))


def rocchio(positive: DataFrame, negative: DataFrame, weight: float = 0.5) -> DataFrame:
    """One row ``centroid``: c+ - weight * c-, unit; c+ where there is no c- or the result is zero."""
    both = centroids(positive).withColumnRenamed("centroid", "p").join(centroids(negative).withColumnRenamed("centroid", "n"), F.lit(True), "left")
    moved = unit(F.zip_with("p", "n", lambda x, y: x - F.lit(weight) * y))
    return both.select(F.coalesce(moved, F.col("p")).alias("centroid"))


def rank_by(vectors: DataFrame, centroid: DataFrame, k: int | None = None, key: str = "id") -> DataFrame:
    """(key, score) against the one row of ``centroid``, best first, ties by key."""
    scored = vectors.join(F.broadcast(centroid.select("centroid")), F.lit(True)).select(key, dot(F.col("embedding"), F.col("centroid")).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def similar_to(vectors: DataFrame, id_: int, k: int = 20) -> DataFrame:
    """Top k to one row, without itself; describe the hits after this limit, not before."""
    query = vectors.where(F.col("id") == id_).select(F.transform("embedding", lambda x: x.cast("double")).alias("centroid")).limit(1)
    return rank_by(vectors.where(F.col("id") != id_), query, k)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["embedding"].to_numpy()).astype(np.float64)


def block_scores(vectors: DataFrame, references: DataFrame, columns: list[str], pick: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str, cut: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """What ``pick`` keeps of the scores of all vectors against all references (``id``, ``columns`` and embedding).

    ``pick`` gets some vectors, their score matrix and the references of a block, sorted by the first of ``columns``; a row
    does not meet itself, and one whose vector is null meets none.
    ``cut``, if given, cuts what a task has found so far to what can still be wanted.
    """
    vectors, references = (df.where(F.col("embedding").isNotNull()) for df in (vectors, references))
    # Both may come from one table: new columns on one side, so that the two are told apart where they meet.
    narrow, refs = vectors.select("id", "embedding"), references.select(*[F.col(c).alias(c) for c in ("id", *columns, "embedding")])
    n = refs.count()

    def scored(batch: pd.DataFrame, block: pd.DataFrame, across: np.ndarray) -> pd.DataFrame:
        scores = _matrix(batch) @ across
        both = np.flatnonzero(batch["id"].isin(block["id"]))
        row, col = np.nonzero(batch["id"].to_numpy()[both, None] == block["id"].to_numpy()[None, :])
        scores[both[row], col] = -np.inf
        return pick(batch, scores, block)

    def found(batches: Iterator[pd.DataFrame], block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        block = block.sort_values(columns[0], kind="stable") if columns else block
        held, most, across = [], HELD_ROWS, _matrix(block).T
        step = max(1, min(SLICE, SLICE_SCORES // len(block)))
        for batch in batches:
            for begin in range(0, len(batch), step):
                some = scored(batch.iloc[begin : begin + step], block, across)
                if cut is None:
                    yield some
                    continue
                held.append(some)
                if sum(map(len, held)) > most:
                    held = [cut(pd.concat(held))]
                    most = max(HELD_ROWS, 2 * len(held[0]))
        if held:
            yield cut(pd.concat(held))

    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    if n <= BLOCK:
        sent = vectors.sparkSession.sparkContext.broadcast(refs.toPandas())
        return narrow.mapInPandas(lambda batches: found(batches, sent.value), schema)
    parts = [max(1, min(-(-count // BLOCK), MOST_BLOCKS), -(-count // LARGE_BLOCK)) for count in (narrow.count(), n)]

    def placed(df: DataFrame, own: int) -> DataFrame:
        """Each row in its block of its own side, once for each block of the other side."""
        home = F.pmod(F.xxhash64("id", "embedding"), F.lit(parts[own])).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(parts[1 - own] - 1)))
        return df.select("*", home.alias(f"__{own}"), every.alias(f"__{1 - own}"))

    def meet(batch: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(block):
            return pd.DataFrame({x.split()[0]: pd.Series([], dtype=object) for x in schema.split(", ")})
        return pd.concat(found(iter([batch]), block))

    return placed(narrow, 0).groupBy("__0", "__1").cogroup(placed(refs, 1).groupBy("__0", "__1")).applyInPandas(meet, schema)


def top_k_join(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each row of a stated query set the k best of all vectors, itself excluded.

    Each task gives the k best that it has met for each query; the rest is one ranked window per query.
    """
    least = -np.inf if threshold is None else threshold

    def best(batch: pd.DataFrame, scores: np.ndarray, block: pd.DataFrame) -> pd.DataFrame:
        keep = min(k, len(scores))
        # All that reach the k-th best score, so that ties are broken by id and not by chance.
        floor = np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep]
        v, q = np.nonzero((scores >= floor[None, :]) & np.isfinite(scores) & (scores >= least))
        return pd.DataFrame({"query_id": block["id"].to_numpy()[q], "id": batch["id"].to_numpy()[v], "score": scores[v, q]})

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)

    found = block_scores(vectors, queries, [], best, "query_id long, id long, score double", cut)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def nearest_label(vectors: DataFrame, references: DataFrame, label: str, threshold: float) -> DataFrame:
    """(id, label, score): label of the nearest reference at or above the threshold; ties to the least label."""

    def nearest(batch: pd.DataFrame, scores: np.ndarray, block: pd.DataFrame) -> pd.DataFrame:
        names = block[label].to_numpy()
        best = scores.argmax(axis=1)  # of equal scores the first, whose label is the least
        top = scores[np.arange(len(scores)), best]
        ok = top >= threshold
        return pd.DataFrame({"id": batch["id"].to_numpy()[ok], label: names[best[ok]], "score": top[ok]})

    found = block_scores(vectors, references, [label], nearest, f"id long, {label} {dict(references.dtypes)[label]}, score double")
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("minus"), label)).alias("b"))
    return best.select("id", F.col(f"b.{label}").alias(label), (-F.col("b.minus")).alias("score"))


def max_similarity(vectors: DataFrame, references: DataFrame, label: str, floor: float) -> DataFrame:
    """(id, label, score): best score, of the floor or more, to any reference of each label, a row never compared with itself.

    References may have a column ``floor`` of their own, which then holds besides.
    """
    own = ["floor"] if "floor" in references.columns else []

    def tops(batch: pd.DataFrame, scores: np.ndarray, block: pd.DataFrame) -> pd.DataFrame:
        if own:
            scores = np.where(scores >= block["floor"].to_numpy()[None, :], scores, -np.inf)
        codes, names = pd.factorize(block[label], sort=True)  # in order, null ones (-1) at the end
        labelled = np.count_nonzero(codes >= 0)
        begins = np.searchsorted(codes[:labelled], np.arange(len(names)))
        best = np.maximum.reduceat(scores[:, :labelled], begins, axis=1) if labelled else np.zeros((len(scores), 0))
        row, col = np.nonzero((best >= floor) & np.isfinite(best))
        return pd.DataFrame({"id": batch["id"].to_numpy()[row], label: np.asarray(names)[col], "score": best[row, col]})

    found = block_scores(vectors, references, [label, *own], tops, f"id long, {label} {dict(references.dtypes)[label]}, score double")
    return found.groupBy("id", label).agg(F.max("score").alias("score"))


def in_band(scored: DataFrame, floor: float, ceiling: float | None = None, limit: int | None = None, ascending: bool = False) -> DataFrame:
    """Scores in [floor, ceiling), ordered, cut to the limit."""
    out = scored.where(F.col("score") >= floor)
    out = out if ceiling is None else out.where(F.col("score") < ceiling)
    return out if limit is None else out.orderBy(F.asc("score") if ascending else F.desc("score"), "id").limit(limit)


def best_per_group(scored: DataFrame, group: str, threshold: float | None = None, k: int | None = None) -> DataFrame:
    """(group, id, score): the best row of each group, ties to the least id."""
    rows = scored if threshold is None else scored.where(F.col("score") >= threshold)
    best = rows.groupBy(group).agg(F.min(F.struct((-F.col("score")).alias("minus"), "id")).alias("b")).select(group, F.col("b.id").alias("id"), (-F.col("b.minus")).alias("score"))
    return best if k is None else best.orderBy(F.desc("score"), group).limit(k)


def cohort_outliers(faces: DataFrame, group: str = "identity", reviewed: DataFrame | None = None) -> DataFrame:
    """(id, group, score): best score of each face to the *others* of its own group, worst first by score; groups of two or more.

    Each group is split in blocks and two blocks meet in one task, each pair of blocks once, so no group is gathered whole.
    """
    counts = faces.groupBy(group).agg(F.ceil(F.count("*") / COHORT_BLOCK).cast("int").alias("__n"))
    placed = faces.select("id", group, "embedding").join(counts, group).withColumn("__home", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    met = placed.withColumn("__met", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    met = met.select("id", group, "embedding", "__home", F.least("__home", "__met").alias("__a"), F.greatest("__home", "__met").alias("__b"))
    kind = dict(faces.dtypes)[group]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        low = (pdf["__home"] == pdf["__a"]).to_numpy()
        parts = [pdf] if pdf["__a"].iloc[0] == pdf["__b"].iloc[0] else [pdf[low], pdf[~low]]
        out = []
        if all(map(len, parts)):
            a, b = parts[0], parts[-1]
            scores = _matrix(a) @ _matrix(b).T
            scores[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -np.inf
            out = [pd.DataFrame({"id": x["id"], group: x[group], "score": scores.max(axis=axis)}) for x, axis in zip(parts, (1, 0), strict=False)]
        return pd.concat(out) if out else pd.DataFrame({"id": [], group: [], "score": []})

    found = met.groupBy(group, "__a", "__b").applyInPandas(score, f"id long, {group} {kind}, score double")
    best = found.groupBy("id", group).agg(F.max("score").alias("score")).where(F.col("score") > F.lit(float("-inf")))
    return best if reviewed is None else best.join(reviewed.select("id"), "id", "left_anti")


def category_matches(vectors: DataFrame, examples: DataFrame, thresholds: DataFrame, decided: DataFrame) -> DataFrame:
    """(id, category, score) of vectors whose score to a category's centroid reaches its own threshold and that have no
    decision (manual or rejected) on it.  ``examples``: category, embedding; ``thresholds``: category, temperature."""
    central = centroids(examples, ["category"]).join(thresholds, "category").where("centroid IS NOT NULL")
    # One row per category, with its threshold; an id that no vector has.
    queries = central.select(F.lit(None).cast("long").alias("id"), "category", F.col("temperature").cast("double").alias("floor"), F.col("centroid").alias("embedding"))
    found = max_similarity(vectors, queries, "category", -2.0)
    return found.select("id", "category", "score").join(decided.select("id", "category"), ["id", "category"], "left_anti")


def match_faces_to_bodies(faces: DataFrame, bodies: DataFrame, least: float = 0.7) -> DataFrame:
    """(face_id, body_id, share): per face the body of its image that contains most of it."""
    from ..functions.scalar import containment

    both = faces.join(bodies, "file_id").withColumn("share", containment(F.col("face_box"), F.col("body_box"))).where(F.col("share") >= least)
    best = both.groupBy("face_id").agg(F.min(F.struct((-F.col("share")).alias("minus"), "body_id")).alias("b"))
    return best.select("face_id", F.col("b.body_id").alias("body_id"), (-F.col("b.minus")).alias("share"))


def suggestion_stream(scored: DataFrame, excluded: DataFrame, count: int, bias: Column | None = None, last: Column | None = None) -> DataFrame:
    """Best cards first: without the refs already held, biased ones moved, those for ``last`` (a flag) at the end."""
    fresh = scored.join(excluded.select("id"), "id", "left_anti")
    keys = [] if last is None else [last.cast("int")]
    score = F.col("score") if bias is None else F.col("score") + bias
    return fresh.withColumn("score", score).orderBy(*keys, F.desc("score"), "id").limit(count)


def bias_reorder(cards: DataFrame, key: Column, value: str, action: str) -> DataFrame:
    """Stable: after a confirmation cards of that key come first, after a rejection last.  ``cards`` has place."""
    hit = key.eqNullSafe(F.lit(value)).cast("int")
    return cards.withColumn("rank_flag", -hit if action == "confirm" else hit).orderBy("rank_flag", "place").drop("rank_flag")
