"""Requests by picture: a drawn region, a face, and more of a kind for a feed.  Each is one plan; limits come before display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import basename
from .curation import resolve_alias
from .vectors import FACE_SEARCH, dot, rank_by

#: Share of the extent from which on a tile is the whole image, and says nothing of a place in it.
WHOLE = 0.9


def best_tiles(tiles: DataFrame) -> DataFrame:
    """(file_id, score, box): per file the best score of its tiles (file_id, x1, y1, x2, y2, score), and the best tile that is
    not the whole image, as shares of the extent to four decimals; null where there is no such tile.

    A file has as many tiles as the grids have cells, so the list that the aggregate holds for it is short.
    """
    tile = F.struct((-F.col("score")).alias("minus"), "x1", "y1", "x2", "y2")
    held = tiles.groupBy("file_id").agg(F.max("score").alias("score"), F.max("x2").alias("w"), F.max("y2").alias("h"), F.collect_list(tile).alias("all"))
    w, h = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0), F.when(F.col("h") > 0, F.col("h")).otherwise(1.0)
    part = F.array_min(F.filter("all", lambda t: (t["x2"] - t["x1"]) * (t["y2"] - t["y1"]) < WHOLE * w * h))
    share = lambda c, of: F.round(part[c] / of, 4)
    return held.select("file_id", "score", F.when(part.isNotNull(), F.array(share("x1", w), share("y1", h), share("x2", w), share("y2", h))).alias("box"))


def region_search(region: DataFrame, tiles: DataFrame, wholes: DataFrame, k: int = 50) -> DataFrame:
    """(file_id, score, box, mode): the k files most like a region, which is one row (file_id, embedding); not its own file.

    With a tile index (any row in ``tiles``) a file counts by its best tile; without one by its whole image (``wholes``: id,
    embedding), whose box is null.  Which of them holds is decided inside the plan, by one row that says whether there are tiles.
    """
    asked = F.broadcast(region.select(F.col("file_id").alias("own"), F.transform("embedding", lambda x: x.cast("double")).alias("asked")).limit(1))
    indexed = F.broadcast(tiles.limit(1).agg((F.count("*") > 0).alias("indexed")))
    score = dot(F.col("embedding"), F.col("asked")).alias("score")
    by_tile = best_tiles(tiles.join(asked, F.col("file_id") != F.col("own")).select("file_id", "x1", "y1", "x2", "y2", score)).withColumn("mode", F.lit("tiles"))
    by_whole = wholes.join(indexed.where("NOT indexed")).join(asked, F.col("id") != F.col("own"))
    by_whole = by_whole.select(F.col("id").alias("file_id"), score, F.lit(None).cast("array<double>").alias("box"), F.lit("whole").alias("mode"))
    return by_tile.unionByName(by_whole).orderBy(F.desc("score"), "file_id").limit(k)


def face_search(face: DataFrame, detected: DataFrame, curated: DataFrame, promoted: DataFrame, files: DataFrame, k: int = 50, threshold: float = FACE_SEARCH) -> DataFrame:
    """(file_id, score, ref, identity, path, filename): the k files with the faces most like one (``face``: one row, embedding).

    Faces are those detected (id, file_id, embedding) that were not promoted to a curated one (``promoted``: id), and the
    curated ones (id, checksum, identity, embedding) of files that are still there.  A file counts by its best face, ties to
    the least ref; names and paths are joined to the k rows.
    """
    auto = detected.join(promoted.select("id"), "id", "left_anti").select("file_id", F.concat(F.lit("auto:"), "id").alias("ref"), F.lit(None).cast("string").alias("identity"), "embedding")
    known = files.select("checksum", F.col("id").alias("file_id"))
    manual = curated.join(known, "checksum").select("file_id", F.concat(F.lit("manual:"), "id").alias("ref"), "identity", "embedding")
    asked = F.broadcast(face.select(F.transform("embedding", lambda x: x.cast("double")).alias("asked")).limit(1))
    scored = auto.unionByName(manual).join(asked).withColumn("score", dot(F.col("embedding"), F.col("asked"))).where(F.col("score") >= threshold)
    best = scored.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ref", "identity")).alias("b"))
    top = best.select("file_id", (-F.col("b.minus")).alias("score"), "b.ref", "b.identity").orderBy(F.desc("score"), "file_id").limit(k)
    shown = top.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return shown.withColumn("filename", basename(F.col("path")))


def more_of_identity(name: str, faces: DataFrame, assigned: DataFrame, aliases: DataFrame) -> DataFrame:
    """(checksum, place) of a person's photos, found under the owner of an alias: by face (identity, checksum) or assigned."""
    asked = resolve_alias(faces.sparkSession.createDataFrame([(name,)], "identity string"), aliases).select(F.col("resolved").alias("identity"))
    both = faces.select("identity", "checksum").union(assigned.select("identity", "checksum"))
    return both.join(F.broadcast(asked), "identity").select("checksum").distinct().withColumn("place", F.lit(0).cast("long"))


def more_of_set(set_id: int, members: DataFrame) -> DataFrame:
    """(checksum, place) of a set's members in their manual order, those without a position last."""
    place = F.coalesce(F.col("position").cast("long"), F.lit((1 << 62)).cast("long"))
    return members.where(F.col("set_id") == set_id).groupBy("checksum").agg(F.min(place).alias("place"))


def more_like(file_id: int, vectors: DataFrame, files: DataFrame, k: int = 40) -> DataFrame:
    """(checksum, place) of the k files most like one, itself among the k but not returned, best first."""
    asked = vectors.where(F.col("id") == file_id).select(F.transform("embedding", lambda x: x.cast("double")).alias("centroid")).limit(1)
    near = rank_by(vectors, asked, k).where(F.col("id") != file_id).join(files.select("id", "checksum"), "id")
    return near.select("checksum", F.floor(F.col("score") * -1e12).cast("long").alias("place"))


def feed_more(files: DataFrame, more: DataFrame, excluded: DataFrame, cap: int = 20) -> DataFrame:
    """(id, path, checksum, place): the first files of ``more`` (checksum, place) that are not in the feed yet, ties by id."""
    fresh = files.join(more, "checksum").join(excluded.select("id"), "id", "left_anti")
    return fresh.select("id", "path", "checksum", "place").orderBy("place", "id").limit(cap)


def set_aliases(cards: DataFrame, aliases: DataFrame, key: Column | str = "set_id") -> DataFrame:
    """Adds ``aliases`` (sorted, empty if none) to cards of sets; ``aliases``: set_id, alias.  Joined to the cards of a page."""
    names = aliases.groupBy(F.col("set_id").alias("__set")).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    out = cards.join(names, (F.col(key) if isinstance(key, str) else key) == F.col("__set"), "left").drop("__set")
    return out.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
