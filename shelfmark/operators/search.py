"""Search: detected classes, path text, sort keys, cards, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import basename, fuzzy_score

SENTINEL = "__indexed__"


def search_classes(detections: DataFrame, tokens: list[str], limit: int | None = None) -> DataFrame:
    """(file_id, score): summed confidence of primary detections whose class holds any token, best first."""
    lowered = F.lower("class_name")
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.contains(lowered, F.lit(t.lower()))
    rows = detections.where(hit & (F.col("class_name") != SENTINEL))
    if "frame_index" in detections.columns:
        rows = rows.where("frame_index = 0")
    out = rows.groupBy("file_id").agg(F.sum("confidence").alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "file_id").limit(limit)


def detected_classes(detections: DataFrame) -> DataFrame:
    """(file_id, class_name, confidence): distinct classes of each file at their best."""
    return detections.where(F.col("class_name") != SENTINEL).groupBy("file_id", "class_name").agg(F.max("confidence").alias("confidence"))


def best_boxes(detections: DataFrame) -> DataFrame:
    """Per file and class the box of the most confident detection, ties to the least id."""
    best = detections.groupBy("file_id", "class_name").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "id")).alias("b"))
    return best.select("file_id", "class_name", F.col("b.id").alias("detection_id"), (-F.col("b.minus")).alias("confidence"))


def sort_keys(sort: str, order: str = "asc") -> list[Column]:
    """Keys of a listing; missing ages, positions and distances come last in both directions; ties by id."""
    down = order == "desc"
    last = {"age", "distance", "position"}
    expr = {
        "added": F.col("first_seen"),
        "modified": F.coalesce(F.col("modified"), F.lit(0)),
        "filename": F.lower(basename(F.col("path"))),
        "favorites": F.coalesce(F.col("favorite"), F.lit(0)),
        "age": F.col("age"),
        "distance": F.col("km"),
        "position": F.col("position"),
        "size": F.col("size"),
    }[sort]
    if sort in last:
        return [expr.desc_nulls_last() if down else expr.asc_nulls_last(), F.col("id")]
    return [expr.desc() if down else expr.asc(), F.col("id")]


def manual_order(members: DataFrame, set_id: int) -> DataFrame:
    """A set's members by their manual position, those without one last."""
    return members.where(F.col("set_id") == set_id).orderBy(F.asc_nulls_last("position"), "checksum")


def unorganised_first(scored: DataFrame, organised: DataFrame) -> DataFrame:
    """Adds ``organised`` (0 before 1): rows that are in no set come first, each part by score."""
    flags = organised.select("id").distinct().withColumn("organised", F.lit(1))
    return scored.join(flags, "id", "left").withColumn("organised", F.coalesce("organised", F.lit(0)))


def fuzzy_rank(items: DataFrame, query: str, per_type: int = 6) -> DataFrame:
    """(type, label, score, place): the best fuzzy matches of each type, at most ``per_type``."""
    scored = items.select("type", "label").distinct().withColumn("score", F.round(fuzzy_score(F.lit(query), F.col("label")), 6)).where("score IS NOT NULL")
    # Spark keeps no more than ``per_type`` rows of a type in each task before the shuffle.
    ranked = scored.withColumn("n", F.row_number().over(W.partitionBy("type").orderBy("score", "label")))
    return ranked.where(F.col("n") <= per_type).select("type", "label", "score", (F.col("n") - 1).alias("place"))


def feed(files: DataFrame, source: str, anti: list[DataFrame], limit: int = 8, offset: int = 0, seed: int = 0) -> DataFrame:
    """A feed (biggest, random, favorites, unloved) without what the toggles exclude; limit clamped to 1..30."""
    rows = files
    for t in anti:
        rows = rows.join(t.select("checksum").distinct(), "checksum", "left_anti")
    keys = {
        "biggest": [F.desc("size"), F.col("id")],
        "random": [F.xxhash64(F.lit(seed), "id"), F.col("id")],
        "favorites": [F.desc("favorite"), F.col("id")],
        "unloved": [F.asc("view_count"), F.xxhash64(F.lit(seed), "id"), F.col("id")],
    }[source]
    rows = rows.where("favorite > 0") if source == "favorites" else rows
    return rows.orderBy(*keys).offset(offset).limit(max(1, min(30, limit)))


def collapse_into_sets(photos: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, ref, sort_value, n): photos in sets become one card per set at the mean of their values."""
    inside = photos.join(members, "checksum").groupBy("set_id").agg(F.avg("value").alias("sort_value"), F.count("*").alias("n"))
    alone = photos.join(members.select("checksum").distinct(), "checksum", "left_anti")
    sets = inside.select(F.lit("set").alias("kind"), F.col("set_id").cast("string").alias("ref"), "sort_value", "n")
    return sets.unionByName(alone.select(F.lit("photo").alias("kind"), F.col("checksum").alias("ref"), F.col("value").cast("double").alias("sort_value"), F.lit(1).cast("long").alias("n")))


def folder_suggestions(paths: DataFrame, limit: int = 8) -> DataFrame:
    """Parent folders of a set's files by frequency."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return paths.select(folder.alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(limit)
