"""Aggregates over the curation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.where("polarity = 'positive'").groupBy("label").agg(F.count("*").alias("n"))


def set_counts(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Sets with the number of their members, 0 included."""
    counted = members.groupBy("set_id").agg(F.count("checksum").alias("n_files"))
    return sets.join(counted, sets["id"] == counted["set_id"], "left").select(sets["id"], "name", "studio_id", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def studio_rollup(studios: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """(studio, n_sets, n_files) of studios that have sets; members are counted per set before the join."""
    per_set = set_counts(sets, members)
    grouped = per_set.groupBy("studio_id").agg(F.count("*").alias("n_sets"), F.sum("n_files").alias("n_files"))
    return grouped.join(studios.select(F.col("id").alias("studio_id"), F.col("name").alias("studio")), "studio_id").select("studio", "n_sets", "n_files")


def identity_summary(faces: DataFrame) -> DataFrame:
    """(identity, n_faces, last_created, representative): the representative is the row with the greatest id."""
    return faces.where("identity IS NOT NULL").groupBy("identity").agg(F.count("*").alias("n_faces"), F.max("created_at").alias("last_created"), F.max("id").alias("representative"))


def latest_per_key(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The newest row of each key, ties to the greater row."""
    newest = rows.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("r"))
    return newest.select(key, F.col(f"r.{at}").alias(at), *[F.col(f"r.{c}").alias(c) for c in columns])


def ages(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Mean age and most frequent gender (ties to the least) per group, nulls left out."""
    return estimates.groupBy(*by).agg(F.round(F.avg("age"), 4).alias("mean_age"), F.mode("gender", True).alias("gender"))


def homepage(files: DataFrame, tags: DataFrame, members: DataFrame, faces: DataFrame) -> DataFrame:
    """One row of library totals, each from its own aggregation."""
    n_files = files.agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    n_tags = tags.where("polarity = 'positive'").agg(F.count_distinct("label").alias("n_labels"))
    n_members = members.agg(F.count_distinct("checksum").alias("n_in_sets"))
    n_faces = faces.agg(F.count_distinct("identity").alias("n_people"), F.count_if(F.col("identity").isNull()).alias("n_unknown"))
    one = n_files.join(n_tags, F.lit(True)).join(n_members, F.lit(True)).join(n_faces, F.lit(True))
    return one.withColumn("n_without_set", F.greatest(F.lit(0).cast("long"), F.col("n_files") - F.col("n_in_sets")))


def frame_times(frames: DataFrame) -> DataFrame:
    """Adds time_ms: the durations of the frames before."""
    from pyspark.sql import Window as W

    before = W.partitionBy("file_id").orderBy("frame_index").rowsBetween(W.unboundedPreceding, -1)
    return frames.withColumn("time_ms", F.coalesce(F.sum("duration").over(before), F.lit(0)).cast("long"))


def counts_per_hour(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, n): events of each kind in each hour."""
    return events.groupBy(F.date_trunc("hour", ts).alias("start"), kind).agg(F.count("*").alias("n"))


def top_of_each(events: DataFrame, kind: str, who: str, k: int) -> DataFrame:
    """(kind, who, n): the k most frequent of each kind; each task gives k rows of a kind at most."""
    counted = events.groupBy(kind, who).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("__r", F.row_number().over(W.partitionBy(kind).orderBy(F.desc("n"), who)))
    return ranked.where(F.col("__r") <= k).drop("__r")


def rollup_counts(rows: DataFrame, key: str, places: DataFrame, levels: list[str]) -> DataFrame:
    """Counts per place and, by rollup of the levels, above; rows are counted per key before they meet the places."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__k"))
    return counted.join(places, key).rollup(*levels).agg(F.sum("__k").alias("n"))
