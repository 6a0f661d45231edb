"""Lookups over the curation tables: by key, by lists of keys, grouped to lists per key.

Key lists are DataFrames and become semi-joins, so there is no bound on their length and no chunking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_keys(table: DataFrame, keys: DataFrame, key: str = "checksum") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_semi")


def values_by_key(links: DataFrame, key: str, value: str, fold_case: bool = False) -> DataFrame:
    """(key, values): sorted distinct values of each key as one text, separated by commas."""
    values = F.array_sort(F.collect_set(value))
    if fold_case:
        values = F.transform(F.array_sort(F.transform(values, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))), lambda s: s["v"])
    return links.groupBy(key).agg(F.array_join(values, ",").alias("values"))


def positive_labels(tags: DataFrame) -> DataFrame:
    return tags.where("polarity = 'positive'").select("checksum", "label").distinct()


def negative_labels(tags: DataFrame) -> DataFrame:
    return tags.where("polarity = 'negative'").select("checksum", "label").distinct()


def decided(tags: DataFrame, label: str) -> DataFrame:
    """Checksums with a decision of either polarity."""
    return tags.where(F.col("label") == label).select("checksum").distinct()


def last_polarity(tags: DataFrame, label: str) -> DataFrame:
    """(checksum, polarity): the decision with the greatest id counts."""
    return tags.where(F.col("label") == label).groupBy("checksum").agg(F.max_by("polarity", "id").alias("polarity"))


def counts_with_default(keys: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """Counts of the keys, 0 where there is none."""
    return keys.select(key).distinct().join(counted.select(key, count), key, "left").select(key, F.coalesce(count, F.lit(0)).alias(count))


def top_favourites(counts: DataFrame, key: str, count: str, limit: int = 60) -> DataFrame:
    return counts.where(F.col(count) > 0).orderBy(F.desc(count), key).limit(limit)


def variants(names: DataFrame, name: str, column: str = "name") -> DataFrame:
    """(column, n) of other spellings of a name that differ by case only."""
    return names.where((F.lower(column) == name.lower()) & (F.col(column) != name)).groupBy(column).agg(F.count("*").alias("n"))


def find_set(sets: DataFrame, name: str, studio: str | None = None) -> DataFrame:
    return sets.where((F.col("name") == name) & F.col("studio").eqNullSafe(F.lit(studio)))


def identity_instances(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """(identity, checksum, face_id): one row per face, and per photo assignment that no face covers."""
    named = faces.where("identity IS NOT NULL").select("identity", "checksum", F.col("id").alias("face_id"))
    extra = photos.select("identity", "checksum").distinct().join(named, ["identity", "checksum"], "left_anti")
    return named.unionByName(extra.withColumn("face_id", F.lit(None).cast("long")))


def scrub_identity(faces: DataFrame, photos: DataFrame, members: DataFrame, identity: str, set_id: int) -> tuple[DataFrame, DataFrame]:
    """(faces, photos) after a person is taken off all photos of a set."""
    inside = members.where(F.col("set_id") == set_id).select("checksum").distinct().withColumn("__in", F.lit(True))
    marked = faces.join(inside, "checksum", "left")
    cleared = marked.withColumn("identity", F.when(F.coalesce("__in", F.lit(False)) & (F.col("identity") == identity), None).otherwise(F.col("identity")))
    rest = photos.join(inside, "checksum", "left").where(~(F.coalesce("__in", F.lit(False)) & (F.col("identity") == identity)))
    return cleared.select(*faces.columns), rest.select(*photos.columns)


def confirm_above(suggestions: DataFrame, threshold: float) -> DataFrame:
    """Decisions (source_face_id, identity, action) of all suggestions at or above a threshold."""
    return suggestions.where(F.col("score") >= threshold).select(F.col("id").alias("source_face_id"), "identity", F.lit("confirm").alias("action"))


def captures_of(captures: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, child, time_ms) of the stills of some parents, in time order within each."""
    return captures.join(parents.select("parent").distinct(), "parent", "left_semi")
