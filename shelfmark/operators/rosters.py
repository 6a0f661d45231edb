"""Rosters and set algebra: categories, people in sets, typed chips."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_categories(manual: DataFrame, auto: DataFrame, rejected: DataFrame) -> DataFrame:
    """(checksum, category, source, score): manual rows, and automatic ones that are neither manual nor rejected."""
    keys = ["checksum", "category"]
    extra = auto.join(manual.select(*keys), keys, "left_anti").join(rejected.select(*keys), keys, "left_anti")
    extra = extra.groupBy(*keys).agg(F.max("score").alias("score"))
    own = manual.select(*keys).distinct()
    return own.select(*keys, F.lit("manual").alias("source"), F.lit(None).cast("double").alias("score")).unionByName(extra.select(*keys, F.lit("auto").alias("source"), "score"))


def category_counts(resolved: DataFrame, categories: DataFrame) -> DataFrame:
    counted = resolved.groupBy("category").agg(F.count("*").alias("n_files"))
    return categories.select("category").join(counted, "category", "left").select("category", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def combined_faces(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """Manual faces that are not rejected, and detected ones without a decision."""
    open_auto = auto.join(manual.where("source_face_id IS NOT NULL").select(F.col("source_face_id").alias("id")), "id", "left_anti")
    own = manual.where(~F.coalesce("rejected", F.lit(False))).select(F.concat(F.lit("manual:"), "id").alias("face_ref"), "checksum", "identity")
    return own.unionByName(open_auto.select(F.concat(F.lit("auto:"), "id").alias("face_ref"), "checksum", F.lit(None).cast("string").alias("identity")))


def people_of_sets(members: DataFrame, faces: DataFrame, photos: DataFrame, links: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(set_id, identity): people on faces or photos of members, or linked to the set, without the excluded."""
    on_faces = members.join(faces.where("identity IS NOT NULL"), "checksum").select("set_id", "identity")
    on_photos = members.join(photos, "checksum").select("set_id", "identity")
    everyone = on_faces.union(on_photos).union(links.select("set_id", "identity")).distinct()
    return everyone.join(exclusions, ["set_id", "identity"], "left_anti")


def set_roster(members: DataFrame, faces: DataFrame, photos: DataFrame, links: DataFrame, exclusions: DataFrame) -> DataFrame:
    """people_of_sets with set_linked and a representative face: the least of the set's members, else of the library."""
    people = people_of_sets(members, faces, photos, links, exclusions)
    named = faces.where("identity IS NOT NULL")
    inside = members.join(named, "checksum").groupBy("set_id", "identity").agg(F.min("id").alias("in_set"))
    anywhere = named.groupBy("identity").agg(F.min("id").alias("in_library"))
    flagged = people.join(links.select("set_id", "identity").distinct().withColumn("set_linked", F.lit(True)), ["set_id", "identity"], "left")
    out = flagged.join(inside, ["set_id", "identity"], "left").join(anywhere, "identity", "left")
    return out.select("set_id", "identity", F.coalesce("set_linked", F.lit(False)).alias("set_linked"), F.coalesce("in_set", "in_library").alias("face_id"))


def identity_checksums(faces: DataFrame, photos: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """(identity, checksum): faces, photo assignments and the members of linked sets."""
    linked = links.join(members, "set_id").select("identity", "checksum")
    return faces.where("identity IS NOT NULL").select("identity", "checksum").union(photos.select("identity", "checksum")).union(linked).distinct()


def facets(**typed: DataFrame) -> DataFrame:
    """(type, value, checksum) from frames of (value, checksum) per type."""
    parts = [df.select(F.lit(kind).alias("type"), F.col("value").cast("string").alias("value"), "checksum") for kind, df in typed.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def intersect_chips(facet: DataFrame, chips: Sequence[tuple[str, str]], everything: DataFrame) -> DataFrame:
    """Checksums that carry all chips; no chips are no restriction.  One pass and one aggregation for any number of chips."""
    if not chips:
        return everything.select("checksum").distinct()
    wanted = reduce(lambda a, b: a | b, [(F.col("type") == t) & (F.col("value") == v) for t, v in set(chips)])
    hit = facet.where(wanted).select("type", "value", "checksum").distinct()
    return hit.groupBy("checksum").agg(F.count("*").alias("n")).where(F.col("n") == len(set(chips))).select("checksum")


def effective_set(chip_hits: DataFrame | None, tag_hits: DataFrame, path_hits: DataFrame) -> DataFrame:
    """Chips win over text; without chips it is tag or path text."""
    return chip_hits if chip_hits is not None else tag_hits.select("checksum").union(path_hits.select("checksum")).distinct()


def priority_union(*ranked: DataFrame) -> DataFrame:
    """Hits of several sources, each checksum at its first source and best place in it."""
    rows = reduce(DataFrame.unionByName, [df.select("checksum", "place", F.lit(k).alias("source")) for k, df in enumerate(ranked)])
    return rows.groupBy("checksum").agg(F.min(F.struct("source", "place")).alias("b")).select("checksum", F.col("b.source").alias("source"), F.col("b.place").alias("place"))


def facet_top(facet: DataFrame, hits: DataFrame, kind: str, n: int = 6) -> DataFrame:
    """The n values of one type with most hits."""
    counted = facet.where(F.col("type") == kind).join(hits.select("checksum"), "checksum", "left_semi").groupBy("value").agg(F.count("*").alias("n_files"))
    return counted.orderBy(F.desc("n_files"), "value").limit(n)


def cards(files: DataFrame, tags: DataFrame, sets: DataFrame, titles: DataFrame, favourites: DataFrame) -> DataFrame:
    """Cards: each map is aggregated by checksum before it is joined, so a card stays one row."""
    labels = tags.groupBy("checksum").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("tags"))
    in_sets = sets.groupBy("checksum").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("sets"))
    out = files.join(labels, "checksum", "left").join(in_sets, "checksum", "left").join(titles, "checksum", "left").join(favourites, "checksum", "left")
    return out.withColumn("favorite", F.coalesce("favorite", F.lit(0).cast("long")))


def nobody_else(photos: DataFrame, roster: DataFrame, set_id: int) -> DataFrame:
    """Photos (checksum, people array) on which nobody outside the set's roster was recognised."""
    known = roster.where(F.col("set_id") == set_id).agg(F.collect_set("identity").alias("known"))  # one row
    return photos.join(F.broadcast(known), F.lit(True)).where(F.size(F.array_except("people", "known")) == 0).select(*photos.columns)
