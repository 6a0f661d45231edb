"""Composed requests: a search from chips and text to its ordered page, suggestion streams, the pages of a person or a set.

Each is one plan over the operators of this package; limits come last but before anything is joined for display.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rosters, search, vectors

Chips = Sequence[tuple[str, str]]


def resolve_search(facet: DataFrame, paths: DataFrame, chips: Chips, text: str = "") -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(chip hits, tag hits, path hits) as checksums; None where there are no chips or no text; text is narrowed by the chips."""
    chosen = rosters.intersect_chips(facet, chips, facet) if chips else None
    if not text:
        return chosen, None, None
    wanted = F.lit(text.lower())
    tagged = facet.where((F.col("type") == "tag") & F.contains(F.lower("value"), wanted)).select("checksum").distinct()
    filed = paths.where(F.contains(F.lower("path"), wanted)).select("checksum").distinct()
    if chosen is not None:
        tagged, filed = (x.join(chosen, "checksum", "left_semi") for x in (tagged, filed))
    return chosen, tagged, filed


def effective_hits(facet: DataFrame, paths: DataFrame, chips: Chips, text: str = "") -> DataFrame:
    """The checksums that a search stands for: those of the chips, else those of tag or path text, else none."""
    chosen, tagged, filed = resolve_search(facet, paths, chips, text)
    if chosen is None and tagged is None:
        return facet.select("checksum").where(F.lit(False))
    return rosters.effective_set(chosen, tagged, filed)


def ordered(files: DataFrame, hits: DataFrame, sort: str, order: str) -> DataFrame:
    """The files of the hits in order.  ``files`` has one row per checksum and the column of the sort."""
    return files.join(hits.select("checksum"), "checksum", "left_semi").orderBy(*search.sort_keys(sort, order))


def _placed(rows: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    """The first rows with their place; Spark keeps no more than ``limit`` of each task."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("section").orderBy(*keys)) - 1).where(F.col("place") < limit)


def palette(files: DataFrame, facet: DataFrame, paths: DataFrame, chips: Chips, text: str, sort: str, order: str, cap: int = 16, top: int = 6) -> DataFrame:
    """(section, place, ref, n): previews of chip, tag and path hits, the top sets and people of all hits, and their number."""
    chosen, tagged, filed = resolve_search(facet, paths, chips, text)
    hits = effective_hits(facet, paths, chips, text)
    previews = [(name, df) for name, df in (("media", chosen), ("tag_matches", tagged), ("file_matches", filed)) if df is not None]
    parts = []
    for name, found in previews:
        rows = files.join(found, "checksum", "left_semi").withColumn("section", F.lit(name))
        parts.append(_placed(rows, search.sort_keys(sort, order), cap).select("section", "place", F.col("id").cast("string").alias("ref"), F.lit(None).cast("long").alias("n")))
    for name, kind in (("sets", "set"), ("people", "person")):
        counted = rosters.facet_top(facet, hits, kind, top).withColumn("section", F.lit(name))
        parts.append(_placed(counted, [F.desc("n_files"), F.col("value")], top).select("section", "place", F.col("value").alias("ref"), F.col("n_files").alias("n")))
    parts.append(hits.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("ref"), "n"))
    return reduce(DataFrame.unionByName, parts)


def similar_page(files: DataFrame, embeddings: DataFrame, id_: int, k: int = 20) -> DataFrame:
    """(id, path, score) of the k files most like one; paths are joined to the k hits only."""
    best = vectors.similar_to(embeddings, id_, k)
    return files.select("id", "path").join(F.broadcast(best), "id").select("id", "path", F.round("score", 4).alias("score"))


def centroid_suggestions(
    embeddings: DataFrame, positives: DataFrame, decided: DataFrame, held: DataFrame, count: int, threshold: float, last: tuple[int, str] | None = None
) -> DataFrame:
    """(id, score), best first: vectors like the centroid of the positives, without decided and already held ones.

    After a decision ``last`` = (id, 'confirm' or 'reject') those like (unlike) it come first; the score stays as it was.
    """
    central = vectors.centroids(embeddings.join(positives.select("id"), "id", "left_semi")).where("centroid IS NOT NULL")
    open_ = embeddings.join(decided.select("id"), "id", "left_anti").join(held.select("id"), "id", "left_anti")
    scored = vectors.rank_by(open_, central).where(F.col("score") >= threshold)
    if last is None:
        return scored.orderBy(F.desc("score"), "id").limit(count)
    of = embeddings.where(F.col("id") == last[0]).select(F.transform("embedding", lambda x: x.cast("double")).alias("centroid")).limit(1)
    moved = vectors.rank_by(open_, of).select("id", (F.col("score") * (1.0 if last[1] == "confirm" else -1.0)).alias("bias"))
    blended = scored.join(moved, "id", "left").withColumn("bias", F.col("score") + F.coalesce("bias", F.lit(0.0)))
    return blended.orderBy(F.desc("bias"), "id").limit(count).select("id", "score")


def split_candidates(own: DataFrame, others: DataFrame, held: DataFrame, count: int) -> DataFrame:
    """(id, score): a person's faces by their best likeness to another person's; 0 where there is nothing to compare with."""
    fresh = own.join(held.select("id"), "id", "left_anti")
    best = vectors.max_similarity(fresh, others.select("id", "embedding", F.lit("other").alias("label")), "label", -2.0)
    scored = fresh.select("id").join(best.select("id", "score"), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(count)


def set_candidates(
    embeddings: DataFrame,
    members: DataFrame,
    excluded: DataFrame,
    organised: DataFrame,
    threshold: float = vectors.SUGGEST_SET,
    limit: int = 12,
    offset: int = 0,
    honor_negatives: bool = False,
    strangers: DataFrame | None = None,
) -> DataFrame:
    """(id, score): files like a set's members that are neither in it nor excluded, those in no set first.

    ``honor_negatives`` moves the centroid off the excluded ones; ``strangers`` are files that show somebody who is not of
    the set, and go.
    """
    inside = embeddings.join(members.select("id"), "id", "left_semi")
    outside = embeddings.join(excluded.select("id"), "id", "left_semi")
    central = (vectors.rocchio(inside, outside) if honor_negatives else vectors.centroids(inside)).where("centroid IS NOT NULL")
    open_ = reduce(lambda df, gone: df.join(gone.select("id"), "id", "left_anti"), [members, excluded] + ([] if strangers is None else [strangers]), embeddings)
    scored = vectors.rank_by(open_, central).where(F.col("score") >= threshold)
    return search.unorganised_first(scored, organised).orderBy("organised", F.desc("score"), "id").offset(offset).limit(limit).select("id", "score")


def best_sets_of_file(embeddings: DataFrame, members: DataFrame, people_of_sets: DataFrame, people_of_files: DataFrame, id_: int, threshold: float = vectors.SUGGEST_SET, limit: int = 3) -> DataFrame:
    """(set_id, score): sets whose centroid is like the file, without those it is in; with recognised people, only sets that hold one of them."""
    mine = members.where(F.col("id") == id_).select("set_id")
    known = people_of_files.where(F.col("id") == id_).select("identity").distinct()
    anybody = F.broadcast(known.agg(F.count("*").alias("n_people")))  # one row
    related = people_of_sets.join(known, "identity", "left_semi").select("set_id").distinct().withColumn("related", F.lit(True))
    central = vectors.centroids(embeddings.join(members.join(mine, "set_id", "left_anti"), "id"), ["set_id"]).where("centroid IS NOT NULL")
    allowed = central.join(related, "set_id", "left").join(anybody, F.lit(True)).where("related OR n_people = 0")
    file = F.broadcast(embeddings.where(F.col("id") == id_).select("embedding").limit(1))  # one row
    scored = allowed.join(file, F.lit(True)).select("set_id", vectors.dot(F.col("embedding"), F.col("centroid")).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "set_id").limit(limit)


def person_photos(instances: DataFrame, files: DataFrame, ages: DataFrame, sort: str = "added", order: str = "desc", offset: int = 0, limit: int = 20) -> DataFrame:
    """(face_id, id, path, age): a page of a person's appearances, each with its own face's age."""
    rows = instances.join(files, "checksum").join(ages.select("face_id", "age"), "face_id", "left")
    keys = search.sort_keys(sort, order)
    return rows.orderBy(*keys, F.asc_nulls_last("face_id")).offset(offset).limit(limit).select("face_id", "id", "path", "age")


def person_page(instances: DataFrame, tags: DataFrame, members: DataFrame, linked: DataFrame) -> DataFrame:
    """(kind, value, n): how often each tag stands on a person's photos, and the sets linked to the person or holding such a photo.

    ``instances``: checksum; ``tags``: checksum, label; ``members``: checksum, set_id; ``linked``: set_id.
    """
    photos = instances.select("checksum").distinct()
    counted = tags.select("checksum", "label").distinct().join(photos, "checksum", "left_semi").groupBy("label").agg(F.count("*").alias("n"))
    holding = members.join(photos, "checksum", "left_semi").select("set_id").union(linked.select("set_id")).distinct()
    sets = holding.select(F.lit("set").alias("kind"), F.col("set_id").cast("string").alias("value"), F.lit(None).cast("long").alias("n"))
    return counted.select(F.lit("tag").alias("kind"), F.col("label").alias("value"), "n").unionByName(sets)


def gallery_page(files: DataFrame, favourites: DataFrame, touched: Sequence[DataFrame], seed: int = 0, top: int = 60, few: int = 6) -> DataFrame:
    """(section, place, checksum): most favoured files, least viewed ones that nobody has touched, and random ones.

    ``favourites``: checksum, count; ``touched``: frames of checksums that have a name, a set, a tag or a category.
    """
    loved = favourites.where("count > 0").join(files.select("checksum", "id"), "checksum").withColumn("section", F.lit("favorites"))
    open_ = reduce(lambda df, gone: df.join(gone.select("checksum").distinct(), "checksum", "left_anti"), touched, files)
    parts = [
        _placed(loved, [F.desc("count"), F.col("checksum")], top),
        _placed(open_.withColumn("section", F.lit("needs_attention")), [F.asc("view_count"), F.col("id")], few),
        _placed(files.withColumn("section", F.lit("random")), [F.xxhash64(F.lit(seed), F.col("id")), F.col("id")], few),
    ]
    return reduce(DataFrame.unionByName, [p.select("section", "place", "checksum") for p in parts])


def probe_examples(embeddings: DataFrame, decisions: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, embedding, label) that a probe learns from: files with a decision and a vector, and decided regions by their own vectors.

    ``embeddings``: id, checksum, embedding; ``decisions``: checksum, polarity (one per file); ``regions``: id, embedding
    (null where a crop could not be read; such regions are skipped), polarity.
    """
    label = (F.col("polarity") == "positive").cast("int").alias("label")
    whole = embeddings.join(decisions, "checksum").select(F.concat(F.lit("file:"), F.col("id").cast("string")).alias("id"), "embedding", label)
    parts = regions.where("embedding IS NOT NULL").select(F.concat(F.lit("region:"), F.col("id").cast("string")).alias("id"), "embedding", label)
    return whole.unionByName(parts)


def set_detail(members: DataFrame, files: DataFrame, sort: str = "position", order: str = "asc") -> DataFrame:
    """A set's files in manual or any other order.  ``members``: checksum, position."""
    return files.join(members.select("checksum", "position"), "checksum").orderBy(*search.sort_keys(sort, order))


def files_meta(ids: DataFrame, files: DataFrame, titles: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, name, sets): title or base name, and the names of the sets; ids without a file are left out."""
    from ..functions.scalar import basename

    rows = files.join(ids.select("id").distinct(), "id", "left_semi")
    names = sets.join(rows.select("checksum"), "checksum", "left_semi").groupBy("checksum").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("sets"))
    out = rows.join(titles.select("checksum", "title"), "checksum", "left").join(names, "checksum", "left")
    return out.select("id", F.coalesce("title", basename(F.col("path"))).alias("name"), F.coalesce("sets", F.lit("")).alias("sets"))


def service_stats(tables: dict[str, DataFrame], embeddings: dict[str, DataFrame]) -> DataFrame:
    """(section, name, n): rows of each table, and rows and bytes of each vector table; one aggregation each."""
    from .queues import embedding_stats

    rows = [df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("section"), F.lit(name).alias("name"), "n") for name, df in tables.items()]
    for name, df in embeddings.items():
        sized = embedding_stats(df).select(F.explode(F.create_map(F.lit("vectors"), F.col("n_rows"), F.lit("bytes"), F.col("n_bytes"))).alias("section", "n"))
        rows.append(sized.select("section", F.lit(name).alias("name"), "n"))
    return reduce(DataFrame.unionByName, rows)
