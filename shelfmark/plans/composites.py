"""Queries of the composed requests, the write paths and the parsers, with their SQL; registered like those of ``queries``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalog, composed, curation, lookups, probe, queues, rosters, search, vectors
from ..sources import scan, sinks
from .fixtures import Library, shared_folder
from .registry import query

# Listings in every order


def _gallery(t: Library) -> DataFrame:
    """id, checksum, path, size, first_seen, modified, favorite, age, km, position; some without age, place or position."""
    paths = t.listing.select("id", "path")
    files = t.files.select("id", "checksum", "size", "first_seen").join(paths, "id")
    return files.select(
        "*",
        F.when(F.col("id") % 5 != 0, F.col("id") * 37 % 1009).alias("modified"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("favorite"),
        F.when(F.col("id") % 4 != 0, F.col("id") % 83).alias("age"),
        F.when(F.col("id") % 6 != 0, F.col("id") * 53 % 997).alias("km"),
        F.when(F.col("id") % 2 == 0, F.col("id") * 29 % 991).alias("position"),
    )


GALLERY = """gallery AS (SELECT f.id, f.checksum, f.size, f.first_seen, l.path, CASE WHEN f.id % 5 <> 0 THEN f.id * 37 % 1009 END AS modified, CASE WHEN f.id % 3 = 0 THEN f.id % 7 END AS favorite,
CASE WHEN f.id % 4 <> 0 THEN f.id % 83 END AS age, CASE WHEN f.id % 6 <> 0 THEN f.id * 53 % 997 END AS km, CASE WHEN f.id % 2 = 0 THEN f.id * 29 % 991 END AS position FROM files f JOIN listing l ON l.id = f.id)"""
#: Sort, and its key in SQL.
SORTS = {
    "added": "first_seen",
    "modified": "coalesce(modified, 0)",
    "filename": "lower(regexp_extract(path, '[^/]*$'))",
    "favorites": "coalesce(favorite, 0)",
    "age": "age",
    "distance": "km",
    "position": "position",
    "size": "size",
}


def _gallery_sql() -> str:
    parts = [
        f"SELECT '{sort}' AS sort, '{way}' AS direction, id, row_number() OVER (ORDER BY {key} {way.upper()} NULLS LAST, id) - 1 AS place FROM gallery QUALIFY place < 25"
        for sort, key in SORTS.items()
        for way in ("asc", "desc")
    ]
    return f"WITH {GALLERY} " + " UNION ALL ".join(parts)


@query(_gallery_sql(), "listing", "files")
def gallery_orders(t: Library) -> DataFrame:
    """The first 25 of every sort in both directions."""
    out = None
    for sort in SORTS:
        for way in ("asc", "desc"):
            rows = _gallery(t).withColumn("section", F.lit(sort))
            part = composed._placed(rows, search.sort_keys(sort, way), 25).select(F.col("section").alias("sort"), F.lit(way).alias("direction"), "id", "place")
            out = part if out is None else out.unionByName(part)
    return out


# Composed search


def _search_facets(t: Library) -> DataFrame:
    docs = t.raw("documents").select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("checksum"))
    people = t.faces.where("identity IS NOT NULL AND checksum IS NOT NULL")
    return rosters.facets(
        tag=t.tags.where("polarity = 'positive'").select(F.col("label").alias("value"), "checksum"),
        set=docs.select(F.col("source").alias("value"), "checksum"),
        lang=docs.select(F.col("lang").alias("value"), "checksum"),
        person=people.select(F.col("identity").alias("value"), "checksum"),
    )


SEARCH = """facet AS (SELECT DISTINCT 'tag' AS type, label AS value, checksum FROM tags WHERE polarity = 'positive' UNION SELECT DISTINCT 'set', source, md5(text) FROM documents
UNION SELECT DISTINCT 'lang', lang, md5(text) FROM documents UNION SELECT DISTINCT 'person', identity, checksum FROM faces WHERE identity IS NOT NULL AND checksum IS NOT NULL)"""


@query(
    f"""WITH {GALLERY}, {SEARCH}, hits AS (SELECT checksum FROM facet WHERE type = 'tag' AND value = 'quality' INTERSECT SELECT checksum FROM facet WHERE type = 'lang' AND value = 'en')
SELECT id, path, age FROM gallery WHERE checksum IN (SELECT checksum FROM hits) ORDER BY age DESC NULLS LAST, id LIMIT 40""",
    "tags",
    "files",
    "faces",
)
def search_page(t: Library) -> DataFrame:
    """Chips, then order, then a page."""
    hits = composed.effective_hits(_search_facets(t), t.listing, [("tag", "quality"), ("lang", "en")])
    return composed.ordered(_gallery(t), hits, "age", "desc").limit(40).select("id", "path", "age")


@query(
    f"WITH {GALLERY}, {SEARCH}, hits AS (SELECT checksum FROM facet WHERE type = 'tag' AND contains(lower(value), 'src4') UNION SELECT checksum FROM listing WHERE contains(lower(path), 'src4')) SELECT id FROM gallery WHERE checksum IN (SELECT checksum FROM hits)",
    "tags",
    "files",
    "faces",
)
def search_ids(t: Library) -> DataFrame:
    """Free text alone: all ids, in order."""
    return composed.ordered(_gallery(t), composed.effective_hits(_search_facets(t), t.listing, [], "SRC4"), "filename", "asc").select("id")


def _section(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS section, row_number() OVER (ORDER BY first_seen DESC, id) - 1 AS place, id::VARCHAR AS ref, NULL::BIGINT AS n FROM gallery WHERE {condition} QUALIFY place < 16"


def _top(name: str, kind: str) -> str:
    return f"SELECT '{name}', row_number() OVER (ORDER BY count(*) DESC, value) - 1 AS place, value, count(*) FROM facet WHERE type = '{kind}' AND checksum IN (SELECT checksum FROM chosen) GROUP BY value QUALIFY place < 6"


@query(
    f"""WITH {GALLERY}, {SEARCH}, chosen AS (SELECT checksum FROM facet WHERE type = 'lang' AND value = 'en'), tagged AS (SELECT checksum FROM facet WHERE type = 'tag' AND contains(value, 'tox') INTERSECT SELECT checksum FROM chosen),
filed AS (SELECT checksum FROM listing WHERE contains(lower(path), 'tox') INTERSECT SELECT checksum FROM chosen)
{_section("media", "checksum IN (SELECT checksum FROM chosen)")} UNION ALL {_section("tag_matches", "checksum IN (SELECT checksum FROM tagged)")} UNION ALL {_section("file_matches", "checksum IN (SELECT checksum FROM filed)")}
UNION ALL {_top("sets", "set")} UNION ALL {_top("people", "person")} UNION ALL SELECT 'total', 0, NULL, (SELECT count(DISTINCT checksum) FROM chosen)""",
    "tags",
    "files",
    "faces",
)
def search_palette(t: Library) -> DataFrame:
    """Chips and text together: previews, top sets and people, and the number of hits."""
    return composed.palette(_gallery(t), _search_facets(t), t.listing, [("lang", "en")], "tox", "added", "desc")


# Suggestion streams

UNIT = "u AS (SELECT list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM (SELECT list(m ORDER BY k) AS c FROM (SELECT k, avg(e[k]) AS m FROM vectors, unnest(generate_series(1, len(e))) AS g(k) WHERE {where} GROUP BY 1)))"


def _stream(t: Library, last: tuple[int, str] | None) -> DataFrame:
    decided = t.vectors.where("label = 3 OR id % 11 = 0").select("id")
    held = t.vectors.where("id % 13 = 0").select("id")
    out = composed.centroid_suggestions(t.vectors, t.vectors.where("label = 3"), decided, held, 40, -0.05, last)
    return out.withColumn("score", F.round("score", 4))


STREAM = f"WITH {UNIT.format(where='label = 3')}, s AS (SELECT v.id, list_inner_product(v.e, u.c) AS x, list_inner_product(v.e, b.e) AS y FROM vectors v, u, (SELECT e FROM vectors WHERE id = 4) b WHERE label <> 3 AND v.id % 11 <> 0 AND v.id % 13 <> 0)"


@query(f"{STREAM} SELECT id, round(x, 4) AS score FROM s WHERE x >= -0.05 ORDER BY x DESC, id LIMIT 40", "vectors")
def tag_suggestions(t: Library) -> DataFrame:
    return _stream(t, None)


@query(f"{STREAM} SELECT id, round(x, 4) AS score FROM s WHERE x >= -0.05 ORDER BY x + y DESC, id LIMIT 40", "vectors")
def tag_suggestions_after_confirm(t: Library) -> DataFrame:
    return _stream(t, (4, "confirm"))


@query(f"{STREAM} SELECT id, round(x, 4) AS score FROM s WHERE x >= -0.05 ORDER BY x - y DESC, id LIMIT 40", "vectors")
def tag_suggestions_after_reject(t: Library) -> DataFrame:
    return _stream(t, (4, "reject"))


@query(
    "WITH s AS (SELECT a.id, max(list_inner_product(a.e, b.e)) AS x FROM vectors a, vectors b WHERE a.label = 1 AND a.id % 7 <> 0 AND b.label = 2 GROUP BY 1) SELECT id, round(x, 4) AS score FROM s ORDER BY x DESC, id LIMIT 25",
    "vectors",
)
def split_candidates(t: Library) -> DataFrame:
    out = composed.split_candidates(t.vectors.where("label = 1"), t.vectors.where("label = 2"), t.vectors.where("id % 7 = 0"), 25)
    return out.withColumn("score", F.round("score", 4))


@query(
    "WITH c AS (SELECT id, label, id % 7 = 0 AS held FROM vectors WHERE NOT id % 5 = 0), r AS (SELECT id, row_number() OVER (ORDER BY label = 2, id) AS k FROM c WHERE NOT held) SELECT id FROM r WHERE k <= 30",
    "vectors",
)
def suggestion_stream(t: Library) -> DataFrame:
    """Cards without those held; the label of the last rejection comes last."""
    cards = t.vectors.where("id % 5 <> 0").select("id", "label", (-F.col("id")).cast("double").alias("score"))
    return vectors.suggestion_stream(cards, t.vectors.where("id % 7 = 0"), 30, last=F.col("label") == 2).select("id")


@query(
    "(SELECT 'confirm' AS action, id FROM vectors ORDER BY label IS NOT DISTINCT FROM 2 DESC, id LIMIT 30) UNION ALL (SELECT 'reject', id FROM vectors WHERE label IN (1, 2) ORDER BY label IS NOT DISTINCT FROM 2, id LIMIT 70)",
    "vectors",
)
def bias_reorder(t: Library) -> DataFrame:
    """The first cards after a confirmation and after a rejection."""
    cards = t.vectors.select("id", F.col("label").cast("string").alias("k"), F.col("id").alias("place"))
    first = vectors.bias_reorder(cards, F.col("k"), "2", "confirm").limit(30).select(F.lit("confirm").alias("action"), "id")
    then = vectors.bias_reorder(cards.where("k IN ('1', '2')"), F.col("k"), "2", "reject").limit(70).select(F.lit("reject").alias("action"), "id")
    return first.unionByName(then)


@query(
    f"WITH {UNIT.format(where='label = 1')}, s AS (SELECT v.id, list_inner_product(v.e, u.c) AS x, v.id % 2 AS organised FROM vectors v, u WHERE v.label <> 1 AND v.id % 17 <> 0 AND v.id % 19 <> 0) SELECT id, round(x, 4) AS score FROM s WHERE x >= -0.1 ORDER BY organised, x DESC, id LIMIT 30 OFFSET 5",
    "vectors",
)
def set_candidates(t: Library) -> DataFrame:
    """Files like a set's members, those in no set first, without excluded ones and those that show a stranger."""
    out = composed.set_candidates(
        t.vectors, t.vectors.where("label = 1"), t.vectors.where("id % 17 = 0 AND label <> 1"), t.vectors.where("id % 2 = 1"), -0.1, 30, 5, strangers=t.vectors.where("id % 19 = 0 AND label <> 1")
    )
    return out.withColumn("score", F.round("score", 4))


BEST_SETS = """cen AS (SELECT set_id, list(m ORDER BY k) AS c FROM (SELECT id % 12 AS set_id, k, avg(e[k]) AS m FROM vectors, unnest(generate_series(1, len(e))) AS g(k) WHERE id % 12 <> 3 GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT set_id, list_inner_product(c, (SELECT e FROM vectors WHERE id = 15)) / sqrt(list_inner_product(c, c)) AS x FROM cen)"""


@query(f"WITH {BEST_SETS} SELECT set_id, round(x, 4) AS score FROM s WHERE x >= -1 AND set_id IN (1, 4, 7, 10) ORDER BY x DESC, set_id LIMIT 3", "vectors")
def best_sets_of_file(t: Library) -> DataFrame:
    """A file with a recognised person: only sets that hold the person."""
    members = t.vectors.select((F.col("id") % 12).alias("set_id"), "id")
    holds = members.select("set_id").distinct().select("set_id", F.concat(F.lit("p"), F.col("set_id") % 3).alias("identity"))
    on_file = t.spark.createDataFrame([(15, "p1")], "id long, identity string")
    return composed.best_sets_of_file(t.vectors, members, holds, on_file, 15, -1.0).withColumn("score", F.round("score", 4))


@query(f"WITH {BEST_SETS} SELECT set_id, round(x, 4) AS score FROM s WHERE x >= -1 ORDER BY x DESC, set_id LIMIT 3", "vectors")
def best_sets_of_unknown(t: Library) -> DataFrame:
    members = t.vectors.select((F.col("id") % 12).alias("set_id"), "id")
    nobody = t.spark.createDataFrame([], "id long, identity string")
    holds = t.spark.createDataFrame([], "set_id long, identity string")
    return composed.best_sets_of_file(t.vectors, members, holds, nobody, 15, -1.0).withColumn("score", F.round("score", 4))


@query(
    "WITH s AS (SELECT v.id, list_inner_product(v.e, q.e) AS x FROM vectors v, (SELECT e FROM vectors WHERE id = 5) q WHERE v.id <> 5 ORDER BY x DESC, id LIMIT 20) SELECT s.id, l.path, round(x, 4) AS score FROM s JOIN listing l ON l.id = s.id",
    "vectors",
    "listing",
)
def similar_page(t: Library) -> DataFrame:
    return composed.similar_page(t.listing, t.vectors, 5)


# Pages of a person, a set, a list of files


@query(
    f"WITH {GALLERY} SELECT f.id AS face_id, g.id, g.path, CASE WHEN f.id % 3 <> 0 THEN f.id % 60 END AS age FROM faces f JOIN gallery g USING (checksum) WHERE f.identity = 'person 1' ORDER BY age DESC NULLS LAST, g.id, face_id LIMIT 20 OFFSET 5",
    "faces",
    "files",
)
def person_photos(t: Library) -> DataFrame:
    """Oldest first; each appearance has its own face's age."""
    instances = t.faces.where("identity = 'person 1'").select(F.col("id").alias("face_id"), "checksum")
    ages = t.faces.where("id % 3 <> 0").select(F.col("id").alias("face_id"), (F.col("id") % 60).alias("age"))
    return composed.person_photos(instances, _gallery(t).drop("age"), ages, "age", "desc", 5, 20)


@query(
    """WITH ph AS (SELECT DISTINCT checksum FROM faces WHERE identity = 'person 1' AND checksum IS NOT NULL)
SELECT 'tag' AS kind, label AS value, count(DISTINCT checksum) AS n FROM tags WHERE polarity = 'positive' AND checksum IN (SELECT checksum FROM ph) GROUP BY 2
UNION ALL SELECT 'set', v, NULL FROM (SELECT source AS v FROM documents WHERE md5(text) IN (SELECT checksum FROM ph) UNION SELECT 'linked ' || n_nationkey FROM nation WHERE n_nationkey < 3)""",
    "faces",
    "tags",
)
def person_page(t: Library) -> DataFrame:
    instances = t.faces.where("identity = 'person 1' AND checksum IS NOT NULL")
    members = t.raw("documents").select(F.md5(F.col("text").cast("binary")).alias("checksum"), F.col("source").alias("set_id"))
    linked = t.raw("nation").where("n_nationkey < 3").select(F.concat(F.lit("linked "), F.col("n_nationkey").cast("string")).alias("set_id"))
    return composed.person_page(instances, t.tags.where("polarity = 'positive'"), members, linked)


@query(
    """WITH fav AS (SELECT l.checksum, count(*) AS n FROM events e JOIN listing l ON l.id = e.user_id WHERE event_type = 'purchase' GROUP BY 1)
(SELECT 'favorites' AS section, row_number() OVER (ORDER BY n DESC, checksum) - 1 AS place, checksum FROM fav WHERE checksum IN (SELECT checksum FROM files) QUALIFY place < 60)
UNION ALL (SELECT 'needs_attention', row_number() OVER (ORDER BY view_count, id) - 1 AS place, checksum FROM files WHERE checksum NOT IN (SELECT checksum FROM tags WHERE polarity = 'positive') AND checksum NOT IN (SELECT checksum FROM faces WHERE identity IS NOT NULL AND checksum IS NOT NULL) QUALIFY place < 6)""",
    "files",
    "tags",
    "faces",
)
def gallery_page(t: Library) -> DataFrame:
    """Without the random part, which no SQL repeats; its rows are drawn by a seeded hash."""
    sums = t.listing.select(F.col("id").alias("user_id"), "checksum")
    favourites = t.raw("events").where("event_type = 'purchase'").join(sums, "user_id").groupBy("checksum").agg(F.count("*").alias("count"))
    touched = [t.tags.where("polarity = 'positive'"), t.faces.where("identity IS NOT NULL AND checksum IS NOT NULL")]
    return composed.gallery_page(t.files, favourites, touched).where("section <> 'random'")


@query(
    """WITH p AS (SELECT checksum, arg_max(polarity, id) AS polarity FROM tags WHERE label = 'quality' GROUP BY 1)
SELECT 'file:' || f.id AS id, CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END AS label, round(f.e[1], 6) AS first FROM faces f JOIN p USING (checksum)
UNION ALL SELECT 'region:' || id, CASE WHEN label = 1 THEN 1 ELSE 0 END, round(e[1], 6) FROM vectors WHERE id % 5 = 0 AND id % 10 <> 0""",
    "tags",
    "faces",
)
def probe_examples(t: Library) -> DataFrame:
    """Whole files by their last decision, regions by their own vectors; regions without one are skipped."""
    regions = t.vectors.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("label") == 1, "positive").otherwise("negative").alias("polarity"))
    out = composed.probe_examples(t.faces.select("id", "checksum", "embedding"), lookups.last_polarity(t.tags, "quality"), regions)
    return out.select("id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(f"WITH {GALLERY} SELECT id, CASE WHEN id % 3 = 0 THEN id * 7 % 101 END AS position FROM gallery WHERE starts_with(path, 'src3/')", "files")
def set_detail(t: Library) -> DataFrame:
    files = _gallery(t).drop("position")
    members = files.where(F.col("path").startswith("src3/")).select("checksum", F.when(F.col("id") % 3 == 0, F.col("id") * 7 % 101).alias("position"))
    return composed.set_detail(members, files).select("id", "position")


@query(
    f"""WITH {GALLERY} SELECT g.id, coalesce(CASE WHEN g.id % 4 = 0 THEN 'Title ' || g.id END, regexp_extract(path, '[^/]*$')) AS name, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM documents d WHERE md5(d.text) = g.checksum) AS sets
FROM gallery g WHERE g.id IN (SELECT doc_id + 1 FROM labels)""",
    "files",
)
def files_meta(t: Library) -> DataFrame:
    files = _gallery(t)
    titles = files.where("id % 4 = 0").select("checksum", F.concat(F.lit("Title "), F.col("id").cast("string")).alias("title"))
    sets = t.raw("documents").select(F.md5(F.col("text").cast("binary")).alias("checksum"), F.col("source").alias("name"))
    return composed.files_meta(t.raw("labels").select((F.col("doc_id") + 1).alias("id")), files, titles, sets)


@query(
    "SELECT 'rows' AS section, 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'rows', 'tags', count(*) FROM tags UNION ALL SELECT 'vectors', 'clip', count(*) FROM vectors UNION ALL SELECT 'bytes', 'clip', sum(len(e)) * 4 FROM vectors",
    "files",
    "tags",
    "vectors",
)
def service_stats(t: Library) -> DataFrame:
    return composed.service_stats({"files": t.files, "tags": t.tags}, {"clip": t.vectors})


@query("SELECT id, round(x, 4) AS score, organised FROM (SELECT v.id, list_inner_product(v.e, q.e) AS x, CASE WHEN EXISTS (SELECT 1 FROM labels WHERE doc_id = v.id) THEN 1 ELSE 0 END AS organised FROM vectors v, (SELECT e FROM vectors WHERE id = 0) q)", "vectors")
def unorganised_first(t: Library) -> DataFrame:
    of = t.vectors.where("id = 0").select(F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
    return search.unorganised_first(vectors.rank_by(t.vectors, of), t.raw("labels").select(F.col("doc_id").alias("id"))).withColumn("score", F.round("score", 4))


@query(
    """WITH ph AS (SELECT l_orderkey AS checksum, list(DISTINCT p_brand) AS people FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' GROUP BY 1),
known AS (SELECT DISTINCT p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' AND o_custkey = 7)
SELECT checksum FROM ph WHERE NOT EXISTS (SELECT 1 FROM unnest(people) AS u(x) WHERE x NOT IN (SELECT b FROM known))"""
)
def nobody_else(t: Library) -> DataFrame:
    lines = t.raw("lineitem").where("l_returnflag = 'A'").join(t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("identity")), "l_partkey")
    photos = lines.groupBy(F.col("l_orderkey").alias("checksum")).agg(F.collect_set("identity").alias("people"))
    roster = lines.join(t.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("set_id"), "identity").distinct()
    return rosters.nobody_else(photos, roster, 7).select("checksum")


@query(
    """SELECT 'manual:' || doc_id AS face_ref, 'x' AS checksum, 'p' || quality AS identity FROM labels WHERE toxic = 0
UNION ALL SELECT 'auto:' || id, checksum, NULL FROM faces WHERE id NOT IN (SELECT doc_id * 2 FROM labels)""",
    "faces",
)
def combined_faces(t: Library) -> DataFrame:
    manual = t.raw("labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2).alias("source_face_id"), F.lit("x").alias("checksum"), F.concat(F.lit("p"), "quality").alias("identity"), (F.col("toxic") == 1).alias("rejected"))
    return rosters.combined_faces(manual, t.faces.select("id", "checksum"))


# Lookups


@query("SELECT DISTINCT checksum FROM tags WHERE label = 'toxic'", "tags")
def decided(t: Library) -> DataFrame:
    return lookups.decided(t.tags, "toxic")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0")
def find_set(t: Library) -> DataFrame:
    """Name and studio together; no studio is a value of its own."""
    studio = F.when(F.col("c_nationkey") % 2 == 1, F.col("c_nationkey").cast("string"))
    sets = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), studio.alias("studio"))
    return lookups.find_set(sets, "BUILDING").select("id")


@query("SELECT conv_id AS parent, turn AS child, length(text) AS time_ms FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)")
def captures_of(t: Library) -> DataFrame:
    captures = t.frames.select(F.col("file_id").alias("parent"), F.col("frame_index").alias("child"), F.col("duration").alias("time_ms"))
    return lookups.captures_of(captures, t.raw("labels").select(F.col("doc_id").alias("parent")))


@query("SELECT id, checksum FROM canon WHERE id % 3 = 0", "canon")
def find_by_checksums(t: Library) -> DataFrame:
    files = catalog.canonical_files(t.listing)
    return catalog.find_by_checksums(files, files.where("id % 3 = 0")).select("id", "checksum")


@query("SELECT path FROM file_paths WHERE file_id = (SELECT min(file_id) FROM (SELECT file_id FROM file_paths GROUP BY 1 HAVING count(*) > 1))", "file_paths")
def paths_of_file(t: Library) -> DataFrame:
    """All paths of the first file that has several."""
    first = t.file_paths.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("file_id").alias("id")).first()["id"]
    return catalog.paths_of_file(t.file_paths, first).select("path")


@query(
    "WITH r AS (SELECT DISTINCT checksum, label AS category FROM tags WHERE polarity = 'positive'), c AS (SELECT DISTINCT label AS category FROM tags UNION SELECT 'empty') SELECT c.category, count(r.checksum) AS n_files FROM c LEFT JOIN r USING (category) GROUP BY 1",
    "tags",
)
def category_counts(t: Library) -> DataFrame:
    """Categories with their number of files, those without any included."""
    resolved = t.tags.where("polarity = 'positive'").select("checksum", F.col("label").alias("category")).distinct()
    known = t.tags.select(F.col("label").alias("category")).distinct().unionByName(t.spark.createDataFrame([("empty",)], "category string"))
    return rosters.category_counts(resolved, known)


@query("SELECT user_id AS key, count FROM (WITH c AS (SELECT user_id, event_id AS ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('purchase', 'error')), r AS (SELECT user_id, ts, sum(d) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM c) SELECT user_id, (arg_max(s, ts) - least(0, min(s)))::BIGINT AS count FROM r GROUP BY 1) WHERE count > 0")
def favourite_counters(t: Library) -> DataFrame:
    """Counters that stand above zero."""
    return curation.favourite_counters(t.favourite_changes, "key")


# Write paths


@query("SELECT conv_id AS file_id, turn AS frame_index, length(text) AS duration FROM conversations WHERE NOT (turn = 0 AND conv_id % 2 = 0 AND NOT length(text) > 60)")
def clear_primary(t: Library) -> DataFrame:
    return queues.clear_primary(t.frames, t.frames.where("file_id % 2 = 0").select("file_id"), F.col("duration") > 60)


@query("SELECT DISTINCT doc_id AS file_id, 'clip' AS stage FROM labels UNION SELECT DISTINCT user_id, 'clip' FROM events")
def mark_processed(t: Library) -> DataFrame:
    done = t.raw("labels").select(F.col("doc_id").alias("file_id"), F.lit("clip").alias("stage"))
    return queues.mark_processed(done, t.raw("events").select(F.col("user_id").alias("file_id")), "clip")


@query("SELECT set_id, checksum, position FROM members WHERE set_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'new ' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 2 = 0", "members")
def replace_group(t: Library) -> DataFrame:
    """Sets indexed again, half of them with no result."""
    touched = t.raw("supplier").select(F.col("s_suppkey").alias("set_id"))
    rows = touched.where("set_id % 2 = 0").select("set_id", F.concat(F.lit("new "), F.col("set_id").cast("string")).alias("checksum"), F.lit(0).cast("long").alias("position"))
    return curation.replace_group(t.members, rows, ["set_id"], touched)


@query("SELECT set_id, checksum, CASE WHEN set_id < 40 THEN row_number() OVER (PARTITION BY set_id ORDER BY checksum DESC) - 1 ELSE position END AS position FROM members", "members")
def set_positions(t: Library) -> DataFrame:
    wanted = t.members.where("set_id < 40").groupBy("set_id").agg(F.sort_array(F.collect_list("checksum"), asc=False).alias("checksums"))
    return curation.set_positions(t.members, wanted)


ASSIGNED = """ex AS (SELECT set_id, checksum FROM members WHERE position IS NULL), ad AS (SELECT set_id, checksum FROM members WHERE position IS NULL AND set_id % 2 = 0 UNION SELECT s_suppkey, 'x' FROM supplier),
me AS (SELECT set_id, checksum FROM members WHERE position IS NOT NULL)"""


@query(f"WITH {ASSIGNED} SELECT 'member' AS kind, set_id, checksum FROM (SELECT * FROM me UNION ALL (SELECT * FROM ad EXCEPT SELECT * FROM me)) UNION ALL SELECT 'excluded', set_id, checksum FROM ex WHERE (set_id, checksum) NOT IN (SELECT (set_id, checksum) FROM ad)", "members")
def assign_with_exclusions(t: Library) -> DataFrame:
    keys = ["set_id", "checksum"]
    out = t.members.where("position IS NULL").select(*keys)
    added = out.where("set_id % 2 = 0").union(t.raw("supplier").select("s_suppkey", F.lit("x")))
    members, exclusions = curation.assign_with_exclusions(t.members.where("position IS NOT NULL").select(*keys), out, added, keys)
    return members.select(F.lit("member").alias("kind"), *keys).unionByName(exclusions.select(F.lit("excluded").alias("kind"), *keys))


@query("SELECT c_mktsegment AS name, CASE WHEN c_nationkey % 2 = 1 THEN 'n' || c_nationkey END AS studio, max(CASE WHEN c_custkey > 60 THEN 1 ELSE 0 END) = 1 AND min(c_custkey) > 60 AS fresh FROM customer GROUP BY 1, 2")
def create_sets(t: Library) -> DataFrame:
    """Pairs of name and studio; a pair that is there, also one without studio, is not made again."""
    studio = F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    wanted = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), studio.alias("studio"))
    have = wanted.where("id <= 60").groupBy("name", "studio").agg(F.min("id").alias("id")).select("id", "name", "studio")
    top = F.broadcast(have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))  # one row; new ids lie above it, wherever it is
    return curation.create_sets(have, wanted).join(top, F.lit(True)).select("name", "studio", (F.col("id") > F.col("top")).alias("fresh"))


@query("SELECT CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'manual:' || doc_id ELSE 'auto:' || doc_id END AS face_ref, quality AS age FROM labels UNION ALL SELECT 'manual:' || doc_id, 99 FROM labels WHERE doc_id % 3 = 0 AND doc_id % 2 = 1")
def migrate_refs(t: Library) -> DataFrame:
    """Ages follow a promoted face unless the manual face has one."""
    ref = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("doc_id").cast("string"))
    labels = t.raw("labels")
    own = labels.where("doc_id % 3 = 0 AND doc_id % 2 = 1").select(ref("manual").alias("face_ref"), F.lit(99).alias("age"))
    ages = labels.select(ref("auto").alias("face_ref"), F.col("quality").alias("age")).unionByName(own)
    return curation.migrate_refs(ages, labels.where("doc_id % 3 = 0").select(ref("auto").alias("auto_ref"), ref("manual").alias("manual_ref")))


@query("SELECT DISTINCT source AS place, lang FROM (SELECT CASE WHEN source = 'src1' THEN 'src2' ELSE source END AS source, lang FROM documents)")
def rename_value(t: Library) -> DataFrame:
    return curation.rename_value([t.raw("documents").select(F.col("source").alias("place"), "lang")], "place", "src1", "src2")[0]


# Sources


@query("SELECT DISTINCT md5(text) AS checksum, 'categories' AS kind, v AS value FROM documents, unnest([lang, 'mixed']) AS u(v) WHERE lang <> 'en' UNION SELECT DISTINCT md5(text), 'noface', 'true' FROM documents WHERE source LIKE '%1'")
def folder_markers(t: Library) -> DataFrame:
    docs = t.raw("documents")
    categories = docs.where("lang <> 'en'").select(F.concat_ws("/", "source", "lang", F.lit("categories.marker")).alias("path"), F.concat(F.lit("# what is below\n"), "lang", F.lit("\r\n\n mixed \n")).alias("value"))
    noface = docs.where(F.col("source").endswith("1")).select(F.concat_ws("/", "source", F.lit("noface.marker")).alias("path"), F.lit("").alias("value"))
    return scan.apply_markers(scan.parse_markers(categories.union(noface).distinct()), t.listing.select("checksum", "path"))


@query("SELECT lang AS set_name, md5(text) AS checksum, NULL::VARCHAR AS path FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT lang, NULL, 'gone/' || doc_id FROM documents WHERE doc_id % 3 = 2")
def set_entries(t: Library) -> DataFrame:
    """Entries by checksum, by path, and by neither."""
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("set_name")).join(t.listing.select("id", "checksum", "path"), "id")
    entries = docs.select(
        "set_name",
        F.when(F.col("id") % 3 == 2, F.concat(F.lit("gone/"), F.col("id").cast("string"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("id") % 3 == 0, F.col("checksum")).otherwise("none").alias("checksum"),
    )
    found, lost = scan.resolve_set_entries(entries, t.listing.select("checksum", "path"))
    return found.withColumn("path", F.lit(None).cast("string")).unionByName(lost.withColumn("checksum", F.lit(None).cast("string")))


@query(
    """SELECT s_suppkey AS id, s_name AS name, (s_suppkey * 37) % 1400 / 10 - 70 AS lat, s_suppkey / 1000 AS lon, 'C' || s_nationkey AS country, 'A1' AS admin1, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey * 10 END AS population
FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0"""
)
def place_dump(t: Library) -> DataFrame:
    """Lines of a dump: some with a bad position, some too short, some without a number of people."""
    key = F.col("s_suppkey")
    lat = F.when(key % 7 == 0, F.lit("north")).otherwise(((key * 37) % 1400 / 10 - 70).cast("string"))
    head = [key.cast("string"), F.col("s_name"), F.lit(""), F.lit(""), lat, (key / 1000).cast("string"), F.lit(""), F.lit("")]
    rest = [F.concat(F.lit("C"), F.col("s_nationkey").cast("string")), F.lit(""), F.lit("A1"), F.lit(""), F.lit(""), F.lit(""), F.when(key % 5 == 0, F.lit("?")).otherwise((key * 10).cast("string"))]
    lines = t.raw("supplier").select(F.when(key % 11 == 0, F.concat_ws("\t", *head)).otherwise(F.concat_ws("\t", *head, *rest)).alias("value"))
    return scan.parse_places(lines)


@query("SELECT o_orderkey AS id, o_custkey || ' ' || o_orderkey || ' ' || o_orderpriority AS line FROM orders WHERE o_orderstatus = 'F'")
def duplicate_lines(t: Library) -> DataFrame:
    """The lines of the report of duplicates, before they are written."""
    rows = t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "duplicate").otherwise("new").alias("kind"), F.col("o_custkey").cast("string").alias("path"), F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("repeats")
    )
    return sinks.duplicate_lines(rows, "id").select("id", F.translate("value", "\t", " ").alias("line"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber % 3 AS c, l_linenumber * 2 AS x1, l_linenumber AS y1, l_linenumber * 2 + 10 AS x2, l_linenumber + 5 AS y2 FROM lineitem WHERE l_orderkey % 4 = 0),
l AS (SELECT l_orderkey, printf('%d %.6f %.6f %.6f %.6f', c, (x1 + x2) / 2::DOUBLE / 630, (y1 + y2) / 2::DOUBLE / 470, (x2 - x1) / 630::DOUBLE, (y2 - y1) / 470::DOUBLE) AS line FROM b)
SELECT l_orderkey AS checksum, string_agg(line, chr(10) ORDER BY line) AS labels FROM l GROUP BY 1"""
)
def detection_labels(t: Library) -> DataFrame:
    """Label files of a detector's data set, before they are written."""
    n = F.col("l_linenumber").cast("double")
    box = F.struct((n * 2).alias("x1"), n.alias("y1"), (n * 2 + 10).alias("x2"), (n + 5).alias("y2"))
    boxes = t.raw("lineitem").where("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("checksum"), (F.col("l_linenumber") % 3).alias("class_id"), box.alias("box"), F.lit(630).alias("width"), F.lit(470).alias("height"))
    return sinks.detection_labels(boxes)


@query("SELECT doc_id AS id, sha256(text) AS checksum FROM documents WHERE doc_id % 9 <> 4 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 9 = 4")
def content_hashes(t: Library) -> DataFrame:
    """SHA-256 of contents; a file without content has none."""
    files = t.raw("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 4, F.col("text").cast("binary")).alias("content"))
    return scan.content_hash(files, "sha256").select("id", "checksum")


@query("SELECT id, len(e) AS dim FROM vectors WHERE id % 4 > 0", "vectors")
def usable_vectors(t: Library) -> DataFrame:
    """Empty vectors and those of another size are dropped."""
    ragged = F.when(F.col("id") % 8 == 0, F.slice("embedding", 1, 3)).when(F.col("id") % 4 == 0, F.slice("embedding", 1, 0)).otherwise(F.col("embedding"))
    return vectors.usable(t.vectors.select("id", ragged.alias("embedding")), 64).select("id", F.size("embedding").alias("dim"))


@query("SELECT c_custkey AS id, greatest(0, least(1, c_acctbal / 5000)) AS temperature FROM customer")
def clamped_temperatures(t: Library) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("id"), curation.clamp(F.col("c_acctbal") / 5000).alias("temperature"))


@query("SELECT media FROM (SELECT p_name || CASE p_size % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.webm' WHEN 2 THEN '.txt' ELSE '' END AS media, p_size FROM part) WHERE p_size % 4 < 2 GROUP BY 1")
def media_only(t: Library) -> DataFrame:
    """Tracked extensions, whatever their case, without what lies in the library's own folder."""
    suffix = F.when(F.col("p_size") % 4 == 0, ".JPG").when(F.col("p_size") % 4 == 1, ".webm").when(F.col("p_size") % 4 == 2, ".txt").otherwise("")
    own = t.raw("part").select(F.concat(F.lit("a/.media/"), "p_name", F.lit(".jpg")).alias("path"))
    return scan.media_only(t.raw("part").select(F.concat("p_name", suffix).alias("path")).unionByName(own)).select(F.col("path").alias("media")).distinct()


# Model stages


def _word_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands for a detector: one row per kind of mark in a text, an error for some files, nothing for others."""
    for pdf in batches:
        rows = []
        for file_id, text in zip(pdf["id"], pdf["text"], strict=True):
            if file_id % 50 == 7:
                rows.append((file_id, None, None, "unreadable"))
                continue
            found = [(c, text.count(c)) for c in "!|#" if c in text]
            rows += [(file_id, c, n / len(text), None) for c, n in found] or [(file_id, None, None, None)]
        yield pd.DataFrame(rows, columns=["file_id", "class_name", "confidence", "error"])


STAGE = """d AS (SELECT doc_id AS file_id, text, doc_id % 3 = 0 AS seen FROM documents), marks AS (SELECT * FROM (VALUES ('!'), ('|'), ('#')) AS m(c)),
found AS (SELECT file_id, c AS class_name, (length(text) - length(replace(text, c, ''))) / length(text)::DOUBLE AS confidence FROM d, marks WHERE NOT seen AND file_id % 50 <> 7 AND contains(text, c))"""


@query(
    f"""WITH {STAGE} SELECT 'table' AS part, file_id, class_name AS what, round(confidence, 9) AS confidence FROM found
UNION ALL SELECT 'table', file_id, 'old', 1.0 FROM d WHERE seen OR file_id % 50 = 7
UNION ALL SELECT 'done', file_id, 'detect', NULL FROM d WHERE seen OR file_id % 50 <> 7 UNION ALL SELECT 'failed', file_id, 'unreadable', NULL FROM d WHERE NOT seen AND file_id % 50 = 7"""
)
def index_stage(t: Library) -> DataFrame:
    """A whole stage: what is open, a model over it, results in place of the old rows, markers and failures."""
    files = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    seen = files.where("id % 3 = 0").select(F.col("id").alias("file_id"), F.lit("detect").alias("stage"))
    other = files.select(F.col("id").alias("file_id"), F.lit("embed").alias("stage"))
    markers = seen.unionByName(other)
    table = files.select(F.col("id").alias("file_id"), F.lit("old").alias("class_name"), F.lit(1.0).alias("confidence"))
    at = f"{shared_folder(t.spark)}/outcomes-{uuid.uuid4().hex}"
    rows, done, failed = queues.run_stage(files, table, markers, _word_model, "file_id long, class_name string, confidence double, error string", "detect", at)
    parts = [
        rows.select(F.lit("table").alias("part"), "file_id", F.col("class_name").alias("what"), F.round("confidence", 9).alias("confidence")),
        done.where("stage = 'detect'").select(F.lit("done").alias("part"), "file_id", F.col("stage").alias("what"), F.lit(None).cast("double").alias("confidence")),
        failed.select(F.lit("failed").alias("part"), "file_id", F.col("error").alias("what"), F.lit(None).cast("double").alias("confidence")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT p_partkey AS file_id, count(*) AS n, min(tile_index) AS least FROM (SELECT p_partkey, unnest(generate_series(0, 13)) AS tile_index FROM part WHERE p_size >= 10) GROUP BY 1")
def tile_queue(t: Library) -> DataFrame:
    """Tiles of large images, as they go to a model: one whole, four of a grid of two, nine of a grid of three."""
    images = t.raw("part").where("p_size >= 10").select(F.col("p_partkey").alias("file_id"), (F.col("p_size") * 12 + 3).alias("width"), (F.col("p_size") * 8 + 5).alias("height"))
    return queues.tile_queue(images).groupBy("file_id").agg(F.count("*").alias("n"), F.min("tile_index").alias("least"))


@query("SELECT doc_id AS path, 'no ' || quality AS message FROM labels WHERE toxic = 0 ORDER BY doc_id % 17 DESC, doc_id LIMIT 50")
def list_errors(t: Library) -> DataFrame:
    log = t.raw("labels").select(F.col("doc_id").alias("path"), F.concat(F.lit("no "), F.col("quality").cast("string")).alias("message"), (F.col("doc_id") % 17).alias("created_at"), (F.col("toxic") == 1).alias("read"))
    return sinks.list_errors(log, unread_only=True).select("path", "message")


@query(
    "SELECT id, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, '.txt' AS suffix FROM listing",
    "listing",
)
def path_parts(t: Library) -> DataFrame:
    upper = F.when(F.col("id") % 2 == 0, F.regexp_replace("path", r"\.txt$", ".TXT")).otherwise(F.col("path"))
    return t.listing.select("id", scalar.basename(F.col("path")).alias("name"), scalar.dirname(F.col("path")).alias("folder"), scalar.extension(upper).alias("suffix"))


@query("SELECT p_partkey AS id, string_agg(w, ' ' ORDER BY k) AS tokens FROM part, unnest(string_split(lower(p_name), ' ')) WITH ORDINALITY AS u(w, k) WHERE length(w) > 1 GROUP BY 1")
def query_tokens(t: Library) -> DataFrame:
    """Words of a query without stop words and single characters."""
    text = F.concat(F.lit("  The a "), F.upper("p_name"), F.lit(" of\tX with "))
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.array_join(scalar.query_tokens(text), " ").alias("tokens"))


# Scalars


@query(
    """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'filename' WHEN 2 THEN 'age' END AS field, CASE p_size % 4 WHEN 0 THEN 'desc' WHEN 1 THEN 'asc' WHEN 2 THEN 'desc' END AS direction FROM part"""
)
def sort_tokens(t: Library) -> DataFrame:
    token = F.when(F.col("p_size") % 4 == 0, "Date: DESC").when(F.col("p_size") % 4 == 1, "name:asc").when(F.col("p_size") % 4 == 2, "age :desc").otherwise("ages:desc")
    return t.raw("part").select(F.col("p_partkey").alias("id"), scalar.sort_token(F.concat_ws(" ", "p_name", token)).alias("s")).select("id", "s.field", "s.direction")


@query(
    """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size END::DOUBLE AS x1, CASE WHEN p_size % 3 = 0 THEN p_size + 4 END::DOUBLE AS y2,
CASE WHEN p_size % 3 = 1 THEN 'auto' WHEN p_size % 3 = 2 THEN 'manual' END AS kind, CASE WHEN p_size % 3 > 0 THEN p_partkey END AS ref FROM part"""
)
def boxes_and_refs(t: Library) -> DataFrame:
    """Boxes and face references in one column, told apart by their form."""
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.format_string("[%s, 2, 3.5, %s]", size, (F.col("p_size") + 4).cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("auto:"), "p_partkey")).otherwise(F.concat(F.lit("manual:"), "p_partkey"))
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), scalar.parse_box(text).alias("b"), scalar.parse_face_ref(text).alias("r"))
    return rows.select("id", "b.x1", "b.y2", "r.kind", F.col("r.id").alias("ref"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN epoch(o_orderdate)::BIGINT END AS taken,
CASE WHEN o_orderkey % 7 > 0 THEN round((o_orderkey % 90 + 30 / 60.0::DOUBLE + (o_orderkey % 60) / 3600.0::DOUBLE) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END, 6) END AS degrees FROM orders"""
)
def exif_values(t: Library) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 5 > 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).otherwise("0000:00:00")
    whole = F.array((key % 90).cast("double"), F.lit(30.0), (key % 60).cast("double"))
    dms = F.when(key % 7 > 0, whole).otherwise(F.slice(whole, 1, 2))
    ref = F.when(key % 2 == 0, "s").otherwise("N")
    return t.raw("orders").select(key.alias("id"), scalar.exif_timestamp(raw).alias("taken"), F.round(scalar.dms_to_degrees(dms, ref), 6).alias("degrees"))


@query(
    "WITH w AS (SELECT list_transform(generate_series(0, 63), lambda k: (k % 7 - 3) / 10.0::DOUBLE) AS w) SELECT id, round(1 / (1 + exp(-(list_inner_product(e, w.w) + 0.25))), 6) AS score FROM vectors, w",
    "vectors",
)
def probe_of_fixed_weights(t: Library) -> DataFrame:
    """Scoring alone, by weights that are known."""
    fixed = probe.Probe([(k % 7 - 3) / 10 for k in range(64)], 0.25, 0.0, "fixed")
    return probe.score(t.vectors, fixed).withColumn("score", F.round("score", 6))


CALIBRATED = """WITH RECURSIVE s AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS score FROM part),
r AS (SELECT 0 AS k, 0.10::DOUBLE AS risky, 0.95::DOUBLE AS safe UNION ALL
SELECT k + 1, CASE WHEN clean THEN risky ELSE (risky + safe) / 2 END, CASE WHEN clean THEN (risky + safe) / 2 ELSE safe END
FROM (SELECT r.*, coalesce((SELECT bool_and(score >= 0.61) FROM (SELECT score FROM s WHERE score >= (r.risky + r.safe) / 2 AND score < r.safe ORDER BY score, id LIMIT 5)), true) AS clean FROM r WHERE k < 8 AND safe - risky >= 0.03))
SELECT round(arg_max(safe, k), 6) AS threshold FROM r"""


@query(CALIBRATED)
def calibrated_threshold(t: Library) -> DataFrame:
    """Bisection where a score of 0.61 is the first that is clean."""
    scored = t.raw("part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 1000) / 1000.0).alias("score"))
    return t.spark.createDataFrame([(round(probe.calibrate(scored, lambda r: r["score"] >= 0.61), 6),)], "threshold double")
