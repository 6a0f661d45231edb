"""One query per operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalog, curation, geo, lookups, probe, queues, rosters, search, stats, vectors
from ..sources import scan
from .fixtures import Library
from .registry import query

HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


# Catalog


@query("SELECT id, checksum, size, first_seen FROM canon", "canon")
def canonical_identity(t: Library) -> DataFrame:
    return catalog.canonical_files(t.listing).select("id", "checksum", "size", "first_seen")


@query("SELECT file_id, path FROM primary_paths", "primary_paths")
def primary_path(t: Library) -> DataFrame:
    return catalog.primary_paths(t.file_paths)


@query("SELECT f.id, f.checksum, f.size, p.path FROM files f JOIN primary_paths p ON p.file_id = f.id", "files", "primary_paths")
def files_with_path(t: Library) -> DataFrame:
    return catalog.files_with_path(t.files, t.file_paths).select("id", "checksum", "size", "path")


@query("SELECT file_id, count(*) AS n_paths FROM file_paths GROUP BY 1 HAVING count(*) > 1", "file_paths")
def duplicates(t: Library) -> DataFrame:
    return catalog.duplicates(t.file_paths)


@query("SELECT file_id, count(*) AS n_paths FROM file_paths GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20", "file_paths")
def top_duplicates(t: Library) -> DataFrame:
    return catalog.duplicates(t.file_paths, 20)


@query("SELECT f.id, f.path FROM (SELECT file_id AS id, path, dense_rank() OVER (ORDER BY file_id) AS r FROM primary_paths) f WHERE f.id = (SELECT min(file_id) FROM file_paths WHERE path = (SELECT min(path) FROM listing))", "primary_paths")
def file_by_any_path(t: Library) -> DataFrame:
    path = t.listing.agg(F.min("path")).first()[0]
    return catalog.file_by_any_path(t.files, t.file_paths, path or "").select("id", "path")


@query("SELECT f.id, f.size FROM files f WHERE NOT hidden AND f.id IN (SELECT file_id FROM file_paths WHERE path = 'src1/en' OR starts_with(path, 'src1/en/'))", "files", "file_paths")
def files_under_folder(t: Library) -> DataFrame:
    return catalog.files_under_folder(t.files, t.file_paths, "src1/en").select("id", "size")


@query(
    """WITH s AS (SELECT p.file_id, p.path FROM file_paths p JOIN files f ON f.id = p.file_id WHERE NOT f.hidden AND starts_with(p.path, 'src1/')),
r AS (SELECT file_id, string_split(substr(path, 6), '/') AS rest FROM s)
SELECT 'folder' AS kind, rest[1] AS name, count(*) AS n FROM r WHERE len(rest) > 1 GROUP BY 2
UNION ALL SELECT 'file', min(rest[1]), 1 FROM r WHERE len(rest) = 1 GROUP BY file_id""",
    "files",
    "file_paths",
)
def browse_folder(t: Library) -> DataFrame:
    return catalog.browse_folder(t.files, t.file_paths, "src1")


@query(
    """WITH p AS (SELECT string_split(path, '/') AS s FROM tree WHERE contains(path, '/'))
SELECT array_to_string(s[1:k], '/') AS folder, count(*) AS n_paths FROM p, unnest(generate_series(1, len(s) - 1)) AS g(k) GROUP BY 1""",
    "tree",
)
def folder_totals(t: Library) -> DataFrame:
    return catalog.folder_totals(t.tree)


@query("SELECT f.id, p.path FROM files f JOIN primary_paths p ON p.file_id = f.id WHERE contains(lower(p.path), 'src1')", "files", "primary_paths")
def path_substring(t: Library) -> DataFrame:
    return catalog.search_path(t.files, t.file_paths, "SRC1").select("id", "path")


@query("SELECT f.id FROM files f WHERE f.id IN (SELECT file_id FROM file_paths WHERE NOT starts_with(path, 'src2/'))", "files", "file_paths")
def untrack_folder(t: Library) -> DataFrame:
    return catalog.remove_paths_under(t.files, t.file_paths, "src2")[0].select("id")


@query("SELECT id, lag(id) OVER (ORDER BY id) AS prev_id, lead(id) OVER (ORDER BY id) AS next_id FROM files", "files")
def neighbours(t: Library) -> DataFrame:
    return catalog.neighbours(t.files)


@query("SELECT max(id) FILTER (id < 100) AS prev_id, min(id) FILTER (id > 100) AS next_id FROM files", "files")
def neighbour_of_file(t: Library) -> DataFrame:
    return catalog.neighbour_of(t.files, 100)


@query("SELECT id, size FROM files WHERE NOT hidden ORDER BY size DESC, id LIMIT 20 OFFSET 20", "files")
def page_by_size(t: Library) -> DataFrame:
    return catalog.page(catalog.visible(t.files).select("id", "size"), [F.desc("size"), F.asc("id")], 20, 20)


@query("SELECT id, view_count FROM files WHERE NOT hidden ORDER BY view_count, id LIMIT 50", "files")
def least_viewed(t: Library) -> DataFrame:
    return catalog.page(catalog.visible(t.files).select("id", "view_count"), [F.asc("view_count"), F.asc("id")], 50)


@query(
    """WITH old AS (SELECT * FROM listing WHERE NOT starts_with(path, 'src9/')),
kf AS (SELECT checksum, min(id) AS id FROM old GROUP BY 1),
kp AS (SELECT o.checksum, arg_max(o.path, struct_pack(a := o.seen, b := o.path)) AS known_path FROM old o GROUP BY 1),
nw AS (SELECT checksum, min(path) AS first_path FROM listing GROUP BY 1)
SELECT l.path, CASE WHEN NOT starts_with(l.path, 'src9/') THEN 'already_indexed' WHEN kp.known_path IS NOT NULL OR l.path <> nw.first_path THEN 'duplicate' ELSE 'new' END AS kind,
  CASE WHEN NOT starts_with(l.path, 'src9/') THEN NULL WHEN kp.known_path IS NOT NULL THEN kp.known_path WHEN l.path <> nw.first_path THEN nw.first_path END AS repeats
FROM listing l LEFT JOIN kp USING (checksum) JOIN nw USING (checksum)""",
    "listing",
)
def classify_scan(t: Library) -> DataFrame:
    old = t.listing.where(~F.col("path").startswith("src9/"))
    files = catalog.canonical_files(old)
    return catalog.classify_scan(t.listing.select("path", "checksum"), files, catalog.attach_paths(files, old)).select("path", "kind", "repeats")


@query(
    """WITH alive AS (SELECT file_id, min(path) AS lives_at FROM file_paths WHERE NOT starts_with(path, 'src3/') GROUP BY 1)
SELECT p.file_id, p.path, CASE WHEN a.lives_at IS NULL THEN 'missing' ELSE 'moved' END AS state, a.lives_at
FROM file_paths p LEFT JOIN alive a USING (file_id) WHERE starts_with(p.path, 'src3/')""",
    "file_paths",
)
def stale_paths(t: Library) -> DataFrame:
    return catalog.stale_paths(t.file_paths, t.listing.where(~F.col("path").startswith("src3/")))


@query("SELECT c.id, l.id IS NOT NULL AS intact FROM canon c LEFT JOIN listing l ON l.id = c.id AND l.checksum = c.checksum", "canon")
def verify_integrity(t: Library) -> DataFrame:
    return catalog.verify_integrity(catalog.canonical_files(t.listing), t.listing)


@query("SELECT d.doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def undetected(t: Library) -> DataFrame:
    return queues.unprocessed(t.listing.select("id"), t.vectors.select(F.col("id").alias("file_id")))


@query("SELECT count(*) AS n_rows, max(len(embedding)) AS dim, count(*) * max(len(embedding)) * 4 AS n_bytes FROM embeddings")
def embedding_stats(t: Library) -> DataFrame:
    return queues.embedding_stats(t.vectors).select("n_rows", F.col("dim").cast("long").alias("dim"), "n_bytes")


@query("SELECT conv_id AS file_id, turn AS frame_index, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS time_ms FROM conversations")
def frame_times(t: Library) -> DataFrame:
    return stats.frame_times(t.frames).select("file_id", "frame_index", "time_ms")


# Aggregates


@query("SELECT label, count(*) AS n FROM tags WHERE polarity = 'positive' GROUP BY 1", "tags")
def tag_counts(t: Library) -> DataFrame:
    return stats.tag_counts(t.tags)


@query("SELECT s.id, s.name, s.studio_id, count(m.checksum) AS n_files FROM sets s LEFT JOIN members m ON m.set_id = s.id GROUP BY ALL", "sets", "members")
def set_counts(t: Library) -> DataFrame:
    return stats.set_counts(t.sets, t.members)


@query("SELECT n_name AS studio, count(DISTINCT s.id) AS n_sets, count(m.checksum) AS n_files FROM sets s LEFT JOIN members m ON m.set_id = s.id JOIN nation ON n_nationkey = s.studio_id GROUP BY 1", "sets", "members")
def studio_rollup(t: Library) -> DataFrame:
    return stats.studio_rollup(t.studios, t.sets, t.members)


@query("SELECT identity, count(*) AS n_faces, max(created_at) AS last_created, max(id) AS representative FROM faces WHERE identity IS NOT NULL GROUP BY 1", "faces")
def identity_summary(t: Library) -> DataFrame:
    return stats.identity_summary(t.faces)


@query("SELECT user_id AS face_ref, max(event_id) AS created_at, arg_max(value, event_id) AS age, arg_max(event_type, event_id) AS gender FROM events GROUP BY 1")
def latest_age(t: Library) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("face_ref"), F.col("event_id").alias("created_at"), F.col("value").alias("age"), F.col("event_type").alias("gender"))
    return stats.latest_per_key(rows, "face_ref", "created_at", ["age", "gender"])


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT e.user_id AS identity, round(avg(value), 4) AS mean_age, (SELECT c.event_type FROM c WHERE c.user_id = e.user_id ORDER BY c.n DESC, c.event_type LIMIT 1) AS gender FROM events e GROUP BY 1"""
)
def avg_age_mode(t: Library) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("identity"), F.col("value").alias("age"), F.col("event_type").alias("gender"))
    return stats.ages(rows, ["identity"])


@query(
    """SELECT f.n_files, f.n_bytes, t.n_labels, m.n_in_sets, p.n_people, p.n_unknown, greatest(0, f.n_files - m.n_in_sets) AS n_without_set
FROM (SELECT count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM files) f, (SELECT count(DISTINCT label) AS n_labels FROM tags WHERE polarity = 'positive') t,
(SELECT count(DISTINCT checksum) AS n_in_sets FROM members) m, (SELECT count(DISTINCT identity) AS n_people, count(*) FILTER (identity IS NULL) AS n_unknown FROM faces) p""",
    "files",
    "tags",
    "members",
    "faces",
)
def homepage_stats(t: Library) -> DataFrame:
    return stats.homepage(t.files, t.tags, t.members, t.faces)


@query("SELECT file_id, round(sum(confidence), 6) AS score FROM detections WHERE contains(lower(class_name), 'ring') OR contains(lower(class_name), 'widget') GROUP BY 1", "detections")
def class_search(t: Library) -> DataFrame:
    return search.search_classes(t.detections, ["ring", "widget"]).withColumn("score", F.round("score", 6))


@query("SELECT file_id, class_name, round(max(confidence), 6) AS confidence FROM detections GROUP BY 1, 2", "detections")
def detected_classes(t: Library) -> DataFrame:
    return search.detected_classes(t.detections).withColumn("confidence", F.round("confidence", 6))


@query("SELECT file_id, class_name, id AS detection_id, round(confidence, 6) AS confidence FROM detections QUALIFY row_number() OVER (PARTITION BY file_id, class_name ORDER BY confidence DESC, id) = 1", "detections")
def best_boxes(t: Library) -> DataFrame:
    return search.best_boxes(t.detections).withColumn("confidence", F.round("confidence", 6))


@query("SELECT city_id, n_files, name FROM (SELECT s_nationkey::BIGINT AS city_id, count(*) AS n_files FROM supplier GROUP BY 1) JOIN (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation) ON id = city_id")
def used_cities(t: Library) -> DataFrame:
    files = t.raw("supplier").select(F.col("s_nationkey").cast("long").alias("city_id"))
    return geo.used_cities(files, t.studios)


# Search


FACETS = """facet AS (SELECT DISTINCT 'tag' AS type, label AS value, checksum FROM tags WHERE polarity = 'positive'
UNION SELECT DISTINCT 'source', source, md5(text) FROM documents UNION SELECT DISTINCT 'lang', lang, md5(text) FROM documents)"""


def _facets(t: Library) -> DataFrame:
    docs = t.raw("documents").select("source", "lang", F.md5(F.col("text").cast("binary")).alias("checksum"))
    return rosters.facets(
        tag=t.tags.where("polarity = 'positive'").select(F.col("label").alias("value"), "checksum"),
        source=docs.select(F.col("source").alias("value"), "checksum"),
        lang=docs.select(F.col("lang").alias("value"), "checksum"),
    )


@query(f"WITH {FACETS} SELECT checksum FROM facet WHERE type = 'tag' AND value = 'quality' INTERSECT SELECT checksum FROM facet WHERE type = 'lang' AND value = 'en'", "tags")
def chip_intersection(t: Library) -> DataFrame:
    return rosters.intersect_chips(_facets(t), [("tag", "quality"), ("lang", "en")], t.files)


@query(f"WITH {FACETS} SELECT checksum FROM facet WHERE type = 'tag' AND value = 'toxic' UNION SELECT checksum FROM listing WHERE contains(lower(path), 'src4')", "tags")
def text_union(t: Library) -> DataFrame:
    tagged = _facets(t).where("type = 'tag' AND value = 'toxic'")
    return rosters.effective_set(None, tagged, t.listing.where(F.contains(F.lower("path"), F.lit("src4"))))


@query(f"WITH {FACETS} SELECT value, count(*) AS n_files FROM facet WHERE type = 'source' AND checksum IN (SELECT checksum FROM facet WHERE type = 'tag' AND value = 'quality') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6", "tags")
def facet_top6(t: Library) -> DataFrame:
    f = _facets(t)
    return rosters.facet_top(f, f.where("type = 'tag' AND value = 'quality'"), "source")


@query(
    """WITH a AS (SELECT DISTINCT checksum, 0 AS source, 0 AS place FROM tags WHERE polarity = 'positive' AND label = 'toxic' UNION SELECT checksum, 1, min(id) FROM listing WHERE starts_with(path, 'src4/') GROUP BY 1)
SELECT checksum, source, place FROM a QUALIFY row_number() OVER (PARTITION BY checksum ORDER BY source, place) = 1""",
    "tags",
)
def priority_union(t: Library) -> DataFrame:
    first = t.tags.where("polarity = 'positive' AND label = 'toxic'").select("checksum", F.lit(0).cast("long").alias("place")).distinct()
    second = t.listing.where(F.col("path").startswith("src4/")).groupBy("checksum").agg(F.min("id").alias("place"))
    return rosters.priority_union(first, second)


@query(
    """SELECT f.id, t.tags, s.sets, coalesce(v.n, 0) AS favorite FROM files f
LEFT JOIN (SELECT checksum, string_agg(DISTINCT label, ',' ORDER BY label) AS tags FROM tags WHERE polarity = 'positive' GROUP BY 1) t USING (checksum)
LEFT JOIN (SELECT md5(text) AS checksum, string_agg(DISTINCT source, ',' ORDER BY source) AS sets FROM documents GROUP BY 1) s USING (checksum)
LEFT JOIN (SELECT l.checksum, count(*) AS n FROM events e JOIN listing l ON l.id = e.user_id WHERE event_type = 'purchase' GROUP BY 1) v USING (checksum)""",
    "files",
    "tags",
)
def cards(t: Library) -> DataFrame:
    sums = t.listing.select(F.col("id").alias("user_id"), "checksum")
    favourites = t.raw("events").where("event_type = 'purchase'").join(sums, "user_id").groupBy("checksum").agg(F.count("*").alias("favorite"))
    sets = t.raw("documents").select(F.md5(F.col("text").cast("binary")).alias("checksum"), F.col("source").alias("name"))
    titles = t.listing.select("checksum").distinct().withColumn("title", F.lit(None).cast("string"))
    return rosters.cards(t.files.select("id", "checksum"), t.tags.where("polarity = 'positive'"), sets, titles, favourites).select("id", "tags", "sets", "favorite")


@query("SELECT set_id, checksum, position FROM members WHERE set_id = 7 ORDER BY position NULLS LAST, checksum", "members")
def manual_order(t: Library) -> DataFrame:
    return search.manual_order(t.members, 7)


@query("SELECT id, size FROM files WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.checksum = files.checksum AND t.polarity = 'positive') ORDER BY size DESC, id LIMIT 8", "files", "tags")
def feed_biggest(t: Library) -> DataFrame:
    files = t.files.withColumn("favorite", F.lit(0))
    return search.feed(files, "biggest", [t.tags.where("polarity = 'positive'")]).select("id", "size")


@query(
    """SELECT 'set' AS kind, set_id::VARCHAR AS ref, round(avg(o_totalprice), 6) AS sort_value, count(*) AS n FROM members JOIN orders ON o_orderkey::VARCHAR = checksum WHERE position IS NOT NULL GROUP BY set_id
UNION ALL SELECT 'photo', checksum, round(o_totalprice, 6), 1 FROM members JOIN orders ON o_orderkey::VARCHAR = checksum WHERE position IS NULL""",
    "members",
)
def collapsed_person_photos(t: Library) -> DataFrame:
    photos = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("checksum"), F.col("o_totalprice").alias("value"))
    return search.collapse_into_sets(photos, t.members.where("position IS NOT NULL").select("set_id", "checksum")).withColumn("sort_value", F.round("sort_value", 6))


@query("SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM listing GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "listing")
def folder_suggestions(t: Library) -> DataFrame:
    return search.folder_suggestions(t.listing)


@query(
    """WITH RECURSIVE q AS (SELECT DISTINCT p_name AS label, lower(p_name) AS t, 1 AS k, position('r' IN lower(p_name)) AS first, position('r' IN lower(p_name)) AS pos FROM part
UNION ALL SELECT label, t, k + 1, first, CASE WHEN position(substr('rig', k + 1, 1) IN substr(t, pos + 1)) > 0 THEN pos + position(substr('rig', k + 1, 1) IN substr(t, pos + 1)) ELSE 0 END FROM q WHERE k < 3 AND pos > 0),
s AS (SELECT label, round(first - 1 + (pos - first) * 0.1, 6) AS score FROM q WHERE k = 3 AND pos > 0)
SELECT 'class' AS type, label, score, row_number() OVER (ORDER BY score, label) - 1 AS place FROM s ORDER BY score, label LIMIT 6"""
)
def fuzzy_rank(t: Library) -> DataFrame:
    return search.fuzzy_rank(t.raw("part").select(F.lit("class").alias("type"), F.col("p_name").alias("label")), "rig")


# Rosters


@query(
    """WITH manual AS (SELECT DISTINCT checksum, label AS category FROM tags WHERE polarity = 'positive'), rej AS (SELECT DISTINCT checksum, label AS category FROM tags WHERE polarity = 'negative'),
auto AS (SELECT md5(text) AS checksum, CASE WHEN lang = 'en' THEN 'quality' ELSE 'toxic' END AS category, max(n_chars / 100000.0::DOUBLE) AS score FROM documents GROUP BY 1, 2)
SELECT checksum, category, 'manual' AS source, NULL::DOUBLE AS score FROM manual
UNION ALL SELECT checksum, category, 'auto', score FROM auto a WHERE NOT EXISTS (SELECT 1 FROM manual m WHERE m.checksum = a.checksum AND m.category = a.category) AND NOT EXISTS (SELECT 1 FROM rej r WHERE r.checksum = a.checksum AND r.category = a.category)""",
    "tags",
)
def category_resolver(t: Library) -> DataFrame:
    decided = t.tags.withColumnRenamed("label", "category")
    auto = t.raw("documents").select(F.md5(F.col("text").cast("binary")).alias("checksum"), F.when(F.col("lang") == "en", "quality").otherwise("toxic").alias("category"), (F.col("n_chars") / 100000.0).alias("score"))
    return rosters.resolve_categories(decided.where("polarity = 'positive'"), auto, decided.where("polarity = 'negative'"))


PEOPLE = """m AS (SELECT o_custkey AS set_id, o_orderkey AS checksum FROM orders), f AS (SELECT l_orderkey AS checksum, p_brand AS identity, l_orderkey * 100 + l_linenumber AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'),
ph AS (SELECT l_orderkey AS checksum, p_brand AS identity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_discount >= 0.09), li AS (SELECT c_custkey AS set_id, 'Brand#' || c_nationkey AS identity FROM customer),
ex AS (SELECT c_custkey AS set_id, 'Brand#' || (c_nationkey + 1) AS identity FROM customer),
people AS (SELECT set_id, identity FROM m JOIN f USING (checksum) UNION SELECT set_id, identity FROM m JOIN ph USING (checksum) UNION SELECT * FROM li EXCEPT SELECT * FROM ex)"""


def _people(t: Library) -> tuple[DataFrame, ...]:
    members = t.raw("orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("checksum"))
    lines = t.raw("lineitem").join(t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("identity")), "l_partkey")
    faces = lines.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("checksum"), "identity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    photos = lines.where("l_returnflag = 'R' AND l_discount >= 0.09").select(F.col("l_orderkey").alias("checksum"), "identity")
    links = t.raw("customer").select(F.col("c_custkey").alias("set_id"), F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("identity"))
    out = t.raw("customer").select(F.col("c_custkey").alias("set_id"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("identity"))
    return members, faces, photos, links, out


@query(f"WITH {PEOPLE} SELECT set_id, identity FROM people")
def people_of_sets(t: Library) -> DataFrame:
    return rosters.people_of_sets(*_people(t))


@query(
    f"""WITH {PEOPLE}, ins AS (SELECT set_id, identity, min(id) AS a FROM m JOIN f USING (checksum) GROUP BY ALL), lib AS (SELECT identity, min(id) AS b FROM f GROUP BY 1)
SELECT p.set_id, p.identity, EXISTS (SELECT 1 FROM li WHERE li.set_id = p.set_id AND li.identity = p.identity) AS set_linked, coalesce(ins.a, lib.b) AS face_id
FROM people p LEFT JOIN ins USING (set_id, identity) LEFT JOIN lib USING (identity)"""
)
def set_roster(t: Library) -> DataFrame:
    return rosters.set_roster(*_people(t))


@query(f"WITH {PEOPLE} SELECT identity, checksum FROM f UNION SELECT identity, checksum FROM ph UNION SELECT identity, checksum FROM li JOIN m USING (set_id)")
def identity_checksums(t: Library) -> DataFrame:
    members, faces, photos, links, _ = _people(t)
    return rosters.identity_checksums(faces, photos, links, members)


# Curation


@query(
    """WITH c AS (SELECT user_id AS key, event_id AS ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('purchase', 'error')),
r AS (SELECT key, ts, sum(d) OVER (PARTITION BY key ORDER BY ts) AS s FROM c), l AS (SELECT key, arg_max(s, ts) AS last, min(s) AS low FROM r GROUP BY 1)
SELECT key, (last - least(0, low))::BIGINT AS count FROM l"""
)
def favourite_fold(t: Library) -> DataFrame:
    return curation.floored_counters(t.favourite_changes, "key")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1 UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def last_wins_upsert(t: Library) -> DataFrame:
    state = t.raw("customer").select(F.col("c_custkey").alias("id"), F.lit("none").alias("state"))
    return curation.upsert(state, t.raw("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("state"), "event_id"), ["id"], "event_id")


@query("SELECT c_custkey AS id, 'old' AS origin FROM customer UNION ALL SELECT DISTINCT user_id + 100, 'new' FROM events WHERE user_id + 100 NOT IN (SELECT c_custkey FROM customer)")
def first_wins_insert(t: Library) -> DataFrame:
    state = t.raw("customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("origin"))
    return curation.insert_ignore(state, t.raw("events").select((F.col("user_id") + 100).alias("id"), F.lit("new").alias("origin")), ["id"])


MERGES = "mg AS (SELECT s_suppkey AS source, s_suppkey // 2 + 1000000 AS dest FROM supplier)"


@query(f"WITH {MERGES}, u AS (SELECT coalesce(mg.dest, m.set_id) AS set_id, m.checksum, m.position FROM members m LEFT JOIN mg ON mg.source = m.set_id) SELECT set_id, checksum, min(position) AS position FROM u GROUP BY 1, 2", "members")
def merge_sets(t: Library) -> DataFrame:
    merges = t.raw("supplier").select(F.col("s_suppkey").alias("source"), (F.floor(F.col("s_suppkey") / 2) + 1000000).alias("dest"))
    return curation.merge_groups(t.sets, t.members, [], merges)[1]


@query("SELECT n_nationkey::BIGINT AS id, n_name AS identity, coalesce(r_name, n_name) AS resolved FROM nation LEFT JOIN region ON 'NATION_' || r_regionkey = n_name")
def alias_resolve(t: Library) -> DataFrame:
    aliases = t.raw("region").select(F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("alias"), F.col("r_name").alias("owner"))
    return curation.resolve_alias(t.studios.select("id", F.col("name").alias("identity")), aliases)


@query("SELECT DISTINCT checksum, CASE WHEN label = 'toxic' THEN 'quality' ELSE label END AS label FROM tags WHERE polarity = 'positive'", "tags")
def rename_merge(t: Library) -> DataFrame:
    flat = t.tags.where("polarity = 'positive'").select("id", "checksum", F.col("label"))
    ids = flat.select("label").distinct().withColumn("id", F.when(F.col("label") == "quality", 1).otherwise(2))
    links = flat.select("checksum", "label").join(ids, "label").select("checksum", F.col("id").alias("tag_id"))
    defs, moved = curation.rename_or_merge(ids.select("id", "label"), links, "toxic", "quality")
    return moved.join(defs.withColumnRenamed("id", "tag_id"), "tag_id").select("checksum", "label").distinct()


@query("SELECT doc_id AS source_face_id, CASE WHEN quality = 1 THEN 'q' END AS identity, quality = 0 AS rejected FROM labels WHERE toxic = 0")
def promote_faces(t: Library) -> DataFrame:
    empty = t.spark.createDataFrame([], "source_face_id long, checksum string, identity string, rejected boolean")
    labels = t.raw("labels").select(F.col("doc_id").alias("source_face_id"), F.lit("x").alias("checksum"), F.lit("q").alias("identity"), "quality", "toxic")
    first = labels.select("source_face_id", "checksum", "identity", F.lit("confirm").alias("action"), F.lit(1).alias("at"))
    second = labels.select("source_face_id", "checksum", "identity", F.when(F.col("toxic") == 1, "undo").when(F.col("quality") == 1, "confirm").otherwise("reject").alias("action"), F.lit(2).alias("at"))
    return curation.promote_faces(empty, first.unionByName(second)).select("source_face_id", "identity", "rejected")


@query("SELECT set_id, checksum, position FROM members WHERE set_id NOT IN (SELECT s_suppkey FROM supplier)", "members")
def delete_sets_cascade(t: Library) -> DataFrame:
    return curation.delete_with_links(t.sets, [t.members], t.raw("supplier").select(F.col("s_suppkey").alias("id")), "set_id")[1][0]


@query("SELECT l.id AS tag_row, d.id AS tag_id FROM tags l JOIN (SELECT label, min(id) AS id FROM tags GROUP BY 1) d USING (label)", "tags")
def migrate_flat_tags(t: Library) -> DataFrame:
    return curation.flat_to_definitions(t.tags)[1].select(F.col("id").alias("tag_row"), "tag_id")


@query(
    """WITH p AS (SELECT DISTINCT a.file_id AS old_id, b.file_id AS new_id FROM tree a JOIN (SELECT file_id + 5000 AS file_id, path FROM tree) b USING (path)),
o AS (SELECT old_id, min(new_id) AS new_id FROM p GROUP BY 1 HAVING count(*) = 1), n AS (SELECT new_id FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT old_id, new_id FROM o WHERE new_id IN (SELECT new_id FROM n)""",
    "tree",
)
def recover_by_path(t: Library) -> DataFrame:
    old = t.tree.select(F.col("file_id").alias("id"), "path")
    return curation.recover_by_path(old, old.withColumn("id", F.col("id") + 5000))


@query("SELECT 'Unnamed ' || (min(n) + 1) AS name FROM (SELECT DISTINCT s_suppkey + 1 AS n FROM supplier UNION SELECT 0) a WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey + 1 = a.n + 1)")
def placeholder_name(t: Library) -> DataFrame:
    return scalar.next_placeholder(t.raw("supplier").select(F.concat(F.lit("Unnamed "), (F.col("s_suppkey") + 1).cast("string")).alias("identity")))


# Places


@query(f"SELECT p.id, CASE WHEN p.lat IS NOT NULL THEN round({HAVERSINE.format(a='c', b='p')}, 1) END AS km FROM points p, (SELECT 48.0 AS lat, 11.0 AS lon) c", "points")
def distance_sort(t: Library) -> DataFrame:
    return geo.by_distance(t.points, 48.0, 11.0).select("id", "km")


@query("SELECT floor(lat / 10)::BIGINT AS gx, floor(lon / 10)::BIGINT AS gy, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM points WHERE lat IS NOT NULL GROUP BY 1, 2", "points")
def geo_grid(t: Library) -> DataFrame:
    return geo.clusters(t.points, 10.0).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(
    f"""WITH d AS (SELECT p.id, c.id AS city_id, {HAVERSINE.format(a='p', b='c')} AS km, abs(p.lat - c.lat) <= 0.75 AND abs(p.lon - c.lon) <= 0.75 AS boxed FROM points p, cities c WHERE p.lat IS NOT NULL)
SELECT id, city_id, round(km, 1) AS km FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY NOT boxed, km, city_id) = 1""",
    "points",
    "cities",
)
def nearest_city(t: Library) -> DataFrame:
    return geo.nearest_city(t.points, t.cities)


@query("SELECT id, name, population FROM cities WHERE starts_with(lower(name), 'supplier#00000000') ORDER BY population DESC, id LIMIT 20", "cities")
def find_cities(t: Library) -> DataFrame:
    return geo.find_cities(t.cities, "supplier#00000000").select("id", "name", "population")


# Vectors


@query("WITH q AS (SELECT e FROM vectors WHERE id = 0), s AS (SELECT v.id, list_inner_product(v.e, q.e) AS x FROM vectors v, q WHERE v.id <> 0) SELECT s.id, round(x, 4) AS score, d.source, d.lang FROM (SELECT * FROM s ORDER BY x DESC, id LIMIT 20) s LEFT JOIN documents d ON d.doc_id = s.id", "vectors")
def similar_topk(t: Library) -> DataFrame:
    best = vectors.similar_to(t.vectors, 0, 20)
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return docs.join(F.broadcast(best), "id", "right").select("id", F.round("score", 4).alias("score"), "source", "lang")  # 20 rows


CENTROID = "cen AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(e[k]) AS m FROM vectors, unnest(generate_series(1, len(e))) AS g(k) GROUP BY 1, 2) GROUP BY 1), uc AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM cen)"


@query(f"WITH {CENTROID} SELECT uc.label, round(c[1], 6) AS c1, round(c[2], 6) AS c2, round(sqrt(list_inner_product(c, c)), 6) AS length FROM uc", "vectors")
def label_centroids(t: Library) -> DataFrame:
    c = vectors.centroids(t.vectors, ["label"])
    return c.select("label", F.round(F.col("centroid")[0], 6).alias("c1"), F.round(F.col("centroid")[1], 6).alias("c2"), F.round(vectors.norm(F.col("centroid")), 6).alias("length"))


@query(f"WITH {CENTROID} SELECT v.id, round(list_inner_product(v.e, uc.c), 4) AS score FROM vectors v, uc WHERE uc.label = 3", "vectors")
def centroid_rank(t: Library) -> DataFrame:
    return vectors.rank_by(t.vectors, vectors.centroids(t.vectors.where("label = 3"))).withColumn("score", F.round("score", 4))


@query(
    f"""WITH {CENTROID}, r AS (SELECT list_transform(list_zip(p.c, n.c), lambda x: x[1] - 0.5 * x[2]) AS c FROM uc p, uc n WHERE p.label = 1 AND n.label = 2),
u AS (SELECT list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM r) SELECT v.id, round(list_inner_product(v.e, u.c), 4) AS score FROM vectors v, u""",
    "vectors",
)
def rocchio_rank(t: Library) -> DataFrame:
    c = vectors.rocchio(t.vectors.where("label = 1"), t.vectors.where("label = 2"))
    return vectors.rank_by(t.vectors, c).withColumn("score", F.round("score", 4))


@query(
    """WITH s AS (SELECT a.id AS query_id, b.id, list_inner_product(a.e, b.e) AS x FROM vectors a, vectors b WHERE a.id % 100 = 0 AND a.id <> b.id)
SELECT query_id, id, round(x, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "vectors",
)
def topk_search(t: Library) -> DataFrame:
    """The stated query set of searches: every id divisible by 100, against all rows."""
    return vectors.top_k_join(t.vectors.where("id % 100 = 0"), t.vectors, 10).withColumn("score", F.round("score", 4))


@query(
    "WITH s AS (SELECT u.id, n.identity, list_inner_product(u.e, n.e) AS x FROM faces u, faces n WHERE u.identity IS NULL AND n.identity IS NOT NULL) SELECT id, identity, round(x, 4) AS score FROM s WHERE x >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, identity) = 1",
    "faces",
)
def nn_label(t: Library) -> DataFrame:
    unknown, named = t.faces.where("identity IS NULL"), t.faces.where("identity IS NOT NULL")
    return vectors.nearest_label(unknown, named, "identity", 0.3).withColumn("score", F.round("score", 4))


@query(
    "WITH s AS (SELECT u.id, n.identity, max(list_inner_product(u.e, n.e)) AS x FROM faces u, faces n WHERE u.identity IS NULL AND n.identity IS NOT NULL GROUP BY 1, 2) SELECT id, identity, round(x, 4) AS score FROM s WHERE x >= 0.25 AND x < 0.4",
    "faces",
)
def max_sim_band(t: Library) -> DataFrame:
    unknown, named = t.faces.where("identity IS NULL"), t.faces.where("identity IS NOT NULL")
    return vectors.in_band(vectors.max_similarity(unknown, named, "identity", 0.25), 0.25, 0.4).withColumn("score", F.round("score", 4))


@query("WITH q AS (SELECT e FROM vectors WHERE id = 0), s AS (SELECT v.label, v.id, list_inner_product(v.e, q.e) AS x FROM vectors v, q) SELECT label, id, round(x, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY x DESC, id) = 1", "vectors")
def best_per_group(t: Library) -> DataFrame:
    query_vector = t.vectors.where("id = 0").select(F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
    labels = t.vectors.select("id", "label")
    scored = vectors.rank_by(t.vectors, query_vector).join(labels, "id")
    return vectors.best_per_group(scored, "label").withColumn("score", F.round("score", 4))


@query("SELECT a.id, a.identity, round(max(list_inner_product(a.e, b.e)), 4) AS score FROM faces a JOIN faces b ON a.identity = b.identity AND a.id <> b.id GROUP BY 1, 2", "faces")
def cohort_outliers(t: Library) -> DataFrame:
    named = t.faces.where("identity IS NOT NULL").select("id", "identity", "embedding")
    return vectors.cohort_outliers(named).withColumn("score", F.round("score", 4))


@query(
    f"""WITH {CENTROID} SELECT v.id, 'cat ' || uc.label AS category, round(list_inner_product(v.e, uc.c), 4) AS score FROM vectors v, uc
WHERE list_inner_product(v.e, uc.c) >= 0.3 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.id AND l.quality = uc.label)""",
    "vectors",
)
def category_match(t: Library) -> DataFrame:
    name = F.concat(F.lit("cat "), F.col("label").cast("string")).alias("category")
    examples = t.vectors.select(name, "embedding")
    thresholds = t.vectors.select(name).distinct().withColumn("temperature", F.lit(0.3))
    decided = t.raw("labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("cat "), F.col("quality").cast("string")).alias("category"))
    return vectors.category_matches(t.vectors, examples, thresholds, decided).withColumn("score", F.round("score", 4))


@query()
def probe_scores(t: Library) -> DataFrame:
    examples = t.vectors.where("label IN (0, 1)")
    return probe.score(t.vectors, probe.fit(examples)).withColumn("score", F.round("score", 6))


# Scalars


@query(
    """WITH s AS (SELECT p_partkey AS id, p_size * 12 + 3 AS w, p_size * 8 + 5 AS h FROM part),
g AS (SELECT * FROM (VALUES (2), (3)) a(n), unnest(generate_series(0, n - 1)) AS r(i), unnest(generate_series(0, n - 1)) AS c(j)),
t AS (SELECT id, 0 AS k, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, w::DOUBLE AS x2, h::DOUBLE AS y2, w, h FROM s
UNION ALL SELECT id, n * 100 + i * 10 + j, w * j / (n + 1)::DOUBLE, h * i / (n + 1)::DOUBLE, w * j / (n + 1)::DOUBLE + w * 2 / (n + 1)::DOUBLE, h * i / (n + 1)::DOUBLE + h * 2 / (n + 1)::DOUBLE, w, h FROM s, g),
b AS (SELECT id, greatest(0, least(w, round_even(x1, 0)))::INT AS x1, greatest(0, least(h, round_even(y1, 0)))::INT AS y1, greatest(0, least(w, round_even(x2, 0)))::INT AS x2, greatest(0, least(h, round_even(y2, 0)))::INT AS y2 FROM t)
SELECT DISTINCT id, x1, y1, x2, y2 FROM b WHERE x2 - x1 >= 8 AND y2 - y1 >= 8"""
)
def tiles(t: Library) -> DataFrame:
    sized = t.raw("part").select(F.col("p_partkey").alias("id"), F.explode(scalar.tiles(F.col("p_size") * 12 + 3, F.col("p_size") * 8 + 5)).alias("b"))
    return sized.select("id", "b.x1", "b.y1", "b.x2", "b.y2")


@query("SELECT p_partkey AS id, CASE WHEN s = '' THEN 'tag' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)")
def slugs(t: Library) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("id"), scalar.slugify(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("SELECT min(pos) AS pos, arg_min(term, pos) AS term FROM (SELECT p_partkey AS pos, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS term FROM part) GROUP BY lower(term)")
def merged_vocabulary(t: Library) -> DataFrame:
    return scalar.merge_vocabulary(t.raw("part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("term")))


@query(r"SELECT id FROM listing WHERE regexp_matches(path, '(^|/)[^/]*7\.txt$') OR regexp_matches(path, '(^|/)de(/|$)') OR path = 'src3/en/3.txt'", "listing")
def ignore_rules(t: Library) -> DataFrame:
    return t.listing.where(scan.ignore_condition(F.col("path"), ["*7.txt", "de", "src3/en/3.txt"])).select("id")


@query(
    """WITH f AS (SELECT l_orderkey AS face_id, l_orderkey AS file_id, l_linenumber AS x1, 0 AS y1, l_linenumber + 4 AS x2, 4 AS y2 FROM lineitem WHERE l_linenumber = 1),
b AS (SELECT l_orderkey * 100 + l_linenumber AS body_id, l_orderkey AS file_id, l_linenumber - 2 AS x1, 0 AS y1, l_linenumber + 3 AS x2, 9 AS y2 FROM lineitem),
c AS (SELECT face_id, body_id, greatest(0, least(f.x2, b.x2) - greatest(f.x1, b.x1)) * greatest(0, least(f.y2, b.y2) - greatest(f.y1, b.y1)) / greatest(1e-6, (f.x2 - f.x1) * (f.y2 - f.y1))::DOUBLE AS share FROM f JOIN b USING (file_id))
SELECT face_id, body_id, round(share, 6) AS share FROM (SELECT DISTINCT * FROM c) WHERE share >= 0.7 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY share DESC, body_id) = 1"""
)
def faces_in_bodies(t: Library) -> DataFrame:
    lines = t.raw("lineitem").select("l_orderkey", "l_linenumber")
    n = F.col("l_linenumber").cast("double")
    box = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    faces = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("face_id"), F.col("l_orderkey").alias("file_id"), box(n, F.lit(0.0), n + 4, F.lit(4.0)).alias("face_box"))
    bodies = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("body_id"), F.col("l_orderkey").alias("file_id"), box(n - 2, F.lit(0.0), n + 3, F.lit(9.0)).alias("body_box"))
    return vectors.match_faces_to_bodies(faces, bodies).withColumn("share", F.round("share", 6))


# Lookups


@query("SELECT id, checksum FROM canon WHERE checksum IN (SELECT checksum FROM tags WHERE polarity = 'positive')", "canon", "tags")
def files_by_checksums(t: Library) -> DataFrame:
    return lookups.by_keys(catalog.canonical_files(t.listing), lookups.positive_labels(t.tags)).select("id", "checksum")


@query("SELECT checksum, string_agg(DISTINCT label, ',' ORDER BY label) AS values FROM tags WHERE polarity = 'positive' GROUP BY 1".replace(" values", ' "values"'), "tags")
def labels_of_files(t: Library) -> DataFrame:
    return lookups.values_by_key(lookups.positive_labels(t.tags), "checksum", "label")


@query("SELECT DISTINCT checksum, label FROM tags WHERE polarity = 'negative'", "tags")
def negated_labels(t: Library) -> DataFrame:
    return lookups.negative_labels(t.tags)


@query("SELECT checksum, arg_max(polarity, id) AS polarity FROM tags WHERE label = 'quality' GROUP BY 1", "tags")
def last_polarity(t: Library) -> DataFrame:
    return lookups.last_polarity(t.tags, "quality")


@query("SELECT c_custkey AS set_id, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND user_id = c_custkey) AS n FROM customer")
def favourite_counts(t: Library) -> DataFrame:
    counted = t.raw("events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("set_id")).agg(F.count("*").alias("n"))
    return lookups.counts_with_default(t.raw("customer").select(F.col("c_custkey").alias("set_id")), counted, "set_id", "n")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def top_favourites(t: Library) -> DataFrame:
    counted = t.raw("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    return lookups.top_favourites(counted, "user_id", "n")


@query("SELECT n AS name, count(*) AS n FROM (SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS n FROM part) WHERE lower(n) = 'red widget' AND n <> 'red widget' GROUP BY 1")
def name_variants(t: Library) -> DataFrame:
    return lookups.variants(t.raw("part").select(F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")), "red widget")


INSTANCES = "f AS (SELECT l_orderkey AS checksum, p_brand AS identity, l_orderkey * 100 + l_linenumber AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'), ph AS (SELECT DISTINCT l_orderkey AS checksum, p_brand AS identity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_discount >= 0.09)"


@query(f"WITH {INSTANCES} SELECT identity, checksum, id AS face_id FROM f UNION ALL SELECT identity, checksum, NULL FROM ph WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.checksum = ph.checksum AND f.identity = ph.identity)")
def identity_instances(t: Library) -> DataFrame:
    _, faces, photos, _, _ = _people(t)
    return lookups.identity_instances(faces, photos)


@query(f"WITH {INSTANCES} SELECT id, CASE WHEN identity = 'Brand#1' AND checksum IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) THEN NULL ELSE identity END AS identity FROM f")
def scrub_identity(t: Library) -> DataFrame:
    members, faces, photos, _, _ = _people(t)
    return lookups.scrub_identity(faces, photos, members, "Brand#1", 7)[0].select("id", "identity")


@query("WITH s AS (SELECT u.id, n.identity, list_inner_product(u.e, n.e) AS x FROM faces u, faces n WHERE u.identity IS NULL AND n.identity IS NOT NULL) SELECT id AS source_face_id, identity, 'confirm' AS action FROM s WHERE x >= 0.33 QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, identity) = 1", "faces")
def confirm_above_threshold(t: Library) -> DataFrame:
    suggested = vectors.nearest_label(t.faces.where("identity IS NULL"), t.faces.where("identity IS NOT NULL"), "identity", 0.3)
    return lookups.confirm_above(suggested, 0.33)


@query("WITH a AS (SELECT * FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 3) SELECT event_type, user_id, n FROM a")
def top_per_type(t: Library) -> DataFrame:
    return stats.top_of_each(t.raw("events"), "event_type", "user_id", 3)


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def place_rollup(t: Library) -> DataFrame:
    nations = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("n_nationkey", "c_nationkey")
    return stats.rollup_counts(t.raw("customer"), "c_nationkey", nations, ["r_name", "n_name"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(t: Library) -> DataFrame:
    return stats.counts_per_hour(t.raw("events"))
