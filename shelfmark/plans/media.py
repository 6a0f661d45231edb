"""Queries of the file layer (bytes to facts) and of the pruned search, with their SQL; registered like those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geo, pivots, probe, queues, requests
from ..sources import media, scan, sinks, vector_store
from . import blobs
from .fixtures import Library, shared_folder
from .registry import query

# Bytes of files


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n FROM documents")
def content_groups(t: Library) -> DataFrame:
    """Files of equal content, found by their XXH64."""
    files = scan.content_hash(t.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))).select("id", "checksum")
    heads = files.groupBy("checksum").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return files.join(heads, "checksum").select("id", "first_id", "n")


def _photos(t: Library) -> DataFrame:
    """id, content: a JPEG for each order, both byte orders, two date tags; some with a broken EXIF block or date."""
    key = F.col("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy:MM:dd")
    date = F.when(key % 11 == 4, F.lpad(F.lit("?"), 19, "?")).otherwise(F.concat(day, F.lit(" 12:34:"), F.lpad((key % 60).cast("string"), 2, "0")))
    lat, lon = [key % 80 * 100, key % 60 * 100, key * 7 % 6000], [key % 180 * 100, key % 50 * 100, key * 3 % 6000]
    block = blobs.exif_block(key % 2 == 1, F.when(key % 3 == 0, 36867).otherwise(306), date, lat, key % 4 == 1, lon, key % 5 == 2)
    damaged = F.when(key % 7 == 3, F.concat(blobs.text("XX"), F.substring(block, 3, 200))).otherwise(block)
    return t.raw("orders").select(key.alias("id"), blobs.jpeg(key % 640 + 1, key % 480 + 1, damaged).alias("content"))


@query(
    """SELECT o_orderkey AS id, o_orderkey % 640 + 1 AS width, o_orderkey % 480 + 1 AS height,
CASE WHEN o_orderkey % 7 <> 3 AND o_orderkey % 11 <> 4 THEN epoch(CAST(o_orderdate AS DATE) + INTERVAL 45240 SECOND)::BIGINT + o_orderkey % 60 END AS taken,
CASE WHEN o_orderkey % 7 <> 3 THEN round((o_orderkey % 80 + (o_orderkey % 60) / 60 + (o_orderkey * 7 % 6000) / 360000) * CASE WHEN o_orderkey % 4 = 1 THEN -1 ELSE 1 END, 6) END AS lat,
CASE WHEN o_orderkey % 7 <> 3 THEN round((o_orderkey % 180 + (o_orderkey % 50) / 60 + (o_orderkey * 3 % 6000) / 360000) * CASE WHEN o_orderkey % 5 = 2 THEN -1 ELSE 1 END, 6) END AS lon FROM orders"""
)
def exif_scan(t: Library) -> DataFrame:
    """Capture time and position out of the bytes of photos."""
    found = media.inspect(_photos(t))
    return found.select("id", "width", "height", media.taken_at().alias("taken"), F.round(media.latitude(), 6).alias("lat"), F.round(media.longitude(), 6).alias("lon"))


def _pictures(t: Library) -> DataFrame:
    """id, checksum, content: a PNG of one pixel for each customer, damaged in a way that the key tells."""
    key = F.col("c_custkey")
    whole = blobs.png(key % 256)
    # The file is 8 bytes of start, 25 of header, 25 of pixels and 12 of end.
    flip = lambda at, with_: F.concat(F.substring(whole, 1, at), blobs.fixed(with_), F.substring(whole, at + 2, 200))
    content = F.when(key % 8 == 1, flip(29, "EE")).when(key % 8 == 2, F.substring(whole, 1, 60)).when(key % 8 == 3, flip(0, "00")).when(key % 8 == 4, flip(57, "EE")).when(key % 8 == 5, blobs.fixed(""))
    return t.raw("customer").select(key.alias("id"), F.concat(F.lit("c"), key.cast("string")).alias("checksum"), content.alias("damaged"), whole.alias("whole")).select("id", "checksum", F.coalesce("damaged", "whole").alias("content"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 8 NOT IN (3, 5) THEN 'png' END AS kind, CASE c_custkey % 8 WHEN 1 THEN 'IHDR: wrong checksum' WHEN 2 THEN 'file ends early' WHEN 3 THEN 'unknown format'
WHEN 4 THEN 'IDAT: wrong checksum' WHEN 5 THEN 'empty file' END AS error FROM customer"""
)
def broken_scan(t: Library) -> DataFrame:
    """Pictures whose bytes are damaged at known places."""
    return media.inspect(_pictures(t)).select("id", "kind", "error")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 8 BETWEEN 1 AND 5 THEN 99 WHEN c_custkey % 3 = 0 THEN 7 END AS broken FROM customer")
def broken_files(t: Library) -> DataFrame:
    """Files marked as broken by a scan; an earlier mark stays."""
    scanned = media.inspect(_pictures(t))
    files = t.raw("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("checksum"), F.when(F.col("c_custkey") % 3 == 0, 7).alias("broken"))
    return media.mark_broken(files, scanned, F.lit(99)).select("id", "broken")


@query(
    """SELECT l_orderkey AS file_id, (row_number() OVER w - 1)::INT AS frame_index, coalesce(sum(l_partkey % 200 * 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 200 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS time_ms,
count(*) OVER (PARTITION BY l_orderkey)::INT AS n_frames FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 200)"""
)
def animation_frames(t: Library) -> DataFrame:
    """Frames and their times out of the bytes of animations: an order's lines are its frames."""
    lines = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 200).alias("d")))).alias("l"))
    files = lines.select("file_id", blobs.gif(F.transform("l", lambda x: x["d"])).alias("content"))
    found = media.inspect(files).withColumn("n_frames", media.frame_count().cast("int"))
    return media.frames(found, "file_id", "n_frames").select("file_id", "frame_index", "time_ms", "n_frames")


# Search with pruning

NEAREST = """WITH s AS (SELECT u.id, n.identity, list_inner_product(u.e, n.e) AS x FROM faces u, faces n WHERE u.identity IS NULL AND n.identity IS NOT NULL)
SELECT id, identity, round(x, 4) AS score FROM s WHERE x >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, identity) = 1"""


@query(NEAREST, "faces")
def nn_pruned(t: Library) -> DataFrame:
    """The rows of ``nn_label``, found by pivots."""
    found = pivots.nearest_label(t.faces.where("identity IS NULL"), t.faces.where("identity IS NOT NULL"), "identity", 0.3)
    return found.withColumn("score", F.round("score", 4))


@query(NEAREST, "faces")
def nn_from_store(t: Library) -> DataFrame:
    """The same from a stored version of the references, read where they lie."""
    root = f"{shared_folder(t.spark)}/vectors-{uuid.uuid4().hex}"
    stored = vector_store.ensure(t.spark, root, 1, t.faces.where("identity IS NOT NULL"), "identity")
    return pivots.nearest_label(t.faces.where("identity IS NULL"), stored, "identity", 0.3).withColumn("score", F.round("score", 4))


@query(
    """WITH c AS (SELECT id, label, list_transform(e, lambda x, i: x * 0.2 + CASE WHEN i = label + 1 THEN 1 ELSE 0 END) AS e FROM vectors),
s AS (SELECT a.id, b.label, list_inner_product(a.e, b.e) AS x FROM c a, c b WHERE a.id % 2 = 0 AND b.id % 2 = 1 AND b.label <> 3)
SELECT id, label, round(x, 4) AS score, true AS pruned FROM s WHERE x >= 0.9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, label) = 1""",
    "vectors",
)
def nn_pruning(t: Library) -> DataFrame:
    """Vectors that lie in clusters: of all scores, not half are worked out for any vector (``pruned``)."""
    moved = F.transform("embedding", lambda x, i: x.cast("double") * 0.2 + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    all_ = t.vectors.select("id", "label", moved.alias("embedding"))
    references = all_.where("id % 2 = 1 AND label <> 3")
    found = pivots.nearest_with_counts(all_.where("id % 2 = 0"), pivots.build(references, "label"), 0.9)
    n = references.agg(F.count("*").alias("n"))
    return found.where("score IS NOT NULL").join(F.broadcast(n)).select("id", "label", F.round("score", 4).alias("score"), (F.col("pairs") * 2 < F.col("n")).alias("pruned"))


# Requests by picture


def _tiles(t: Library) -> DataFrame:
    """Four tiles for each vector, the first of them the whole image; files whose id ends in 7 have only that one."""
    tile = F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 10 == 7, 0).otherwise(3))).alias("k")
    spread = t.vectors.select("id", "embedding", tile)
    moved = F.transform("embedding", lambda x, i: x.cast("double") * (1 + (i + F.col("k") * 7) % 5))
    left, top = (F.col("k") % 2) * 300.0, F.floor(F.col("k") / 2) * 200.0
    whole = F.col("k") == 0
    return spread.select(
        F.col("id").alias("file_id"), F.when(whole, 0.0).otherwise(left).alias("x1"), F.when(whole, 0.0).otherwise(top).alias("y1"), F.when(whole, 640.0).otherwise(left + 300).alias("x2"),
        F.when(whole, 480.0).otherwise(top + 200).alias("y2"), moved.alias("embedding"),
    )


REGION = "region AS (SELECT id AS own, e AS q FROM vectors WHERE id = 3)"


@query(
    f"""WITH {REGION}, tiles AS (SELECT id AS file_id, k, list_transform(e, lambda x, i: x * (1 + (i - 1 + k * 7) % 5)) AS e FROM vectors, range(4) r(k) WHERE k = 0 OR id % 10 <> 7),
s AS (SELECT file_id, k, list_inner_product(e, q) AS x FROM tiles, region WHERE file_id <> own),
b AS (SELECT file_id, max(x) AS score, arg_max(k, x) FILTER (k > 0) AS k FROM s GROUP BY 1)
SELECT file_id, round(score, 4) AS score, CASE WHEN k IS NOT NULL THEN CAST([round(k % 2 * 300 / CASE WHEN file_id % 10 = 7 THEN 1 ELSE 640 END, 4), round((k // 2) * 200 / 480, 4), round((k % 2 * 300 + 300) / 640, 4), round(((k // 2) * 200 + 200) / 480, 4)] AS VARCHAR) END AS box, 'tiles' AS mode
FROM b ORDER BY score DESC, file_id LIMIT 50""",
    "vectors",
)
def region_by_tiles(t: Library) -> DataFrame:
    """Files by the tile most like a region, and where in the picture that is."""
    region = t.vectors.where("id = 3").select(F.col("id").alias("file_id"), "embedding")
    found = requests.region_search(region, _tiles(t), t.vectors)
    return found.withColumn("score", F.round("score", 4)).withColumn("box", F.concat(F.lit("["), F.array_join(F.col("box").cast("array<string>"), ", "), F.lit("]")))


@query(f"WITH {REGION} SELECT id AS file_id, round(list_inner_product(e, q), 4) AS score, 'whole' AS mode FROM vectors, region WHERE id <> own ORDER BY list_inner_product(e, q) DESC, id LIMIT 50", "vectors")
def region_by_wholes(t: Library) -> DataFrame:
    """The same request while no tile has been indexed."""
    region = t.vectors.where("id = 3").select(F.col("id").alias("file_id"), "embedding")
    return requests.region_search(region, _tiles(t).where(F.lit(False)), t.vectors).select("file_id", F.round("score", 4).alias("score"), "mode")


@query(
    """WITH q AS (SELECT e AS q FROM vectors WHERE id = 5), f AS (SELECT min(id) AS id, checksum, min(path) AS path FROM listing GROUP BY checksum),
u AS (SELECT v.id // 3 AS file_id, 'auto:' || v.id AS ref, NULL AS identity, v.e FROM vectors v WHERE v.id % 2 = 0 AND v.id % 10 <> 4
UNION ALL SELECT f.id, 'manual:' || a.id, a.identity, a.e FROM faces a JOIN f USING (checksum) WHERE a.id % 2 = 1),
s AS (SELECT u.*, list_inner_product(e, q) AS x FROM u, q), b AS (SELECT * FROM s WHERE x >= 0.1 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY x DESC, ref) = 1)
SELECT b.file_id, round(x, 4) AS score, ref, identity, f.path, regexp_extract(f.path, '[^/]*$') AS filename FROM b LEFT JOIN f ON f.id = b.file_id ORDER BY x DESC, b.file_id LIMIT 50""",
    "faces",
)
def search_by_face(t: Library) -> DataFrame:
    """Files by the face most like one, over detected and curated faces; faces 4, 14, ... were promoted."""
    detected = t.vectors.where("id % 2 = 0").select("id", F.floor(F.col("id") / 3).alias("file_id"), "embedding")
    files = t.listing.groupBy("checksum").agg(F.min("id").alias("id"), F.min("path").alias("path"))
    promoted = t.vectors.where("id % 10 = 4").select("id")
    found = requests.face_search(t.vectors.where("id = 5"), detected, t.faces.where("id % 2 = 1"), promoted, files, threshold=0.1)
    return found.withColumn("score", F.round("score", 4))


@query(
    """WITH f AS (SELECT min(id) AS id, checksum, min(path) AS path FROM listing GROUP BY checksum), c AS (SELECT row_number() OVER (ORDER BY checksum) AS o, checksum FROM f),
q AS (SELECT e AS q FROM vectors WHERE id = 5), near AS (SELECT id, list_inner_product(e, q) AS x FROM vectors, q ORDER BY x DESC, id LIMIT 40),
person AS (SELECT DISTINCT checksum FROM faces WHERE identity = 'person 2' UNION SELECT checksum FROM listing WHERE id % 50 = 1),
s AS (SELECT 'similar' AS kind, f.id, f.checksum, -x AS place FROM near JOIN f USING (id) WHERE id <> 5 UNION ALL SELECT 'identity', f.id, checksum, 0 FROM person JOIN f USING (checksum)
UNION ALL SELECT 'set', f.id, l.checksum, min(CASE WHEN l.id % 3 > 0 THEN 1000 - l.id ELSE 1e9 END) FROM listing l JOIN f USING (checksum) WHERE l.id % 7 = 2 GROUP BY 1, 2, 3)
SELECT kind, id, checksum, path FROM s JOIN f USING (id, checksum) WHERE id % 4 > 0 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY place, id) <= 20""",
    "faces",
)
def feed_injection(t: Library) -> DataFrame:
    """More of a person (asked for by an alias), of a set and of what looks alike, without what the feed has."""
    files = t.listing.groupBy("checksum").agg(F.min("id").alias("id"), F.min("path").alias("path"))
    aliases = t.spark.createDataFrame([("p2", "person 2")], "alias string, owner string")
    assigned = t.listing.where("id % 50 = 1").select(F.lit("person 2").alias("identity"), "checksum")
    members = t.listing.where("id % 7 = 2").select(F.lit(9).alias("set_id"), "checksum", F.when(F.col("id") % 3 > 0, 1000 - F.col("id")).alias("position"))
    kinds = {"identity": requests.more_of_identity("p2", t.faces, assigned, aliases), "set": requests.more_of_set(9, members), "similar": requests.more_like(5, t.vectors, files)}
    excluded = files.where("id % 4 = 0")
    parts = [requests.feed_more(files, more, excluded).select(F.lit(kind).alias("kind"), "id", "checksum", "path") for kind, more in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """SELECT c_custkey AS set_id, c_name AS name, CASE WHEN a.l IS NULL THEN '' ELSE a.l END AS aliases FROM customer LEFT JOIN
(SELECT k, string_agg(x, '|' ORDER BY x) AS l FROM (SELECT DISTINCT o_custkey AS k, 'alias ' || o_orderstatus AS x FROM orders) GROUP BY k) a ON k = c_custkey"""
)
def cards_with_aliases(t: Library) -> DataFrame:
    cards = t.sets.select(F.col("id").alias("set_id"), "name")
    aliases = t.raw("orders").select(F.col("o_custkey").alias("set_id"), F.concat(F.lit("alias "), "o_orderstatus").alias("alias"))
    return requests.set_aliases(cards, aliases).withColumn("aliases", F.array_join("aliases", "|"))


# Places


@query(
    """WITH edge AS (SELECT id, CASE id % 5 WHEN 0 THEN 89.5 WHEN 1 THEN -89.5 ELSE lat END AS lat, CASE id % 3 WHEN 0 THEN 179.95 WHEN 1 THEN -179.95 ELSE lon END AS lon FROM points WHERE lat IS NOT NULL),
d AS (SELECT p.id, c.id AS city_id, 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) AS km FROM edge p, cities c)
SELECT id, round(min(km), 1) AS km FROM d GROUP BY id""",
    "points",
    "cities",
)
def nearest_place(t: Library) -> DataFrame:
    """The nearest city on the sphere, also of points at the seam of 180 degrees and by the poles."""
    lat = F.when(F.col("id") % 5 == 0, 89.5).when(F.col("id") % 5 == 1, -89.5).otherwise(F.col("lat"))
    lon = F.when(F.col("id") % 3 == 0, 179.95).when(F.col("id") % 3 == 1, -179.95).otherwise(F.col("lon"))
    edge = t.points.where("lat IS NOT NULL").select("id", lat.alias("lat"), lon.alias("lon"))
    return geo.nearest_city(edge, t.cities, exact=True).select("id", "km")


# Files written and read back


BOXES = """b AS (SELECT l_suppkey::VARCHAR AS checksum, 0 AS class_id, (l_partkey % 50)::DOUBLE AS x1, (l_partkey % 30)::DOUBLE AS y1, (l_partkey % 50 + 1 + l_linenumber)::DOUBLE AS x2, (l_partkey % 30 + 2 + l_linenumber)::DOUBLE AS y2
FROM lineitem)"""


def _boxes(t: Library) -> DataFrame:
    """A box for each order line, on a picture of its supplier."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    box = F.struct((part % 50).cast("double").alias("x1"), (part % 30).cast("double").alias("y1"), (part % 50 + 1 + line).cast("double").alias("x2"), (part % 30 + 2 + line).cast("double").alias("y2"))
    return t.raw("lineitem").select(F.col("l_suppkey").cast("string").alias("checksum"), F.lit(0).alias("class_id"), box.alias("box"), F.lit(64).alias("width"), F.lit(48).alias("height"))


@query(
    f"""WITH {BOXES}, i AS (SELECT checksum, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 2 / 64, (y1 + y2) / 2 / 48, (x2 - x1) / 64, (y2 - y1) / 48), chr(10)
ORDER BY printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 2 / 64, (y1 + y2) / 2 / 48, (x2 - x1) / 64, (y2 - y1) / 48)) AS labels FROM b GROUP BY 1),
n AS (SELECT count(*) AS n FROM i)
SELECT checksum, labels, greatest(1, floor(0.2 * n)::BIGINT) AS n_val, n - greatest(1, floor(0.2 * n)::BIGINT) AS n_train FROM i, n"""
)
def detector_dataset(t: Library) -> DataFrame:
    """The label files of a detector's data set, written one per image and read back from their folder."""
    root = f"{shared_folder(t.spark).removeprefix('file://')}/detector-{uuid.uuid4().hex}"
    sinks.detection_dataset(_boxes(t), root, "thing")
    read = t.spark.read.text(f"{root}/labels", wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    files = read.select(F.regexp_extract(name, r"([^/]*)\.txt$", 1).alias("checksum"), F.regexp_replace("value", "\n$", "").alias("labels"), F.regexp_extract(name, "/(train|val)/", 1).alias("split"))
    counts = files.agg(F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "train").alias("n_train"))
    return files.drop("split").join(F.broadcast(counts))


# Training of tags


@query(
    """SELECT v.id, s.checksum, round(1 / (1 + exp(-(list_sum(list_transform(v.e, lambda x, i: x * ((i - 1) % 7 - 3))) + 0.25))), 6) AS score FROM vectors v JOIN listing s USING (id)
WHERE s.checksum NOT IN (SELECT checksum FROM tags WHERE label = 'quality') AND v.id % 5 > 0 ORDER BY score DESC, v.id LIMIT 40""",
    "vectors",
    "tags",
)
def suggestions_by_probe(t: Library) -> DataFrame:
    """Undecided files that a probe of given weights scores best, without those already shown."""
    given = probe.Probe([float(i % 7 - 3) for i in range(64)], 0.25, 1.0, "given")
    vectors = t.vectors.join(t.listing.select("id", "checksum"), "id")
    decided = t.tags.where("label = 'quality'").select("checksum").distinct()
    return probe.suggest(vectors, given, decided, t.vectors.where("id % 5 = 0"), 40).withColumn("score", F.round("score", 6))


@query(
    """WITH g AS (SELECT p_brand AS label, count(*) FILTER (l_linenumber <= 2) AS n_positive, count(*) FILTER (l_linenumber > 2) AS n_negative, count(*) FILTER (l_linenumber = 1) AS n_boxes, min(p_partkey) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT label, n_positive, n_negative, n_boxes, n_positive >= 5 AND n_negative >= 5 AS can_fit, n_boxes >= 10 AS can_detect, CASE WHEN k % 3 = 0 THEN 'done' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'failed' WHEN k % 3 = 1 THEN 'running' END AS status,
CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'the training process is gone' END AS error FROM g"""
)
def training_states(t: Library) -> DataFrame:
    """Brands as labels, order lines as their examples; trainings that run, are done, or whose process is gone."""
    lines = t.raw("lineitem").join(t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label")), "l_partkey")
    tags = lines.select("label", F.when(F.col("l_linenumber") <= 2, "positive").otherwise("negative").alias("polarity"))
    first = lines.groupBy("label").agg(F.min("l_partkey").alias("k"))
    status = first.where("k % 3 < 2").select("label", F.when(F.col("k") % 3 == 0, "done").otherwise("running").alias("status"), F.col("k").alias("pid"), F.lit(None).cast("string").alias("error"))
    return probe.training_state(tags, lines.where("l_linenumber = 1"), status, first.where("k % 2 = 1").select(F.col("k").alias("pid")))


@query(
    """WITH b AS (SELECT l_orderkey AS file_id, l_linenumber AS n, greatest(0, trunc(l_partkey % 40 - 6.5))::BIGINT AS x1, greatest(0, trunc(l_partkey % 30 - 4.25))::BIGINT AS y1, least(60, trunc(l_partkey % 40 - 6.5 + l_quantity))::BIGINT AS x2, least(50, trunc(l_partkey % 30 - 4.25 + 2 * l_quantity))::BIGINT AS y2 FROM lineitem)
SELECT file_id, count(*) AS n_crops, sum(x1 + 3 * y1 + 5 * x2 + 7 * y2)::BIGINT AS digest FROM b WHERE x2 - x1 >= 8 AND y2 - y1 >= 8 GROUP BY 1"""
)
def body_crops(t: Library) -> DataFrame:
    """Boxes of people cut to their pictures."""
    x, y, q = F.col("l_partkey") % 40 - 6.5, F.col("l_partkey") % 30 - 4.25, F.col("l_quantity").cast("double")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + q).alias("x2"), (y + 2 * q).alias("y2"))
    crops = queues.body_crops(t.raw("lineitem").select(F.col("l_orderkey").alias("file_id"), box.alias("box"), F.lit(60).alias("width"), F.lit(50).alias("height")))
    digest = F.col("box.x1") + 3 * F.col("box.y1") + 5 * F.col("box.x2") + 7 * F.col("box.y2")
    return crops.groupBy("file_id").agg(F.count("*").alias("n_crops"), F.sum(digest).alias("digest"))
