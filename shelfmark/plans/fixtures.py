"""Logical catalog tables derived from the driver's tables, as DataFrames and as SQL for the comparison runs.

| logical | from |
| --- | --- |
| listing, files, file_paths | documents: the text's MD5 is the checksum, source/lang/doc_id the path |
| views, favourite changes | events: kinds view and purchase/error of a user, who stands for a file |
| tags | labels: quality and toxic as positive or negative decisions |
| sets, studios, members | customer, nation, orders |
| detections | lineitem: the order is the file, the part's name the class |
| faces | embeddings: labels below 5 are named people, the others unknown |
| places, points | supplier, customer: positions computed from their keys |
| categories | embeddings by label; rejections and manual rows from labels |
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog

FIRST_SEEN = 1_700_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (where or tempfile.mkdtemp(prefix="shelfmark-")).rstrip("/")


@dataclass
class Library:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def listing(self) -> DataFrame:
        path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("checksum"), path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 60 + FIRST_SEEN).alias("seen"))

    @cached_property
    def files(self) -> DataFrame:
        """id, checksum, size, first_seen, hidden, view_count."""
        files = catalog.canonical_files(self.listing)
        hidden = self.raw("labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("hidden")).distinct()
        views = self.raw("events").where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("view_count"))
        out = files.join(hidden, "id", "left").join(views, "id", "left")
        return out.select("id", "checksum", "size", "first_seen", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("view_count", F.lit(0)).alias("view_count"))

    @cached_property
    def file_paths(self) -> DataFrame:
        return catalog.attach_paths(catalog.canonical_files(self.listing), self.listing)

    @cached_property
    def tags(self) -> DataFrame:
        """id, checksum, label, polarity."""
        sums = self.listing.select("id", "checksum")
        labels = self.raw("labels").select(F.col("doc_id").alias("id"), F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("label", "v"))
        return labels.join(sums, "id").select("id", "checksum", "label", F.when(F.col("v") == 1, "positive").otherwise("negative").alias("polarity"))

    @cached_property
    def studios(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def sets(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("studio_id"), F.floor(F.abs("c_acctbal") / 1000).alias("favorite"))

    @cached_property
    def members(self) -> DataFrame:
        """set_id, checksum (the order's key as text), position (null for pending orders)."""
        return self.raw("orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").cast("string").alias("checksum"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("position"))

    @cached_property
    def detections(self) -> DataFrame:
        """id, file_id, class_name, confidence (0 to 1), frame_index."""
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("class_name"))
        return lines.join(parts, "l_partkey").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("file_id"), "class_name", (F.col("l_discount") * 10).alias("confidence"), F.lit(0).alias("frame_index"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("int").alias("label"))

    @cached_property
    def faces(self) -> DataFrame:
        """id, embedding, identity (null for labels of 5 and more), checksum (of the file with that id), created_at."""
        identity = F.when(F.col("label") < 5, F.concat(F.lit("person "), F.col("label").cast("string")))
        sums = self.listing.select("id", "checksum")
        return self.vectors.join(sums, "id", "left").select("id", "embedding", identity.alias("identity"), "checksum", (F.col("id") * 7 + FIRST_SEEN).alias("created_at"), "label")

    @cached_property
    def cities(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(key.alias("id"), F.col("s_name").alias("name"), ((key * 37) % 1400 / 10 - 70).alias("lat"), ((key * 91) % 3600 / 10 - 180).alias("lon"), F.floor(F.abs("s_acctbal") * 100).alias("population"))

    @cached_property
    def points(self) -> DataFrame:
        """id, lat, lon; customers in the red have no position."""
        key = F.col("c_custkey")
        there = F.col("c_acctbal") >= 0
        return self.raw("customer").select(key.alias("id"), F.when(there, (key * 53) % 1700 / 10 - 85).alias("lat"), F.when(there, (key * 29) % 3600 / 10 - 180).alias("lon"))

    @cached_property
    def favourite_changes(self) -> DataFrame:
        """key, at, delta: purchases add one, errors take one."""
        rows = self.raw("events").where("event_type IN ('purchase', 'error')")
        return rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("delta"))

    @cached_property
    def frames(self) -> DataFrame:
        return self.raw("conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("frame_index"), F.length("text").alias("duration"))

    @cached_property
    def tree(self) -> DataFrame:
        """file_id, path of the pages' urls without scheme and query."""
        return self.raw("pages").select(F.col("page_id").alias("file_id"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


#: The same tables in SQL; a query takes those it names.
SQL: dict[str, str] = {
    "listing": "SELECT doc_id AS id, md5(text) AS checksum, source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size, doc_id * 60 + 1700000000 AS seen FROM documents",
    "canon": "SELECT checksum, min(id) AS id, arg_min(size, id) AS size, min(seen) AS first_seen FROM listing GROUP BY checksum",
    "files": "SELECT c.id, c.checksum, c.size, c.first_seen, EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = c.id) AS hidden, (SELECT count(*) FROM events e WHERE e.event_type = 'view' AND e.user_id = c.id) AS view_count FROM canon c",
    "file_paths": "SELECT c.id AS file_id, l.path, l.seen AS last_seen_at FROM listing l JOIN canon c USING (checksum)",
    "primary_paths": "SELECT file_id, path FROM file_paths QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY last_seen_at DESC, path DESC) = 1",
    "tags": "SELECT l.doc_id AS id, s.checksum, v.label, CASE WHEN v.x = 1 THEN 'positive' ELSE 'negative' END AS polarity FROM (SELECT doc_id, 'quality' AS label, quality AS x FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) v JOIN labels l USING (doc_id) JOIN listing s ON s.id = l.doc_id",
    "sets": "SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS studio_id, floor(abs(c_acctbal) / 1000)::BIGINT AS favorite FROM customer",
    "members": "SELECT o_custkey AS set_id, o_orderkey::VARCHAR AS checksum, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS position FROM orders",
    "detections": "SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS file_id, p_name AS class_name, l_discount * 10 AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS e, label::INT AS label FROM embeddings",
    "faces": "SELECT v.id, v.e, CASE WHEN v.label < 5 THEN 'person ' || v.label END AS identity, s.checksum, v.id * 7 + 1700000000 AS created_at, v.label FROM vectors v LEFT JOIN listing s ON s.id = v.id",
    "cities": "SELECT s_suppkey AS id, s_name AS name, (s_suppkey * 37) % 1400 / 10 - 70 AS lat, (s_suppkey * 91) % 3600 / 10 - 180 AS lon, floor(abs(s_acctbal) * 100)::BIGINT AS population FROM supplier",
    "points": "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN (c_custkey * 53) % 1700 / 10 - 85 END AS lat, CASE WHEN c_acctbal >= 0 THEN (c_custkey * 29) % 3600 / 10 - 180 END AS lon FROM customer",
    "tree": "SELECT page_id AS file_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages",
}
#: What each table is built on.
NEEDS = {"canon": ["listing"], "files": ["listing", "canon"], "file_paths": ["listing", "canon"], "primary_paths": ["listing", "canon", "file_paths"], "tags": ["listing"], "faces": ["vectors", "listing"]}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` (a SELECT or a WITH) after the definitions of the named tables and what they need."""
    order: list[str] = []
    for name in names:
        for x in [*NEEDS.get(name, []), name]:
            if x not in order:
                order.append(x)
    head = ",\n".join(f"{x} AS ({SQL[x]})" for x in order)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
