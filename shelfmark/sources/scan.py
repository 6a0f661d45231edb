"""Ingest sources: file listings, content hashes, ignore rules, folder markers, place dumps, term lists."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import xxh64

#: Extensions that are tracked (fixed values).
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp"]
VIDEO_EXTENSIONS = [".mp4", ".mov", ".m4v", ".webm"]


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files below a root, without reading their content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length", "modificationTime")


def contents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root)


def media_only(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(suffix.isin(IMAGE_EXTENSIONS + VIDEO_EXTENSIONS) & ~F.contains("path", F.lit("/.media/")))


def content_hash(files: DataFrame, method: str = "xxh64") -> DataFrame:
    """Adds checksum of ``content``, without Python: XXH64 with seed 0, or SHA-256."""
    return files.withColumn("checksum", F.sha2("content", 256) if method == "sha256" else xxh64(F.col("content")))


def ignore_condition(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: ``**/x`` any segment, ``a/b`` the full path, else the base name or any folder.

    A pattern with a trailing slash names folders.  All patterns become one regular expression per kind.
    """
    segment, full, folder = [], [], []
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        if p.startswith("**/"):
            segment.append(p[3:])
        elif p.endswith("/"):
            folder.append(p[:-1])
        elif "/" in p:
            full.append(p)
        else:
            segment.append(p)

    def regex(globs: list[str]) -> str:
        return "|".join(re.sub(r"\(\?s:(.*)\)\\[Zz]$", r"(?:\1)", fnmatch.translate(g)) for g in globs)

    parts = F.split(path, "/")
    out = F.lit(False)
    if segment:
        out = out | F.exists(parts, lambda s: s.rlike(f"^(?s:{regex(segment)})$"))
    if folder:
        out = out | F.exists(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda s: s.rlike(f"^(?s:{regex(folder)})$"))
    if full:
        out = out | path.rlike(f"^(?s:{regex(full)})$")
    return out


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(pos, term) of a term list, comments and blank lines left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "term"))
    return lines.select("pos", F.trim("term").alias("term")).where("term <> '' AND NOT startswith(term, '#')")


def read_markers(spark: SparkSession, root: str) -> DataFrame:
    """parse_markers of the files named noface, categories or set with the suffix .marker below a root.

    Spark lists no file whose name starts with a dot, so marker files carry a suffix instead.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.marker")
    return parse_markers(raw.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_markers(texts: DataFrame) -> DataFrame:
    """(folder, kind, lines) of marker files (path, value); comments and blank lines left out."""
    kind = F.regexp_extract("path", r"/\.?(noface|categories|set)(?:\.marker)?$", 1)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return texts.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), kind.alias("kind"), lines.alias("lines")).where("kind <> ''")


def apply_markers(markers: DataFrame, paths: DataFrame) -> DataFrame:
    """(checksum, kind, value) of files below a marker's folder: noface, or each category.

    A file's ancestors are exploded, so the prefix join is an equi-join on the folder.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    below = paths.where(F.instr("path", "/") > 0).select("checksum", F.explode(up).alias("folder"))
    hit = below.join(markers.where("kind <> 'set'"), "folder")
    return hit.select("checksum", "kind", F.explode(F.when(F.col("kind") == "noface", F.array(F.lit("true"))).otherwise(F.col("lines"))).alias("value")).distinct()


def resolve_set_entries(entries: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) of (set_name, path, checksum): by checksum first, then by path."""
    known = paths.select("checksum").distinct().withColumn("__known", F.lit(True))
    by_path = paths.groupBy("path").agg(F.min("checksum").alias("__by_path"))
    found = entries.join(known, "checksum", "left").join(by_path, "path", "left")
    found = found.withColumn("resolved", F.when(F.col("__known"), F.col("checksum")).otherwise(F.col("__by_path")))
    return found.where("resolved IS NOT NULL").select("set_name", F.col("resolved").alias("checksum")), found.where("resolved IS NULL").select("set_name", "path")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return parse_places(spark.read.text(path))


def parse_places(texts: DataFrame) -> DataFrame:
    """(id, name, lat, lon, country, admin1, population) of the lines (``value``) of a headerless place dump; bad positions and short rows go."""
    lines = texts.select(F.split("value", "\t").alias("c")).where(F.size("c") >= 15)
    out = lines.select(
        F.try_to_number(F.col("c")[0], F.lit("999999999999")).cast("long").alias("id"), F.col("c")[1].alias("name"), F.expr("try_cast(c[4] AS double)").alias("lat"), F.expr("try_cast(c[5] AS double)").alias("lon"),
        F.col("c")[8].alias("country"), F.col("c")[10].alias("admin1"), F.coalesce(F.expr("try_cast(c[14] AS bigint)"), F.lit(0)).alias("population"),
    )
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


def replace_places(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new place table and files without their places; an empty dump is refused."""
    if rows.isEmpty():
        raise ValueError("an empty place table does not replace the old one")
    return rows, files.withColumn("city_id", F.lit(None).cast("long"))


def map_model(files: DataFrame, model, schema: str, at: str, on_error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(results, failures) of a per-batch model whose rows may carry a message in the column ``on_error``.

    The model runs once on every file: its rows are written to the folder ``at``, and both tables read them there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from model(iter([pdf]))

    files.mapInPandas(run, schema).write.mode("overwrite").parquet(at)
    out = files.sparkSession.read.schema(schema).parquet(at)
    return out.where(F.col(on_error).isNull()), out.where(F.col(on_error).isNotNull())
