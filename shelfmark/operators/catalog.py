"""Catalog: identity, paths, folders, duplicates, listings and counts.

Tables: files (id, checksum, size, first_seen, hidden, view_count), file_paths (file_id, path, last_seen_at).
The checksum identifies a file; paths are its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical_files(listing: DataFrame) -> DataFrame:
    """One file per checksum: id is the least id of its copies; size and first_seen follow it."""
    return listing.groupBy("checksum").agg(F.min("id").alias("id"), F.min_by("size", "id").alias("size"), F.min("seen").alias("first_seen"))


def attach_paths(files: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_id, path, last_seen_at): every path of every file."""
    return listing.join(files.select(F.col("id").alias("file_id"), "checksum"), "checksum").select("file_id", "path", F.col("seen").alias("last_seen_at"))


def primary_paths(file_paths: DataFrame) -> DataFrame:
    """(file_id, path): the path seen last; ties go to the greater path."""
    return file_paths.groupBy("file_id").agg(F.max(F.struct("last_seen_at", "path")).alias("p")).select("file_id", F.col("p.path").alias("path"))


def files_with_path(files: DataFrame, file_paths: DataFrame) -> DataFrame:
    """Files with their primary path; a file without a path vanishes."""
    return files.join(primary_paths(file_paths).withColumnRenamed("file_id", "id"), "id")


def find_by_checksums(files: DataFrame, checksums: DataFrame) -> DataFrame:
    return files.join(checksums.select("checksum").distinct(), "checksum", "left_semi")


def file_by_any_path(files: DataFrame, file_paths: DataFrame, path: str) -> DataFrame:
    """The file that any known path names, with its primary path."""
    wanted = file_paths.where(F.col("path") == path).select(F.col("file_id").alias("id"))
    return files_with_path(files, file_paths).join(wanted, "id", "left_semi")


def paths_of_file(file_paths: DataFrame, file_id: int) -> DataFrame:
    return file_paths.where(F.col("file_id") == file_id).orderBy(F.desc("last_seen_at"), F.desc("path"))


def visible(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce("hidden", F.lit(False)))


def duplicates(file_paths: DataFrame, limit: int | None = None) -> DataFrame:
    """Files with several paths, most first."""
    out = file_paths.groupBy("file_id").agg(F.count("*").alias("n_paths")).where("n_paths > 1")
    return out if limit is None else out.orderBy(F.desc("n_paths"), "file_id").limit(limit)


def under_folder(path: Column, folder: str) -> Column:
    """The path itself or below the folder; '' is the whole library.  Plain prefixes reach the scan."""
    return F.lit(True) if folder == "" else (path == folder) | path.startswith(folder + "/")


def files_under_folder(files: DataFrame, file_paths: DataFrame, folder: str) -> DataFrame:
    """Visible files with any path under the folder, once each."""
    inside = file_paths.where(under_folder(F.col("path"), folder)).select(F.col("file_id").alias("id")).distinct()
    return visible(files).join(inside, "id", "left_semi")


def browse_folder(files: DataFrame, file_paths: DataFrame, folder: str) -> DataFrame:
    """One tree level (kind, name, n): child folders with the paths below them, and the files right here."""
    shown = visible(files).select(F.col("id").alias("file_id"))
    inside = file_paths.where(under_folder(F.col("path"), folder)).join(shown, "file_id", "left_semi")
    start = len(folder) + 1 if folder else 0
    rest = F.split(F.expr(f"substring(path, {start + 1})"), "/")
    level = inside.select("file_id", rest.alias("rest"))
    folders = level.where(F.size("rest") > 1).groupBy(F.col("rest")[0].alias("name")).agg(F.count("*").alias("n")).select(F.lit("folder").alias("kind"), "name", "n")
    here = level.where(F.size("rest") == 1).groupBy("file_id").agg(F.min(F.col("rest")[0]).alias("name")).select(F.lit("file").alias("kind"), "name", F.lit(1).cast("long").alias("n"))
    return folders.unionByName(here)


def folder_totals(file_paths: DataFrame) -> DataFrame:
    """(folder, n_paths) of every folder at every depth, by exploding ancestors: an equi-join key instead of a prefix join."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nested = file_paths.where(F.instr("path", "/") > 0)
    return nested.select(F.explode(ancestors).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_paths"))


def search_path(files: DataFrame, file_paths: DataFrame, text: str, escape: bool = True) -> DataFrame:
    """Files whose primary path holds the text, without case.  ``escape`` takes % and _ literally."""
    path = F.lower("path")
    hit = F.contains(path, F.lit(text.lower())) if escape else path.like(f"%{text.lower()}%")
    return files_with_path(files, file_paths).where(hit)


def remove_paths_under(files: DataFrame, file_paths: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(files, file_paths) without the folder; a file goes with its last path."""
    kept = file_paths.where(~under_folder(F.col("path"), folder))
    return files.join(kept.select(F.col("file_id").alias("id")), "id", "left_semi"), kept


def neighbours(files: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(id, prev_id, next_id) of all files in id order.

    lag and lead run inside buckets of ``width`` ids; the borders come from the buckets' ends (a row per bucket).
    """
    bucketed = files.select("id", F.floor(F.col("id") / width).alias("bucket"))
    inner = W.partitionBy("bucket").orderBy("id")
    local = bucketed.withColumn("prev_id", F.lag("id").over(inner)).withColumn("next_id", F.lead("id").over(inner))
    ends = bucketed.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    across = W.orderBy("bucket")
    borders = ends.select("bucket", F.lag("hi").over(across).alias("before"), F.lead("lo").over(across).alias("after"))
    out = local.join(borders, "bucket")
    return out.select("id", F.coalesce("prev_id", "before").alias("prev_id"), F.coalesce("next_id", "after").alias("next_id"))


def neighbour_of(files: DataFrame, file_id: int) -> DataFrame:
    """(prev_id, next_id) of one file, by two aggregates."""
    return files.agg(F.max(F.when(F.col("id") < file_id, F.col("id"))).alias("prev_id"), F.min(F.when(F.col("id") > file_id, F.col("id"))).alias("next_id"))


def page(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """LIMIT/OFFSET over a total order."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def has_more(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> bool:
    """Whether a page after this one has rows (reads one row more than the page)."""
    return len(page(df, keys, 1, offset + limit).take(1)) > 0


def classify_scan(scanned: DataFrame, files: DataFrame, file_paths: DataFrame, on_duplicate: str = "report") -> DataFrame:
    """Class of each scanned (path, checksum): new, already_indexed, duplicate, with the path it repeats.

    Known content at a known path is already indexed; known content elsewhere is a duplicate; of new content the least
    path is new and the others repeat it.  ``on_duplicate='track'`` calls duplicates new paths instead.
    """
    known = file_paths.join(files.select(F.col("id").alias("file_id"), "checksum"), "file_id")
    first_known = known.groupBy("checksum").agg(F.max(F.struct("last_seen_at", "path")).alias("k")).select("checksum", F.col("k.path").alias("known_path"))
    first_new = scanned.groupBy("checksum").agg(F.min("path").alias("first_path"))
    same = known.select("checksum", "path", F.lit(True).alias("same")).distinct()
    out = scanned.join(first_known, "checksum", "left").join(first_new, "checksum").join(same, ["checksum", "path"], "left")
    kind = (
        F.when(F.col("same"), "already_indexed")
        .when(F.col("known_path").isNotNull() | (F.col("path") != F.col("first_path")), "duplicate" if on_duplicate == "report" else "new_path")
        .otherwise("new")
    )
    repeats = F.when(kind.isin("duplicate", "new_path"), F.coalesce("known_path", "first_path"))
    return out.select("path", "checksum", kind.alias("kind"), repeats.alias("repeats"))


def stale_paths(file_paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Tracked paths that are no longer listed: moved (another path of the file lives) or missing."""
    gone = file_paths.join(listing.select("path"), "path", "left_anti")
    alive = file_paths.join(listing.select("path"), "path", "left_semi").groupBy("file_id").agg(F.min("path").alias("lives_at"))
    return gone.join(alive, "file_id", "left").select("file_id", "path", F.when(F.col("lives_at").isNull(), "missing").otherwise("moved").alias("state"), "lives_at")


def verify_integrity(files: DataFrame, hashed: DataFrame) -> DataFrame:
    """Stored against recomputed checksum by path-resolved id; null-safe."""
    return files.join(hashed.select("id", F.col("checksum").alias("found")), "id", "left").select("id", F.col("checksum").eqNullSafe(F.col("found")).alias("intact"))
