"""Sinks: versioned snapshots, duplicate reports, detection data sets, error log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import yolo_line
from .files import register

#: Boxes that a detector needs, share of the images that validate it, and hash buckets in which images are counted.
MIN_BOXES, VALIDATION, BUCKETS = 10, 0.2, 1024


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], version: int) -> None:
    """Write a version of all tables, then the marker that makes it visible (written last, by one task)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    show_version(spark, root, version)


def show_version(spark: SparkSession, root: str, version: int) -> None:
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/_versions")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The visible versions, oldest first."""
    system, at = _files(spark, f"{root}/_versions")
    if not system.exists(at):
        return []
    return sorted({r["version"] for r in spark.read.schema("version long").json(str(at)).collect()})


def latest(spark: SparkSession, root: str, name: str | None = None, version: int | None = None) -> DataFrame | dict[str, DataFrame]:
    """A table of a version (the latest visible one); without a name all its tables."""
    version = versions(spark, root)[-1] if version is None else version
    if name is not None:
        return spark.read.parquet(f"{root}/v={version}/{name}")
    system, at = _files(spark, f"{root}/v={version}")
    return {s.getPath().getName(): spark.read.parquet(str(s.getPath())) for s in system.listStatus(at)}


def duplicate_lines(classified: DataFrame, *keep: str) -> DataFrame:
    """value: ``new<TAB>existing``, one line per duplicate, after the columns to keep."""
    return classified.where("kind = 'duplicate'").select(*keep, F.concat_ws("\t", "path", "repeats").alias("value"))


def duplicate_report(classified: DataFrame, path: str) -> None:
    """Appends the lines to a folder of text files."""
    duplicate_lines(classified).write.mode("append").text(path)


def detection_labels(boxes: DataFrame) -> DataFrame:
    """(checksum, labels): the label file text of each image, one line per box, sorted."""
    lines = boxes.select("checksum", yolo_line(F.col("class_id"), F.col("box"), F.col("width"), F.col("height")).alias("line"))
    return lines.groupBy("checksum").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("labels"))


def split_images(images: DataFrame, share: float = VALIDATION, key: str = "checksum") -> DataFrame:
    """Adds ``split``: of n distinct images exactly max(1, floor(share * n)) are ``val``, in the order of a hash, the others ``train``.

    A single image is for training.  Images are counted in hash buckets, and only the bucket in which the border lies is
    numbered, so nothing is sorted or gathered as a whole.
    """
    spark = images.sparkSession
    h = F.xxhash64(key)
    keyed = images.select(key).distinct().withColumn("__b", F.pmod(F.shiftright(h, 20), F.lit(BUCKETS)).cast("int"))
    counts = sorted(map(tuple, keyed.groupBy("__b").count().collect()))
    n = sum(c for _, c in counts)
    wanted, whole, border = max(1, int(share * n)) if n > 1 else 0, [], -1
    for bucket, count in counts:
        if count > wanted:
            border = bucket
            break
        whole, wanted = [*whole, bucket], wanted - count
    inside = keyed.where(F.col("__b").isin(whole)).select(key)
    some = keyed.where(F.col("__b") == border).orderBy(h, key).limit(wanted).select(key)
    val = inside.unionByName(some).withColumn("split", F.lit("val"))
    return images.join(val, key, "left").withColumn("split", F.coalesce("split", F.lit("train"))) if n else images.withColumn("split", F.lit("train"))


def label_files(boxes: DataFrame, share: float = VALIDATION) -> DataFrame:
    """(path, value): a label file for each image, ``labels/<split>/<checksum>.txt``; a box is never parted from its image's others."""
    path = F.concat(F.lit("labels/"), "split", F.lit("/"), "checksum", F.lit(".txt"))
    return split_images(detection_labels(boxes), share).select(path.alias("path"), F.concat("labels", F.lit("\n")).alias("value"))


def detection_dataset(boxes: DataFrame, root: str, label: str, share: float = VALIDATION) -> None:
    """The data set of a detector: label files and ``data.yaml``, all or nothing.  Images keep their own folder."""
    if boxes.count() < MIN_BOXES:
        raise ValueError(f"at least {MIN_BOXES} boxes are needed")
    register(boxes.sparkSession)
    yaml = f"path: {root}\ntrain: images/train\nval: images/val\nnc: 1\nnames: [{label!r}]\n"
    files = label_files(boxes, share).union(boxes.sparkSession.createDataFrame([("data.yaml", yaml)], "path string, value string"))
    files.write.format("text_files").mode("overwrite").save(root)


def log_errors(errors: DataFrame, path: str) -> None:
    errors.select("path", "message", F.current_timestamp().alias("created_at"), F.lit(False).alias("read")).write.mode("append").parquet(path)


def list_errors(log: DataFrame, unread_only: bool = False, limit: int = 50) -> DataFrame:
    rows = log.where("NOT read") if unread_only else log
    return rows.orderBy(F.desc("created_at"), "path").limit(limit)
