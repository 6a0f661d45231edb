"""Structured Streaming: ingest of listings and counters with state (an addition; batch operators do not need it)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import upsert


def stream_listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(source: DataFrame, table_path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """Last-wins table kept by micro-batches: each rewrites the hash buckets of its keys, and no others.

    A version holds the rewritten buckets and a manifest (bucket, version) of all, written last; versions are never
    changed, so a repeated batch gives the same table.
    """
    spark = source.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = batch.withColumn("__order", F.col(order)).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = {r[0] for r in newest.select("bucket").distinct().collect()}  # at most ``buckets``
        held = _manifest(spark, table_path, batch_id - 1) if batch_id else {}
        old = _rows(spark, table_path, {b: v for b, v in held.items() if b in touched})
        state = newest.drop("__order").where(F.lit(False)) if old is None else old
        target = f"{table_path}/data/v={batch_id}"
        upsert(state, newest, [*keys, "bucket"], "__order").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        newest.unpersist()
        manifest = sorted((held | dict.fromkeys(touched, batch_id)).items())
        spark.createDataFrame(manifest, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{table_path}/manifest/v={batch_id}")

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _manifest(spark: SparkSession, table_path: str, version: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{table_path}/manifest/v={version}").collect()}


def _rows(spark: SparkSession, table_path: str, held: dict[int, int]) -> DataFrame | None:
    of: dict[int, list[int]] = {}
    for bucket, version in held.items():
        of.setdefault(version, []).append(bucket)
    parts = [spark.read.parquet(f"{table_path}/data/v={v}").where(F.col("bucket").isin(b)) for v, b in sorted(of.items())]
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_upserted(spark: SparkSession, table_path: str, version: int) -> DataFrame | None:
    """The table as of a batch; None where nothing has come yet."""
    rows = _rows(spark, table_path, _manifest(spark, table_path, version))
    return None if rows is None else rows.drop("bucket")


def windowed_views(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per kind and window, late rows within the watermark counted."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
