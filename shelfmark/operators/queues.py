"""Work queues: what still has to be processed by a model stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MIN_TILE_PX, tiles
from .curation import replace_group

#: Least side of a body that is cropped.
MIN_BODY_PX = 8


def unprocessed(files: DataFrame, done: DataFrame, where: Column | None = None, key: str = "file_id") -> DataFrame:
    """Files without a row in ``done`` (rows of the primary frame when the table has frames)."""
    rows = done.where(F.col("frame_index") == 0) if "frame_index" in done.columns else done
    queue = files if where is None else files.where(where)
    return queue.join(rows.select(F.col(key).alias("id")).distinct(), "id", "left_anti")


def mark_processed(markers: DataFrame, file_ids: DataFrame, stage: str) -> DataFrame:
    """Marker table (file_id, stage) that replaces sentinel rows: also files with no result count as done."""
    return markers.unionByName(file_ids.select("file_id", F.lit(stage).alias("stage"))).distinct()


def clear_primary(table: DataFrame, file_ids: DataFrame, keep: Column | None = None) -> DataFrame:
    """Without the primary-frame rows of the files, except those that ``keep`` protects."""
    doomed = F.col("frame_index") == 0 if keep is None else (F.col("frame_index") == 0) & ~keep
    touched = file_ids.select("file_id").distinct().withColumn("__hit", F.lit(True))
    joined = table.join(touched, "file_id", "left")
    return joined.where(~(doomed & F.coalesce("__hit", F.lit(False)))).drop("__hit")


def run_model(queue: DataFrame, model, schema: str) -> DataFrame:
    """Apply a model (iterator of pandas frames to iterator of pandas frames) to a queue.

    Model proxies for detection, embedding, faces, bodies and ages have this one shape; no weights come with this library.
    """
    return queue.mapInPandas(model, schema)


def stage_queue(files: DataFrame, markers: DataFrame, stage: str, where: Column | None = None) -> DataFrame:
    """Files that a stage has not seen yet, by the marker table."""
    return unprocessed(files, markers.where(F.col("stage") == stage), where)


def take_outcomes(table: DataFrame, markers: DataFrame, outcomes: DataFrame, stage: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, markers, failures) after a stage: rows of its files are replaced, files with no result count as done, failed ones do not.

    ``outcomes`` are the written results of ``run_model``: the table's columns, file_id and error; a row with a null in
    the first column besides file_id says that nothing was found.
    """
    failed = outcomes.where("error IS NOT NULL").select("file_id", "error").distinct()
    done = outcomes.where("error IS NULL")
    first = next(c for c in table.columns if c != "file_id")
    found = done.where(F.col(first).isNotNull()).select(*table.columns)
    return replace_group(table, found, ["file_id"], done.select("file_id")), mark_processed(markers, done, stage), failed


def run_stage(files: DataFrame, table: DataFrame, markers: DataFrame, model, schema: str, stage: str, at: str, where: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole stage: its queue, the model once on each file, its outcomes written to the folder ``at``, and ``take_outcomes`` of them."""
    run_model(stage_queue(files, markers, stage, where), model, schema).write.mode("overwrite").parquet(at)
    return take_outcomes(table, markers, files.sparkSession.read.schema(schema).parquet(at), stage)


def body_crops(boxes: DataFrame, least: int = MIN_BODY_PX) -> DataFrame:
    """The boxes (``box``, of an image ``width`` x ``height``) as whole pixels inside the image; those under ``least`` pixels go."""
    corner = lambda c, side: F.least(F.floor(side).cast("long"), F.floor(c).cast("long"))
    low = lambda c: F.greatest(F.lit(0).cast("long"), F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long"))
    b = F.col("box")
    cut = F.struct(low(b["x1"]).alias("x1"), low(b["y1"]).alias("y1"), corner(b["x2"], F.col("width")).alias("x2"), corner(b["y2"], F.col("height")).alias("y2"))
    out = boxes.withColumn("box", cut)
    return out.where((F.col("box.x2") - F.col("box.x1") >= least) & (F.col("box.y2") - F.col("box.y1") >= least))


def tile_queue(images: DataFrame, min_px: int = MIN_TILE_PX) -> DataFrame:
    """(file_id, tile_index, box) of the tiles of sized images, in order, as a model takes them."""
    boxes = tiles(F.col("width"), F.col("height"), min_px)
    return images.select("file_id", F.posexplode(boxes).alias("tile_index", "box"))


def embedding_stats(embeddings: DataFrame) -> DataFrame:
    """(n_rows, dim, n_bytes): dim of the first usable vector size, bytes at four per value."""
    sizes = embeddings.select(F.size("embedding").alias("dim")).where("dim > 0")
    return sizes.agg(F.count("*").alias("n_rows"), F.max("dim").alias("dim")).select("n_rows", F.coalesce("dim", F.lit(0)).alias("dim"), (F.col("n_rows") * F.coalesce("dim", F.lit(0)) * 4).cast("long").alias("n_bytes"))
