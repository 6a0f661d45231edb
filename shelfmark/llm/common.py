"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word class ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local session that names none, as in tests, gets a temporary folder; on a cluster a missing setting is an error,
    because a folder of one machine is no place for tables that others read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_workspace: ContextVar[list[DataFrame] | None] = ContextVar("workspace", default=None)


@contextmanager
def workspace() -> Iterator[None]:
    """Tables settled inside are removed at its end, when the result that was made of them has been written."""
    held: list[DataFrame] = []
    token = _workspace.set(held)
    try:
        yield
    finally:
        _workspace.reset(token)
        discard(*held)


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as parquet and read it back.

    The written files outlive lost executors, so later stages never recompute what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if (held := _workspace.get()) is not None:
        held.append(out)
    return out


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder of any file system that Spark writes to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of settled tables that no plan reads any more."""
    for df in tables:
        if at := getattr(df, "_settled_at", None):
            remove(df.sparkSession, at)


def apart(documents: DataFrame, *needed: str) -> DataFrame:
    """The documents with all but the needed columns named by their place, so that no helper column can clash.

    ``toDF(*documents.columns)`` gives the names back.
    """
    return documents.toDF(*[c if c in needed else f"c{k}" for k, c in enumerate(documents.columns)])


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_slices(column: pa.Array, max_bytes: int, max_texts: int = 10_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of an Arrow text column of about ``max_bytes`` and ``max_texts``; null becomes ''.

    Only one run at a time becomes Python strings, so a worker's memory follows the run (or one long text), not the batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = min(begin + max_texts, max(begin + 1, int(np.searchsorted(ends, base + max_bytes, "right"))))
        yield begin, [t or "" for t in column.slice(begin, end - begin).to_pylist()]
        begin = end
