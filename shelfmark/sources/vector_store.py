"""A versioned store of references in blocks, laid out so that a search joins them without moving them.

``save`` writes the packed blocks of ``pivots.build``, bucketed by block, and a manifest, last, that makes the version
visible: the version of the source, buckets, pivots and their numbers.  ``load`` declares the written files as a bucketed
table again, so that a join on ``block`` shuffles the vectors that ask and never the stored side.  ``ensure`` loads the
version that the source has now, or builds it anew if the stored one is stale.  A version stays readable until a later one
is complete; a write that fails leaves no manifest.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pivots import Blocks, Pivots, build

MANIFEST = "version long, at string, label string, kind string, id_kind string, buckets int, blocks long, pivots array<struct<direction: array<double>, first: long, parts: long, radius: double, shortest: double, longest: double>>"

#: Where manifests of this layout are; a store of another layout has none here and is built anew.
AT = "manifest-2"


def save(spark: SparkSession, root: str, version: int, blocks: Blocks) -> None:
    """Writes the blocks and then the manifest of this version."""
    p, root = blocks.pivots, root.rstrip("/")
    total = int((p.first + p.parts).max())
    # A bucketed side is read where it lies only if a shuffle would not have more partitions than it has buckets.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 64))
    at, name = f"blocks-{uuid.uuid4().hex}", f"store_{uuid.uuid4().hex}"
    spread = blocks.rows.repartition(buckets, "block")
    spread.write.bucketBy(buckets, "block").option("path", f"{root}/{at}").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    pivots = [(d.tolist(), int(f), int(n), float(r), float(a), float(b)) for d, f, n, r, a, b in zip(p.directions, p.first, p.parts, p.radius, p.shortest, p.longest, strict=True)]
    id_kind = dict(blocks.rows.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    row = (version, at, blocks.label, blocks.kind, id_kind, buckets, total, pivots)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/{AT}")


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{AT}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/{AT}")


def version(spark: SparkSession, root: str) -> int | None:
    """The latest complete version; None if there is none."""
    found = _manifests(spark, root)
    return None if found is None else found.agg(F.max("version")).first()[0]


def load(spark: SparkSession, root: str, version: int | None = None) -> Blocks:
    """The blocks of a version (the latest one), as a table bucketed by block."""
    found = _manifests(spark, root)
    rows = None if found is None else found.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version"), "at").first()
    if rows is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} of vectors at {root}")
    name = f"store_{uuid.uuid4().hex}"
    columns = f"block BIGINT, n BIGINT, pivots ARRAY<BIGINT>, ends ARRAY<BIGINT>, ids ARRAY<{rows['id_kind']}>, labels ARRAY<{rows['kind']}>, matrix BINARY"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (block) INTO {rows['buckets']} BUCKETS LOCATION '{root.rstrip('/')}/{rows['at']}'")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan has the files and their buckets
    columns = {c: np.array([p[c] for p in rows["pivots"]], np.float64) for c in ("radius", "shortest", "longest")}
    directions = np.array([p["direction"] for p in rows["pivots"]], np.float64)
    first, parts = (np.array([p[c] for p in rows["pivots"]], np.int64) for c in ("first", "parts"))
    return Blocks(stored, Pivots(directions, first, parts, **columns), rows["label"], rows["kind"])


def ensure(spark: SparkSession, root: str, current: int, references: DataFrame, label: str) -> Blocks | None:
    """The blocks of the source's version, built and saved if the stored version is another; None without references."""
    if version(spark, root) != current:
        blocks = build(references, label)
        if blocks is None:
            return None
        save(spark, root, current, blocks)
    return load(spark, root, current)
