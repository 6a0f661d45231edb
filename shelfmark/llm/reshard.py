"""Resharding by minimum-cost flow: new shards of equal row counts, reached by moving the fewest bytes.

The old layout and the new capacities form a transport problem.  Its sources are blocks (old shard x size class), its
sinks the new shards; a row that stays in its shard costs nothing, one that moves costs its bytes (in the flow, the mean
of its block).  Successive shortest paths solve it on the driver over at most ``old shards x size classes`` blocks, a
number that the data do not change.  The flow says how many rows of each block go to which shard.  Of a block that
leaves only in part the smallest rows go: the size at which it divides is found in Spark, and rows below, at and above
it are numbered one after the other.  As size classes do not overlap, the bytes moved are the fewest that the capacities
allow.  The rows of a block are numbered inside buckets of about ``BUCKET`` rows, never in one group, and pieces of those
numbers are dealt out, which also gives the gapless slots.

Law ``rows``: the row counts of the new shards differ by one at most.

Defined results: a null text has 0 bytes (size 1, crc32 of the empty text); a null source belongs to the old shard of the
empty text; equal rows are interchangeable and each gets its own slot; an empty table gives no rows; extra columns are
ignored, and kept by ``place_documents``.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, utf8_size

OLD_SHARDS = 12
NEW_SHARDS = 16
#: Rows of a bucket, about; only the counts of the buckets reach the driver, one row for each.
BUCKET = 250_000
#: Buckets of a block at least, so that a block of many equal rows is dealt out at every size.
LEAST_BUCKETS = 16
#: Files that the rows of a rewritten shard are dealt into.
FILES = 64


def capacities(n_rows: int, shards: int) -> list[int]:
    return [n_rows // shards + (s < n_rows % shards) for s in range(shards)]


def min_cost_flow(supplies: list[int], costs: list[list[float]], demands: list[int]) -> list[list[int]]:
    """Optimal transport plan (sources x sinks) by successive shortest paths with potentials.

    Sources with the same costs per row should come merged; supplies and demands have equal sums.
    """
    n, m = len(supplies), len(demands)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supplies), list(demands)
    pot_src, pot_dst = [0.0] * n, [0.0] * m
    for s in range(n):
        while left[s]:
            # Dijkstra over reduced costs, from source s to any sink with room.
            dist_src, dist_dst = {s: 0.0}, {}
            via_dst: dict[int, int] = {}
            via_src: dict[int, int] = {}
            heap: list[tuple[float, int, int]] = [(0.0, 0, s)]
            done: set[tuple[int, int]] = set()
            target = -1
            while heap:
                d, side, k = heapq.heappop(heap)
                if (side, k) in done:
                    continue
                done.add((side, k))
                if side == 0:
                    for j in range(m):
                        nd = d + costs[k][j] + pot_src[k] - pot_dst[j]
                        if nd < dist_dst.get(j, float("inf")) - 1e-9:
                            dist_dst[j], via_dst[j] = nd, k
                            heapq.heappush(heap, (nd, 1, j))
                else:
                    if room[k]:
                        target = k
                        break
                    for i in range(n):
                        if flow[i][k]:
                            nd = d - costs[i][k] + pot_dst[k] - pot_src[i]
                            if nd < dist_src.get(i, float("inf")) - 1e-9:
                                dist_src[i], via_src[i] = nd, k
                                heapq.heappush(heap, (nd, 0, i))
            reach = dist_dst[target]
            for side, k in done:
                if side == 0:
                    pot_src[k] += dist_src[k] - reach
                elif k != target:
                    pot_dst[k] += dist_dst[k] - reach
            path, j = [], target
            while True:
                i = via_dst[j]
                path.append((i, j))
                if i == s:
                    break
                j = via_src[i]
            amount = min(left[s], room[target], *[flow[i][via_src[i]] for i, _ in path[:-1]] or [left[s]])
            for i, j in path:
                flow[i][j] += amount
                if i != s:
                    flow[i][via_src[i]] -= amount
            left[s] -= amount
            room[target] -= amount
    return flow


def shard_of_source(source: Column, shards: int = OLD_SHARDS) -> Column:
    """Old layout: all rows of a source in one shard."""
    return F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def size_class(size: Column) -> Column:
    """Quarter powers of two."""
    return F.floor(F.log2(size.cast("double")) * 4).cast("int")


def plan(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (old, cls, from, to, shard, slot of the first) of blocks (old, cls, n, bytes); in a block those that move come first."""
    demands = capacities(sum(b[2] for b in blocks), new_shards)
    costs = [[0.0 if old == s else size / n for s in range(new_shards)] for old, _, n, size in blocks]
    flow = min_cost_flow([b[2] for b in blocks], costs, demands)
    slots, pieces = [0] * new_shards, []
    for (old, cls, _, _), row in zip(blocks, flow, strict=True):
        at = 0
        for s in sorted(range(new_shards), key=lambda s: s == old):
            if row[s]:
                pieces.append((old, cls, at, at + row[s], s, slots[s]))
                at, slots[s] = at + row[s], slots[s] + row[s]
    return pieces


def dividing_sizes(keyed: DataFrame, pieces: list[tuple[int, int, int, int, int, int]]) -> dict[tuple[int, int], int]:
    """For each block that leaves its shard only in part: the size up to which its rows, smallest first, leave."""
    leaving: dict[tuple[int, int], int] = {}
    staying = set()
    for old, cls, begin, end, shard, _ in pieces:
        if shard == old:
            staying.add((old, cls))
        else:
            leaving[old, cls] = leaving.get((old, cls), 0) + end - begin
    parted = [(*block, n) for block, n in leaving.items() if block in staying]
    if not parted:
        return {}
    wanted = keyed.sparkSession.createDataFrame(parted, "old int, cls int, leaving long")
    histogram = keyed.join(F.broadcast(wanted), ["old", "cls"]).groupBy("old", "cls", "leaving", "size").agg(F.count("*").alias("n"))
    upto = histogram.withColumn("upto", F.sum("n").over(W.partitionBy("old", "cls").orderBy("size")))
    return {(r["old"], r["cls"]): r["size"] for r in upto.where("upto >= leaving AND upto - n < leaving").collect()}


def reshard(rows: DataFrame, new_shards: int = NEW_SHARDS, bucket: int = BUCKET) -> DataFrame:
    """Adds shard and slot.  ``rows`` has ``old`` (int, old shard), ``size`` (long) and whatever identifies a row."""
    spark = rows.sparkSession
    names = rows.columns
    # The number of a row is fixed by being written; equal rows have different ones.
    keyed = settle(rows.withColumn("__cls", size_class(F.col("size"))).withColumn("__id", F.monotonically_increasing_id()), "reshard").withColumnRenamed("__cls", "cls")
    blocks = sorted(tuple(r) for r in keyed.groupBy("old", "cls").agg(F.count("*"), F.sum("size")).collect())  # at most old shards x classes
    if not blocks:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    pieces = plan(blocks, new_shards)
    sizes = dividing_sizes(keyed, pieces)
    # Of a block: its pieces, the size that divides it, the number of its buckets on each side.
    of: dict[tuple[int, int], list] = {}
    for old, cls, *piece in pieces:
        of.setdefault((old, cls), []).append(tuple(piece))
    known = [(old, cls, sizes.get((old, cls)), max(LEAST_BUCKETS, -(-n // bucket)), of[old, cls]) for old, cls, n, _ in blocks]
    table = spark.createDataFrame(known, "old int, cls int, at long, salts long, pieces array<struct<lo: long, hi: long, shard: int, first: long>>")
    side = F.coalesce(F.when(F.col("size") < F.col("at"), 0).when(F.col("size") > F.col("at"), 2), F.lit(1))
    placed = keyed.join(F.broadcast(table), ["old", "cls"]).withColumn("side", side).withColumn("salt", F.pmod(F.xxhash64("__id"), F.col("salts")))
    key = ["old", "cls", "side", "salt"]
    counted = sorted(tuple(r) for r in placed.groupBy(*key).agg(F.count("*")).collect())  # three for each block and bucket of it at most
    begins, at = [], {}
    for old, cls, part, salt, n in counted:
        begins.append((old, cls, part, salt, at.get((old, cls), 0)))
        at[old, cls] = at.get((old, cls), 0) + n
    begin = spark.createDataFrame(begins, "old int, cls int, side int, salt long, begin long")
    numbered = placed.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("__id")) - 1)
    numbered = numbered.join(F.broadcast(begin), key).withColumn("pos", F.col("begin") + F.col("k"))
    piece = F.element_at(F.filter("pieces", lambda p: (p["lo"] <= F.col("pos")) & (F.col("pos") < p["hi"])), 1)
    numbered = numbered.withColumn("piece", piece)
    return numbered.select(*names, F.col("piece.shard").alias("shard"), (F.col("piece.first") + F.col("pos") - F.col("piece.lo")).alias("slot"))


def place_documents(documents: DataFrame, new_shards: int = NEW_SHARDS) -> DataFrame:
    """document (struct of all columns), old_shard, shard: whole rows, so null and repeated ids need no join back."""
    rows = documents.select(F.struct(*documents.columns).alias("document"), (utf8_size(F.col("text")) + 1).alias("size"), shard_of_source(F.col("source")).alias("old"))
    return reshard(rows, new_shards).select("document", F.col("old").alias("old_shard"), F.col("shard").cast("int").alias("shard"))


def write_shards(placed: DataFrame, path: str, version: int, base: int | None = None) -> None:
    """Version ``version`` of a layout under ``path``: only shards that a row leaves or enters are written.

    ``placed``: document, old_shard, shard; ``old_shard`` is where the row lies in version ``base`` (None: nothing is
    written yet, all shards are).  Files of earlier versions are never touched; a manifest of (shard, version), written
    last, says where each shard lies, and a shard without rows is not in it.
    """
    spark = placed.sparkSession
    sizes = placed.groupBy("old_shard", "shard").count().collect()  # old shards x new shards rows at most
    filled = {r["shard"] for r in sizes}
    kept = {} if base is None else {r["shard"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v{base}").collect()}
    touched = {s for r in sizes if r["old_shard"] != r["shard"] for s in (r["old_shard"], r["shard"])}
    fresh = filled & (touched | (filled - kept.keys()))
    if fresh:
        affected = placed.where(F.col("shard").isin(sorted(fresh))).select("document", "shard")
        affected.repartition("shard", F.pmod(F.xxhash64("document"), F.lit(FILES))).write.partitionBy("shard").parquet(f"{path}/data/v{version}")
    manifest = [(s, version if s in fresh else kept[s]) for s in sorted(filled)]
    spark.createDataFrame(manifest, "shard int, version int").coalesce(1).write.parquet(f"{path}/manifest/v{version}")


def read_shards(spark: SparkSession, path: str, version: int) -> DataFrame:
    """document and shard of all rows of a version that has some."""
    manifest = spark.read.parquet(f"{path}/manifest/v{version}").collect()
    of: dict[int, list[str]] = {}
    for r in manifest:
        of.setdefault(r["version"], []).append(f"{path}/data/v{r['version']}/shard={r['shard']}")
    parts = [spark.read.option("basePath", f"{path}/data/v{v}").parquet(*folders) for v, folders in sorted(of.items())]
    return reduce(DataFrame.unionByName, parts)


def op10_reshard(spark: SparkSession, documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (utf8_size(F.col("text")) + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of_source(F.col("source")).alias("old"),
    )
    out = reshard(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
