r"""Benchmark decontamination by a broadcast hash set of normalised n-grams (DataFrame functions only).

Words are the runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z went to lower case.  A benchmark item gives one
window per 10 consecutive words, or one window of all its words when it has fewer.  A document is scanned in two
steps, both inside one row and without Python:

* anchor step: a window of ``m`` words always covers a block of ``b = (m + 1) // 2`` words that starts at a multiple
  of ``m - b + 1``, so testing those sparse blocks against the hash set of all benchmark blocks finds every document
  that may hold a window and drops nearly all others;
* verify step: only the documents left build all their windows and look each up in the hash set of whole windows.

Hash sets are literals inside the expression (Catalyst turns them into a set that goes out with the tasks) while the
benchmark stays under ``max_windows``.  Beyond that both steps are joins: the 64-bit hashes of the sparse blocks are
joined to those of the benchmark, and only the documents found by that build their windows and join them.  The rows are
the same.

Defined results: null texts, empty texts and texts without words have 0 words and no hits; a null benchmark text gives
no window; equal rows are returned as often as they came in; extra columns are ignored; empty tables give no rows or
no hits.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, settle

WINDOW = 10
#: Largest benchmark (in windows) that is sent out as literals.
MAX_WINDOWS = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalise(text: Column) -> Column:
    """Words of the text joined by one space each; '' for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.trim(F.regexp_replace(lowered, SEPARATORS, " ")), F.lit(""))


def count_words(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def row_key() -> Column:
    """Identity of a row: its id and text."""
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x01")), F.coalesce("text", F.lit("\x01"))).cast("binary"))


def _windows(words: Column, m: Column | int) -> Column:
    """All runs of ``m`` words, as strings, in order; null where there are fewer words."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.when(F.size(words) >= m, F.transform(F.sequence(F.lit(1), F.size(words) - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, m, window, words), distinct: the windows of each item."""
    norm = benchmark.select("item_id", normalise(F.col("text")).alias("norm")).where("norm <> ''")
    words = norm.select("item_id", F.split("norm", " ").alias("words"))
    words = words.withColumn("m", F.least(F.lit(n), F.size("words")))
    return words.select("item_id", "m", F.explode(_windows(F.col("words"), F.col("m"))).alias("window")).distinct()


def _block(m: int) -> tuple[int, int]:
    size = (m + 1) // 2
    return size, m - size + 1


def _anchors(norm: Column, m: int) -> Column:
    size, stride = _block(m)
    pattern = "((?:[^ ]+ ){%d}[^ ]+)(?: [^ ]+){0,%d}" % (size - 1, stride - size)
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(1))


def _in_set(item: str, values: list[str]) -> str:
    """SQL membership test; normalised words hold no ASCII besides letters, digits and the space, so quoting is safe."""
    return f"{item} IN ({', '.join(chr(39) + v + chr(39) for v in values)})"


def _literal_hits(docs: DataFrame, per_length: dict[int, list[str]]) -> DataFrame:
    candidate = F.lit(False)
    for m, windows in per_length.items():
        size, _ = _block(m)
        blocks = sorted({" ".join(w[i : i + size]) for w in (x.split(" ") for x in windows) for i in range(m - size + 1)})
        candidate = candidate | F.expr(f"exists(anchors_{m}, x -> {_in_set('x', blocks)})")
    docs = docs.select("*", *[_anchors(F.col("norm"), m).alias(f"anchors_{m}") for m in per_length])
    docs = docs.withColumn("words", F.when(candidate, F.split("norm", " ")))
    starts = []
    for m, windows in per_length.items():
        docs = docs.withColumn(f"windows_{m}", _windows(F.col("words"), m))
        found = F.expr(f"filter(transform(windows_{m}, (x, i) -> struct(i AS start, {m} AS m, x AS window)), x -> {_in_set('x.window', windows)})")
        starts.append(F.coalesce(found, F.expr("cast(array() as array<struct<start:int,m:int,window:string>>)")))
    docs = docs.withColumn("hits", F.array_sort(F.concat(*starts)) if len(starts) > 1 else starts[0])
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["m"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["m"] - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return docs.select("row_key", "doc_id", "n_words", covered.alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["window"])).alias("windows"))


def _shuffled_hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same two steps by joins, for a benchmark too large to send out."""

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    blocks, anchors = [], []
    for m in lengths:
        size, _ = _block(m)
        held = windows.where(F.col("m") == m).select(F.explode(_windows(F.split("window", " "), size)).alias("block"))
        blocks.append(held.select(F.xxhash64(F.lit(m), "block").alias("h")))
        anchors.append(docs.select("row_key", F.explode(F.array_distinct(_anchors(F.col("norm"), m))).alias("block")).select("row_key", F.xxhash64(F.lit(m), "block").alias("h")))
    candidates = union(anchors).join(settle(union(blocks).distinct(), "blocks"), "h", "left_semi").select("row_key").distinct()
    words = settle(docs.join(settle(candidates, "candidates"), "row_key", "left_semi").select("row_key", F.split("norm", " ").alias("words")).dropDuplicates(["row_key"]), "words")
    runs = union([words.select("row_key", F.posexplode(_windows(F.col("words"), m)).alias("start", "window")).select("*", F.lit(m).alias("m")) for m in lengths])
    found = settle(runs.join(settle(windows.select("window").distinct(), "windows"), "window", "left_semi"), "found")
    hit = found.select("row_key", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("at")).distinct().groupBy("row_key").agg(F.count("*").alias("n_hit"))
    per_row = found.groupBy("row_key").agg(F.collect_set("window").alias("windows"))
    out = docs.select("row_key", "doc_id", "n_words").join(settle(hit.join(per_row, "row_key"), "hits"), "row_key", "left")
    return out.select("row_key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("windows", F.array().cast("array<string>")).alias("windows"))


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document row: doc_id, row_key, n_words, n_hit, item_ids (sorted array of strings).

    ``row_key`` identifies equal rows (same id and text).
    """
    windows = benchmark_windows(benchmark, n)
    n_windows = windows.agg(F.count("*")).first()[0]
    lengths = sorted(r[0] for r in windows.select("m").distinct().collect())
    docs = documents.select(
        "doc_id",
        row_key().alias("row_key"),
        normalise(F.col("text")).alias("norm"),
    ).withColumn("n_words", count_words(F.col("norm")))
    if not lengths:
        return docs.select("doc_id", "row_key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    small = n_windows <= max_windows
    if small:
        per_length: dict[int, list[str]] = {m: [] for m in lengths}
        for row in windows.select("m", "window").distinct().collect():
            per_length[row["m"]].append(row["window"])
        found = _literal_hits(docs, per_length)
    else:
        found = _shuffled_hits(docs, windows, lengths)
    owners = windows.select("window", F.col("item_id").cast("string").alias("item_id"))
    owners = F.broadcast(owners) if small else owners
    long = found.select("row_key", "doc_id", "n_words", "n_hit", F.posexplode_outer("windows").alias("k", "window"))
    joined = long.join(owners, "window", "left")
    # A row's first window may belong to several items: count a document row once, at its first (window, item).
    grouped = joined.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("n_hit").alias("n_hit"),
        F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, F.lit(1)).otherwise(0)).alias("at_first"),
        F.count_distinct(F.when(F.coalesce("k", F.lit(0)) == 0, F.coalesce("item_id", F.lit("")))).alias("items_first"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    copies = (F.col("at_first") / F.greatest(F.lit(1), F.col("items_first"))).cast("int")
    once = grouped.select("row_key", "doc_id", "n_words", "n_hit", "item_ids", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return once.drop("copy")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Documents without any hit, with their columns as they came; nothing is shuffled while the benchmark is small."""
    windows = benchmark_windows(benchmark, n)
    n_windows = windows.agg(F.count("*")).first()[0]
    if not n_windows:
        return documents
    if n_windows > max_windows:
        dirty = find_hits(documents, benchmark, n, max_windows).where("n_hit > 0").select("row_key").distinct()
        dirty = settle(dirty, "dirty")
        return apart(documents, "doc_id", "text").withColumn("row_key", row_key()).join(dirty, "row_key", "left_anti").drop("row_key").toDF(*documents.columns)
    per_length: dict[int, list[str]] = {}
    for row in windows.select("m", "window").distinct().collect():
        per_length.setdefault(row["m"], []).append(row["window"])
    packed = documents.select(F.struct(*documents.columns).alias("row_key"), "doc_id", normalise(F.col("text")).alias("norm"))
    found = _literal_hits(packed.withColumn("n_words", count_words(F.col("norm"))), per_length)
    # A filter on n_hit would be pushed below the projections, which then work out all windows again for each use of
    # them; as the output of a generator the count is worked out once.
    return found.select("row_key", F.explode_outer(F.array("n_hit")).alias("hits")).where("hits = 0").select("row_key.*")


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """Documents without their hit words, with their columns: documents over ``max_share`` hit go, of others the hit words are cut.

    Only documents that hold a hit are touched.  A cut word takes the separators after it along; all others stay, also
    those before the first word.
    """
    windows = benchmark_windows(benchmark, n)
    lengths = sorted(r[0] for r in windows.select("m").distinct().collect())
    if not lengths:
        return documents
    columns = documents.columns
    documents = apart(documents, "doc_id", "text")
    dirty = find_hits(documents, benchmark, n).where("n_hit > 0").select("row_key", "n_words", "n_hit").distinct()
    dirty = settle(dirty.select("row_key", (F.col("n_hit") <= max_share * F.col("n_words")).alias("light")), "dirty")
    keyed = documents.withColumn("row_key", row_key())
    clean = keyed.join(dirty, "row_key", "left_anti").drop("row_key")
    words = keyed.join(dirty.where("light").select("row_key"), "row_key", "left_semi").select("row_key", F.split(normalise(F.col("text")), " ").alias("words")).dropDuplicates(["row_key"])
    runs = reduce(DataFrame.unionByName, [words.select("row_key", F.posexplode(_windows(F.col("words"), m)).alias("start", "window")).select("*", F.lit(m).alias("m")) for m in lengths])
    spans = runs.join(windows.select("window").distinct(), "window", "left_semi")
    at = spans.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("m") - 1)))).alias("at"))
    # The original words (case and punctuation) are the runs between separators; hit ones are dropped.
    word, separator = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all("text", F.lit(f"({word}++{separator}*+)"), F.lit(0))
    cut = F.array_join(F.filter(F.transform(pieces, lambda x, i: F.when(~F.array_contains("at", i), x)), lambda x: x.isNotNull()), "")
    before = F.regexp_extract("text", f"^{separator}*+", 0)
    touched = keyed.join(settle(at, "at"), "row_key").withColumn("text", F.concat(before, cut))
    return clean.unionByName(touched.select(*documents.columns)).toDF(*columns)


def op9_decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_hits(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (
  SELECT rid, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM d, (SELECT DISTINCT m FROM bw) AS ms, unnest(generate_series(1, greatest(0, len(w) - m + 1))) AS t(i)),
h AS (SELECT dw.rid, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
p AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM h, unnest(generate_series(0, m - 1)) AS t(k) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN it USING (rid)
"""
