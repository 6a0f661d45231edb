r"""Substring dedup: passages whose words stand earlier in the corpus are cut, found by fixed-block anchors.

A window of ``window`` words is removed where the same words start earlier: in a document of smaller id, or further up in
the same document.  Every window holds, whole, one of its document's non-overlapping blocks of ``(window + 1) // 2`` words.
Those blocks are the anchors:

1. the blocks are indexed, and every rolling window of a block's length probes the index.  A slice of documents sends its
   distinct hashes packed, four bytes each, to the bucket of their hash; the bucket tells each slice which of its blocks
   also stand elsewhere;
2. the windows around such blocks are extended to the full length and compared by 128 bits of hash: a slice sends each
   distinct one with its first place, the bucket answers which stand earlier in another slice;
3. windows that stand earlier, in another slice or in the own one, cover the words that go.  Overlapping windows make up
   the maximal exact repeats, which are returned as spans.

A slice sends a window once, however often it stands in it, so a passage that a third of all rows hold costs a bucket one
entry for each slice.  The texts are written once, as slices bucketed by their number, and both joins with the answers read
them where they lie: nothing but hashes is shuffled.  Slices and buckets grow with the root of the corpus, so that a
packed row keeps some entries at any size; both are memory of a task (8 and 16 MB of text up to a terabyte, some 70 and
140 MB at 100 TB).

A false agreement in step 1 (one block in twenty thousand) only means a window more to compare; in step 2 it needs two
windows of the corpus that agree in 128 bits.

Defined results: null and empty texts have no words and come back with empty text; ids are whole numbers, null ids come
after all others; rows that share an id are one document for the order, so equal rows do not remove each other;
repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, utf8_size
from .token_counts import span_hashes

WINDOW = 20
#: Bytes of text of a slice and of the texts whose windows meet in a bucket, and of the files that one task reads.
SLICE_BYTES, BUCKET_BYTES, HOME_BYTES = 8 << 20, 16 << 20, 24 << 20
#: Entries that a slice sends to a bucket at least, on average.
PACKED = 16
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
NULL_ID = np.iinfo(np.int64).max

_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts: places in their bytes, the text of each and its place in that text, and a hash."""

    def __init__(self, texts: pa.Array):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
        self.n_texts = len(raw)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        blank = _is_space[self.data]
        self.begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        self.ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.text = np.searchsorted(np.cumsum(sizes), self.begins, "right")
        self.counts = np.bincount(self.text, minlength=len(raw))
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.hash = span_hashes(self.data, self.begins, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words that lie in one text."""
        n = max(0, len(self.text) - size + 1)
        return np.flatnonzero(self.text[:n] == self.text[size - 1 :][:n])

    def rolling(self, size: int, second: bool = False) -> np.ndarray:
        """Hash of every run of ``size`` words: a polynomial over odd powers, put together from runs of doubled length."""
        base = int(BASES[second])
        run, length = (_mix(self.hash ^ BASES[1]) if second else self.hash), 1
        out, done = None, 0
        while True:
            if size & length:
                if out is None:
                    out = run
                else:
                    n = max(0, min(len(out), len(run) - done))
                    out = out[:n] + run[done : done + n] * np.uint64(pow(base, done, 1 << 64))
                done += length
            if done == size:
                return _mix(out)
            n = max(0, len(run) - length)
            run = run[:n] + run[length:] * np.uint64(pow(base, length, 1 << 64))
            length *= 2


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between two cuts as a row each."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(rows, kind) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of packed rows."""
    parts = [np.frombuffer(x, kind) for x in rows]
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int64), np.concatenate([np.zeros(0, kind), *parts])


def layout(documents: DataFrame) -> tuple[int, int, int]:
    """(bytes of a slice, hash buckets, buckets of the written slices) for the size of the texts."""
    total = documents.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    # A word and its blank are some six bytes; a slice has so many windows for each bucket.
    growth = max(1.0, math.sqrt(6 * PACKED * total / (SLICE_BYTES * BUCKET_BYTES)))
    # Buckets of the written table are used as they lie only where a shuffle would not have more partitions.
    homes = max(math.ceil(total / (HOME_BYTES * growth)), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slice_bytes = int(min(SLICE_BYTES * growth, max(total // (4 * homes), 1 << 18)))
    return slice_bytes, max(1, math.ceil(total / (BUCKET_BYTES * growth))), homes


def written_slices(documents: DataFrame, slice_bytes: int, homes: int) -> DataFrame:
    """(slice, ids, texts): the documents in slices, written to the shared folder, bucketed by the number of the slice."""
    spark = documents.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def out() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            ends = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, texts)], ["slice", "ids", "texts"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
            begin = 0
            while begin < batch.num_rows:
                base = ends[begin - 1] if begin else 0
                end = min(batch.num_rows, max(begin + 1, int(np.searchsorted(ends, base + slice_bytes - size, "right"))))
                held.append(batch.slice(begin, end - begin))
                size += int(ends[end - 1] - base)
                begin = end
                if size >= slice_bytes or begin < batch.num_rows:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    cut = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "slice long, ids array<long>, texts array<string>")
    name = f"slices_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    cut.write.bucketBy(homes, "slice").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the plan has its buckets
    out._settled_at = path
    return out


def offered_blocks(slices: DataFrame, block: int, buckets: int) -> DataFrame:
    """(bucket, slice, blocks, rolls): of each slice the distinct hashes of its blocks and of its other rolling windows.

    A hash that stands more than once in the slice is there twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Words(texts.values)
                at = words.windows(block)
                h, own = words.rolling(block)[at], words.place[at] % block == 0
                order = np.argsort(h)
                h, own = h[order], own[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                often = np.minimum(np.diff(first, append=len(h)), 2)
                anchored = np.add.reduceat(own, first, dtype=np.int64) > 0 if len(h) else np.zeros(0, bool)
                lists = []
                for use in (anchored, ~anchored):
                    some = np.repeat(h[first][use], often[use])
                    cuts = np.searchsorted(bucket_of(some, buckets), np.arange(buckets + 1))
                    lists.append(packed((some & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(np.full(buckets, number)), *lists], ["bucket", "slice", "blocks", "rolls"])

    return slices.select("slice", "texts").mapInArrow(run, "bucket long, slice long, blocks binary, rolls binary")


def repeated_blocks(offers: DataFrame) -> DataFrame:
    """(slice, bucket, keys): the blocks of a slice whose hash a rolling window at another place has."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        (row, key), (_, other) = unpacked(pdf["blocks"], np.uint32), unpacked(pdf["rolls"], np.uint32)
        every, counts = np.unique(np.concatenate([key, other]), return_counts=True)
        hit = counts[np.searchsorted(every, key)] > 1
        row, key = row[hit], key[hit]
        at = np.flatnonzero(np.diff(row, prepend=-1))
        keys = [part.tobytes() for part in np.split(key, at[1:])] if len(row) else []
        return pd.DataFrame({"slice": pdf["slice"].to_numpy()[row[at]], "bucket": pdf["bucket"].to_numpy()[row[at]], "keys": keys})

    return offers.groupBy("bucket").applyInPandas(answer, "slice long, bucket long, keys binary")


def with_answers(slices: DataFrame, answers: DataFrame, *columns: str) -> DataFrame:
    """The slices, each with its answers; the slices are read where they lie."""
    gathered = answers.groupBy("slice").agg(F.collect_list(F.struct(*columns)).alias("answers"))
    # A slice's answers are never more than its own windows.
    return slices.hint("merge").join(gathered, "slice", "left")


def offered_windows(asked: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """(bucket, slice, a, b, ids, places): of each slice the distinct windows around repeated blocks, each with its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, texts, answers in zip(batch.column("slice").to_pylist(), batch.column("ids"), batch.column("texts"), batch.column("answers").to_pylist(), strict=True):
                if not answers:
                    continue
                words = Words(texts.values)
                known = np.sort(np.concatenate([np.frombuffer(x["keys"], np.uint32).astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in answers]))
                h = words.rolling(block)
                at = np.flatnonzero((words.place[: len(h)] % block == 0) & (words.text[: len(h)] == words.text[block - 1 :]))
                code = (h[at] & np.uint64(0xFFFFFFFF)) | (bucket_of(h[at], buckets) << np.uint64(32))
                hit = np.zeros(len(words.text) + block, bool)
                hit[at] = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
                # The first block inside a window.
                begin = words.windows(window)
                begin = begin[hit[begin + (-words.place[begin]) % block]]
                a, b = words.rolling(window)[begin], words.rolling(window, True)[begin]
                doc = ids.values.fill_null(NULL_ID).to_numpy()[words.text[begin]]
                order, same = grouped(a, b, doc, words.place[begin])
                order = order[~same]
                a, b, doc, place = a[order], b[order], doc[order], words.place[begin][order]
                cuts = np.searchsorted(bucket_of(a, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cuts))
                if len(some):
                    cuts = np.append(cuts[some], len(a))
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), number)), *(packed(x, cuts) for x in (a, b, doc, place))], ["bucket", "slice", "a", "b", "ids", "places"])

    return asked.mapInArrow(run, "bucket long, slice long, a binary, b binary, ids binary, places binary")


def grouped(a: np.ndarray, b: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, document and place, and which of that order has the same window as the one before it."""
    order = np.lexsort((place, doc, b, a))
    same = np.zeros(len(order), bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    return order, same


def later_windows(offers: DataFrame) -> DataFrame:
    """(slice, a, b): the windows of a slice that stand earlier in another one."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        (row, a), (_, b), (_, doc), (_, place) = (unpacked(pdf[c], k) for c, k in (("a", np.uint64), ("b", np.uint64), ("ids", np.int64), ("places", np.int64)))
        order, same = grouped(a, b, doc, place)
        first = order[np.flatnonzero(~same)][np.cumsum(~same) - 1]  # earliest place of the same window
        late = order[(doc[order] != doc[first]) | (place[order] != place[first])]
        late = late[np.argsort(row[late], kind="stable")]
        row = row[late]
        at = np.flatnonzero(np.diff(row, prepend=-1))
        columns = {c: [part.tobytes() for part in np.split(x[late], at[1:])] if len(row) else [] for c, x in (("a", a), ("b", b))}
        return pd.DataFrame({"slice": pdf["slice"].to_numpy()[row[at]]} | columns)

    return offers.groupBy("bucket").applyInPandas(answer, "slice long, a binary, b binary")


def late_places(words: Words, doc: np.ndarray, window: int, answers: list[dict] | None) -> np.ndarray:
    """First words of the windows that stand earlier, in another slice (as answered) or in this one."""
    begin = words.windows(window)
    a = words.rolling(window)[begin]
    # Windows that the answers or another place of the slice may hold, by half of the hash.
    order = np.argsort(a)
    twin = np.zeros(len(a), bool)
    equal = a[order][1:] == a[order][:-1]
    twin[order[1:][equal]] = twin[order[:-1][equal]] = True
    told = [np.concatenate([np.frombuffer(x[c], np.uint64) for x in answers]) if answers else np.zeros(0, np.uint64) for c in ("a", "b")]
    if len(told[0]):
        known = np.sort(told[0])
        twin |= known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a
    begin, a = begin[twin], a[twin]
    b = words.rolling(window, True)[begin]
    # The answered windows take part as places before all others.
    n = len(told[0])
    every = [np.concatenate([told[0], a]), np.concatenate([told[1], b])]
    at_doc = np.concatenate([np.zeros(n, np.int64), doc[words.text[begin]]])
    at_place = np.concatenate([np.zeros(n, np.int64), words.place[begin]])
    order = np.lexsort((at_place, at_doc, np.arange(len(at_doc)) >= n, *every[::-1]))
    same = np.zeros(len(order), bool)
    same[1:] = (every[0][order][1:] == every[0][order][:-1]) & (every[1][order][1:] == every[1][order][:-1])
    first = order[np.flatnonzero(~same)][np.cumsum(~same) - 1] if len(order) else order
    late = (order >= n) & ((first < n) | (at_doc[order] != at_doc[first]) | (at_place[order] != at_place[first]))
    return begin[order[late] - n]


def kept_texts(words: Words, gone: np.ndarray) -> list[str]:
    """The words of each text that are left, joined by one blank."""
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[words.begins[~gone]] += 1
    mark[words.ends[~gone] + 1] -= 1  # with the byte behind the word
    data = np.where(_is_space[words.data], np.uint8(0x20), words.data)[np.cumsum(mark[:-1]) > 0].tobytes()
    sizes = np.bincount(words.text[~gone], (words.ends - words.begins + 1)[~gone], words.n_texts).astype(np.int64)
    ends = np.cumsum(sizes)
    return [data[e - s : max(e - s, e - 1)].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def cut_repeats(told: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept of each row of the slices."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, answers in zip(batch.column("ids"), batch.column("texts"), batch.column("answers").to_pylist(), strict=True):
                words = Words(texts.values)
                late = late_places(words, ids.values.fill_null(NULL_ID).to_numpy(), window, answers)
                cover = np.zeros(len(words.text) + 1, np.int64)
                np.add.at(cover, late, 1)
                np.add.at(cover, late + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.concatenate(([True], words.text[1:] != words.text[:-1])) if len(gone) else gone
                starts = np.flatnonzero(gone & (edge | ~np.concatenate(([False], gone[:-1]))))
                stops = np.flatnonzero(gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False)))
                spans = pa.StructArray.from_arrays([pa.array(words.place[starts]), pa.array(words.place[stops] + 1)], fields=list(span))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(words.text[starts], minlength=words.n_texts))])
                removed = np.bincount(words.text[gone], minlength=words.n_texts)
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(words.counts), pa.array(removed), listed, pa.array(kept_texts(words, gone), pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return told.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, kept string")


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal runs of removed words, end exclusive) and the kept words of each row."""
    block = (window + 1) // 2
    slice_bytes, buckets, homes = layout(documents)
    slices = written_slices(documents, slice_bytes, homes)
    asked = with_answers(slices, repeated_blocks(offered_blocks(slices, block, buckets)), "bucket", "keys")
    told = with_answers(slices, later_windows(offered_windows(asked, window, block, buckets)), "a", "b")
    return cut_repeats(told, window)


def op12_substring_dedup(spark: SparkSession, documents: DataFrame) -> DataFrame:
    found = remove_repeats(documents)
    kind = dict(documents.dtypes)["doc_id"]
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, doc_id, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
windows AS (SELECT s.r, s.doc_id, s.p, array_to_string(d.w[s.p:s.p + 19], ' ') AS x FROM starts s JOIN d USING (r)),
firsts AS (SELECT x, min((coalesce(doc_id, 9223372036854775807), p)) AS f FROM windows GROUP BY x HAVING count(*) > 1),
late AS (SELECT w.r, w.p FROM windows w JOIN firsts USING (x) WHERE (coalesce(w.doc_id, 9223372036854775807), w.p) > f),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS p FROM late),
gaps AS (SELECT r, list(p) AS g FROM gone GROUP BY r),
kept AS (SELECT d.r, d.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN w ELSE (SELECT coalesce(list(y ORDER BY q), []) FROM (SELECT unnest(d.w) AS y, generate_subscripts(d.w, 1) AS q) z WHERE NOT list_contains(g, q)) END AS k
  FROM d LEFT JOIN gaps USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
