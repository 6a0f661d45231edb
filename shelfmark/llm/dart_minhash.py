"""Near-duplicate groups by DartMinHash signatures and a banded join.

A document is a weighted set of word shingles (five lower-cased words; a shorter document is one shingle).  Weighted
MinHash asks, for each of ``k`` coordinates, for the element hit first by random darts.  Instead of drawing ``k`` hashes
per element, darts are thrown at the elements: the darts of a weight region of an element ([0,1), [1,2), [2,4), ...) form
a Poisson process whose times, positions and coordinates are hashes of (element, region, number of the dart), so all
documents see the same darts.  A document needs only the darts up to about ``ln k / weight``: their number depends on
``k``, not on its length.  The earliest dart of each coordinate is the signature.

Bands of the signature are joined.  No bucket is expanded to pairs: in each round every open bucket elects a few of its
members (the least of each hash cell), all members in other groups are held against them, and the elected leave the
bucket.  A large bucket is dealt out in parts of about ``PART`` members, each with a copy of the elected, so no task has
to hold a whole bucket.  Rounds go on, with more elected each time, until every bucket lies in one group or is used up; so every pair of
a bucket that could still join two groups is judged.  Groups are connected components, found by alternating large-star
and small-star steps on tables in the shared folder.

A pair is judged first by its parity maps: each shingle of a text flips one of 512 bits, so two maps differ in at most as
many bits as the sets differ in elements, and a pair whose maps differ in more than the similarity allows is out for
certain.  A set of more than 512 elements has a second map, whose bits are the next power of two, so the bound stays as
tight for long texts: below a similarity of some 0.74 to 0.78 it rules a pair out, whatever the length.  Maps of two sizes
are compared by folding the longer one.  All of this is a condition of the join; only the pairs that the bound leaves
become rows, each of them once over all rounds, and are compared exactly.

Weights: ``set`` (each distinct shingle weighs 1; similarity is the Jaccard of the shingle sets, the default, because
near-duplicates are defined by the sets) or ``count`` (weighted Jaccard of shingle counts, where the darts meet several
weight regions of an element).

Defined results: equal texts always share a group; a text without words only joins its equals; a null text is a group
of its own row; the group's id is its least doc_id, its class id the text identity of its least row (null for a null
text), which no two groups share; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, discard, settle, text_slices
from .token_counts import span_hashes

SHINGLE = 5
BANDS, ROWS = 32, 6
SIMILARITY = 0.8
SLICE_BYTES, SLICE_TEXTS = 500_000, 2_000
#: Rows of two narrow columns that may be broadcast; beyond it tables are joined by a shuffle.
BROADCAST_ROWS = 200_000
ELECTED_FIRST, ELECTED_GROWTH = 1, 32
SMALL_BUCKET = 8
#: Members of a bucket that one task holds against the elected; a larger bucket is dealt out in parts.
PART = 1024
#: Darts of an element that are thrown at once, at most; few texts of few words need hundreds each.
DART_BLOCK = 32
#: Words of 64 bits in the parity map that every text has; larger sets have a longer one besides.
MAP_WORDS = 8
MAP = [f"m{k}" for k in range(MAP_WORDS)]

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each distinct shingle of each text, sorted."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _lower[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    blank = _is_space[data]
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    text = np.searchsorted(np.cumsum(sizes), begins, "right")
    word = span_hashes(data, begins, ends)
    n = len(word)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    owner = np.concatenate([text, np.full(size, -1)])
    first = np.concatenate(([True], text[1:] != text[:-1]))
    full = owner[size - 1 : size - 1 + n] == text
    h = np.zeros(n, np.uint64)
    for j in range(size):
        same = owner[j : j + n] == text
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ np.where(same, padded[j : j + n], np.uint64(1))
        h ^= h >> np.uint64(29)
    use = full | first  # a text with fewer words has one shingle, at its first word
    text, h = text[use], _mix(h[use])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])))
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(at, append=len(h))


def dart_signatures(n_texts: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Signatures (n_texts x k) of weighted sets; all ones where a set is empty."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full(n_texts * k, empty)
    total = np.bincount(text, weight, n_texts)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n_texts)
    limit[todo] = (np.log(k) + 3) / total[todo]
    # One entry per (element, weight region) that lies at least partly below the element's weight.
    low, width = np.zeros(len(text)), np.ones(len(text))
    regions = [(np.arange(len(text)), low, width, 0)]
    top, region = 1.0, 1
    while (over := np.flatnonzero(weight > top)).size:
        regions.append((over, np.full(len(over), top), np.full(len(over), top), region))
        top, region = top * 2, region + 1
    at = np.concatenate([r[0] for r in regions])
    low, width = np.concatenate([r[1] for r in regions]), np.concatenate([r[2] for r in regions])
    which = np.concatenate([np.full(len(r[0]), r[3], np.uint64) for r in regions])
    seed = _mix(element[at] + which * np.uint64(0xD1342543DE82EF95))
    owner, weight_of = text[at], weight[at].astype(float)
    while len(todo):
        chosen = np.zeros(n_texts, bool)
        chosen[todo] = True
        live = np.flatnonzero(chosen[owner])
        time = np.zeros(len(live))
        dart = 0
        while len(live):
            block = min(max(1, dart // 2), DART_BLOCK)
            numbers = np.arange(dart + 1, dart + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = _mix(seed[live][:, None] ^ numbers)
            uniform = ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
            wait = -np.log(uniform) / (k * width[live])[:, None]
            wait[:, 0] += time
            times = np.cumsum(wait, axis=1)
            early = times < limit[owner[live]][:, None]
            thrown, h, at_time = live[np.nonzero(early)[0]], h[early], times[early]
            live, time = live[early[:, -1]], times[early[:, -1], -1]
            dart += block
            g = _mix(h ^ np.uint64(0xA0761D6478BD642F))
            position = low[thrown] + width[thrown] * ((g >> np.uint64(40)).astype(float) / float(1 << 24))
            hit = position < weight_of[thrown]
            coordinate = (g & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            stamp = (at_time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            np.minimum.at(signature, owner[thrown][hit] * k + coordinate[hit], stamp[hit])
        holes = (signature.reshape(n_texts, k)[todo] == empty).any(axis=1)
        todo = todo[holes]
        limit[todo] *= 2
    return signature.reshape(n_texts, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hash of each band, its number included."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for r in range(rows):
        h = _mix(h ^ parts[:, :, r]) + np.uint64(r)
    return h.view(np.int64)


def weights_of(count: np.ndarray, weighting: str) -> np.ndarray:
    return np.ones(len(count)) if weighting == "set" else count.astype(float)


def text_key(text: str = "text"):
    """Identity of a text: 128 bits of its MD5; null for null."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def occurrences(text: np.ndarray, element: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, element) once for each time it counts; the k-th occurrence is an element of its own."""
    if not (count > 1).any():
        return text, element
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(text, count), np.repeat(element, count) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def parity_maps(bits: np.ndarray, text: np.ndarray, element: np.ndarray) -> np.ndarray:
    """The maps of all texts, one after the other, as words of 64 bits: every element has flipped a bit of its text's map.

    ``bits``: length of each map, 0 or a power of two from 64.  The map of half the length is the exclusive or of both halves.
    """
    use = bits[text] > 0
    text, element = text[use], element[use]
    begin = np.cumsum(bits) - bits
    place = begin[text] + (_mix(element) & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def long_map_bits(size: np.ndarray) -> np.ndarray:
    """Length of the longer map of sets of these sizes: the next power of two, 0 where the short map is as good."""
    return np.where(size > 64 * MAP_WORDS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 0)


def _folded(words: Column, other: Column) -> Column:
    """The map at half its length where ``other`` is shorter."""
    half = (F.size(words) / 2).cast("int")
    halves = F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(words) > F.size(other), halves).otherwise(words)


def may_be_similar(similarity: float, a: str = "a", b: str = "b") -> Column:
    """False only where the sizes and parity maps of two sets rule the similarity out (a similarity of 0.5 or more)."""
    n_a, n_b, long_a, long_b = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.long_map"), F.col(f"{b}.long_map")
    differ = sum((F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in MAP[1:]), F.bit_count(F.col(f"{a}.{MAP[0]}").bitwiseXOR(F.col(f"{b}.{MAP[0]}"))))
    # Sizes that pass the first test differ by less than two, so their maps by one fold at most.
    apart_by = F.zip_with(_folded(long_a, long_b), _folded(long_b, long_a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ_long = F.aggregate(apart_by, F.lit(0), lambda total, n: total + n)

    def allowed(n: Column) -> Column:
        return n * (1 + similarity) <= (n_a + n_b) * (1 - similarity) + 1e-6

    short = (F.size(long_a) == 0) | (F.size(long_b) == 0)
    return allowed(F.greatest(F.abs(n_a - n_b), differ)) & (short | allowed(differ_long))


def signatures(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weighting: str = "set") -> DataFrame:
    """doc_id, key, bands (array of long; empty for texts without words and for nulls), size of the set, its parity maps."""
    narrow = documents.select("doc_id", text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in text_slices(batch.column("text"), SLICE_BYTES, SLICE_TEXTS):
                b = a + len(part)
                text, element, count = shingles(part, size)
                weight = weights_of(count, weighting)
                keys = band_keys(dart_signatures(len(part), text, element, weight, bands * rows), bands, rows)
                each = occurrences(text, element, weight.astype(np.int64))
                maps = parity_maps(np.full(len(part), 64 * MAP_WORDS), *each).reshape(len(part), MAP_WORDS)
                some = np.bincount(text, minlength=len(part)) > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].ravel(), pa.int64()))
                total = np.bincount(text, weight, len(part)).astype(np.int64)
                bits = long_map_bits(total)
                ends = np.concatenate([[0], np.cumsum(bits // 64)])
                long_maps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(parity_maps(bits, *each)))
                own = [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*own, listed, pa.array(total), *map(pa.array, maps.T), long_maps], ["doc_id", "key", "bands", "size", *MAP, "long_map"])

    kind = dict(documents.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, key binary, bands array<long>, size long, " + ", ".join(f"{m} long" for m in MAP) + ", long_map array<long>")


def pair_similarities(a: list[str], b: list[str], size: int = SHINGLE, weighting: str = "set") -> np.ndarray:
    """Exact (weighted) Jaccard of each pair of texts; 0 where either has no words."""
    (ta, ha, ca), (tb, hb, cb) = shingles(a, size), shingles(b, size)
    wa, wb = weights_of(ca, weighting), weights_of(cb, weighting)
    text, h = np.concatenate([ta, tb]), np.concatenate([ha, hb])
    w = np.concatenate([wa, wb])
    order = np.lexsort((h, text))
    text, h, w = text[order], h[order], w[order]
    twin = np.flatnonzero((text[1:] == text[:-1]) & (h[1:] == h[:-1]))
    common = np.bincount(text[twin], np.minimum(w[twin], w[twin + 1]), len(a))
    union = np.bincount(text, w, len(a)) - common
    return np.divide(common, union, out=np.zeros(len(a)), where=union > 0)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint, for a table counted to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_texts(texts: DataFrame | None, wanted: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, text), settled: ``texts`` and the texts of those ``wanted`` nodes that are not in it.

    The first call reads the documents for nearly all texts that are ever compared; later ones look for the few that are missing.
    """
    missing = settle(wanted if texts is None else wanted.join(texts.select("node"), "node", "left_anti"), "missing")
    n_missing = missing.count()
    if texts is not None and not n_missing:
        return texts
    needed = nodes.join(_small(missing, n_missing), "node")
    needed = F.broadcast(needed) if n_missing <= BROADCAST_ROWS else settle(needed, "needed")
    more = settle(documents.select(text_key().alias("key"), "text").join(needed, "key").groupBy("node").agg(F.first("text").alias("text")), "texts")
    discard(missing)
    return more if texts is None else texts.unionByName(more)


def similar_pairs(pairs: DataFrame, texts: DataFrame, size: int, weighting: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough, by exact comparison, settled.  ``texts``: node, text."""
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, a in text_slices(batch.column("text_a"), SLICE_BYTES):
                part = batch.slice(begin, len(a))
                ok = pair_similarities(a, part.column("text_b").to_pylist(), size, weighting) >= similarity
                part = part.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"])

    return settle(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable; only nodes with an edge.

    The least neighbours of all nodes are broadcast while the edges are few, else settled before they are joined, so that
    the edges of a node with very many do not meet in one task.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = signature(edges)
    while True:
        held: list[DataFrame] = [edges]

        def kept(df: DataFrame, many: bool = 2 * before[0] > BROADCAST_ROWS, held: list[DataFrame] = held) -> DataFrame:
            if many:
                held.append(settle(df, "star"))
            return held[-1] if many else F.broadcast(df)

        # Large star: each node's greater neighbours are tied to the least node around it.
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: the lesser neighbours and the node itself are tied to the least of them.
        lower = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.union(lower.select("u", "m")).where("u <> v").distinct(), "edges")
        discard(*held)
        after = signature(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = after


def merge_components(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component), settled, after new links (a, b): only the components that the links tie together are worked on."""
    if components is None:
        return settle(connected_components(links), "components")
    of = {c: components.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("a", "b")}
    ends = links.join(of["a"], "a", "left").join(of["b"], "b", "left")
    merged = connected_components(ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    onto = merged.select(F.col("node").alias("component"), F.col("component").alias("onto"))
    moved = components.join(onto, "component", "left").select("node", F.coalesce("onto", "component").alias("component"))
    out = settle(moved.unionByName(merged.join(components, "node", "left_anti")), "components")
    discard(components)
    return out


def near_duplicate_groups(
    documents: DataFrame,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SHINGLE,
    weighting: str = "set",
    similarity: float = SIMILARITY,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, node, component) of each row, the links (a, b) between nodes that made the groups, and (key, node)."""
    signed = settle(signatures(documents, bands, rows, size, weighting), "signatures")
    # Equal texts share a node; the number is fixed by being written.
    described = signed.where("key IS NOT NULL").groupBy("key").agg(*[F.first(c).alias(c) for c in ("bands", "size", *MAP, "long_map")])
    described = settle(described.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = described.select("key", "node")
    numbered = settle(signed.select("doc_id", "key").join(nodes, "key", "left"), "numbered")
    discard(signed)
    spread = described.select("node", F.explode("bands").alias("key"))
    shared = settle(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    members = settle(spread.join(_small(shared, shared.count()), "key").join(described.select("node", "size", *MAP, "long_map"), "node"), "members")
    discard(shared)
    links = components = texts = judged = None
    n_components = n_judged = 0
    judged_tables: list[DataFrame] = []
    elected_cells = ELECTED_FIRST
    while True:
        if components is None:
            grouped = members.withColumn("c", F.col("node"))
        else:
            grouped = members.join(_small(components, n_components), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        # Buckets that lie in several groups.  They are settled, so that a large bucket is dealt out by the skew join.
        open_buckets = settle(grouped.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"), "open")
        if not (n_open := open_buckets.count()):
            break
        before, placed = members, settle(grouped.join(_small(open_buckets, n_open), "key"), "placed")
        n_placed = placed.count()
        # A small bucket elects nearly all its members at once, a large one a few in each round.
        cells = F.when(F.col("n") <= SMALL_BUCKET, F.lit(SMALL_BUCKET**2)).otherwise(F.lit(elected_cells))
        elected = settle(placed.groupBy("key", F.pmod(F.xxhash64("node"), cells).alias("cell")).agg(F.min("node").alias("node")).drop("cell"), "elected")
        chosen = _small(elected, n_placed)
        parts = F.ceil(F.col("n") / PART).cast("int")
        copies = placed.join(chosen, ["key", "node"], "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = placed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int"))
        met = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.c") != F.col("b.c")) & may_be_similar(similarity)
        against = copies.alias("a").join(dealt.alias("b"), met).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
        against = against.distinct()
        # A pair that was judged in an earlier round comes back in other bands.
        pairs = settle(against if judged is None else against.join(_small(judged, n_judged), ["a", "b"], "left_anti"), "pairs")
        if n_pairs := pairs.count():
            judged, n_judged = pairs if judged is None else judged.unionByName(pairs), n_judged + n_pairs
            judged_tables.append(pairs)
            texts = with_texts(texts, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, documents)
            found = similar_pairs(pairs, texts, size, weighting, similarity)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                components = merge_components(components, found)
                n_components = components.count()
        # Elected members have been held against all others of their bucket.
        members = settle(placed.join(chosen, ["key", "node"], "left_anti").drop("n", "c"), "members")
        discard(before, open_buckets, placed, elected)
        elected_cells *= ELECTED_GROWTH
    discard(*judged_tables)
    if links is None:
        return numbered.withColumn("component", F.col("node")), documents.sparkSession.createDataFrame([], "a long, b long"), nodes
    return numbered.join(components, "node", "left").select("doc_id", "key", "node", F.coalesce("component", "node").alias("component")), links, nodes


def order_in_group() -> Column:
    """Order of the rows of a component: by id, null ids last, then by text identity."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")


def group_ids(grouped: DataFrame) -> DataFrame:
    """doc_id, key, component, group_id (least doc_id of the component), class_id, n_group (rows in it), kept (the least row).

    An id that stands on several texts may be the least of several components: those differ in ``class_id``, the MD5 (hex)
    of the text of the component's least row.
    """
    heads = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min(order_in_group()).alias("head"), F.count("*").alias("n_group"))
    # Settled, so that the rows of a large component are dealt out by the skew join; a row by itself needs no head.
    out = grouped.join(settle(heads.where("n_group > 1"), "heads"), "component", "left")
    return out.select(
        "doc_id",
        "key",
        "component",
        F.when(F.col("n_group").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        F.lower(F.hex(F.coalesce("head.key", "key"))).alias("class_id"),
        F.coalesce("n_group", F.lit(1)).cast("long").alias("n_group"),
        (F.col("n_group").isNull() | (order_in_group() == F.col("head"))).alias("kept"),
    )


def keep_one(documents: DataFrame, **parameters) -> DataFrame:
    """One document of each component (of a repeated row, one copy), with the columns as they came.

    Of a component the row with the least (doc_id, text identity) stays; a null text has no component and always stays.
    Rows are told apart by id and text, never by the id alone.
    """
    columns = documents.columns
    documents = apart(documents, "doc_id", "text")
    grouped, _, _ = near_duplicate_groups(documents, **parameters)
    judged = group_ids(grouped).where("component IS NOT NULL").groupBy("doc_id", "key", "kept").agg(F.count("*").alias("n"))
    marked = judged.select(F.col("doc_id").alias("__id"), F.col("key").alias("__text"), "kept", "n")
    # A row that stays and is alone needs no look-up.
    marked = settle(marked.where("NOT kept OR n > 1").drop("n"), "marked")
    counts = {r["kept"]: r["count"] for r in marked.groupBy("kept").count().collect()}
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text"))
    keyed = documents.withColumn("__key", text_key())
    left = keyed.join(_small(marked.drop("kept"), sum(counts.values())), same, "left_anti").drop("__key")
    if counts.get(True):
        again = keyed.join(_small(marked.where("kept").drop("kept"), counts[True]), same, "left_semi")
        left = left.unionByName(again.dropDuplicates(["doc_id", "__key"]).drop("__key"))
    return left.toDF(*columns)


def op4_near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    grouped, _, _ = near_duplicate_groups(documents)
    return group_ids(grouped).drop("key", "component")
