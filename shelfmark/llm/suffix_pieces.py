"""SentencePiece encoding and decoding by suffix-array matching.

The characters of a batch are cut where no piece of the vocabulary spans two neighbours; the distinct units that were
not met before are concatenated and indexed by a suffix array (numpy, windows as long as the longest piece).  Every
piece is binary-searched in it, which gives all its occurrences as a range.  The occurrences are edges (begin, end,
piece); sorted by position they are relaxed from left to right.

For a BPE model the relaxation follows from how merges work: the encoding of a prefix that ends with piece ``a`` goes on
with piece ``b`` exactly if merging the characters of ``a`` + ``b`` by score gives back these two pieces.  So each end
position has exactly one edge that survives, and its piece is the last one of that prefix.  The test walks down the
merge trees of both pieces along the seam and asks whether any merge across it would have come first.

A character without a piece becomes its UTF-8 bytes (byte fallback).  The results equal the sentencepiece library's.

Defined results: null and empty texts have no ids and decode to the empty text; U+2581 in a text reads as a blank, as in
the library, so only such texts do not come back unchanged; repeated rows stay; extra columns stay where they are asked
for and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices
from .token_counts import span_hashes

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
SLICE_BYTES = 500_000
#: Units, and ids of units, that a process remembers before it starts afresh.
MAX_UNITS, MAX_POOL = 400_000, 2_000_000
#: Longer units are relaxed edge by edge, not level by level.
LONG_UNIT = 256
NONE = -1


@dataclass
class Vocabulary:
    """Pieces by merge order: tokens 0..n_merged-1 have several characters, best score first, then the single ones."""

    tokens: list[str]
    ids: np.ndarray
    n_merged: int
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # left, right, merged
    bytes_of: list[bytes]  # by id, for decoding
    byte_ids: np.ndarray


def read_vocabulary(path: str) -> Vocabulary:
    """Made once, on the driver."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    piece = {i: sp.id_to_piece(i) for i in normal}
    merged = sorted((i for i in normal if len(piece[i]) > 1), key=lambda i: (-sp.get_score(i), i))
    single = [i for i in normal if len(piece[i]) == 1]
    byte_ids = np.full(256, NONE, np.int32)
    bytes_of = [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[1:-1], 16)
            byte_ids[value], bytes_of[i] = i, bytes([value])
        elif i in piece:
            bytes_of[i] = piece[i].replace(BLANK, " ").encode()
    return arrange([piece[i] for i in merged], [piece[i] for i in single], merged + single, bytes_of, byte_ids)


def arrange(merged: list[str], single: list[str], ids: list[int], bytes_of: list[bytes], byte_ids: np.ndarray) -> Vocabulary:
    """Vocabulary of the merged pieces, best first, and the single characters."""
    tokens = merged + single
    index = {t: k for k, t in enumerate(tokens)}
    n_merged = len(merged)
    left, right = np.full(len(ids), NONE, np.int32), np.full(len(ids), NONE, np.int32)
    pairs = []
    for k in range(n_merged):
        t = tokens[k]
        for cut in range(1, len(t)):
            a, b = index.get(t[:cut]), index.get(t[cut:])
            if a is not None and b is not None:
                pairs.append((a, b, k))
        final = _last_merge(t, index)
        if final:
            left[k], right[k] = final
    return Vocabulary(tokens, np.array(ids, np.int32), n_merged, left, right, np.array(pairs, np.int64), bytes_of, byte_ids)


def _last_merge(text: str, index: dict[str, int]) -> tuple[int, int] | None:
    """The two pieces that merge last when ``text`` becomes one piece; None if it never does."""
    parts = list(text)
    if any(c not in index for c in parts):
        return None
    while len(parts) > 2:
        best = min(((index[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in index), default=None)
        if best is None:
            return None
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return index[parts[0]], index[parts[1]]


class Encoder:
    """Encodes texts; keeps the units it has met."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        n = len(v.tokens)
        self.lengths = np.array([len(t) for t in v.tokens], np.int64)
        self.index = {t: k for k, t in enumerate(v.tokens)}
        self.birth = np.where(np.arange(n) < v.n_merged, np.arange(n), -1)
        self._hash_pairs()
        usable = [k for k in range(v.n_merged) if v.left[k] != NONE]
        letters = sorted({c for k in usable for c in v.tokens[k]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.full(0x110000, NONE, np.int32)
        for k in range(v.n_merged, n):
            self.single[ord(v.tokens[k])] = k
        self.spans = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for k in usable:
            c = self.code[[ord(x) for x in v.tokens[k]]]
            self.spans[c[:-1], c[1:]] = True
        self.usable = np.array(usable, np.int64)
        self.width = int(self.lengths[self.usable].max()) if usable else 1
        self.piece_codes = np.zeros((len(usable), self.width), np.int32)
        for row, k in enumerate(usable):
            self.piece_codes[row, : self.lengths[k]] = self.code[[ord(x) for x in v.tokens[k]]]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    # Pairs that merge, in an open hash table.

    def _hash_pairs(self) -> None:
        a, b, c = self.v.pairs.T if len(self.v.pairs) else np.zeros((3, 0), np.int64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(a) + 4))))
        keys = a * len(self.v.tokens) + b
        self.pair_keys = np.full(1 << self.bits, NONE, np.int64)
        self.pair_values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.pair_keys[slot[todo]] == NONE]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.pair_keys[slot[put]], self.pair_values[slot[put]] = keys[put], c[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.pair_of = dict(zip(keys.tolist(), c.tolist(), strict=True))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token that a and b merge into, or a number above all tokens."""
        keys = a * len(self.v.tokens) + b
        out = np.full(len(keys), len(self.v.tokens) + 1, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            there = self.pair_keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.pair_values[slot[todo[hit]]]
            todo = todo[~hit & (there != NONE)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b next to each other stay as they are.

        Backwards in time, the piece made later comes apart first; at each step a merge across the seam must not
        come before the one that ended the two pieces at the seam (at equal score the left one comes first).
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        never = len(self.v.tokens)
        end_x, end_y = np.full(len(a), never), np.full(len(a), never)
        while len(at):
            across = self.merged_of(x, y)
            crossed = (across < end_x) & (across <= end_y)
            ok[at[crossed]] = False
            born_x, born_y = self.birth[x], self.birth[y]
            split_x = born_x > born_y
            go = ~crossed & (np.maximum(born_x, born_y) >= 0)
            at, x, y, end_x, end_y, split_x = (z[go] for z in (at, x, y, end_x, end_y, split_x))
            end_x = np.where(split_x, x, end_x)
            end_y = np.where(split_x, end_y, y)
            x, y = np.where(split_x, self.v.right[x], x), np.where(split_x, y, self.v.left[y])
        return ok

    # Matching.

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, token) of every occurrence of a piece of several characters; ``codes`` has 0 between the units."""
        letters = np.unique(codes[codes > 0])
        small = np.zeros(self.spans.shape[0], np.uint64)
        small[letters] = np.arange(1, len(letters) + 1)
        # Windows as sort keys of 64 bits: eight characters each, or four where more than 255 different ones occur.
        bits = 8 if len(letters) < 256 else 16
        per, top = 64 // bits, np.uint64((1 << bits) - 1)
        shift = np.uint64(64 - bits) - np.uint64(bits) * np.arange(per, dtype=np.uint64)
        n, w = len(codes), self.width
        keys = -(-w // per)
        padded = np.concatenate([small[codes], np.zeros(per * keys + per, np.uint64)])
        packed = np.zeros(n + per * keys, np.uint64)
        for k in range(per):
            packed |= padded[k : k + len(packed)] << shift[k]
        columns = [packed[per * k : per * k + n] for k in range(keys)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        present = (small[self.piece_codes] > 0) | (self.piece_codes == 0)
        rows = np.flatnonzero(present.all(axis=1))
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens = self.usable[rows]
        chars = np.where(self.piece_codes[rows] > 0, small[self.piece_codes[rows]], 0).astype(np.uint64)
        chars = np.pad(chars, ((0, 0), (0, per * keys - w)))
        filled = np.arange(per * keys)[None, :] < self.lengths[tokens][:, None]
        low, high = np.full(len(rows), 0, np.int64), np.full(len(rows), n, np.int64)
        for k in range(keys):
            part, full = chars[:, per * k : per * k + per], filled[:, per * k : per * k + per]
            least = (part << shift).sum(axis=1, dtype=np.uint64)
            most = (np.where(full, part, top) << shift).sum(axis=1, dtype=np.uint64)
            used = np.flatnonzero(full[:, 0])
            if k == 0:
                low, high = np.searchsorted(columns[0], least, "left"), np.searchsorted(columns[0], most, "right")
            elif len(used):
                low[used], high[used] = self._between(columns[k], low[used], high[used], least[used], most[used])
        found = high - low
        token = np.repeat(tokens, found)
        within = np.arange(len(token)) - np.repeat(np.cumsum(found) - found, found)
        return order[np.repeat(low, found) + within], token

    @staticmethod
    def _between(column: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of all pieces at once, each in its own range."""
        out = []
        for bound, right in ((least, False), (most, True)):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                value = column[np.minimum(mid, len(column) - 1)]
                up = open_ & ((value <= bound) if right else (value < bound))
                a = np.where(up, mid + 1, a)
                b = np.where(open_ & ~up, mid, b)
            out.append(a)
        return out[0], out[1]

    def units(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit) of units given as spans of code points."""
        lengths = ends - begins
        alone = lengths == 1
        n_ids = np.zeros(len(begins), np.int64)
        tokens_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, order, token
        one = np.flatnonzero(alone)
        tokens_of.append((one, np.zeros(len(one), np.int64), self.single[points[begins[one]]].astype(np.int64)))
        many = np.flatnonzero(~alone)
        if len(many):
            size = lengths[many] + 1
            start = np.cumsum(size) - size
            total = int(size.sum())
            unit = np.repeat(np.arange(len(many)), size)
            offset = np.arange(total) - start[unit]
            is_end = offset == lengths[many][unit]
            chars = points[np.minimum(begins[many][unit] + offset, len(points) - 1)]
            codes = np.where(is_end, 0, self.code[chars])
            edge_at, edge_token = self.edges(codes)
            inner = np.flatnonzero(~is_end)
            edge_at = np.concatenate([inner, edge_at])
            edge_token = np.concatenate([self.single[chars[inner]].astype(np.int64), edge_token])
            last = np.full(total, NONE, np.int64)  # last token of the prefix that ends here; NONE at the unit's start
            unknown = NONE - 1
            edge_token = np.where(edge_token == NONE, unknown, edge_token)
            edge_len = np.where(edge_token >= 0, self.lengths[np.maximum(edge_token, 0)], 1)
            level = offset[edge_at]
            long_unit = lengths[many] > LONG_UNIT
            is_long = long_unit[unit[edge_at]]
            short = np.flatnonzero(~is_long)
            short = short[np.argsort(level[short].astype(np.int16), kind="stable")]
            bounds = np.searchsorted(level[short], np.arange(LONG_UNIT + 2))
            for k in range(LONG_UNIT + 1):
                e = short[bounds[k] : bounds[k + 1]]
                if not len(e):
                    break
                at, token = edge_at[e], edge_token[e]
                before = last[at]
                both = (before >= 0) & (token >= 0)
                good = np.ones(len(e), bool)
                good[both] = self.stand(before[both], token[both])
                last[at[good] + edge_len[e[good]]] = token[good]
            far = np.flatnonzero(is_long)
            if len(far):
                self._relax_long(far[np.argsort(edge_at[far], kind="stable")], edge_at, edge_token, edge_len, last, unit)
            at = start + lengths[many]
            active, k = np.arange(len(many)), 0
            found = []
            while len(active):
                token = last[at[active]]
                found.append((many[active], np.full(len(active), k), token))
                at[active] -= np.where(token >= 0, self.lengths[np.maximum(token, 0)], 1)
                active, k = active[at[active] > start[active]], k + 1
            counts = np.zeros(len(begins), np.int64)
            for u, _, _ in found:
                counts[u] += 1
            tokens_of += [(u, counts[u] - 1 - k, t) for u, k, t in found]
        u = np.concatenate([t[0] for t in tokens_of])
        k = np.concatenate([t[1] for t in tokens_of])
        token = np.concatenate([t[2] for t in tokens_of])
        n_ids += np.bincount(u, minlength=len(begins))
        place = (np.cumsum(n_ids) - n_ids)[u] + k
        flat = np.empty(len(u), np.int64)
        flat[place] = token
        if (flat >= 0).all():
            return self.v.ids[flat], n_ids
        return self._with_bytes(flat, n_ids, points, begins)

    def _with_bytes(self, flat: np.ndarray, n_ids: np.ndarray, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become bytes."""
        width = np.where(flat >= 0, self.lengths[np.maximum(flat, 0)], 1)
        unit = np.repeat(np.arange(len(n_ids)), n_ids)
        before = np.cumsum(width) - width
        first = np.cumsum(n_ids) - n_ids
        at = begins[unit] + before - before[np.minimum(first, max(0, len(before) - 1))][unit]
        out, sizes = [], np.ones(len(flat), np.int64)
        known = self.v.ids[np.maximum(flat, 0)].tolist()
        for k, token in enumerate(flat.tolist()):
            if token >= 0:
                out.append(known[k])
            else:
                raw = chr(points[at[k]]).encode("utf-8", "surrogatepass")
                out += self.v.byte_ids[list(raw)].tolist()
                sizes[k] = len(raw)
        return np.array(out, np.int32), np.bincount(unit, sizes, minlength=len(n_ids)).astype(np.int64)

    def _relax_long(self, order: np.ndarray, edge_at: np.ndarray, edge_token: np.ndarray, edge_len: np.ndarray, last: np.ndarray, unit: np.ndarray) -> None:
        """The same relaxation, one edge after the other."""
        seen: dict[tuple[int, int], bool] = {}
        for at, token, size in zip(edge_at[order].tolist(), edge_token[order].tolist(), edge_len[order].tolist(), strict=True):
            before = int(last[at])
            if before >= 0 and token >= 0:
                good = seen.get((before, token))
                if good is None:
                    good = seen[before, token] = self._stands(before, token)
                if not good:
                    continue
            last[at + size] = token

    def _stands(self, x: int, y: int) -> bool:
        n, birth, pair_of = len(self.v.tokens), self.birth, self.pair_of
        end_x = end_y = n
        while True:
            across = pair_of.get(x * n + y, n + 1)
            if across < end_x and across <= end_y:
                return False
            if birth[x] < 0 and birth[y] < 0:
                return True
            if birth[x] > birth[y]:
                end_x, x = x, int(self.v.right[x])
            else:
                end_y, y = y, int(self.v.left[y])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        parts = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        joined = "".join(parts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        starts = np.empty(len(points), bool)
        starts[0] = True
        starts[1:] = ~self.spans[code[:-1], code[1:]]
        # Within a piece the blank only leads: a run of blanks ends before a word's first blank.
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        text_begin = np.cumsum(lengths) - lengths
        starts[text_begin[lengths > 0]] = True
        if self.blank_leads:
            is_blank = points == ord(BLANK)
            starts[1:] |= is_blank[1:] & ~is_blank[:-1]
        begins = np.flatnonzero(starts)
        ends = np.append(begins[1:], len(points))
        distinct, first, inverse = np.unique(span_hashes(points, begins, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        old = place < len(self.known)
        old[old] = self.known[place[old]] == distinct[old]
        if not old.all():
            if len(self.known) and (len(self.known) + int((~old).sum()) > MAX_UNITS or len(self.pool) > MAX_POOL):
                self.forget()
                old[:] = False
            new = first[~old]
            ids, n_ids = self.units(points, begins[new], ends[new])
            begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(n_ids) - n_ids])
            count = np.concatenate([self.count, n_ids])
            known = np.concatenate([self.known, distinct[~old]])
            order = np.argsort(known)
            self.known, self.begin, self.count = known[order], begin[order], count[order]
            self.pool = np.concatenate([self.pool, ids])
            place = np.searchsorted(self.known, distinct)
        which = place[inverse]
        n_ids = self.count[which]
        total = np.cumsum(n_ids)
        gather = np.arange(total[-1]) - np.repeat(total - n_ids, n_ids) + np.repeat(self.begin[which], n_ids)
        text_of = np.searchsorted(text_begin + lengths, begins, "right")
        return self.pool[gather], np.bincount(text_of, n_ids, minlength=len(texts)).astype(np.int64)

    @property
    def blank_leads(self) -> bool:
        """Whether no piece holds a blank after another character (then words are units of their own)."""
        if not hasattr(self, "_blank_leads"):
            self._blank_leads = not any(BLANK in self.v.tokens[k].lstrip(BLANK) for k in self.usable.tolist())
        return self._blank_leads


def decode(ids: list[int], bytes_of: list[bytes]) -> str:
    text = b"".join([bytes_of[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary) -> Encoder:
    """One encoder in a worker process, with what it has met."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]


def encode_documents(documents: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, ids array<int>, n_tokens long and round_trip (decoding gives the text back)."""
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    narrow = documents.select(*columns, F.coalesce("text", F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, vocabulary)
        table = encoder.v.bytes_of
        for batch in batches:
            for at, texts in text_slices(batch.column("__text"), SLICE_BYTES):
                ids, n_ids = encoder.encode(texts)
                ends = np.cumsum(n_ids)
                offsets = np.concatenate([[0], ends])
                listed = ids.tolist()
                same = [decode(listed[a:b], table) == t for a, b, t in zip(offsets[:-1].tolist(), ends.tolist(), texts, strict=True)]
                kept = [batch.column(c).slice(at, len(texts)) for c in columns]
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept, values, pa.array(n_ids, pa.int64()), pa.array(same)], [*columns, "ids", "n_tokens", "round_trip"])

    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["ids array<int>", "n_tokens long", "round_trip boolean"]))


def decode_documents(encoded: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and the text of ``ids``."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path).bytes_of)
    narrow = encoded.select(*columns, F.col("ids").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(i or [], vocabulary.value) for i in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(texts, pa.string())], [*columns, "text"])

    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["text string"]))


def op2_sentencepiece(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return encode_documents(documents, public_tokenizers.path(MODEL))
