r"""Alignment of the tokens of two tokenizers, and which pairs of tokens are linked how often in the corpus.

Both tokenizers cut the same bytes: a blank and the text.  The B tokens of a run of bytes are a static interval index, two
sorted arrays of begins and ends.  Every A token stabs it by bisection, which gives the first and the last B token that it
overlaps, and so the gaps between B tokens that it spans; gaps that no A token spans are the borders of the groups.  All A
and B tokens of a group are linked.

A text is cut where no token of either vocabulary lies across (see ``PIECE``), so the pieces are tokenized and aligned by
themselves, and a process aligns a piece that it has met only once.  A vocabulary with a token across such a place is
noticed; its texts are not cut.

The corpus-wide count of a pair (the documents that hold it) is added up in each task, then by Spark.  Each document keeps
its distinct pairs in packed form in the shared folder; the ``HOT`` most frequent pairs, a table of fixed size, go out with
the tasks and are summed on the spot, all other pairs are joined by a shuffle.

Defined results: null and empty texts, and texts whose A or B tokens do not give back the bytes (a U+2581 reads as a blank
in B), have no tokens: zeros and an empty digest; strings of special tokens are plain text; repeated rows are documents of
their own, in the counts too; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import settle, text_slices

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLANK = "▁"
SLICE_BYTES, SLICE_TEXTS = 1_000_000, 2_000
SUMS = ("n_a", "n_b", "n_groups", "n_links")
#: Pieces of text, and their bytes, that a process remembers before it starts afresh; pieces that are aligned at once.
MAX_PIECES, MAX_PIECE_BYTES, ALIGN_AT_ONCE = 350_000, 8_000_000, 10_000
#: Pairs that are summed without a shuffle, and pairs that a task counts before it hands them on.
HOT, FLUSH = 1_000_000, 2_000_000
#: Letters in every version of Unicode, as ranges.
LETTER = "A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ӿ"
#: A text is cut behind a word of these letters before a mark or white space, behind a single line end before a visible
#: character, and behind a visible character before a blank.
PIECE = re.compile(rf" *[{LETTER}]+(?=[,.;:!?\s]|\Z)| +(?:\S+|[^\S ]+ *)*|[,.;:!?]*\n(?=\S)|(?:\S+|[^\S ]+ *)+")
#: What no piece of B may have inside, for these cuts to be safe.
ACROSS = re.compile(rf"\S |[{LETTER}][,.;:!?\s]|\n")


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in the entries of a byte-level vocabulary: itself where it prints, else 256 and up in turn."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Grown:
    """A growing array of whole numbers."""

    def __init__(self) -> None:
        self.room, self.size = np.zeros(1024, np.int64), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(self.size, len(more)), np.int64)])
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class Aligner:
    """Aligns texts; remembers the pieces it has met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(alphabet[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in alphabet for c in t) else (t or "").encode() for i in range(self.size_a)]
        self.bytes_b = [self._piece(i) for i in range(self.size_b)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.cuts = not any(map(ACROSS.search, self._texts_b())) and not any(re.search(r"\S ", t.decode(errors="replace")) for t in self.bytes_a)
        self.line_end = self.b.encode("\n")
        # Texts of ids with what may follow them: within a list, and at its end.
        self.written = np.array([b"%d%s" % (i, s) for n, ends in ((self.size_a, (b",", b"|")), (self.size_b, (b",", b";"))) for s in ends for i in range(n)], object)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(BLANK, " ").encode()

    def _texts_b(self) -> list[str]:
        return [self.b.id_to_piece(i).replace(BLANK, " ") for i in range(self.size_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.groups: list[bytes] = []  # as text, each ends with ``;``
        self.of = {c: Grown() for c in (*SUMS, "good", "first", "distinct")}
        self.pair, self.times = Grown(), Grown()

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each piece.  B puts a blank before a text: it is the piece's own, or goes with a line end put behind it."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        own = [p[0] == " " and p != " " for p in pieces]  # nothing is put before an empty text
        b = self.b.encode([p[1:] if o else f"\n{p}" for p, o in zip(pieces, own, strict=True)], num_threads=1)
        return a, [ids if o else ids[len(self.line_end) :] for o, ids in zip(own, b, strict=True)]

    def learn(self, pieces: list[str]) -> None:
        for begin in range(0, len(pieces), ALIGN_AT_ONCE):
            part = pieces[begin : begin + ALIGN_AT_ONCE]
            ids_a, ids_b = self.encode(part)
            raw = [p.encode() for p in part]
            good = [b"".join(map(self.bytes_a.__getitem__, a)) == r == b"".join(map(self.bytes_b.__getitem__, b)) for a, b, r in zip(ids_a, ids_b, raw, strict=True)]
            self._align([a if ok else [] for a, ok in zip(ids_a, good, strict=True)], [b if ok else [] for b, ok in zip(ids_b, good, strict=True)], good)
            for p in part:
                self.known[p] = len(self.known)
            self.held += sum(map(len, raw))

    def _align(self, ids_a: list[list[int]], ids_b: list[list[int]], good: list[bool]) -> None:
        """Aligns pieces that lie one after the other in one run of bytes."""
        n = len(good)
        counts_a, counts_b = (np.fromiter(map(len, x), np.int64, n) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, c.sum()) for ids, c in ((ids_a, counts_a), (ids_b, counts_b)))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        begin_a, begin_b = end_a - self.length_a[a], end_b - self.length_b[b]
        first = np.searchsorted(end_b, begin_a, "right")
        last = np.searchsorted(begin_b, end_a, "left") - 1
        spans = np.zeros(len(b) + 1, np.int64)
        np.add.at(spans, first, 1)
        np.add.at(spans, last, -1)
        border = np.cumsum(spans)[: len(b)] == 0  # behind each B token: no A token goes on over it
        group_b = np.cumsum(border) - border
        group_a = group_b[first] if len(b) else first
        n_groups = int(group_b[-1]) + 1 if len(b) else 0
        owner_b = np.repeat(np.arange(n), counts_b)
        owner_group = np.zeros(n_groups, np.int64)
        owner_group[group_b] = owner_b
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        links = np.bincount(owner_group, in_a * in_b, minlength=n).astype(np.int64)
        for name, more in zip((*SUMS, "good"), (counts_a, counts_b, np.bincount(owner_group, minlength=n), links, np.array(good)), strict=True):
            self.of[name].add(more)
        self._write(a, b, group_a, group_b, counts_a + counts_b)
        self._pair(a, b, group_a, group_b, n_groups, owner_group, n)

    def _write(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, counts: np.ndarray) -> None:
        ends_a, ends_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        text = np.concatenate([a + ends_a * self.size_a, 2 * self.size_a + b + ends_b * self.size_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = self.written[text[order]].tolist()
        at = 0
        for count in counts.tolist():
            self.groups.append(b"".join(words[at : at + count]))
            at += count

    def _pair(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int, owner_group: np.ndarray, n: int) -> None:
        """Distinct pairs of each piece, with the links that each stands for."""
        (ga, ia, ma), (gb, ib, mb) = (self._distinct(g, i, size) for g, i, size in ((group_a, a, self.size_a), (group_b, b, self.size_b)))
        begin_b, in_b = np.searchsorted(gb, np.arange(n_groups)), np.bincount(gb, minlength=n_groups)
        fan = in_b[ga]
        left = np.repeat(np.arange(len(ga)), fan)
        right = np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan) + begin_b[ga][left]
        pair, times = ia[left] * self.size_b + ib[right], ma[left] * mb[right]
        owner, pair, times = summed(owner_group[ga][left], pair, times, n, self.size_a * self.size_b)
        distinct = np.bincount(owner, minlength=n)
        self.of["first"].add(self.pair.size + np.cumsum(distinct) - distinct)
        self.of["distinct"].add(distinct)
        self.pair.add(pair)
        self.times.add(times)

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, times = np.unique(group * size + ids, return_counts=True)
        return key // size, key % size, times

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups (bytes) and distinct (pairs) of each text; pair and times of all, text by text."""
        if len(self.known) > MAX_PIECES or self.held > MAX_PIECE_BYTES:
            self.forget()
        cut = [(PIECE.findall(f" {t}") if self.cuts else [f" {t}"]) if t else [] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        pieces = list(chain.from_iterable(cut))
        found = list(map(self.known.get, pieces))
        if new := [k for k, f in enumerate(found) if f is None]:
            self.learn(list(dict.fromkeys(pieces[k] for k in new)))
            for k in new:
                found[k] = self.known[pieces[k]]
        which = np.array(found, np.int64)
        text = np.repeat(np.arange(len(cut)), counts)
        spoiled = np.bincount(text, 1 - self.of["good"][which], len(cut)) > 0
        use = ~spoiled[text]
        out = {c: np.bincount(text[use], self.of[c][which[use]], len(cut)).astype(np.int64) for c in SUMS}
        words, ends = list(map(self.groups.__getitem__, found)), np.cumsum(counts)
        out["groups"] = [b"" if bad else b"".join(words[e - c : e])[:-1] for e, c, bad in zip(ends.tolist(), counts.tolist(), spoiled.tolist(), strict=True)]
        key, often = np.unique(text[use] * len(found) + ranked(which[use]), return_counts=True)
        piece = np.unique(which[use])[key % max(1, len(found))]
        lengths = self.of["distinct"][piece]
        at = np.arange(lengths.sum()) + np.repeat(self.of["first"][piece] - (np.cumsum(lengths) - lengths), lengths)
        times = self.times[at] * np.repeat(often, lengths)
        owner, out["pair"], out["times"] = summed(np.repeat(key // max(1, len(found)), lengths), self.pair[at], times, len(cut), self.size_a * self.size_b)
        out["distinct"] = np.bincount(owner, minlength=len(cut))
        return out


def ranked(numbers: np.ndarray) -> np.ndarray:
    """Each number's place among the distinct ones."""
    return np.unique(numbers, return_inverse=True)[1]


def summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray, owners: int, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, sum of times), sorted, each once; there are ``owners`` and ``pairs`` at most."""
    if owners * pairs >= 1 << 63:
        raise ValueError("the vocabularies are too large for pairs in one number")
    key = owner * pairs + pair
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] // pairs, key[at] % pairs, np.add.reduceat(times[order], at) if len(at) else times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A row of bytes for so many values each, eight bytes a value."""
    offsets = np.concatenate([[0], np.cumsum(counts * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of packed numbers: each row holds whole numbers of eight bytes."""
    rows = [np.frombuffer(x, np.int64) for x in column.to_pylist()]
    return np.repeat(np.arange(len(rows)), list(map(len, rows))).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *rows])


def align_documents(documents: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (binary) of each row; ``groups`` (text) if asked for.

    ``pairs`` holds the distinct linked pairs, a x (size of B's vocabulary) + b, ``times`` the links of each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for begin, texts in text_slices(batch.column("text"), SLICE_BYTES, SLICE_TEXTS):
                found = own.align(texts)
                columns = [batch.column("doc_id").slice(begin, len(texts)), *(pa.array(found[c]) for c in SUMS)]
                columns.append(pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]], pa.string()))
                columns += [packed(found[c], found["distinct"]) for c in ("pair", "times")]
                if with_groups:
                    columns.append(pa.array([g.decode() for g in found["groups"]], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *SUMS, "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])]
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return documents.select("doc_id", "text").mapInArrow(run, schema + (", groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best), settled: the rows that hold each pair, and whether no pair of the same A token is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])

        for batch in batches:
            step = max(1, batch.num_rows // 8)
            for begin in range(0, batch.num_rows, step):
                _, pair = numbers(batch.column(0).slice(begin, step))
                key, n = np.unique(pair, return_counts=True)
                _, *held = summed(np.zeros(len(key) + len(held[0]), np.int64), np.concatenate([held[0], key]), np.concatenate([held[1], n]), 1, 1 << 62)
                if len(held[0]) > FLUSH:
                    yield out()
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(held[0]):
            yield out()

    counted = settle(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("pair") / size_b).alias("a")
    # One row for each entry of A's vocabulary at most.
    tops = F.broadcast(counted.groupBy(a).agg(F.max("n").alias("top")))
    return settle(counted.withColumn("a", a).join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")


def most_frequent(counts: DataFrame, hot: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], bool]:
    """(pair, n, best) of the most frequent pairs, at most ``hot``, sorted by pair; whether these are all.

    A histogram (a row per eighth of a power of two) gives the count from which on all fit.
    """
    levelled = counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    least, total, every = None, 0, True
    for level, n in sorted(map(tuple, levelled.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > hot:
            every = False
            break
        least = level
    if least is None:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), every
    found = levelled.where(F.col("level") >= least).select("pair", "n", "best").toArrow()
    pair, n, best = (found[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return (pair[order], n[order], best[order].astype(bool)), every


def link_scores(aligned: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``row`` of ``aligned`` with n_best and count_sum."""
    table, every = most_frequent(counts, hot)
    sent = aligned.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row with the sums over hot pairs for each row, and its other pairs."""
        pairs, n, best = sent.value
        for batch in batches:
            step = max(1, batch.num_rows // 8)
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                owner, pair = numbers(part.column("pairs"))
                _, times = numbers(part.column("times"))
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                sums = np.zeros((2, part.num_rows), np.int64)
                np.add.at(sums[0], owner[hit], times[hit] * best[at[hit]])
                np.add.at(sums[1], owner[hit], times[hit] * n[at[hit]])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=part.num_rows))])
                rest = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[~hit])) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sums[0]), pa.array(sums[1]), *rest], ["row", "n_best", "count_sum", "pair", "times"])

    scored = aligned.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pair array<long>, times array<long>")
    if every:
        return scored.select("row", "n_best", "count_sum")
    scored = settle(scored, "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("pair", "times")).alias("p")).select("row", F.col("p.pair").alias("pair"), F.col("p.times").alias("times"))
    found = rest.join(counts, "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = scored.select("row", "n_best", "count_sum").unionByName(found)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op13_token_alignment(spark: SparkSession, documents: DataFrame, hot: int = HOT) -> DataFrame:
    path_a, path_b = public_tokenizers.path(MODEL_A), public_tokenizers.path(MODEL_B)
    # The number of a row is fixed by being written.
    aligned = settle(align_documents(documents, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    scores = link_scores(aligned, pair_counts(aligned, size_b), hot)
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.drop("pairs", "times").join(scores, "row").select(*shown)
