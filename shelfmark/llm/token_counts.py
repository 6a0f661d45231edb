r"""Token counts of whole texts without token ids.

A byte-level BPE tokenizer first splits a text into pre-tokens and then encodes each of them by itself, so a document's
count is the sum over its distinct pre-tokens of frequency x pieces.  Three steps:

1. the distinct pre-tokens of the corpus, with the number of documents that hold them (aggregated in each batch, then
   by Spark);
2. the pieces of each distinct pre-token, counted once by the tokenizers library, written to the shared folder;
3. each document's pre-token frequencies are joined to those counts and summed.

The join would be skewed (some pre-tokens are in every document), so the ``HOT`` most frequent pre-tokens, a table of
fixed size, go out with the tasks and are summed on the spot; all others are joined by a shuffle on the pre-token.

Pre-tokens are cut with numpy over the code points of a batch: a class per code point (letter, number, white space,
other, by the Unicode version of the tokenizer) and the rules of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside texts are one token each, as is
the library's default; repeated rows are returned as often as they came in; extra columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import settle, text_slices, utf8_size

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pre-tokens that are summed without a shuffle, and their greatest length.
HOT, HOT_CHARS = 100_000, 40
#: Bytes of text that are cut at once, and distinct pre-tokens held before they go to Spark.
SLICE_BYTES = 400_000
FLUSH = 100_000
#: Pre-tokens that the library encodes in one call.
ENCODE_AT_ONCE = 1_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: First letters after an apostrophe, and the second ones where there are two.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_tokenizers: dict[str, Tokenizer] = {}
_classes: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def load(path: str) -> Tokenizer:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in load(path).get_added_tokens_decoder().values()]


def class_runs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of each run of code points of one class, made once on the driver.

    Two Unicode tables at hand (of Python and of the regex library) settle all code points on which they agree; the
    others, which only some Unicode versions know, are put to the tokenizer's own splitter.
    """
    if path not in _classes:
        every = "".join(map(chr, range(0xD800))) + "\ufffd" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        by_regex = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for found in regex.finditer(pattern, every):
                by_regex[found.start() : found.end()] = kind
        first = {"L": LETTER, "N": NUMBER}
        by_python = np.fromiter((first.get(unicodedata.category(c)[0], OTHER) for c in every), np.uint8, len(every))
        by_python[by_regex == SPACE] = SPACE
        split = load(path).pre_tokenizer.pre_tokenize_str
        for c in np.flatnonzero(by_regex != by_python).tolist():
            kinds = [kind for mark, kind in (("a", LETTER), ("1", NUMBER)) if len(split(mark + chr(c))) == 1]
            by_regex[c] = kinds[0] if kinds else OTHER
        begins = np.flatnonzero(np.diff(by_regex.astype(np.int16), prepend=-1))
        _classes[path] = begins, by_regex[begins]
    return _classes[path]


def char_classes(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Class of each code point."""
    return np.repeat(runs[1], np.diff(runs[0], append=0x110000))


def cut_starts(points: np.ndarray, classes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Start of every pre-token.  ``points``: code points of all texts; ``text_starts``: where the texts begin."""
    n = len(points)
    kind = classes[points]
    start = np.empty(n, bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[text_starts] = True
    last = np.zeros(n, bool)  # last point of its text
    last[text_starts[1:] - 1] = True
    last[-1:] = True
    space = kind == SPACE
    # The last of several spaces before a word stands apart; if it is a blank it belongs to the word.
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:]
    before_word &= ~last
    at = np.flatnonzero(before_word)
    start[at] = True
    joined = at[points[at] == 0x20]
    start[joined + 1] = False
    # Contractions: an apostrophe that starts a pre-token by itself.
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote < n - 1]
    if len(quote):
        text_end = np.append(text_starts[1:], n)
        end_of = text_end[np.searchsorted(text_starts, quote, "right") - 1]
        for tail in CONTRACTIONS:
            fits = quote + len(tail) < end_of
            for k, c in enumerate(tail):
                where = np.minimum(quote + 1 + k, n - 1)
                fits &= points[where] == ord(c)
            found = quote[fits]
            start[found + 1] = False
            after = found + 1 + len(tail)
            after = after[after < n]
            follow = after[~start[after]]
            start[follow] = True
            # What follows a contraction is cut as at a start: an apostrophe there may contract again.
    return np.flatnonzero(start)


#: Powers that a process keeps; longer texts work out their own.
KEPT_POWERS = 1 << 20
_powers = np.ones(1, np.uint64)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: a polynomial over odd powers, mixed with the length."""
    global _powers
    n = len(points)
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = _powers
    if len(powers) < n + 1:
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base))))
        if n <= KEPT_POWERS:
            _powers = powers
    down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, inverse))))
    scrambled = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    scrambled ^= scrambled >> np.uint64(32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(scrambled * powers[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Cutter:
    """Pre-tokens of a chunk of texts."""

    def __init__(self, runs: tuple[np.ndarray, np.ndarray], special: list[str]):
        self.classes = char_classes(runs)
        self.special = special

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pre-tokens, owner of each distinct (text, pre-token), its pre-token, its frequency).

        Special strings come as pre-tokens of their own.
        """
        parts, owners, extra = [], [], []
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                rest = [text]
                for s in self.special:
                    pieces = []
                    for r in rest:
                        found = r.split(s)
                        extra += [(k, s)] * (len(found) - 1)
                        pieces += found
                    rest = pieces
                rest = [r for r in rest if r]
            else:
                rest = [text] if text else []
            parts += rest
            owners += [k] * len(rest)
        names: list[str] = []
        owner = np.zeros(0, np.int64)
        which = np.zeros(0, np.int64)
        times = np.zeros(0, np.int64)
        if parts:
            joined = "".join(parts)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            text_starts = np.cumsum(lengths) - lengths
            starts = cut_starts(points, self.classes, text_starts)
            ends = np.append(starts[1:], len(points))
            _, first, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
            names = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            of = np.asarray(owners)[np.searchsorted(text_starts, starts, "right") - 1]
            pair, times = np.unique(of * len(names) + inverse, return_counts=True)
            owner, which = pair // len(names), pair % len(names)
        if extra:
            at = {s: len(names) + k for k, s in enumerate(self.special)}
            more = Counter(extra)
            names = names + self.special
            owner = np.concatenate([owner, [k for k, _ in more]])
            which = np.concatenate([which, [at[s] for _, s in more]])
            times = np.concatenate([times, list(more.values())])
        return names, owner, which, times


def distinct_pretokens(documents: DataFrame, path: str) -> DataFrame:
    """(pretoken, df): one row per distinct pre-token."""
    runs, special = class_runs(path), special_strings(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter(runs, special), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "df"])

        for batch in batches:
            for _, texts in text_slices(batch.column(0), SLICE_BYTES):
                names, _, which, _ = cutter.cut(texts)
                df = np.bincount(which, minlength=len(names)).tolist()
                for name, n in zip(names, df, strict=True):
                    seen[name] += n
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    found = documents.select("text").mapInArrow(run, "pretoken string, df long")
    return found.groupBy("pretoken").agg(F.sum("df").alias("df"))


def piece_counter(path: str):
    """Function of a list of pre-tokens: the pieces of each, by the model of the tokenizers library."""
    tokenizer = load(path)

    def count(names: list[str]) -> list[int]:
        parts = (names[k : k + ENCODE_AT_ONCE] for k in range(0, len(names), ENCODE_AT_ONCE))
        return [len(e.ids) for part in parts for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    return count


def count_pieces(pretokens: DataFrame, path: str) -> DataFrame:
    """Adds n_pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path)
        for batch in batches:
            pieces = pa.array(count(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["pretoken", "df", "n_pieces"])

    return pretokens.mapInArrow(run, "pretoken string, df long, n_pieces int")


def most_frequent(vocabulary: DataFrame, hot: int) -> dict[str, int]:
    """Pieces of the most frequent short pre-tokens, at most ``hot`` of them.

    A histogram of frequencies (a row per eighth of a power of two) gives the frequency from which on all fit.
    """
    short = vocabulary.where(F.length("pretoken") <= HOT_CHARS).withColumn("level", F.floor(F.log2("df") * 8).cast("int"))
    least, total = None, 0
    for row in sorted(short.groupBy("level").count().collect(), reverse=True):
        total += row["count"]
        if total > hot:
            break
        least = row["level"]
    if least is None:
        return {}
    return {r["pretoken"]: r["n_pieces"] for r in short.where(F.col("level") >= least).select("pretoken", "n_pieces").collect()}


def token_counts(documents: DataFrame, path: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row."""
    spark = documents.sparkSession
    runs, special = class_runs(path), special_strings(path)
    vocabulary = settle(count_pieces(distinct_pretokens(documents, path), path), "pretokens")
    known = spark.sparkContext.broadcast(most_frequent(vocabulary, hot))
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("text_key", F.xxhash64("text")).withColumn("n_bytes", utf8_size(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document with the sum over hot pre-tokens, one per (document, other pre-token)."""
        cutter, table = Cutter(runs, special), known.value
        for batch in batches:
            for begin, part in text_slices(batch.column("text"), SLICE_BYTES):
                names, owner, which, times = cutter.cut(part)
                pieces = np.fromiter((table.get(name, -1) for name in names), np.int64, len(names))
                is_hot = pieces[which] >= 0 if len(names) else np.zeros(0, bool)
                sums = np.zeros(len(part), np.int64)
                np.add.at(sums, owner[is_hot], (pieces[which] * times)[is_hot])
                doc = pa.array(begin + np.concatenate([np.arange(len(part)), owner[~is_hot]]))
                words = pa.array(names, pa.string()).take(pa.array(which[~is_hot]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(doc),
                        batch.column("text_key").take(doc),
                        batch.column("n_bytes").take(doc),
                        pa.concat_arrays([pa.nulls(len(part), pa.string()), words]),
                        pa.array(np.concatenate([sums, times[~is_hot]])),
                    ],
                    ["doc_id", "text_key", "n_bytes", "pretoken", "n"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    rows = keyed.mapInArrow(run, f"doc_id {kind}, text_key long, n_bytes long, pretoken string, n long")
    # A document's own row gets a key that no pre-token has, so that these rows spread over the join's partitions.
    rows = rows.withColumn("own", F.col("pretoken").isNull()).withColumn("key", F.coalesce("pretoken", F.concat(F.lit("\x00\x01"), F.hex("text_key"))))
    pieces = vocabulary.select(F.col("pretoken").alias("key"), "n_pieces")
    joined = rows.join(pieces, "key", "left").withColumn("tokens", F.when(F.col("own"), F.col("n")).otherwise(F.col("n") * F.col("n_pieces")))
    summed = joined.groupBy("doc_id", "text_key").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens"), F.sum(F.col("own").cast("int")).alias("copies")
    )
    once = summed.withColumn("n_tokens", (F.col("tokens") / F.col("copies")).cast("long"))
    return once.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op1_token_counts(spark: SparkSession, documents: DataFrame) -> DataFrame:
    counted = token_counts(documents, public_tokenizers.path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
