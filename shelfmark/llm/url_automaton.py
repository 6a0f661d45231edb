"""URL filter by a bit-parallel wildcard automaton (multiword Shift-And).

Glob rules are packed side by side into 64-bit words: one bit for the start of each rule and one for each of its
literals.  All rules run at once over each canonical URL: ``D = ((D << 1) & B[c]) | (D & L[c])``, where ``B`` holds the
literals that accept byte ``c`` and ``L`` the states on which a wildcard waits.  The URLs of an Arrow batch advance
together, byte by byte, as rows of a matrix of words.

Globs: ``*`` stands for any bytes but ``/``, ``**`` for any bytes, ``?`` for one byte but ``/``.  The canonical URL is
host (A-Z lower-cased) and path, without scheme, query and fragment; a rule of the list (host, path) becomes the globs
``host/path**`` and ``*.host/path**``.

Defined results: a null or empty url, and one without ``://``, has empty host and path, fits no rule and gets the
default verdict of the method (allow unless a block glob fits); a path is empty unless it starts with ``/``; equal rows
stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANY, NO_SLASH = "any", "no_slash"
#: Words of 64 bits that the states of the urls advancing together may take.
STATE_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains and a path prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


class ShiftAnd:
    """Simulates all globs at once; ``match`` gives a boolean matrix (strings x globs)."""

    def __init__(self, globs: Iterable[str]):
        self.globs = list(globs)
        parsed = [self._parse(g) for g in self.globs]
        n_bits = sum(len(symbols) + 1 for symbols, _ in parsed)
        self.words = max(1, (n_bits + 63) // 64)
        self.accept_masks = np.zeros((256, self.words), np.uint64)
        self.loop_masks = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        bit = 0
        for symbols, loops in parsed:
            self._set(self.start, bit)
            for k in range(len(symbols) + 1):
                if k:
                    self._allow(self.accept_masks, bit + k, symbols[k - 1])
                if k in loops:
                    self._allow(self.loop_masks, bit + k, loops[k])
            last = bit + len(symbols)
            self.final.append((last // 64, np.uint64(1 << (last % 64))))
            bit = last + 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << (bit % 64))

    def _allow(self, masks: np.ndarray, bit: int, what: int | str) -> None:
        which = [what] if isinstance(what, int) else [c for c in range(256) if what == ANY or c != 0x2F]
        masks[which, bit // 64] |= np.uint64(1 << (bit % 64))

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | str], dict[int, str]]:
        """Symbols that take one byte each, and the wildcards by the number of symbols before them."""
        raw, symbols, loops, i = glob.encode(), [], {}, 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                loops[len(symbols)] = ANY
                i += 2
                continue
            if raw[i : i + 1] == b"*":
                loops.setdefault(len(symbols), NO_SLASH)
            else:
                symbols.append(NO_SLASH if raw[i : i + 1] == b"?" else raw[i])
            i += 1
        return symbols, loops

    def match(self, strings: list[bytes]) -> np.ndarray:
        n = len(strings)
        lengths = np.fromiter((len(s) for s in strings), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        flat = np.frombuffer(b"".join(strings), np.uint8)
        offsets = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        active, at = n, 0
        while True:
            active = int(np.searchsorted(-sorted_lengths[:active], -at, "left"))  # strings longer than ``at``
            if not active:
                break
            chars = flat[offsets[:active] + at]
            now = state[:active]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:active] = (shifted & self.accept_masks[chars]) | (now & self.loop_masks[chars])
            at += 1
        out = np.empty((n, len(self.final)), bool)
        for g, (word, mask) in enumerate(self.final):
            out[order, g] = (state[:, word] & mask) != 0
        return out


def judge(urls: DataFrame, rules: list[Rule], block_globs: list[str], key: str = "page_id") -> DataFrame:
    """key, host, path, rule (longest that fits, else null), glob_rule (first block glob that fits), verdict."""
    url = F.col("url")
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.regexp_replace(rest, r"^[^/?#]*", "")
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    cut = urls.select(F.col(key), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))
    names = [r.name for r in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ShiftAnd([g for r in rules for g in r.globs()] + block_globs)
        by_length = sorted(range(len(rules)), key=lambda k: -len(names[k]))
        step = max(1, STATE_WORDS // max(automaton.words, len(automaton.globs) // 8))
        for pdf in (batch.iloc[k : k + step] for batch in batches for k in range(0, len(batch), step)):
            hits = automaton.match([(h + p).encode() for h, p in zip(pdf["host"], pdf["path"], strict=True)])
            rule = np.full(len(pdf), None, object)
            verdict = np.full(len(pdf), "allow", object)
            glob = np.full(len(pdf), None, object)
            by_glob = hits[:, 2 * len(rules) :]
            for k in reversed(range(len(block_globs))):
                glob[by_glob[:, k]] = block_globs[k]
            verdict[by_glob.any(axis=1)] = "block"
            for k in reversed(by_length):  # the longest last, so that it wins
                fits = hits[:, 2 * k] | hits[:, 2 * k + 1]
                rule[fits], verdict[fits] = names[k], rules[k].verdict
            yield pdf.assign(rule=rule, glob_rule=glob, verdict=verdict)

    kind = dict(cut.dtypes)[key]
    return cut.mapInPandas(run, f"{key} {kind}, host string, path string, rule string, glob_rule string, verdict string")


#: The rules of the query (fixed values).
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]
#: Globs that block where no rule fits.
BLOCK_GLOBS = ["*spam-**", "*cheap-pills.**", "*casino**", "*adult**", "**.exe", "**.zip"]


def op7_url_filter(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, RULES, BLOCK_GLOBS)


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE
    WHEN regexp_matches(host || path, '^[^/]*spam-') THEN '*spam-**'
    WHEN regexp_matches(host || path, '^[^/]*cheap-pills\.') THEN '*cheap-pills.**'
    WHEN regexp_matches(host || path, '^[^/]*casino') THEN '*casino**'
    WHEN regexp_matches(host || path, '^[^/]*adult') THEN '*adult**'
    WHEN ends_with(host || path, '.exe') THEN '**.exe'
    WHEN ends_with(host || path, '.zip') THEN '**.zip' END AS glob_rule FROM p)
SELECT page_id, host, path, rule, glob_rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' ELSE CASE WHEN glob_rule IS NULL THEN 'allow' ELSE 'block' END END AS verdict FROM r
"""
