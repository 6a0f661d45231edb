"""Substring dedup against a dictionary of all windows, and against SQL."""

import random
import re

import pytest

from shelfmark.llm import repeat_anchors
from shelfmark.llm.queries import oracle_sql, queries
from shelfmark.llm.repeat_anchors import remove_repeats

from ..compare import connect, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """[(doc_id, n_words, spans, kept)] of each row."""
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    key = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            first[x] = min(first.get(x, (key(i), p)), (key(i), p))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (key(i), p):
                gone[p : p + window] = [True] * window
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((i, len(w), sum(gone), spans, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], [(s["begin"], s["end"]) for s in r["spans"]], r["kept"]) for r in df.collect()), key=str)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    same_rows(queries()["op12_substring_dedup"](spark, sf_dir), connect(sf_dir), oracle_sql()["op12_substring_dedup"])


@pytest.mark.parametrize("window,slice_bytes,seed", [(20, 1 << 18, 1), (20, 500, 2), (5, 300, 3), (2, 2000, 4), (1, 400, 5)])
def test_random_passages(spark, monkeypatch, window, slice_bytes, seed):
    """Passages of a small vocabulary, in slices of a few documents, so that most repeats cross slices."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(window, 4 * window + 2))] for _ in range(6)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randrange(1, len(p) + 1)] if rng.random() < 0.7 else [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]
        rows.append((k // 2 if rng.random() < 0.1 else k, rng.choice([" ", "  ", "\n", " \t"]).join(parts)))
    rng.shuffle(rows)
    homes, buckets = 3, 5
    monkeypatch.setattr(repeat_anchors, "layout", lambda _: (slice_bytes, buckets, homes))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(remove_repeats(df, window)) == brute(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(5, long), (5, long), (7, f"x {long} y"), (9, f"{long}\n{long}"), (None, long), (None, None), (1, ""), (2, " \n\t "), (3, "ein Wort"), (4, "é " * 45 + "🙂"), (11, long), (12, "a" * 200_000)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, slice int, answers string")
    got = rows_of(remove_repeats(df))
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by[5][2] == 0 and by[7][4] == "x y" and by[9][2] == 100 and by[11][4] == "" and by[4][3] == [(1, 45)]


def test_a_hot_passage_and_no_rows(spark):
    """A third of all rows are one text: all but the first row lose it."""
    hot = " ".join(f"h{k}" for k in range(30))
    rows = [(k, hot if k % 3 == 0 else " ".join(f"{k}x{j}" for j in range(25))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(remove_repeats(df)) == brute(rows)
    assert remove_repeats(df.where("doc_id < 0")).count() == 0


def test_texts_are_not_shuffled(spark, sf_dir):
    """Both joins read the written slices by their buckets; the exchanges hold hashes only."""
    df = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 3 and "disabled by query planner" not in plan
    assert not re.search(r"Exchange hashpartitioning\(slice[^\n]*\n[^\n]*FileScan", plan)
