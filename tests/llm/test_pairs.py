"""Near-duplicates and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import dart_minhash, decontaminate, queries

from ..compare import connect, same_rows

DOCS = "doc_id long, text string, source string, node string, words string"


def shingle_set(text):
    w = "".join(c.lower() if c < "\x7f" else c for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def shingle_counts(text):
    w = "".join(c.lower() if c < "\x7f" else c for c in text).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_groups(rows, weighted=False):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t) if t is not None else None for _, t in rows]
    if weighted:  # the k-th occurrence of a shingle is an element of its own
        sets = [{(x, k) for x, n in shingle_counts(t).items() for k in range(n)} if t is not None else None for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                continue
            if rows[i][1] == rows[j][1] or (a and b and len(a & b) * 5 >= 4 * len(a | b)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def made_documents():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for _ in range(40):
        rows.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))))
    base = " ".join(rnd.choice(vocabulary) for _ in range(150)).split()
    for _ in range(40):  # a large group of near copies
        copy = list(base)
        for k in rnd.sample(range(150), rnd.randint(0, 4)):
            copy[k] = rnd.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [rows[0]] * 5 + ["", "", "\n\t", None, None, "one two", "One TWO", "x y z"]
    return [(k, t) for k, t in enumerate(rows)]


def test_groups_equal_brute_force(spark):
    rows = made_documents()
    docs = spark.createDataFrame([(d, t, "s", "n", "w") for d, t in rows], DOCS).repartition(5)
    got = sorted((r["doc_id"], r["group_id"]) for r in dart_minhash.op4_near_duplicates(spark, docs).collect())
    assert got == brute_groups(rows)


def test_weighted_groups_equal_brute_force(spark):
    """Texts that repeat a part differently often: their counts differ though their sets hardly do."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(12):
        head, part = [word() for _ in range(40)], [word() for _ in range(12)]
        rows += [" ".join(head + part * n) for n in (1, 2, 3, 8, 9)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(d, t, "s", "n", "w") for d, t in rows], DOCS).repartition(5)
    for weighting in ("set", "count"):
        grouped, _, _ = dart_minhash.near_duplicate_groups(docs, weighting=weighting)
        got = sorted((r["doc_id"], r["group_id"]) for r in dart_minhash.group_ids(grouped).collect())
        assert got == brute_groups(rows, weighted=weighting == "count")
    assert brute_groups(rows, weighted=True) != brute_groups(rows)


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    """Parts of two members and shuffles instead of broadcasts give the same groups."""
    monkeypatch.setattr(dart_minhash, "PART", 2)
    monkeypatch.setattr(dart_minhash, "BROADCAST_ROWS", 3)
    rows = made_documents()
    docs = spark.createDataFrame([(d, t, "s", "n", "w") for d, t in rows], DOCS).repartition(5)
    assert sorted((r["doc_id"], r["group_id"]) for r in dart_minhash.op4_near_duplicates(spark, docs).collect()) == brute_groups(rows)


def test_long_texts_below_the_similarity_are_ruled_out(spark, monkeypatch):
    """Texts of 3,000 words at 0.67 share bands but make no pair rows; near copies among them are still found."""
    shared, rows = [f"w{k}" for k in range(2400)], []
    for t in range(60):
        rows.append(shared + [f"p{t}x{k}" for k in range(600)])
    for t in range(6):  # at 0.9 to one of them, and lengths on both sides of a power of two
        rows.append(rows[t][:-150] + [f"q{t}"] * (t % 2))
        rows.append([f"n{t}x{k}" for k in range(1000)])
        rows.append(rows[-1] + [f"m{t}x{k}" for k in range(60 + 10 * t)])
    rows = [(k, " ".join(words)) for k, words in enumerate(rows)]
    judged = []
    compare = dart_minhash.similar_pairs

    def counting(pairs, *rest):
        judged.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(dart_minhash, "similar_pairs", counting)
    docs = spark.createDataFrame([(d, t, "s", "n", "w") for d, t in rows], DOCS).repartition(5)
    got = dart_minhash.op4_near_duplicates(spark, docs).collect()
    assert sorted((r["doc_id"], r["group_id"]) for r in got) == brute_groups(rows)
    assert len({r["class_id"] for r in got}) == len({r["group_id"] for r in got})
    assert 12 <= sum(judged) < 60


def test_parity_maps_fold():
    """The longer map folds to the short one, and never differs in more bits than the sets do."""
    rng = np.random.default_rng(4)
    sizes = np.array([0, 1, 512, 513, 1024, 1025, 5000])
    bits = dart_minhash.long_map_bits(sizes)
    assert bits.tolist() == [0, 0, 0, 1024, 1024, 2048, 8192]
    text, element = np.repeat(np.arange(len(sizes)), sizes), rng.integers(1, 2**62, sizes.sum()).astype(np.uint64)
    short = dart_minhash.parity_maps(np.full(len(sizes), 512), text, element).reshape(-1, 8)
    long = np.split(dart_minhash.parity_maps(bits, text, element), np.cumsum(bits // 64)[:-1])
    for t, words in enumerate(long):
        while len(words) > 8:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        assert not len(words) or (words == short[t]).all()


def test_groups_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["group_id"]) for r in dart_minhash.op4_near_duplicates(spark, docs).collect())
    assert got == brute_groups(rows)


def test_one_of_each_group_stays(spark):
    rows = made_documents()
    docs = spark.createDataFrame([(d, t, "s", "n", "w") for d, t in rows] + [(0, rows[0][1], "t", "n", "w")], DOCS)
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = brute_groups(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for _, g in groups})
    assert dart_minhash.keep_one(docs.where("false")).count() == 0


def test_null_and_repeated_ids_lose_no_text(spark):
    """Null ids, and one id on unrelated texts that is the least of both groups."""
    words = [" ".join(f"{w}{k}" for k in range(30)) for w in ("alpha", "beta", "gamma", "delta")]
    near = words[0] + " more"
    rows = [(None, words[1]), (None, words[2]), (None, words[2]), (None, None), (None, None), (None, ""), (1, words[0]), (2, near), (None, near), (1, words[3]), (3, words[3]), (1, words[3])]
    docs = spark.createDataFrame([(d, t, "s", "n", "w") for d, t in rows], DOCS).repartition(3)
    want = [(None, None), (None, None), (None, ""), (None, words[1]), (None, words[2]), (1, words[0]), (1, words[3])]
    assert sorted(((r["doc_id"], r["text"]) for r in dart_minhash.keep_one(docs).collect()), key=str) == sorted(want, key=str)
    got = sorted(((r["doc_id"], r["group_id"], r["n_group"], r["kept"]) for r in dart_minhash.op4_near_duplicates(spark, docs).collect()), key=str)
    classes = {(r["doc_id"], r["class_id"]) for r in dart_minhash.op4_near_duplicates(spark, docs).collect() if r["group_id"] == 1}
    assert len({c for _, c in classes}) == 2 and len({c for d, c in classes if d == 1}) == 2
    one = [(None, None, 1, True)] * 4 + [(None, None, 2, True)] * 2 + [(1, 1, 3, True)] * 3 + [(2, 1, 3, False), (3, 1, 3, False), (None, 1, 3, False)]
    assert got == sorted(one, key=str)


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_signatures_estimate_similarity(weighting):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 if weighting == "set" else 20, 300).astype(float)
    b = np.where(rng.random(300) < 0.25, rng.permutation(a), a)
    text = np.repeat([0, 1], 300)
    element = np.tile(rng.integers(1, 2**62, 300).astype(np.uint64), 2)
    w = np.concatenate([a, b])
    s = dart_minhash.dart_signatures(2, text[w > 0], element[w > 0], w[w > 0], 2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in dart_minhash.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 99: 99, 100: 99}


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


TEXT = "One two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.mark.parametrize("max_windows", [50_000, 0])
def test_hits_small_cases(spark, max_windows):
    rows = [(1, f"x {TEXT.upper()}! y"), (2, "nothing"), (3, None), (4, ""), (5, "é short É item"), (6, TEXT[:40]), (1, f"x {TEXT.upper()}! y"), (7, "(two) THREE"), (8, "...")]
    docs = spark.createDataFrame([(d, t, "s", "n", "w") for d, t in rows], DOCS)
    items = bench(spark, [(10, TEXT), (11, TEXT), (12, "two three"), (13, "é short É"), (14, None), (15, "!"), (2, TEXT)])
    got = sorted(map(tuple, decontaminate.find_hits(docs, items, max_windows=max_windows).select("doc_id", "n_words", "n_hit", "item_ids").collect()), key=str)
    want = [
        (1, 15, 13, ["10", "11", "12", "2"]), (1, 15, 13, ["10", "11", "12", "2"]), (2, 1, 0, []), (3, 0, 0, []), (4, 0, 0, []), (5, 4, 3, ["13"]), (6, 8, 2, ["12"]), (7, 2, 2, ["12"]), (8, 0, 0, []),
    ]
    assert got == sorted(want, key=str)
    clean = decontaminate.drop_contaminated(docs, items, max_windows=max_windows)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 8]
    assert decontaminate.find_hits(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(docs.where("false"), items).count() == 0


def test_spans_are_cut(spark):
    """Separators stay, columns with clashing names too; null and repeated rows are kept; a document of nothing else goes."""
    long = f"-- Keep this, please: {TEXT}. And this text of a dozen words more than the passage holds in all"
    rows = [(1, long), (1, long), (2, TEXT), (3, None), (4, "clean"), (4, "clean"), (None, long)]
    schema = "doc_id long, text string, row_key string, at string, pieces string, words string, __light string"
    docs = spark.createDataFrame([(d, t, "mine", "a", "p", "w", "l") for d, t in rows], schema)
    items = bench(spark, [(1, TEXT)])
    out = decontaminate.remove_spans(docs, items)
    assert out.columns == docs.columns
    cut = "-- Keep this, please: And this text of a dozen words more than the passage holds in all"
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((d, t, "mine", "a", "p", "w", "l") for d, t in [(1, cut), (1, cut), (3, None), (4, "clean"), (4, "clean"), (None, cut)]), key=str)
    for most in (50_000, 0):
        kept = decontaminate.drop_contaminated(docs, items, max_windows=most).collect()
        assert sorted((r["doc_id"], r["row_key"]) for r in kept) == [(3, "mine"), (4, "mine"), (4, "mine")]


def test_hits_by_joins_equal_hits_by_literals(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    few, many = (sorted(map(str, decontaminate.find_hits(docs, items, max_windows=most).collect())) for most in (50_000, 0))
    assert few == many and any("n_hit=0" not in r for r in few)


@pytest.mark.parametrize("name", ["op7_url_filter", "op8_chat_format", "op9_decontaminate"])
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir):
    same_rows(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])
