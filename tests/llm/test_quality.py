"""Compression classifier and line labelling."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from shelfmark.llm import compression_quality, line_crf

DOCS = "doc_id long, text string, lang string, score string"


def edge(spark):
    return spark.createDataFrame([(1, None, "x", "s"), (2, "", "x", "s"), (3, "word " * 40000, "x", "s"), (3, "word " * 40000, "x", "s"), (None, "a b", None, None)], DOCS)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = compression_quality.op3_quality_classifier(spark, docs, labels).cache()
    assert scored.count() == docs.count()
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert compression_quality.held_out_accuracy(scored, labels) >= 0.93


def test_scores_against_brute_force(spark, sf_dir):
    """Every score from the two compressed sizes, worked out text by text; slices of few bytes change nothing."""
    import math

    import zstandard

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 40000)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    model = compression_quality.learn(docs, labels)
    packers = [zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad)]
    got = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in compression_quality.op3_quality_classifier(spark, every, labels).collect()}
    for r in every.collect():
        raw = (r["text"] or "").encode()
        a, b = (len(p.compress(raw)) for p in packers)
        x = [(b - a) / (a + b), (b - a) / (len(raw) + 300), (a + b) / (2 * len(raw) + 300)]
        x = [(v - m) / s for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        terms = [1.0, *x, *[x[i] * x[j] for i in range(3) for j in range(i, 3)]]
        score = 1 / (1 + math.exp(-max(-35, min(35, sum(t * w for t, w in zip(terms, model.weights, strict=True))))))
        mine = got.pop(r["doc_id"])
        assert abs(mine[0] - score) < 1e-9 and mine[1] == int(score >= 0.5) and mine[2] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert not got


def test_labels_that_are_held_out_change_nothing(spark, sf_dir):
    from pyspark.sql import functions as F

    from shelfmark.llm.common import crc32_mod

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(crc32_mod(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression_quality.learn(docs, labels) == compression_quality.learn(docs, flipped)


def test_edges_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = compression_quality.op3_quality_classifier(spark, edge(spark), labels).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    model = compression_quality.learn(edge(spark), labels)
    kept = compression_quality.keep_good(edge(spark), model)
    assert kept.columns == edge(spark).columns and kept.count() == 5
    assert compression_quality.op3_quality_classifier(spark, edge(spark).where("false"), labels).count() == 0


def test_few_labels_still_fit(spark, sf_dir):
    """Ten texts of the bad class, and one of each; only an absent class leaves the prior."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = compression_quality.op3_quality_classifier(spark, docs, labels)
    assert {r["predicted"] for r in scored.select("predicted").distinct().collect()} == {0, 1}
    two = spark.createDataFrame([(1, "good words of a text", "x", "s"), (2, "zzz $$$ zzz", "x", "s"), (3, "", "x", "s")], DOCS)
    assert compression_quality.train(two, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")).weights
    assert compression_quality.train(two, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, label int")).scores(["a"])[0] >= 0
    assert not compression_quality.train(two, spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, label int")).weights


def test_rows_of_a_repeated_id_reach_the_driver_once(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    hot = labels.where("quality = 1").join(docs, "doc_id").orderBy("doc_id").select(docs.columns).limit(3)
    more = docs.unionByName(hot.crossJoin(spark.range(200)).drop("id"))
    assert compression_quality.learn(more, labels) == compression_quality.learn(docs, labels)
    a, b = line_crf.learn(more, labels), line_crf.learn(docs, labels)
    assert np.array_equal(a.emission, b.emission) and np.array_equal(a.transition, b.transition)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    rnd = random.Random(5)
    parts = ["a", "b", "é ", "\n", " ", "#", "x y", "😀", "\t", "\r\n", "a b c d e "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(2000)] + ["", "a"]
    m = line_crf.measure(texts)
    got = zip(*[a.tolist() for a in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)], strict=True)
    assert list(got) == [brute(t) for t in texts]


def test_viterbi_against_all_paths():
    rng, rnd = np.random.default_rng(0), random.Random(0)
    for _ in range(100):
        chain = np.sort([rnd.randrange(4) for _ in range(rnd.randint(1, 14))])
        scores, moves = rng.normal(size=(len(chain), 2)), rng.normal(size=(2, 2))
        labels = line_crf.viterbi(scores, moves, chain, 4)
        for c in set(chain.tolist()):
            at = np.flatnonzero(chain == c)
            paths = itertools.product([0, 1], repeat=len(at))
            best = max(paths, key=lambda p: sum(scores[i, x] for i, x in zip(at, p, strict=True)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)))
            assert tuple(labels[at]) == best


def test_crf_keeps_clean_documents(spark):
    """On labels that the fit has not seen."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = line_crf.op6_line_crf(spark, docs, labels)
    both = got.join(labels, "doc_id").where("NOT base_failed AND pmod(crc32(cast(doc_id AS string)), 3) = 1")
    good = both.where("quality = 1")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert both.where("quality = 0 AND kept").count() <= 0.2 * max(1, both.where("quality = 0").count())


def spoil(line, kind):
    """The kinds of junk in the tables: shouted twice, cut to cells, marked, stammered."""
    words = line.split()
    mark = random.Random(line)
    return [" ".join([w.upper() + "!!" for w in words] * 2), " | ".join(words), " ".join(w + mark.choice(["***", "$$$", "&&&"]) for w in words), " ".join(" ".join([w] * 7) for w in words)][kind]


def test_lines_of_mixed_documents():
    """Documents that change between clean and spoiled lines; every line's state is known."""
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT text, quality FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) WHERE length(text) < 20000 ORDER BY hash(doc_id)").fetchall()
    sample = [r for q in (0, 1) for r in [x for x in rows[:-600] if x[1] == q][:150]]
    field = line_crf.train(sample)
    clean = [line for t, q in rows[-600:] if q for line in t.split("\n") if len(line.split()) >= 8]
    rnd, texts, truth = random.Random(2), [], []
    for n in range(200):
        lines, state = [], rnd.random() < 0.5
        while len(lines) < 8:
            for line in rnd.sample(clean, rnd.randint(1, 4)):
                lines.append(line if state else spoil(line, n % 4))
                truth.append(state)
            state = not state
        texts.append("\n".join(lines))
    m = line_crf.measure(texts)
    got = line_crf.viterbi(m.features @ field.emission, field.transition, m.line_text, len(texts)) == 1
    truth = np.array(truth)
    assert got[truth].mean() >= 0.97 and (~got[~truth]).mean() >= 0.85
    mixed = [0 < got[m.line_text == k].mean() < 1 for k in range(len(texts))]
    assert np.mean(mixed) >= 0.8


#: Furniture of web pages as whole lines; the field knows such lines by the share of listed words, so lines without any are no part of this.
FOOTERS = [
    "Share the terms of your privacy with the login menu.",
    "We use cookies to improve your visit. Accept all cookies or change your settings.",
    "Copyright 2021 Example Ltd. All rights reserved.",
    "Subscribe to our newsletter and follow us",
    "Home | About us | Contact | Sitemap",
    "Read more at https://example.com/a/b?c=1",
    "Alle Rechte vorbehalten. Impressum Datenschutz",
    "Impressum - AGB - Datenschutzerklärung",
    "Jetzt anmelden oder registrieren",
    "Tous droits réservés. Mentions légales",
    "Conditions générales d'utilisation - Confidentialité",
    "Todos los derechos reservados. Aviso legal",
    "Política de privacidad y condiciones de uso",
    "Читайте также другие новости на нашем сайте.",
    "Все права защищены.",
]


def test_footers_in_clean_documents(spark):
    """Site furniture before, within and after held-out clean documents is boilerplate; the documents' lines stay content."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = line_crf.learn(docs, labels)
    held_out = docs.join(labels.where("quality = 1"), "doc_id").where("pmod(crc32(cast(doc_id AS string)), 3) = 1 AND length(text) < 20000")
    clean = [r["text"].split("\n") for r in held_out.select("text").collect()]
    clean = [[line for line in lines if len(line.split()) >= 8] for lines in clean]
    clean = [lines for lines in clean if len(lines) >= 3]
    assert len(clean) >= 20
    rnd, texts, truth = random.Random(3), [], []
    for n in range(300):
        lines = [(line, True) for line in clean[n % len(clean)]]
        place = rnd.choice([0, len(lines) // 2, len(lines)])
        lines[place:place] = [(f, False) for f in rnd.sample(FOOTERS, rnd.randint(1, 3))]
        texts.append("\n".join(line for line, _ in lines))
        truth += [state for _, state in lines]
    m = line_crf.measure(texts)
    got = line_crf.viterbi(m.features @ field.emission, field.transition, m.line_text, len(texts)) == 1
    truth = np.array(truth)
    assert (~got[~truth]).mean() >= 0.85 and got[truth].mean() >= 0.98
    share = np.bincount(m.line_text, m.line_words * got) / m.n_words
    bare = line_crf.measure(["\n".join(lines) for lines in clean])
    plain = line_crf.viterbi(bare.features @ field.emission, field.transition, bare.line_text, len(clean)) == 1
    before = np.bincount(bare.line_text, bare.line_words * plain, len(clean)) / bare.n_words >= 0.5
    heavy = np.bincount(m.line_text, m.line_words * ~truth) / m.n_words > 0.3
    assert ((share >= 0.5) == before[np.arange(300) % len(clean)])[~heavy].all()


def test_site_words_as_measured():
    """Words count with the marks around them, capitalised and in capitals, also those that end in a letter beyond ASCII."""
    lines = ["Confidentialité, Impressum!", "CONFIDENTIALITÉ", "Подпишитесь", "ПОДПИШИТЕСЬ.", "cookie, x y z", "x cookies9 y"]
    m = line_crf.measure(["\n".join(lines)])
    assert m.features[:, line_crf.SITE].tolist() == [1, 1, 1, 1, 0.25, 0]
    links = line_crf.measure(["see https://a.b/c now :// x", "a:// b", "", "x"]).features[:, line_crf.LINKS]
    assert links.tolist() == [2 / 5, 1 / 2, 0]


def test_fit_climbs_the_exact_likelihood():
    """Against all paths: no small step from the fitted field has a higher posterior."""
    rng = np.random.default_rng(4)
    n_features = line_crf.LINKS + 1
    chains = [(rng.normal(size=(n, n_features)), rng.integers(0, 2, n)) for n in (1, 2, 5, 3, 4, 4)]
    total, mean = sum(len(y) for _, y in chains), line_crf.prior(n_features)

    def posterior(emission, transition):
        value = 0.0
        for x, y in chains:
            s = x @ emission

            def score(path, s=s):
                return sum(s[i, k] for i, k in enumerate(path)) + sum(transition[a, b] for a, b in itertools.pairwise(path))

            value += score(tuple(y)) - np.log(sum(np.exp(score(p)) for p in itertools.product([0, 1], repeat=len(y))))
        return value / total - 0.05 * (((emission - mean) ** 2).sum() + (transition**2).sum())

    field = line_crf.fit(chains, steps=800, rate=0.05, l2=0.1)
    best = posterior(field.emission, field.transition)
    for _ in range(60):
        e, t = rng.normal(size=(n_features, 2)) * 0.02, rng.normal(size=(2, 2)) * 0.02
        assert posterior(field.emission + e, field.transition + t) < best


def test_states_keep_within_the_label():
    words = np.array([10, 1, 1])
    content = np.array([True, True, False])
    assert line_crf.within_bounds(content, np.array([3.0, 1.0, -1.0]), words, 0).tolist() == [False, False, False]
    assert line_crf.within_bounds(content, np.array([3.0, 1.0, -1.0]), words, 1).tolist() == [True, True, False]


def test_verdicts_against_all_paths(spark, sf_dir):
    """Whole verdicts of documents with few lines: every path of states is tried."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = line_crf.learn(docs, labels)
    got = {r["doc_id"]: r for r in line_crf.judge(docs, field).collect()}
    seen = 0
    for r in docs.collect():
        m = line_crf.measure([r["text"]])
        n = len(m.line_text)
        counts = brute(r["text"])
        mine = got[r["doc_id"]]
        assert (mine["n_words"], mine["word_chars"], mine["n_symbols"], mine["n_dup_lines"], mine["n_repeat_words"]) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert mine["base_failed"] == failed
        if n <= 9:
            scores = m.features @ field.emission
            path = max(itertools.product([0, 1], repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) + sum(field.transition[a, b] for a, b in itertools.pairwise(p)))
            share = sum(w for w, x in zip(m.line_words, path, strict=True) if x) / max(1, counts[0])
            assert mine["content_lines"] == [x == 1 for x in path] and mine["kept"] == (not failed and share >= 0.5)
            seen += 1
    assert seen > 50


def test_crf_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = line_crf.op6_line_crf(spark, edge(spark), labels).orderBy("doc_id").collect()
    assert len(got) == 5 and all(r["base_failed"] and not r["kept"] for r in got)
    assert line_crf.op6_line_crf(spark, edge(spark).where("false"), labels).count() == 0
