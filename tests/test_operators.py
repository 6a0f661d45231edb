"""Hand-made cases of single operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scalar
from shelfmark.operators import catalog, curation, geo, probe, queues, rosters, search, vectors
from shelfmark.sources import files, scan, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def rows_any(df):
    return [str(tuple(r)) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_primary_path_is_the_last_seen(spark):
    paths = spark.createDataFrame([(1, "a", 1), (1, "b", 5), (2, "c", 3)], "file_id long, path string, last_seen_at long")
    assert rows(catalog.primary_paths(paths)) == [(1, "b"), (2, "c")]


def test_scan_classes(spark):
    old = spark.createDataFrame([(1, "c1", "a", 1, 10)], "id long, checksum string, path string, size long, seen long")
    files = catalog.canonical_files(old)
    scanned = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("x", "c2"), ("y", "c2"), ("z", "c3")], "path string, checksum string")
    out = catalog.classify_scan(scanned, files, catalog.attach_paths(files, old)).select("path", "kind", "repeats")
    assert rows(out) == [("a", "already_indexed", None), ("b", "duplicate", "a"), ("x", "new", None), ("y", "duplicate", "x"), ("z", "new", None)]
    tracked = catalog.classify_scan(scanned, files, catalog.attach_paths(files, old), "track").where("path = 'b'").first()
    assert tracked["kind"] == "new_path"


def test_prefix_does_not_take_a_sibling(spark):
    df = spark.createDataFrame([("a/b/x",), ("a/b-old/y",), ("a_b/x",), ("aXb/y",), ("a/b",)], "path string")
    assert rows(df.where(catalog.under_folder(F.col("path"), "a/b"))) == [("a/b",), ("a/b/x",)]
    assert rows(df.where(catalog.under_folder(F.col("path"), "a_b"))) == [("a_b/x",)]


def test_tree_level_of_the_root(spark):
    files = spark.createDataFrame([(1, False), (2, False), (3, False)], "id long, hidden boolean")
    paths = spark.createDataFrame([(1, "d/1"), (2, "d/e/2"), (3, "3")], "file_id long, path string")
    assert rows(catalog.browse_folder(files, paths, "")) == [("file", "3", 1), ("folder", "d", 2)]


def test_neighbours_across_buckets(spark):
    files = spark.createDataFrame([(3,), (12,), (19,), (40,)], "id long")
    assert sorted(map(tuple, catalog.neighbours(files, 10).collect())) == [(3, None, 12), (12, 3, 19), (19, 12, 40), (40, 19, None)]


def test_has_more_sees_an_exact_last_page(spark):
    df = spark.range(4)
    assert catalog.has_more(df, [F.col("id")], 2)
    assert not catalog.has_more(df, [F.col("id")], 2, 2)


def test_ignore_rules(spark):
    paths = spark.createDataFrame([("x/a.jpg",), ("cache/y.png",), ("p/tmp1/z",), ("a/q.png",), ("a/b/c.png",), ("keep/me.txt",)], "path string")
    hit = rows(paths.where(scan.ignore_condition(F.col("path"), ["*.jpg", "cache", "**/tmp*", "a/*.png", "# no", ""])))
    assert hit == [("a/b/c.png",), ("a/q.png",), ("cache/y.png",), ("p/tmp1/z",), ("x/a.jpg",)]
    assert rows(paths.where(scan.ignore_condition(F.col("path"), ["cache/"]))) == [("cache/y.png",)]


def test_scan_and_markers(spark, tmp_path):
    import xxhash

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jpg").write_bytes(b"one")
    (tmp_path / "d" / "b.txt").write_bytes(b"two")
    (tmp_path / "d" / "categories.marker").write_text("cats\n# no\ndogs\n")
    found = scan.content_hash(scan.media_only(scan.contents(spark, str(tmp_path))))
    assert [r["checksum"] for r in found.collect()] == [xxhash.xxh64(b"one").hexdigest()]
    markers = scan.read_markers(spark, str(tmp_path))
    assert [(r["kind"], r["lines"]) for r in markers.collect()] == [("categories", ["cats", "dogs"])]
    marks = spark.createDataFrame([("a/b", "categories", ["x"]), ("a", "noface", [])], "folder string, kind string, lines array<string>")
    paths = spark.createDataFrame([("c1", "a/b/f"), ("c2", "a/b-old/f")], "checksum string, path string")
    assert rows(scan.apply_markers(marks, paths)) == [("c1", "categories", "x"), ("c1", "noface", "true"), ("c2", "noface", "true")]


def test_set_entries_by_hash_then_path(spark):
    paths = spark.createDataFrame([("c1", "p1"), ("c2", "p2")], "checksum string, path string")
    entries = spark.createDataFrame([("s", "nope", "c1"), ("s", "p2", "gone"), ("s", "lost", "lost")], "set_name string, path string, checksum string")
    good, bad = scan.resolve_set_entries(entries, paths)
    assert rows(good) == [("s", "c1"), ("s", "c2")] and rows(bad) == [("s", "lost")]


def test_places(spark, tmp_path):
    good = "\t".join(["7", "Ulm", "", "", "48.4", "10.0", "", "", "DE", "", "01", "", "", "", "x"])
    bad = "\t".join(["8", "Nowhere", "", "", "north", "10.0", "", "", "DE", "", "01", "", "", "", "5"])
    (tmp_path / "t.tsv").write_text(f"{good}\n{bad}\nshort\trow\n")
    assert rows(scan.read_places(spark, str(tmp_path / "t.tsv"))) == [(7, "Ulm", 48.4, 10.0, "DE", "01", 0)]
    with pytest.raises(ValueError):
        scan.replace_places(spark.createDataFrame([], "id long"), spark.range(1))


def test_versions_and_reports(spark, tmp_path):
    root = str(tmp_path / "lib")
    sinks.commit(spark, root, {"t": spark.range(1)}, 1)
    sinks.commit(spark, root, {"t": spark.range(3)}, 2)
    assert sinks.latest(spark, root, "t").count() == 3
    classified = spark.createDataFrame([("n", "duplicate", "o"), ("m", "new", None)], "path string, kind string, repeats string")
    sinks.duplicate_report(classified, str(tmp_path / "dup"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "dup")).collect()] == ["n\to"]
    sinks.log_errors(spark.createDataFrame([("p", "bad")], "path string, message string"), str(tmp_path / "err"))
    assert sinks.list_errors(spark.read.parquet(str(tmp_path / "err")), unread_only=True).count() == 1


def test_floored_counter(spark):
    changes = spark.createDataFrame([("k", 1, -1), ("k", 2, 1), ("k", 3, 1), ("k", 4, -5), ("k", 5, 1)], "key string, at long, delta int")
    assert rows(curation.floored_counters(changes, "key")) == [("k", 1)]
    start = spark.createDataFrame([("k", 4), ("j", 2)], "key string, count long")
    assert rows(curation.floored_counters(changes, "key", start=start)) == [("j", 2), ("k", 1)]
    gone = spark.createDataFrame([("f", 1, -1), ("f", 2, 2), ("f", 3, -2)], "key string, at long, delta int")
    assert rows(curation.favourite_counters(gone, "key")) == []


def test_upsert_is_idempotent(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, at long")
    once = curation.upsert(state, changes, ["id"], "at")
    assert rows(once) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(curation.upsert(once, changes, ["id"], "at")) == rows(once)


def test_sets_are_created_null_safe(spark):
    sets = spark.createDataFrame([(4, "S", None)], "id long, name string, studio string")
    wanted = spark.createDataFrame([("S", None), ("S", "x"), ("S", "x")], "name string, studio string")
    out = curation.create_sets(sets, wanted).collect()
    assert len(out) == 2 and {r["studio"] for r in out} == {None, "x"} and all(r["id"] >= 4 for r in out)


def test_merge_sets(spark):
    sets = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "id long, name string, favorite long")
    members = spark.createDataFrame([(1, "x", 0), (2, "x", 5), (2, "y", 6)], "set_id long, checksum string, position long")
    merges = spark.createDataFrame([(2, 1)], "source long, dest long")
    left, united, _ = curation.merge_groups(sets, members, [], merges)
    assert rows(left) == [(1, "a", 5)] and rows(united) == [(1, "x", 0), (1, "y", 6)]


def test_rename_onto_an_existing_tag(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    links = spark.createDataFrame([("x", 1), ("y", 2)], "checksum string, tag_id long")
    defs, moved = curation.rename_or_merge(tags, links, "a", "b")
    assert rows(defs) == [(2, "b")] and rows(moved) == [("x", 2), ("y", 2)]
    defs, moved = curation.rename_or_merge(tags, links, "a", "c")
    assert rows(defs) == [(1, "c"), (2, "b")] and rows(moved) == [("x", 1), ("y", 2)]


def test_positions_refs_and_exclusions(spark):
    members = spark.createDataFrame([(1, "x", None), (1, "y", 9)], "set_id long, checksum string, position long")
    ordered = spark.createDataFrame([(1, ["y", "x"])], "set_id long, checksums array<string>")
    assert rows(curation.set_positions(members, ordered)) == [(1, "x", 1), (1, "y", 0)]
    ages = spark.createDataFrame([("auto:1", 30.0), ("auto:2", 40.0), ("manual:8", 41.0)], "face_ref string, age double")
    promoted = spark.createDataFrame([("auto:1", "manual:7"), ("auto:2", "manual:8")], "auto_ref string, manual_ref string")
    assert rows(curation.migrate_refs(ages, promoted)) == [("auto:2", 40.0), ("manual:7", 30.0), ("manual:8", 41.0)]
    pair = spark.createDataFrame([("x", 1)], "checksum string, set_id long")
    none = pair.where("false")
    added, cleared = curation.assign_with_exclusions(none, pair, pair, ["checksum", "set_id"])
    assert rows(added) == [("x", 1)] and rows(cleared) == []


def test_resolver(spark):
    manual = spark.createDataFrame([("f", "A")], "checksum string, category string")
    auto = spark.createDataFrame([("f", "A", 0.9), ("f", "B", 0.8), ("f", "C", 0.7)], "checksum string, category string, score double")
    rejected = spark.createDataFrame([("f", "B")], "checksum string, category string")
    assert [(r["category"], r["source"]) for r in rosters.resolve_categories(manual, auto, rejected).orderBy("category").collect()] == [("A", "manual"), ("C", "auto")]


def test_chips(spark):
    facet = spark.createDataFrame([("t", "a", "x"), ("t", "b", "x"), ("t", "a", "y")], "type string, value string, checksum string")
    every = spark.createDataFrame([("x",), ("y",), ("z",)], "checksum string")
    assert rows(rosters.intersect_chips(facet, [], every)) == [("x",), ("y",), ("z",)]
    assert rows(rosters.intersect_chips(facet, [("t", "a"), ("t", "b")], every)) == [("x",)]
    assert rows(rosters.intersect_chips(facet, [("t", "b"), ("t", "a")], every)) == [("x",)]
    assert rows(rosters.intersect_chips(facet, [("t", "c")], every)) == []


def test_tokens_slug_fuzzy(spark):
    assert one(spark, scalar.query_tokens(F.lit("A dog at the X beach"))) == ["dog", "beach"]
    assert one(spark, scalar.slugify(F.lit("Hot  Dog!"))) == "hot_dog" and one(spark, scalar.slugify(F.lit("!!"))) == "tag"
    assert math.isclose(one(spark, scalar.fuzzy_score(F.lit("cat"), F.lit("abcaxt"))), 2.3)
    assert one(spark, scalar.fuzzy_score(F.lit("tc"), F.lit("cat"))) is None
    token = one(spark, scalar.sort_token(F.lit("dogs Date:DESC")))
    assert (token["field"], token["direction"]) == ("added", "desc")


@pytest.mark.parametrize(("w", "h", "n"), [(600, 400, 14), (20, 20, 14), (12, 12, 5), (9, 9, 1), (7, 7, 0)])
def test_tiles(spark, w, h, n):
    got = one(spark, scalar.tiles(F.lit(w), F.lit(h)))
    assert len(got) == n
    assert n == 0 or tuple(got[0]) == (0, 0, w, h)


def test_dms_boxes_and_refs(spark):
    assert one(spark, scalar.dms_to_degrees(F.array(F.lit(10.0), F.lit(30.0), F.lit(0.0)), F.lit("S"))) == -10.5
    assert one(spark, scalar.dms_to_degrees(F.array(F.lit(10.0), F.lit(30.0)), F.lit("N"))) is None
    assert one(spark, scalar.parse_box(F.lit("[]"))) is None and one(spark, scalar.parse_box(F.lit("[1,2,3,4]")))["x2"] == 3.0
    assert one(spark, scalar.exif_timestamp(F.lit("1970:01:01 00:01:00"))) == 60 and one(spark, scalar.exif_timestamp(F.lit("bad"))) is None
    assert one(spark, scalar.parse_face_ref(F.lit("auto:12")))["id"] == 12 and one(spark, scalar.parse_face_ref(F.lit("x:1"))) is None


def test_placeholder(spark):
    names = spark.createDataFrame([("Unnamed 1",), ("Unnamed 3",), ("Ann",)], "identity string")
    assert scalar.next_placeholder(names).first()["name"] == "Unnamed 2"
    assert scalar.next_placeholder(names.where("identity = 'Ann'")).first()["name"] == "Unnamed 1"


def test_centroids_and_rocchio(spark):
    schema = "id long, embedding array<float>"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], schema)
    assert vectors.centroids(v.where("id = 9")).first()["centroid"] is None
    assert vectors.centroids(v.where("id IN (1, 3)")).first()["centroid"] is None
    c = vectors.centroids(v.where("id IN (1, 2)")).first()["centroid"]
    assert np.allclose(c, [2**-0.5, 2**-0.5])
    for negative, weight in ((v.where("id = 9"), 0.5), (v.where("id = 1"), 0.0)):
        assert np.allclose(vectors.rocchio(v.where("id IN (1, 2)"), negative, weight).first()["centroid"], c)
    assert np.allclose(vectors.rocchio(v.where("id = 1"), v.where("id = 1"), 1.0).first()["centroid"], [1, 0])


def test_top_k_and_bands(spark):
    v = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(6)], "id long, embedding array<float>")
    full = vectors.similar_to(v, 0, 10).collect()
    assert len(full) == 5 and [r["id"] for r in vectors.similar_to(v, 0, 2).collect()] == [r["id"] for r in full[:2]]
    joined = vectors.top_k_join(v.where("id = 0"), v, 2).orderBy("rank").collect()
    assert [r["id"] for r in joined] == [r["id"] for r in full[:2]]
    assert vectors.top_k_join(v.where("id = 99"), v, 2).count() == 0
    scored = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.9)], "id long, score double")
    assert rows(vectors.in_band(scored, 0.3, 0.9)) == [(2, 0.5)]


def test_cohorts_of_one_have_no_outlier(spark):
    faces = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "b", [0.0, 1.0]), (4, "b", [0.6, 0.8])], "id long, identity string, embedding array<float>")
    reviewed = spark.createDataFrame([(4,)], "id long")
    out = vectors.cohort_outliers(faces, reviewed=reviewed).orderBy("score").collect()
    assert [(r["id"], round(r["score"], 3)) for r in out] == [(2, 0.6), (3, 0.8)]


def test_bias_reorder(spark):
    cards = spark.createDataFrame([("B", 0), ("A", 1), ("C", 2), ("A", 3)], "k string, place int")
    assert [r["k"] for r in vectors.bias_reorder(cards, F.col("k"), "A", "confirm").collect()] == ["A", "A", "B", "C"]
    assert [r["k"] for r in vectors.bias_reorder(cards, F.col("k"), "A", "reject").collect()] == ["B", "C", "A", "A"]


def test_nearest_city(spark):
    schema = "id long, lat double, lon double"
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 60.0, 60.0), (3, None, None), (4, 0.0, 179.9)], schema)
    cities = spark.createDataFrame([(1, 10.5, 10.5), (2, 10.1, 10.1), (3, 0.0, -179.9)], schema)
    got = {r["id"]: (r["city_id"], r["km"]) for r in geo.nearest_city(points, cities).collect()}
    assert got[1][0] == 2 and got[2][0] == 1 and 3 not in got and got[4][0] == 3
    assert geo.nearest_city(points, cities, max_km=20.0).count() == 1
    assert geo.nearest_city(points, cities.where("id = 9")).count() == 0


def test_queues(spark):
    files = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(1, 0), (2, 5)], "file_id long, frame_index int")
    assert rows(queues.unprocessed(files, done)) == [(2,), (3,)]
    table = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "file_id long, frame_index int, v string")
    assert rows(queues.clear_primary(table, files.where("id = 1").select(F.col("id").alias("file_id")))) == [(1, 1, "b"), (2, 0, "c")]


def test_class_search_skips_the_sentinel(spark):
    d = spark.createDataFrame([(1, "dog", 0.5, 0), (1, "hot dog", 0.4, 0), (1, "__indexed__", 1.0, 0), (2, "dog", 0.9, 3)], "file_id long, class_name string, confidence double, frame_index int")
    got = search.search_classes(d, ["dog"]).collect()
    assert len(got) == 1 and math.isclose(got[0]["score"], 0.9)


def test_missing_values_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 1.0)], "id long, age double")
    assert [r["id"] for r in df.orderBy(*search.sort_keys("age", "asc")).collect()] == [3, 2, 1]
    assert [r["id"] for r in df.orderBy(*search.sort_keys("age", "desc")).collect()] == [2, 3, 1]


def test_probe(spark):
    rng = np.random.default_rng(1)
    data = [(k, (rng.normal(size=4) + (3 if k % 2 else -3)).tolist(), k % 2) for k in range(40)]
    examples = spark.createDataFrame(data, "id long, embedding array<double>, label int")
    fitted = probe.fit(examples, epochs=60)
    assert fitted.scheme == "80/20" and fitted.accuracy == 1.0
    assert probe.fit(examples.where("id < 10"), epochs=5).scheme == "5-fold"
    with pytest.raises(ValueError):
        probe.fit(examples.where("id < 8"))
    scored = probe.score(examples, fitted).join(examples, "id").collect()
    assert all((r["score"] > 0.5) == (r["label"] == 1) for r in scored)


def test_probe_is_the_same_fit_at_every_size(spark):
    """Also beyond 50,000 rows the weights are those of full-batch Adam."""
    n = 50_200
    x = np.random.default_rng(2).normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 > 0).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "embedding": x.tolist(), "label": y})
    fitted = probe.fit(spark.createDataFrame(pdf, "id long, embedding array<double>, label int"))
    w, b = probe.fit_local(x, y)
    assert np.allclose(fitted.weights, w, atol=1e-9) and abs(fitted.bias - b) < 1e-9
    assert fitted.scheme == "80/20" and fitted.accuracy > 0.95


def test_calibration(spark):
    scored = spark.range(1000).select("id", (F.col("id") / 1000).alias("score"))
    safe = probe.calibrate(scored, lambda r: r["score"] > 0.6)
    assert 0.6 <= safe <= 0.63 + 1e-9


def test_streamed_upserts(spark, tmp_path):
    from shelfmark.streaming import ingest

    source = str(tmp_path / "in")
    table = str(tmp_path / "t")

    def feed(data):
        spark.createDataFrame(data, "id long, v string, at long").coalesce(1).write.mode("append").parquet(source)
        stream = ingest.stream_listing(spark, source, "id long, v string, at long")
        ingest.upsert_stream(stream, table, ["id"], "at", str(tmp_path / "cp"), buckets=8).trigger(availableNow=True).start().awaitTermination()

    feed([(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    assert rows(ingest.read_upserted(spark, table, 0)) == [(1, "b", 2), (2, "c", 1)]
    feed([(2, "d", 5), (3, "e", 1), (None, "f", 1)])
    assert sorted(rows_any(ingest.read_upserted(spark, table, 1))) == sorted([str((1, "b", 2)), str((2, "d", 5)), str((3, "e", 1)), str((None, "f", 1))])
    written = {r["bucket"] for r in spark.read.parquet(f"{table}/data/v=1").select("bucket").distinct().collect()}
    assert len(written) <= 3  # only the buckets of the new keys


def test_block_joins_equal_one_block(spark, sf_dir, monkeypatch):
    """Many small blocks on both sides give the rows of a single one."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding", "cast(label AS int) AS label").where("id < 200")
    some = v.where("id % 2 = 0")

    def results():
        yield vectors.top_k_join(some, v, 5)
        yield vectors.nearest_label(v, some, "label", -1.0)
        yield vectors.max_similarity(v, some, "label", 0.1)
        yield vectors.cohort_outliers(v, "label")
        yield vectors.category_matches(v, v.selectExpr("label AS category", "embedding"), v.selectExpr("label AS category", "label / 20.0 AS temperature").distinct(), some.selectExpr("id", "label AS category"))

    whole = [sorted((*r[:2], round(r["score"], 9)) for r in df.collect()) for df in results()]
    for name, rows_ in {"BLOCK": 16, "SLICE": 5, "COHORT_BLOCK": 16, "HELD_ROWS": 40}.items():
        monkeypatch.setattr(vectors, name, rows_)
    parts = [sorted((*r[:2], round(r["score"], 9)) for r in df.collect()) for df in results()]
    assert whole == parts and all(whole)


def test_runs_of_a_counter_compose(spark):
    rnd = random.Random(3)
    changes = [(rnd.choice("ab"), k, rnd.choice([-2, -1, 1, 1])) for k in range(500)]
    want = {}
    for key, _, d in changes:
        want[key] = max(0, want.get(key, 4) + d)
    df = spark.createDataFrame(changes, "key string, at long, delta int")
    start = spark.createDataFrame([("a", 4), ("b", 4)], "key string, count long")
    for width in (1, 7, 10_000):
        assert {r["key"]: r["count"] for r in curation.floored_counters(df, "key", start=start, width=width).collect()} == want


def test_nearest_city_against_all_cities(spark):
    rnd = random.Random(4)
    cities = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(150)]
    points = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(300)] + [(900, 89.9, 179.9), (901, -89.9, -180.0), (902, 0.0, 180.0)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    got = {r["id"]: r["city_id"] for r in geo.nearest_city(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(cities, "id long, lat double, lon double")).collect()}
    for p in points:
        boxed = [c for c in cities if abs(c[1] - p[1]) <= 0.75 and abs(c[2] - p[2]) <= 0.75]
        assert got[p[0]] == min(boxed or cities, key=lambda c: (km(p, c), c[0]))[0]


def test_terms_and_failures(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# kinds\r\ncat\n\n  hot dog \ncat\n")
    assert [r["term"] for r in scan.read_terms(spark, str(tmp_path / "terms.txt")).orderBy("pos").collect()] == ["cat", "hot dog", "cat"]

    def model(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["id"] * 2, "error": [None if k % 2 else "odd" for k in pdf["id"]]})

    good, bad = scan.map_model(spark.range(5), model, "id long, v long, error string", str(tmp_path / "rows"))
    assert rows(good.select("id", "v")) == [(1, 2), (3, 6)] and rows(bad.select("id")) == [(0,), (2,), (4,)]


def test_detection_dataset(spark, tmp_path):
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(5.0).alias("x2"), F.lit(10.0).alias("y2"))
    boxes = spark.range(200).select(F.concat(F.lit("c"), F.col("id") % 103).alias("checksum"), F.lit(1).alias("class_id"), box.alias("box"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    root = tmp_path / "set"
    for _ in range(2):  # a second run replaces the first
        sinks.detection_dataset(boxes, str(root), "dog's")
        files = {str(p.relative_to(root)): p.read_text() for p in root.rglob("*.*") if p.is_file()}
        assert files.pop("data.yaml").endswith("names: [\"dog's\"]\n")
        assert sum("/val/" in f for f in files) == 20 and sum("/train/" in f for f in files) == 83
        assert files["labels/train/c5.txt" if "labels/train/c5.txt" in files else "labels/val/c5.txt"] == "1 0.250000 0.250000 0.500000 0.500000\n" * 2
        assert not list(root.glob("_staged*"))
    with pytest.raises(ValueError):
        sinks.detection_dataset(boxes.limit(9), str(root), "x")


def test_an_aborted_write_leaves_no_file(spark, tmp_path):
    files.register(spark)
    root = tmp_path / "out"
    rows = spark.range(40).select(F.concat(F.lit("a/"), "id").alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").alias("value")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        rows.write.format("text_files").mode("append").save(str(root))
    assert not [p for p in root.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([("../x", "y")], "path string, value string").write.format("text_files").mode("append").save(str(root))


def test_split_is_exact(spark):
    for n, val in ((1, 0), (2, 1), (4, 1), (10, 2), (999, 199)):
        images = spark.range(n).select(F.concat(F.lit("c"), "id").alias("checksum"))
        got = sinks.split_images(images.union(images)).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in got} == {k: v for k, v in (("val", 2 * val), ("train", 2 * (n - val))) if v}
    assert sinks.split_images(images.limit(0)).count() == 0


def test_listing_of_a_tree(spark, tmp_path):
    names = ["a.txt", "x/b.txt", "x/y/c.txt", "z/d.txt", "z/.media/e.txt", ".media/f.txt"]
    for k, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1" * k)
    files.register(spark)
    for depth in (0, 1, 2, 5):
        got = spark.read.format("file_tree").option("depth", depth).load(str(tmp_path))
        assert sorted((r["path"], r["size"]) for r in got.collect()) == [(n, k) for k, n in enumerate(names[:4])]
    assert spark.read.format("file_tree").option("skip", "").load(str(tmp_path)).count() == 6
    assert spark.read.format("file_tree").load(f"file://{tmp_path}").where("size > 1").count() == 2



def test_windowed_views(spark, tmp_path):
    from shelfmark.streaming import ingest

    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, 'view' AS event_type FROM range(6)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_views(stream).writeStream.format("memory").queryName("views").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("views").collect()) == [3, 3]
