"""Places on the sphere, the probe's query, requests by picture: cases beyond their SQL."""

import math
import random

import numpy as np
import pytest

from shelfmark.operators import geo, probe, requests
from shelfmark.plans import registry


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("few", [0, 0.01, 4])
def test_nearest_place_against_all_cities(spark, monkeypatch, few):
    """With one, two and three levels of cells; at the seam, by the poles, at the same place, clusters of cities."""
    monkeypatch.setattr(geo, "FEW_CITIES", few)
    rnd = random.Random(3)
    cities = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(150)] + [(200 + k, 48 + rnd.random(), 11 + rnd.random()) for k in range(100)]
    cities += [(400, 89.9, 10.0), (401, -89.9, -170.0), (402, 0.0, 180.0), (403, 0.0, -180.0)]
    points = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(200)]
    points += [(300 + k, lat, lon) for k, (lat, lon) in enumerate([(90.0, 0.0), (-90.0, 77.0), (89.0, -170.0), (-89.0, 10.0), (10.0, 180.0), (10.0, -180.0), (-0.1, 179.99), (0.1, -179.99), (48.5, 11.5)])]
    p, c = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (points, cities))
    got = {r["id"]: r["km"] for r in geo.nearest_city(p, c, exact=True).collect()}
    assert got == {i: pytest.approx(min(km((la, lo), x[1:]) for x in cities), abs=0.0501) for i, la, lo in points}
    assert geo.nearest_city(p, c.where("id < 0"), exact=True).count() == 0


def test_probe_query_is_the_plain_fit(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    used = [(e, y) for _, e, y in rows if y in (0, 1)]
    w, b = probe.fit_local(np.array([e for e, _ in used], float), np.array([y for _, y in used], float))
    got = {r["id"]: r["score"] for r in registry.queries()["probe_scores"](spark, sf_dir).collect()}
    assert got == {i: pytest.approx(1 / (1 + math.exp(-(np.array(e, float) @ w + b))), abs=2e-6) for i, e, _ in rows}


def test_passes_and_one_task_give_one_probe(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(k, (rng.normal(size=3) + k % 2).tolist(), k % 2) for k in range(30)]
    examples = spark.createDataFrame(data, "id long, embedding array<double>, label int")
    one = probe.fit(examples, epochs=6)
    monkeypatch.setattr(probe, "HELD_VALUES", 0)
    many = probe.fit(examples, epochs=6)
    assert np.allclose(one.weights, many.weights, atol=1e-12) and (one.accuracy, one.scheme) == (many.accuracy, many.scheme)


def test_boxes_leave_out_the_whole_image(spark):
    rows = [(1, 0.0, 0.0, 100.0, 50.0, 0.9), (1, 0.0, 0.0, 50.0, 25.0, 0.4), (1, 50.0, 0.0, 100.0, 25.0, 0.4), (1, 0.0, 0.0, 100.0, 46.0, 0.8), (2, 0.0, 0.0, 10.0, 10.0, 0.3), (3, 0.0, 0.0, 0.0, 0.0, 0.1)]
    t = spark.createDataFrame(rows, "file_id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = {r["file_id"]: (r["score"], r["box"]) for r in requests.best_tiles(t).collect()}
    assert got == {1: (0.9, [0.0, 0.0, 0.5, 0.5]), 2: (0.3, None), 3: (0.1, [0.0, 0.0, 0.0, 0.0])}


def test_an_unknown_name_or_region_finds_nothing(spark):
    faces = spark.createDataFrame([("ann", "c1")], "identity string, checksum string")
    aliases = spark.createDataFrame([("nan", "ann")], "alias string, owner string")
    assert [r["checksum"] for r in requests.more_of_identity("nan", faces, faces.limit(0), aliases).collect()] == ["c1"]
    assert requests.more_of_identity("bob", faces, faces, aliases).count() == 0
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, [1.0])], "file_id long, x1 double, y1 double, x2 double, y2 double, embedding array<double>")
    wholes = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, embedding array<double>")
    region = spark.createDataFrame([(1, [1.0])], "file_id long, embedding array<double>")
    assert requests.region_search(region, tiles, wholes).count() == 0  # the only tile is of the region's own file
    assert [r["file_id"] for r in requests.region_search(region, tiles.limit(0), wholes).collect()] == [2]
    assert requests.region_search(region.limit(0), tiles, wholes).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_a_hot_place_is_searched_once(spark, monkeypatch, exact):
    """Points of one place, also at -0.0, and cities of one place meet as one; points and ids keep their rows."""
    met = []
    searched = geo._nearest
    monkeypatch.setattr(geo, "_nearest", lambda pairs, *a: met.append(pairs.count()) or searched(pairs, *a))
    points = [(k, 89.5, 179.95) for k in range(40)] + [(100, 0.0, 5.0), (101, -0.0, 5.0), (102, 50.0, None)]
    cities = [(k, 70.0, 179.0) for k in range(9, 29)] + [(k, 0.5, 5.5) for k in range(40, 60)] + [(1, None, 3.0)]
    p, c = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (points, cities))
    got = {r["id"]: (r["city_id"], r["km"]) for r in geo.nearest_city(p, c, exact=exact).collect()}
    far, near = round(km((89.5, 179.95), (70.0, 179.0)), 1), round(km((0.0, 5.0), (0.5, 5.5)), 1)
    assert got == {k: (9, far) for k in range(40)} | {100: (40, near), 101: (40, near)}
    assert sum(met) <= 4
