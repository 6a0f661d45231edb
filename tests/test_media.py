"""Bytes of files, pruned search and the store of vectors."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.operators import pivots, vectors
from shelfmark.sources import media, scan, vector_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_xxh64_of_known_bytes_without_python(spark):
    rnd = random.Random(1)
    rows = [(k, bytearray(rnd.randbytes(k))) for k in [*range(300), 999, 1000]] + [(-1, None)]
    df = scan.content_hash(spark.createDataFrame(rows, "id long, content binary"))
    got = {r["id"]: r["checksum"] for r in df.collect()}
    assert got == {k: None if b is None else xxhash.xxh64(bytes(b)).hexdigest() for k, b in rows}
    assert "Python" not in plan(df) and got[0] == "ef46db3751d8e999"


# Pictures and videos


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(width=3, height=2, stream=None, more=b""):
    raw = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    stream = zlib.compress(raw) if stream is None else stream
    return media.PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + more + chunk(b"IDAT", stream[:5]) + chunk(b"IDAT", stream[5:]) + chunk(b"IEND", b"")


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def riff(*chunks):
    body = b"WEBP" + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


GIF_FRAME = bytes.fromhex("2C0000000001000100000202440100")
GIF = b"GIF89a" + struct.pack("<HHBBB", 7, 5, 0x80, 0, 0) + bytes(6)
TIFF = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(struct.pack("<HHII", *e) for e in [(256, 4, 1, 40), (257, 3, 1, 30), (0x8769, 4, 1, 50)]) + bytes(4) + struct.pack("<H", 1) + struct.pack("<HHII", 36867, 2, 20, 68) + bytes(4) + b"2020:02:03 04:05:06\0"
FILES = {
    "png": (png(), "png", 3, 2, 1, None),
    "short pixels": (png(stream=zlib.compress(b"abc")), "png", 3, 2, None, "IDAT: too few pixels"),
    "damaged pixels": (png(stream=b"no stream at all"), "png", 3, 2, None, "IDAT: damaged pixels"),
    "cut png": (png()[:-5], "png", 3, 2, None, "file ends early"),
    "apng": (png(more=chunk(b"fcTL", bytes(20) + struct.pack(">HH", 1, 4) + bytes(2)) * 2), "png", 3, 2, 2, None),
    "gif": (GIF + GIF_FRAME + b"\x3b", "gif", 7, 5, 1, None),
    "gif of no frame": (GIF + b"\x3b", "gif", 7, 5, None, "no frame"),
    "gif without end": (GIF + GIF_FRAME, "gif", 7, 5, None, "file ends early"),
    "gif block": (GIF + b"\x99", "gif", 7, 5, None, "unknown block"),
    "webp": (riff((b"VP8X", bytes(4) + bytes([8, 0, 0, 4, 0, 0])), (b"ANMF", bytes(12) + bytes([40, 0, 0, 0])), (b"ANMF", bytes(16))), "webp", 9, 5, 2, None),
    "empty webp": (riff((b"VP8X", bytes(10))), "webp", 1, 1, None, "no pixels"),
    "bmp": (b"BM" + struct.pack("<I", 30) + bytes(12) + struct.pack("<ii", 6, -4) + bytes(4), "bmp", 6, 4, 1, None),
    "tiff": (TIFF, "tiff", 40, 30, 1, None),
    "video": (box(b"ftyp", b"isom") + box(b"moov", bytes(9)) + box(b"mdat", bytes(50)), "video", None, None, 1, None),
    "video without index": (box(b"ftyp", b"isom") + box(b"mdat", bytes(50)), "video", None, None, None, "could not read a frame"),
    "cut video": ((box(b"ftyp", b"isom") + box(b"moov", bytes(9)))[:-3], "video", None, None, None, "file ends early"),
    "jpeg without scan": (bytes.fromhex("FFD8FFC0000B080005000301011100"), "jpeg", 3, 5, None, "file ends early"),
    "jpeg": (bytes.fromhex("FFD8FFC0000B080005000301011100FFDA000801010000 3F001234FFD9"), "jpeg", 3, 5, 1, None),
    "jpeg of noise": (bytes.fromhex("FFD81234"), "jpeg", None, None, None, "no marker where one is due"),
    "text": (b"hello", None, None, None, None, "unknown format"),
    "empty": (b"", None, None, None, None, "empty file"),
    "none": (None, None, None, None, None, "empty file"),
}


def test_files_of_all_kinds(spark):
    df = spark.createDataFrame([(n, None if f[0] is None else bytearray(f[0])) for n, f in FILES.items()], "name string, content binary")
    got = {r["name"]: tuple(r)[1:] for r in media.inspect(df).select("name", "kind", "width", "height", media.frame_count(), "error").collect()}
    assert got == {n: f[1:] for n, f in FILES.items()}
    times = [tuple(r) for r in media.frames(media.inspect(df).where("name IN ('apng', 'webp', 'png', 'cut png')"), "name").collect()]
    assert sorted(times) == [("apng", 0, 0), ("apng", 1, 250), ("png", 0, 0), ("webp", 0, 0), ("webp", 1, 40)]


def test_bytes_cut_anywhere_do_not_crash():
    for n, f in FILES.items():
        for end in range(len(f[0] or b"")):
            found = media.facts_of(f[0][:end])
            assert found["error"] or n in ("tiff", "video", "jpeg", "bmp"), (n, end)
    rnd = random.Random(4)
    for _ in range(2000):
        data = bytearray(rnd.choice([f[0] for f in FILES.values() if f[0]]))
        data[rnd.randrange(len(data))] = rnd.randrange(256)
        media.facts_of(bytes(data))


def test_dates_of_the_exif_directory_only_if_asked_for():
    plain, deep = ({"dates": []} for _ in range(2))
    media.exif(TIFF, plain)
    media.exif(TIFF, deep, deep=True)
    assert (plain["dates"], deep["dates"]) == ([], ["2020:02:03 04:05:06"])


def test_a_model_runs_once_on_each_file(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def model(batches):
        for pdf in batches:
            runs.add(len(pdf))
            yield pdf.assign(error=[None if i % 2 else "odd" for i in pdf["id"]])

    good, bad = scan.map_model(spark.range(10), model, "id long, error string", str(tmp_path / "out"))
    assert (good.count(), bad.count(), good.count()) == (5, 5, 5) and runs.value == 10


# Pruned search


def clustered(seed, n, dim=6, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = centres[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, dim))
    return x * rng.choice([0.5, 1.0, 3.0], n)[:, None]


def table(spark, x, first=0):
    return spark.createDataFrame([(first + k, f"l{k % 7}", v.tolist()) for k, v in enumerate(x)], "id long, label string, embedding array<double>")


def rows_of(df):
    return sorted((r["id"], r["label"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("threshold,count", [(0.3, None), (4.0, 3), (-9.0, 20), (2.0, 1)])
def test_no_hit_is_lost(spark, monkeypatch, threshold, count):
    """Clusters, lengths other than 1, zero vectors, equal rows, a row that is its own reference, blocks of a few rows."""
    monkeypatch.setattr(pivots, "BLOCK", 9)
    monkeypatch.setattr(pivots, "CHUNK", 11)
    x, y = clustered(1, 150), clustered(1, 120)
    x[7] = 0
    y[5:60] = y[4]  # a hot cluster of equal references
    y[61] = 0
    v, refs = table(spark, x), table(spark, y, 100)
    got = rows_of(pivots.nearest_label(v, pivots.build(refs, "label", count), "label", threshold))
    assert got == rows_of(vectors.nearest_label(v, refs, "label", threshold))
    scores = x @ y.T
    scores[np.arange(150)[:, None] == 100 + np.arange(120)[None, :]] = -math.inf
    assert len(got) == (scores.max(axis=1) >= threshold).sum()


def test_blocks_are_skipped(spark):
    v, refs = table(spark, clustered(2, 200)), table(spark, clustered(2, 200), 1000)
    found = pivots.nearest_with_counts(v, pivots.build(refs, "label"), 0.3).agg(F.sum("pairs")).first()[0]
    assert 0 < found < 200 * 200 / 2


def test_no_references(spark):
    v = table(spark, clustered(3, 5))
    assert pivots.build(v.where("id < 0"), "label") is None
    assert pivots.nearest_label(v, v.where("id < 0"), "label", 0.1).count() == 0
    some = pivots.build(v, "label")
    assert pivots.nearest_label(v.where("id < 0"), some, "label", 0.1).count() == 0


def test_store_of_vectors(spark, tmp_path):
    root = str(tmp_path / "store")
    v, old, new = table(spark, clustered(4, 60)), table(spark, clustered(4, 80), 500), table(spark, clustered(5, 80), 500)
    assert vector_store.version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        vector_store.load(spark, root)
    stored = vector_store.ensure(spark, root, 3, old, "label")
    first = pivots.nearest_label(v, stored, "label", 0.2)
    assert rows_of(first) == rows_of(vectors.nearest_label(v, old, "label", 0.2))
    # The same version is not built again, a stale one is; the earlier one stays readable.
    assert rows_of(pivots.nearest_label(v, vector_store.ensure(spark, root, 3, new, "label"), "label", 0.2)) == rows_of(first)
    assert rows_of(pivots.nearest_label(v, vector_store.ensure(spark, root, 4, new, "label"), "label", 0.2)) == rows_of(vectors.nearest_label(v, new, "label", 0.2))
    assert vector_store.version(spark, root) == 4
    assert rows_of(pivots.nearest_label(v, vector_store.load(spark, root, 3), "label", 0.2)) == rows_of(first)
    assert vector_store.ensure(spark, str(tmp_path / "none"), 1, old.where("id < 0"), "label") is None


def test_a_failed_write_leaves_the_stored_version(spark, tmp_path):
    root = str(tmp_path / "store")
    refs = table(spark, clustered(6, 40))
    vector_store.ensure(spark, root, 1, refs, "label")
    broken = pivots.build(refs, "label")
    broken.rows = broken.rows.withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        vector_store.save(spark, root, 2, broken)
    assert vector_store.version(spark, root) == 1 and vector_store.load(spark, root).rows.count() > 0


def test_stored_blocks_are_not_shuffled(spark, tmp_path):
    stored = vector_store.ensure(spark, str(tmp_path / "store"), 1, table(spark, clustered(7, 40)), "label")
    asked = spark.range(100).selectExpr("id % 5 AS block", "id AS q").hint("merge")
    text = plan(asked.join(stored.rows, "block"))
    assert "Bucketed: true" in text and text.count("Exchange") == 1
