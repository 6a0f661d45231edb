"""Migrations of versioned tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import migrations, sinks
from shelfmark.sources.migrations import Migration

FLAT = [(k, f"c{k}", f"l{k % 4}", "positive") for k in range(30)]


@pytest.fixture
def root(spark, tmp_path):
    flat = spark.createDataFrame(FLAT, "id long, checksum string, label string, polarity string")
    sinks.commit(spark, str(tmp_path / "db"), {"tags": flat, "titles": spark.range(7)}, 1)
    return str(tmp_path / "db")


def files(root):
    return sorted(f"{d}/{f}" for d, _, names in os.walk(root) for f in names)


def test_dry_run_writes_nothing(spark, root):
    before = files(root)
    assert migrations.run(spark, root) == ["0001_tags_table: 30 rows of file_tags, 4 rows of tags"]
    assert files(root) == before and sinks.versions(spark, root) == [1]


def test_a_migration_becomes_a_version(spark, root):
    migrations.run(spark, root, apply=True, now=77)
    assert sinks.versions(spark, root) == [1, 2]
    tables = sinks.latest(spark, root)
    assert {n: df.count() for n, df in tables.items()} == {"tags": 4, "file_tags": 30, "titles": 7, "migration_state": 1}
    assert [tuple(r) for r in tables["migration_state"].collect()] == [("0001_tags_table", 77)]
    joined = tables["file_tags"].join(tables["tags"].select(F.col("id").alias("tag_id"), "label"), "tag_id")
    assert sorted((r["checksum"], r["label"]) for r in joined.collect()) == sorted((c, x) for _, c, x, _ in FLAT)
    # The backup is the version before; a second run has nothing to do and writes nothing.
    assert sinks.latest(spark, root, "tags", 1).count() == 30
    assert migrations.run(spark, root, apply=True) == ["nothing pending"] and sinks.versions(spark, root) == [1, 2]


@pytest.mark.parametrize("fault", ["rows", "error"])
def test_a_failed_migration_leaves_the_version_before(spark, root, fault):
    lost = lambda t: {"titles": t["titles"].where("id > 2") if fault == "rows" else t["titles"].select(F.raise_error(F.lit("torn")).alias("id"))}
    bad = Migration("0002_titles", lambda t: {"titles": 7}, lost)
    never = Migration("0003_never", lambda t: {"titles": 7}, lambda t: pytest.fail("ran after a failure"))
    with pytest.raises(Exception, match="titles has 4 rows instead of 7|torn"):
        migrations.run(spark, root, [*migrations.MIGRATIONS, bad, never], apply=True)
    assert sinks.versions(spark, root) == [1, 2]
    tables = sinks.latest(spark, root)
    assert tables["titles"].count() == 7 and tables["migration_state"].count() == 1
    # Mended, it goes on from there, over the torn files.
    good = Migration("0002_titles", lambda t: {"titles": 7}, lambda t: {"titles": t["titles"].withColumn("kind", F.lit("x")), "gone": None})
    assert migrations.run(spark, root, [*migrations.MIGRATIONS, good], apply=True) == ["0002_titles: 7 rows of titles"]
    assert sinks.latest(spark, root, "titles").columns == ["id", "kind"] and sinks.latest(spark, root, "migration_state").count() == 2


def test_nothing_to_do_is_noted_once(spark, tmp_path):
    root = str(tmp_path / "db")
    assert re.fullmatch(r".* has no version", migrations.run(spark, root, apply=True)[0])
    sinks.commit(spark, root, {"titles": spark.range(2)}, 5)
    assert migrations.run(spark, root, apply=True, now=1) == ["nothing pending"]
    assert sinks.versions(spark, root) == [5, 6] and sinks.latest(spark, root, "migration_state").first()["id"] == "0001_tags_table"
    assert migrations.run(spark, root, apply=True) == ["nothing pending"] and sinks.versions(spark, root) == [5, 6]
