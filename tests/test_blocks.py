"""Queries whose tables are cut into blocks on both sides, as they are from 8,192 references on."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import pivots, vectors
from shelfmark.plans import registry as catalog

from .compare import TABLES, connect, same_rows


@pytest.mark.parametrize("name", ["confirm_above_threshold", "max_sim_band", "nn_label", "split_candidates"])
def test_blocks_of_one_table_meet(name, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    same_rows(catalog.queries()[name](spark, sf_dir), connect(sf_dir), catalog.oracle_sql()[name])


def unclustered(spark, rows, first=0):
    x = np.random.default_rng(rows).normal(size=(rows, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(first + k, e.tolist(), k % 5) for k, e in enumerate(x)], "id long, embedding array<double>, label long")


def test_copies_do_not_grow_with_the_pivots(spark, monkeypatch):
    """Where no pivot can be ruled out, a vector goes to some ``COPIES`` blocks, not to those of each of 20 pivots."""
    for name, rows in {"BLOCK": 9, "COPIES": 4, "LARGE_BLOCK": 1000, "CHUNK": 11, "SLICE": 4, "SCORES": 50}.items():
        monkeypatch.setattr(pivots, name, rows, raising=False)
    v, refs = unclustered(spark, 60), unclustered(spark, 400, 30)
    built = pivots.build(refs, "label")
    asked = v.withColumns({"floor": F.lit(None).cast("double"), "home": F.lit(None).cast("long")})
    sent = pivots.chunks(asked, built.pivots, -1.0, 1).agg(F.sum(F.size("ids"))).first()[0]
    assert len(built.pivots.directions) == 20 and 0 < sent <= 60 * 9
    rows = lambda df: sorted((r["id"], r["label"], round(r["score"], 9)) for r in df.collect())
    assert rows(pivots.nearest_label(v, built, "label", -1.0)) == rows(vectors.nearest_label(v, refs, "label", -1.0))


def with_null_vectors(sf_dir, folder):
    """The tables of ``sf_dir``, where two of ten embeddings, named and unknown ones, are null."""
    for name in TABLES:
        if name != "embeddings":
            os.symlink(f"{sf_dir}/{name}.parquet", folder / f"{name}.parquet")
    rows = f"SELECT * REPLACE (CASE WHEN vec_id % 10 NOT IN (3, 4) THEN embedding END AS embedding) FROM '{sf_dir}/embeddings.parquet'"
    duckdb.sql(f"COPY ({rows}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("block", [40, 8192])
@pytest.mark.parametrize("name", ["max_sim_band", "nn_label", "split_candidates"])
def test_null_vectors_meet_nothing(name, block, spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    there = with_null_vectors(sf_dir, tmp_path)
    same_rows(catalog.queries()[name](spark, there), connect(there), catalog.oracle_sql()[name])
