"""The index of vectors in cells against the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, snapshots, vectors

SCHEMA = "id long, embedding array<double>, language string"


def lists(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.cosine, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def world(spark):
    """Vectors around 12 directions, a third of them equal, and some that have no direction."""
    rng = np.random.default_rng(5)
    around = rng.normal(size=(12, 16)) * 3
    v = around[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    rows = [(k, x.tolist() if k % 3 else [1.0] * 16, "en" if k % 4 else "de") for k, x in enumerate(v)]
    rows += [(2000, None, "en"), (2001, [0.0] * 16, "en"), (2002, [1.0, None] * 8, "en"), (2003, [float("nan")] * 16, "en"), (2004, [1.0] * 3, "en"), (None, [1.0] * 16, "en")]
    asked = [(k, v[k].tolist()) for k in range(0, 900, 25)] + [(5000, None), (5001, [1.0] * 3), (5002, [0.0] * 16)]
    return rows, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "query_id long, query_vec array<double>"), v


def test_exact_searches_equal_the_plain_one(spark, world, tmp_path, monkeypatch):
    rows, table, asked, _ = world
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    path = f"{tmp_path}/v"
    vectors.build(table, path, filters=("language",))
    plain = retrieval.cosine_top(table.where("size(embedding) = 16"), asked.where("size(query_vec) = 16"), 9, "id")
    for probe in (1, 5, 100):
        found = vectors.search(spark, path, asked, 9, probe=probe, exact=True)
        assert lists(found.rows) == lists(plain)
    assert vectors.search(spark, path, asked, 9, probe=1, exact=True).compared < found.of / 2  # most cells are out of reach
    german = vectors.search(spark, path, asked, 9, exact=True, where="language = 'de'")
    assert lists(german.rows) == lists(retrieval.cosine_top(table.where("language = 'de'"), asked.where("size(query_vec) = 16"), 9, "id"))


def test_probing_what_calibration_asks_for(spark, world, tmp_path):
    rows, table, asked, _ = world
    path = f"{tmp_path}/v"
    vectors.build(table, path)
    n = vectors.calibrate(spark, path, 0.95, 9, 100)
    found = vectors.search(spark, path, asked, 9, probe=n)
    exact = {x[:1] + x[2:3] for x in lists(vectors.search(spark, path, asked, 9, exact=True).rows)}
    assert len(exact & {x[:1] + x[2:3] for x in lists(found.rows)}) >= 0.9 * len(exact) and found.compared < found.of / 2


def test_upserts_rewrite_their_cells(spark, world, tmp_path):
    rows, table, asked, v = world
    path = f"{tmp_path}/v"
    vectors.build(table, path, filters=("language",))
    change = [(1, v[7].tolist(), "en"), (4, None, "en"), (3000, v[2].tolist(), "de")]
    done = vectors.upsert(spark, path, spark.createDataFrame(change, SCHEMA), deletes=spark.createDataFrame([(8,), (3001,)], "id long"))
    assert len(done.buckets) <= 5 < snapshots.manifest(spark, path).buckets
    now = spark.createDataFrame([r for r in rows if r[0] not in (1, 4, 8)] + change, SCHEMA).where("size(embedding) = 16")
    assert lists(vectors.search(spark, path, asked, 9, exact=True).rows) == lists(retrieval.cosine_top(now, asked.where("size(query_vec) = 16"), 9, "id"))
    stay = snapshots.load(spark, path, 1).where(F.col("id") == 8).count()
    assert stay == 1 and snapshots.load(spark, path).where(F.col("id").isin(4, 8)).count() == 0


def test_empty_tables(spark, tmp_path):
    none, asked = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<double>")
    vectors.build(none, f"{tmp_path}/v")
    assert vectors.search(spark, f"{tmp_path}/v", asked, exact=True).rows.collect() == [] and vectors.calibrate(spark, f"{tmp_path}/v") == 1
    vectors.build(spark.createDataFrame([(1, [1.0, 2.0], "en")], SCHEMA), f"{tmp_path}/w")
    assert vectors.search(spark, f"{tmp_path}/w", asked.limit(0)).rows.collect() == []
    assert [r.id for r in vectors.search(spark, f"{tmp_path}/w", asked).rows.collect()] == [1]
