"""Bucketed tables with snapshots: upserts, readers that stay, writers that die or meet."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import snapshots

SCHEMA = "id long, `group` string, value string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    rnd, path = random.Random(5), f"{tmp_path}/t"
    state = {k: (k, None if k % 7 == 0 else f"g{k % 3}", f"v{k}") for k in range(400)}
    first = snapshots.create(spark.createDataFrame([*state.values(), (3, "g0", "zz")], SCHEMA), path, ["id"], 16)
    assert first.version == 1 and len(first.buckets) == 16
    seen = [dict(state)]
    for step in range(4):
        change = {k: (k, "n", f"w{step}") for k in rnd.sample(range(450), 3)}
        gone = rnd.sample(range(400), 2)
        done = snapshots.upsert(spark, path, spark.createDataFrame(list(change.values()), SCHEMA), spark.createDataFrame([(k,) for k in gone], "id long"))
        state |= change
        state = {k: v for k, v in state.items() if k not in gone}
        assert len(done.buckets) <= 5 and done.bytes < first.bytes
        assert rows_of(snapshots.load(spark, path)) == sorted(state.values(), key=repr)
        seen.append(dict(state))
    for version, rows in enumerate(seen):  # each snapshot can still be read
        assert rows_of(snapshots.load(spark, path, version + 1)) == sorted(rows.values(), key=repr)
    snapshots.vacuum(spark, path, keep=1)
    assert rows_of(snapshots.load(spark, path)) == sorted(state.values(), key=repr)
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, path, 1)


def test_a_write_that_dies_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    snapshots.create(spark.createDataFrame([(k, "g", "v") for k in range(50)], SCHEMA), path, ["id"], 4)
    before = rows_of(snapshots.load(spark, path))
    real = snapshots._swap
    monkeypatch.setattr(snapshots, "_swap", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        snapshots.upsert(spark, path, spark.createDataFrame([(1, "x", "new")], SCHEMA))
    monkeypatch.setattr(snapshots, "_swap", real)
    assert rows_of(snapshots.load(spark, path)) == before and snapshots.manifest(spark, path).version == 1
    assert len(snapshots.vacuum(spark, path)) == 1  # what the dead writer left
    snapshots.upsert(spark, path, spark.createDataFrame([(1, "x", "new")], SCHEMA))
    assert [r.value for r in snapshots.load(spark, path).where("id = 1").collect()] == ["new"]


def test_of_two_writers_one_fails(spark, tmp_path):
    path = f"{tmp_path}/t"
    snapshots.create(spark.createDataFrame([(k, "g", "v") for k in range(20)], SCHEMA), path, ["id"], 4)
    began = snapshots.manifest(spark, path)
    snapshots.upsert(spark, path, spark.createDataFrame([(1, "x", "one")], SCHEMA))
    rows = spark.createDataFrame([(2, "x", "two")], SCHEMA).withColumn("bucket", snapshots.bucket_of(["id"], 4))
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(spark, path, rows, [0], began)
    assert snapshots.load(spark, path).where("value = 'one'").count() == 1


def test_null_and_composite_keys_and_empty_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    snapshots.create(spark.createDataFrame([], SCHEMA), path, ["id", "group"], 4)
    assert snapshots.load(spark, path).count() == 0
    snapshots.upsert(spark, path, spark.createDataFrame([(None, None, "a"), (1, None, "b"), (1, "g", "c")], SCHEMA))
    snapshots.upsert(spark, path, spark.createDataFrame([(None, None, "A"), (1, None, "B")], SCHEMA))
    assert rows_of(snapshots.load(spark, path)) == sorted([(None, None, "A"), (1, None, "B"), (1, "g", "c")], key=repr)
    snapshots.upsert(spark, path, spark.createDataFrame([], SCHEMA), snapshots.load(spark, path).where(F.col("group").isNull()))
    assert rows_of(snapshots.load(spark, path)) == [(1, "g", "c")]
