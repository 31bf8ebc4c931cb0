"""The stored index of postings against the plain search."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings, retrieval, snapshots

SCHEMA = "id long, content string, language string, tax_year string"


def made(rnd, ids):
    words = {"en": [f"en{k}" for k in range(40)], "de": [f"de{k}" for k in range(40)]}
    out = []
    for k in ids:
        lang = rnd.choice(["en", "de"])
        text = None if rnd.random() < 0.05 else " ".join(rnd.choices(words[lang] + ["both", "7"], k=rnd.choice([0, 1, 4, 12, 60])))
        out.append((k, text, lang, rnd.choice([None, "2023", "2024/2025"])))
    return out


def lists(df, score="bm25"):
    return sorted((r.query_id, r["rank"], r.id, round(r[score], 7)) for r in df.collect())


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(11)
    rows = made(rnd, range(500))
    asked = [(k, rows[k][1], rnd.choice([None, "2023", "2024/2025", "1999"])) for k in range(0, 500, 20)] + [(1000, "en1 de1 both", None), (1001, None, None), (1002, "unseen", None)]
    return rnd, rows, spark.createDataFrame(asked, "query_id long, query_text string, tax_year string")


def test_searches_equal_the_plain_ones(spark, world, tmp_path, monkeypatch):
    rnd, rows, asked = world
    monkeypatch.setattr(postings, "SHARD", 16)
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 9)
    docs, path = spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/p"
    postings.build(docs, path, filters=("language", "tax_year"), buckets=4)
    assert lists(postings.search(spark, path, asked, 7).rows) == lists(retrieval.bm25_top(docs, asked, 7, "id", "content"))
    english = docs.where("language = 'en'").select("id")
    found = postings.search(spark, path, asked, 7, where="language = 'en'")
    assert lists(found.rows) == lists(retrieval.bm25_top(docs, asked, 7, "id", "content", among=english))
    by_period = postings.search(spark, path, asked, 7, where="language = 'en'", period="tax_year")
    assert lists(by_period.rows) == lists(retrieval.bm25_top(docs, asked, 7, "id", "content", among=english, period="tax_year"))


def test_upserts_touch_only_their_buckets_and_equal_a_new_build(spark, world, tmp_path):
    rnd, rows, asked = world
    path = f"{tmp_path}/p"
    state = {r[0]: r for r in rows}
    first = postings.build(spark.createDataFrame(rows, SCHEMA), path, filters=("language", "tax_year"), buckets=32)
    for _ in range(2):
        change, gone = {r[0]: r for r in made(rnd, rnd.sample(range(520), 3))}, rnd.sample(range(500), 2)
        done = postings.upsert(spark, path, spark.createDataFrame(list(change.values()), SCHEMA), deletes=spark.createDataFrame([(k,) for k in gone], "id long"))
        state = {k: v for k, v in (state | change).items() if k not in gone}
        assert len(done.buckets) <= 5 and done.bytes < first.bytes / 2
    now = spark.createDataFrame(list(state.values()), SCHEMA)
    assert lists(postings.search(spark, path, asked).rows) == lists(retrieval.bm25_top(now, asked, 24, "id", "content"))
    fresh = f"{tmp_path}/fresh"
    postings.build(now, fresh, filters=("language", "tax_year"), buckets=32)
    same = lambda p: sorted(map(str, snapshots.load(spark, p).select("ids", "lengths", "terms", "begin", "docs", "tf", "max_tf", "min_length").collect()))
    assert same(path) == same(fresh)
    assert lists(postings.search(spark, path, asked, version=1).rows) == lists(retrieval.bm25_top(spark.createDataFrame(rows, SCHEMA), asked, 24, "id", "content"))


def test_postings_read_are_few(spark, tmp_path):
    """Documents of many subjects, filtered by them: a question needs the shards of its own."""
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choices([f"s{k % 20}w{j}" for j in range(30)] + ["the", "of"], k=40)), f"s{k % 20}", None) for k in range(2000)]
    path = f"{tmp_path}/p"
    postings.build(spark.createDataFrame(rows, SCHEMA), path, filters=("language",), buckets=2)
    asked = spark.createDataFrame([(k, " ".join(f"s{k}w{j}" for j in range(8)) + " the") for k in range(3)], "query_id long, query_text string")
    found = postings.search(spark, path, asked, 5)
    assert lists(found.rows) == lists(retrieval.bm25_top(spark.createDataFrame(rows, SCHEMA), asked, 5, "id", "content"))
    read, total = found.read.agg(F.sum("postings")).first()[0], postings.statistics(snapshots.load(spark, path))[2]
    assert 0 < read < total / 10


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    postings.build(none, f"{tmp_path}/p", buckets=2)
    assert postings.search(spark, f"{tmp_path}/p", asked).rows.collect() == []
    postings.upsert(spark, f"{tmp_path}/p", spark.createDataFrame([(None, "a", None, None), (5, "a", None, None), (6, None, None, None)], SCHEMA))
    assert [(r.query_id, r.id) for r in postings.search(spark, f"{tmp_path}/p", asked).rows.collect()] == [(1, 5)]
    assert postings.search(spark, f"{tmp_path}/p", asked.limit(0)).rows.collect() == []
