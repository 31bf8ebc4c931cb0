"""Queries against brute force over all rows of small tables, where a cut of the inputs would show."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, retrieval
from corpusloom.plans import queries as plans


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """240 documents of 3 to 40 words in two languages and 260 vectors, ids from 0; every 60th text is null."""
    d, rng = str(tmp_path_factory.mktemp("whole")), random.Random(7)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, None if k % 60 == 59 else " ".join(rng.choices(words, k=rng.randint(3, 40))), "en" if k % 5 == 0 else "de", f"s{k % 4}") for k in range(240)]
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(8)], 0) for k in range(260)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 240, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    texts = {r.doc_id: r.text and re.findall(r"\w+", r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    stored = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    return d, texts, stored


def best(scores: dict, among=None) -> list:
    """(id, score) of the 24 best, ties to the smaller id."""
    return sorted(((k, s) for k, s in scores.items() if among is None or k in among), key=lambda x: (-x[1], x[0]))[:24]


def brute_bm25(texts: dict) -> dict:
    n, texts = len(texts), {k: ws for k, ws in texts.items() if ws is not None}  # null texts count in n only
    mean = sum(map(len, texts.values())) / len(texts)
    df = {t: sum(t in ws for ws in texts.values()) for ws in texts.values() for t in ws}
    out = {}
    for q in (k for k in texts if k % 20 == 0):
        out[q] = {}
        for k, ws in texts.items():
            both = set(texts[q]) & set(ws)
            if both:
                idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in both}
                out[q][k] = round(sum(idf[t] * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in both), 9)
    return out


def brute_cosine(stored: dict) -> dict:
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    return {q: {k: round(dot(v, stored[q]) / math.sqrt(dot(v, v)) / math.sqrt(dot(stored[q], stored[q])), 9) for k, v in stored.items()} for q in stored if q % 20 == 0}


@pytest.mark.parametrize("block", [3, 4096])
def test_searches_take_every_twentieth_row(spark, small, monkeypatch, block):
    d, texts, stored = small
    monkeypatch.setattr(retrieval, "TERM_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    for name, score, brute in (("bm25_topk", "bm25", brute_bm25(texts)), ("knn_topk", "cosine", brute_cosine(stored))):
        got = {(r.query_id, r["rank"]): (r.doc_id, r[score]) for r in plans.Q[name](spark, d).collect()}
        want = {(q, n + 1): (k, s) for q, scores in brute.items() for n, (k, s) in enumerate(best(scores))}
        assert got.keys() == want.keys() and {q for q, _ in got} == set(range(0, len(texts if score == "bm25" else stored), 20))
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_fusion_takes_every_twentieth_row(spark, small):
    d, texts, stored = small
    want = {}
    for brute in (brute_bm25(texts), brute_cosine(stored)):
        for q, scores in brute.items():
            for n, (k, _) in enumerate(best(scores)):
                want[q, k] = want.get((q, k), 0) + 1 / (61 + n)
    got = {(r.query_id, r.doc_id): r.rrf for r in plans.Q["rrf_fuse"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_upsert_keeps_every_document(spark, small):
    got = {r.doc_id: r.version for r in plans.Q["index_upsert"](spark, small[0]).collect()}
    assert got == {k: "old" if k % 3 else "new" for k in range(240)}


def greedy(rows: list, pieces_of: dict) -> list:
    """The greedy loop over one source: a list of (doc_id, part) for each chunk. rows: doc_id, language, text."""
    out, pending, chars = [], [], 0
    for k, lang, text in rows:
        pieces = pieces_of[k]
        if len(pieces) > 1:
            out, pending = out + [pending] * bool(pending) + [[(k, n, lang)] for n in range(len(pieces))], []
            continue
        n = len(pieces[0])
        if pending and (pending[-1][2] != lang or (chars + 2 + n + 3) // 4 > 900):
            out, pending = [*out, pending], []
        chars = chars + 2 + n if pending else n
        pending = [*pending, (k, 0, lang)]
        if (chars + 3) // 4 >= 900:
            out, pending = [*out, pending], []
    return [[x[:2] for x in g] for g in out + [pending] * bool(pending)]


def test_chunk_merge_is_the_reference_loop(spark, tmp_path):
    rng = random.Random(3)
    sizes = [10, 20, 4201, 30, 40, None, 5, 9000, 9000, 7, 3596, 1, 3597, 3598, 2, 3600, 3601, 4200, 8, 12000, 0, 0]
    sizes += [rng.choice([None, 0, 50, 900, 1500, 3000, 3597, 4200, 4201, 20000]) for _ in range(150)]
    docs = [(k, n if n is None else ("word. " * n)[:n], rng.choice(["en", "en", "de", None]) if k > 22 else "en", "a" if k < 22 else f"s{k % 3}") for k, n in enumerate(sizes)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in plans.Q["chunk_merge"](spark, str(tmp_path)).collect():
        got.setdefault((r.source, r.chunk), []).append((r.doc_id, r.part))
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pieces_of = {r.doc_id: r.ps for r in read.select("doc_id", chunking.split_pieces(F.col("text")).alias("ps")).collect()}
    want = [g for s in {r[3] for r in docs} for g in greedy([(k, lang, t) for k, t, lang, source in docs if source == s], pieces_of)]
    assert sorted(map(sorted, got.values())) == sorted(want) and {k for g in want for k, _ in g} == set(range(len(docs)))


def test_evidence_is_searched_among_eligible_rows(spark, small):
    d, texts, stored = small
    year, asked = {1: "2024/2025", 2: "2025/2026"}, {0: "2025/2026", 1: "2023"}
    words, vectors = brute_bm25(texts), brute_cosine(stored)
    place, beyond, other = {}, 0, 0
    for q in set(words) | set(vectors):
        english = {k for k in texts if k % 5 == 0}
        fit = {k for k in english if None in (year.get(k % 4), asked.get(q % 3)) or year[k % 4] == asked[q % 3]}
        other += len(english - fit)
        rrf = {}
        for scores in (words.get(q, {}), vectors.get(q, {})):
            beyond += len({k for k, _ in best(scores, fit)} - {k for k, _ in best(scores)})
            for n, (k, _) in enumerate(best(scores, fit)):
                rrf[k] = rrf.get(k, 0) + 1 / (61 + n)
        place |= {(q, k): n for n, k in enumerate(sorted(rrf, key=lambda k: (-round(rrf[k], 9), k))[:24])}
    rows = plans.Q["hybrid_retrieve"](spark, d).collect()
    assert beyond and other and all(place[r.query_id, r.id] == r.original_rank for r in rows) and {r.query_id for r in rows} == {q for q, _ in place}
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, id, rank FROM ({plans.SQL['hybrid_retrieve']})").fetchall()
    assert {(r.query_id, r.id, r["rank"]) for r in rows} == set(want) and len(rows) == len(want)
    n = {r.query_id: r.n for r in plans.Q["context_blocks"](spark, d).collect()}
    assert n == {q: sum(r.query_id == q and texts[r.id] is not None for r in rows) for q in {r.query_id for r in rows}}


def test_whole_texts_are_not_ranked(spark, monkeypatch):
    seen, rerank = [], retrieval.rerank
    monkeypatch.setattr(retrieval, "rerank", lambda rows, *a, **k: seen.append(rows.columns) or rerank(rows, *a, **k))
    assert "context_sha" in plans.Q["context_blocks"](spark, "/root/testdata/sf0.001").columns
    assert "source_id" in seen[0] and "content" not in seen[0]



@pytest.mark.parametrize("tried", [0, 32])
@pytest.mark.parametrize("period", [None, "tax_year"])
def test_copies_and_first_tries_change_no_list(spark, monkeypatch, tried, period):
    """Six copies of each text, in several periods, null texts and fewer copies than k: the same lists as if each were ranked for itself."""
    rng = random.Random(9)
    texts = [None if k % 30 == 29 else " ".join(rng.choices([f"w{k}" for k in range(50)], k=rng.randint(1, 20))) for k in range(60)]
    rows = [(k, texts[k % 60], rng.choice([None, "2023", "2024"])) for k in range(360)] + [(None, texts[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tax_year string")
    asked = docs.where("doc_id % 7 = 0").selectExpr("doc_id AS query_id", "text AS query_text", "tax_year")
    among = docs.where("doc_id % 5 > 0").select("doc_id")
    lists = lambda k: [tuple(r) for r in retrieval.bm25_top(docs, asked, k, among=among, period=period).orderBy("query_id", "rank").collect()]
    got = []
    monkeypatch.setattr(retrieval, "_TRIED_FROM", tried)
    for share in (0, 8):
        monkeypatch.setattr(retrieval, "_COPIES", share)
        assert (retrieval._copies(docs.where("doc_id is not null"), "doc_id", F.col("text")) is None) == (share == 0)
        got.append([lists(3), lists(24)])
    assert got[0] == got[1] and len(got[0][1]) > 500
    assert retrieval._copies(docs, "doc_id", F.col("text")) is None  # null ids


def test_copies_are_scored_once(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id AS doc_id", "concat('a b', id % 50) AS text")
    scored = []
    best = retrieval._task_best
    monkeypatch.setattr(retrieval, "_task_best", lambda rows, ids, *a: scored.append((rows.count(), len(ids))) or best(rows, ids, *a))
    found = retrieval.bm25_top(rows, rows.where("doc_id % 2 = 0").selectExpr("doc_id AS query_id", "text AS query_text"), 24)
    assert found.count() == 150 * 24 and scored == [(50, 25)]
