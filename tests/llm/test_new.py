"""Mixing, lexical search and runs against plain versions, and rows that only some operators meet."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _cluster, lexical, mixing, periodic, queries
from tests.llm.test_llm import DATA, LONG, SCHEMA, SMALL, empty, odd  # noqa: F401


# 11: mixing


def plain_targets(sizes, weights, most=3):
    """Weights' shares, cut at the caps again and again."""
    out, full = {s: 0.0 for s in sizes}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        out = {s: most * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        new = {s for s in sizes if s not in full and out[s] > most * sizes[s]}
        if not new:
            return out
        full |= new


def test_targets_are_reshared_until_none_is_above(spark):
    rnd = random.Random(1)
    for _ in range(8):
        sizes = {f"s{k:02}": rnd.choice([0, 1, 5, 40, 900, 10**6]) for k in range(rnd.randint(1, 12))}
        sources = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r.source: r.target for r in mixing.targets(mixing.cyclic_weights(sources)).collect()}
        expected = plain_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
        assert found == pytest.approx(expected)


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(mixing.sized(spark.read.parquet(f"{DATA}/documents.parquet")), seed=7)
    again = mixing.mix(mixing.sized(spark.read.parquet(f"{DATA}/documents.parquet").repartition(7)), seed=7)
    got = rows.collect()
    assert sorted(got) == sorted(again.collect()) and all(r.copies in (0, 1, 2, 3) and r.taken == r.copies * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.03 * own[0].target
    other = mixing.mix(mixing.sized(spark.read.parquet(f"{DATA}/documents.parquet")), seed=8).collect()
    assert {(r.doc_id, r.copies) for r in other} != {(r.doc_id, r.copies) for r in got}


def test_inclusion_follows_the_preference(spark):
    """Over many seeds documents are taken about as often as their expected copies say."""
    rows = spark.createDataFrame([(k, "ab"[k % 2], 1 + k % 60) for k in range(300)], "doc_id long, source string, size long")
    words = [sum(1 + k % 60 for k in range(300) if k % 2 == s) for s in (0, 1)]
    total = {}
    runs = 12
    for seed in range(runs):
        for r in mixing.mix(rows, seed=seed).collect():
            key = (r.source, min(8, 1 + r.size // 8))
            total[key] = total.get(key, 0) + r.copies / runs
    count = {}
    for k in range(300):
        key = ("ab"[k % 2], min(8, 1 + (1 + k % 60) // 8))
        count[key] = count.get(key, 0) + 1
    for s, w in (("a", 1), ("b", 2)):
        goal = sum(words) * w / 3
        base = sum(min(8, 1 + (1 + k % 60) // 8) * (1 + k % 60) for k in range(300) if "ab"[k % 2] == s)
        for level in range(1, 9):  # no level is at its cap here
            assert total[s, level] == pytest.approx(count[s, level] * level * goal / base, rel=0.3, abs=2.5)  # what is left open goes to short ones


def test_mix_of_odd_rows(spark, odd, empty):  # noqa: F811
    rows = mixing.mix(mixing.sized(odd)).collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {"s", None}
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(mixing.sized(empty)).collect() == []
    none = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(mixing.sized(none)).collect()] == [(0, 0.0, 0)] * 2


# 12: lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    """Every score of every document, by the formula."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    terms = [(d, TERM.findall(low(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, own in terms:
            if d is None:
                continue
            m = 75 + (25 * len(own) * n_docs) // n_terms if n_terms else 75
            s = 0
            for t in TERM.findall(low(text)):
                tf = own.count(t)
                if tf:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=20, only=True):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id string, text string")
    index = lexical.build_index(d, only=lexical.term_bitmap(q) if only else None)
    return sorted((tuple(r) for r in lexical.search(index, q, k).collect()), key=repr)


@pytest.mark.parametrize("only", [True, False])
def test_search_is_the_plain_version(spark, monkeypatch, only):
    monkeypatch.setattr(lexical, "CHUNK", 40)
    monkeypatch.setattr(lexical, "SHARD", 4)
    monkeypatch.setattr(lexical, "BLOCK", 3)
    rnd = random.Random(2)
    vocabulary = ["a", "B", "c1", "été", "x", "Zz", "7", "\U0001f600", "q"]
    docs = [(k, " ".join(rnd.choice(vocabulary[: rnd.choice([3, 9])]) for _ in range(rnd.choice([0, 1, 3, 8, 30])))) for k in range(150)]
    docs += [(k, docs[3][1]) for k in range(900, 930)] + [(None, "a b c1"), (5, docs[5][1]), (200, None), (201, LONG)]
    items = [(f"i{k}", "; ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 6])))) for k in range(12)]
    items += [(None, "a été"), ("i1", "a x"), ("none", None), ("lost", "unseen")]
    assert searched(spark, docs, items, 5, only) == plain_search(docs, items, 5)


def test_search_of_empty_tables_and_clashing_names(spark, odd, empty):  # noqa: F811
    items = spark.createDataFrame([("i", "lorem B")], "item_id string, text string")
    assert lexical.search(lexical.build_index(empty), items).collect() == []
    assert lexical.search(lexical.build_index(odd), items.limit(0)).collect() == []
    found = lexical.search(lexical.build_index(odd), items).collect()
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and {r.doc_id for r in found} == {3, 4, 5}


def test_bisection_brings_like_documents_together():
    rnd = np.random.default_rng(3)
    topic = rnd.permutation(np.repeat(np.arange(4), 64))
    doc = np.repeat(np.arange(256), 20)
    term = topic[doc] * 50 + rnd.integers(0, 50, len(doc))
    order = lexical.bisected(doc, term, 256, 200, 64)
    assert sorted(order.tolist()) == list(range(256))
    for k in range(4):
        assert np.bincount(topic[order[64 * k : 64 * k + 64]]).max() >= 62


def test_visits_stop_early_and_lose_nothing():
    rnd = np.random.default_rng(4)
    rows = []
    for k in range(40):  # each shard has a vocabulary of its own and some common terms
        doc = np.repeat(np.arange(64), 12)
        term = np.where(rnd.random(len(doc)) < 0.7, 100 + 20 * k + rnd.integers(0, 20, len(doc)), rnd.integers(0, 30, len(doc)))
        key = np.unique(term * 64 + doc)
        term, doc = key // 64, key % 64
        impact = rnd.integers(1, 1000, len(key))
        begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        rows.append(((np.arange(64) + 64 * k).tobytes(), term[begin].astype(np.uint64).tobytes(), np.r_[begin, len(term)].astype(np.int32).tobytes(),
                     doc.astype(np.uint8).tobytes(), impact.tobytes(), np.maximum.reduceat(impact, begin).tobytes()))
    asked = [np.unique(np.r_[100 + 20 * q + rnd.integers(0, 20, 6), rnd.integers(0, 30, 2)]) for q in range(10)]
    terms = np.unique(np.concatenate(asked))
    size = np.array([len(a) for a in asked])
    term = np.searchsorted(terms, np.concatenate(asked))
    block = lexical.Block(10, terms.astype(np.uint64), np.repeat(np.arange(10), size), term, rnd.integers(1, 9, len(term)), np.zeros(10, np.int64))
    best, whole = lexical.Best(block, 5), lexical.Best(block, 5)
    visits = lexical.visit(rows, block, best)
    for r in rows:
        whole.add(*lexical.Shard(r, block).scores(block, np.ones(10, bool)))
    assert visits < 200 and [x.tolist() for x in (best.question, best.score, best.doc)] == [x.tolist() for x in (whole.question, whole.score, whole.doc)]


# 13: runs


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("few", [0, 3, 512])
def test_runs_are_the_plain_version(monkeypatch, few):
    monkeypatch.setattr(periodic, "FEW", few)
    rnd = random.Random(few)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            n, letters = rnd.choice([0, 1, 2, 13, 40, 90]), rnd.choice([1, 2, 3, 9])
            w = [rnd.randrange(letters) for _ in range(n)]
            if n > 4 and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 2))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w * rnd.choice([1, 1, 2, 3]))
        ends = np.cumsum([len(w) for w in texts])
        least = rnd.choice([2, 5, 12])
        found = periodic.runs_of_ids(np.array([x for w in texts for x in w], np.int64), ends, least)
        assert list(zip(*(x.tolist() for x in found))) == [(s + e - len(w), n, q) for w, e in zip(texts, ends.tolist()) for s, n, q in plain_runs(w, least)]


def test_runs_of_fibonacci_words_and_long_loops():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.runs_of_words(b, 2) == plain_runs(b, 2)
    assert periodic.runs_of_words([1] * 50000) == [(0, 50000, 1)]
    loop = list(range(9000)) * 3
    assert periodic.runs_of_words(loop) == [(0, 27000, 9000)]


def test_find_runs_over_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r.doc_id: r for r in periodic.find_runs(docs, loop_key="crc32(cast(doc_id as string))").collect()}
    some = 0
    for r in docs.collect():
        w = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        own = found[r.doc_id]
        assert [tuple(x) for x in own.runs] == runs and own.n_words == n
        assert own.collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        some += bool(runs)
    assert some > 5


def test_find_runs_of_odd_rows(spark, odd, empty):  # noqa: F811
    rows = periodic.find_runs(odd, tuple(odd.columns)).collect()
    assert len(rows) == odd.count()
    by = {r["id"]: r for r in rows if r["id"] is not None}
    assert by[0].n_runs == 0 and by[0].collapsed == "" and by[0].start is None
    assert (by[5].start, by[5].length, by[5].period, by[5].exponent_milli) == (0, 40000, 2, 20000000) and by[5].collapsed == "lorem ipsum"
    assert periodic.find_runs(empty).collect() == []
    broken = spark.createDataFrame([(1, b"ok \xff\xfe text")], "doc_id long, text binary")
    assert periodic.find_runs(broken).first().n_words == 3


@pytest.mark.parametrize("name", ["op11_pareto_mix", "op12_lexical_search", "op13_periodic_runs"])
def test_columns(spark, name):
    types = dict(queries.QUERIES[name](spark, SMALL).dtypes)
    expected = {
        "op11_pareto_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op12_lexical_search": {"rank": "int", "doc_id": "bigint", "score": "bigint"},
        "op13_periodic_runs": {"n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string"},
    }[name]
    assert {c: types[c] for c in expected} == expected


def test_readers_decode_few_whole_texts_at_once(spark):
    """4,096 rows of long texts in each of many tasks fill a small heap; a session's own lower bound stays."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        for own, want in (("4096", "256"), ("100", "100")):
            spark.conf.set(name, own)
            assert _cluster.map_arrow(spark.range(3).select("id"), lambda b: iter([b]), "id long").count() == 3
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
