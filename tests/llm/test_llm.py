"""The training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, decontam, langid, license_scan, ngram_join, quality, queries, rules, sharding, toxicity, urlfilter
from corpusloom.llm import _cluster
from corpusloom.llm._sample import fold

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, label string, id long, `key` string, Score double, kept string, `a b:c` string"
LONG = "lorem ipsum " * 20000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns whose names operators use inside."""
    texts = [None, "", " \n\t", "A b C d e f", "A b C d e f", LONG, "x" * 50000, "été \U0001f600 ß " * 30, "one\none\none\ntwo"]
    rows = [(k, t, "en" if k % 2 else None, "s", None, "r", None, k, None, 1.0, "no", "x") for k, t in enumerate(texts)]
    rows += [(None, "A b C d e f", *[None] * 10), (None,) * 12, rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())


# 1, 4, 10: classifiers


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 20)).astype(np.float32)
    f = x[:, 0] * 2 - x[:, 1]
    y = np.digitize(f + rng.logistic(size=3000) * 0.3, [-1.5, 0.0, 1.5])
    m = quality.fit_rows(x, y, 4, (1, 2))
    assert (np.diff(m.thresholds) > 0).all()
    grade, tail = m.judge(x, 2)
    assert np.corrcoef(grade, f)[0, 1] > 0.9 and ((tail >= 0.5) == (y >= 2)).mean() > 0.85


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels.where(fold("doc_id", 3) != 1))
    out = quality.judge(docs, model, min_tail=0.4).join(labels.where(fold("doc_id", 3) == 1), "doc_id")
    assert out.where((F.col("quality") == 1) != F.col("kept")).count() <= 0.03 * out.count()


def test_toxicity_held_out(spark):
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    bad = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted for r in rows) - sum(r.predicted for r in bad) <= 0.01 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = queries.op4_language_id(spark, DATA).join(docs, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_codewords_stay_apart():
    for k in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(k).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert apart[~np.eye(k, dtype=bool)].min() >= (1 if k == 2 else 2)


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 1), (5, 0, 0), (7, 0, 0), (7, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for docs in (odd, empty):
        for lab in (labels, labels.limit(0)):
            t = toxicity.score(docs, toxicity.fit(docs, lab)).collect()
            q = quality.judge(docs, quality.fit(docs, lab)).collect()
            g = langid.identify(docs, langid.fit(docs, docs.select("doc_id", "lang"))).collect()
            assert len(t) == len(q) == len(g) == docs.count()
            assert all(0 <= r.score <= 1 for r in [*t, *g])
    by = collections.defaultdict(set)
    for r in langid.identify(odd, langid.fit(odd, odd.select("doc_id", "lang"))).collect():
        by[r.doc_id].add((r.lang_pred, r.score))
    assert by[0] == by[1] == by[2] == {("und", 0.0)} and len(by[3]) == 1
    kept = toxicity.score(odd, toxicity.fit(odd, labels), keep=tuple(odd.columns))
    assert kept.columns == [c for c in odd.columns if c != "Score"] + ["score"] and kept.count() == odd.count()


# 2: BPE


def test_tree_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["a", "ab ", " the", "  ", "\n", "é", "日本", "\U0001f600", "'ll ", "34", "!!", "<|endoftext|>", "x" * 30, " " * 20, "\xa0", "'"]
    for leaf, window in ((7, 2), (40, 4)):
        tree = bpe.TreeEncoder(path, leaf, window, threads=2)
        for _ in range(400):
            some = rng.sample(parts, rng.randint(1, 5))
            text = "".join(rng.choice(some) for _ in range(rng.randint(0, 300)))
            ids = whole.encode(text, add_special_tokens=False).ids
            assert tree.encode(text) == ids and tree.decode(ids) == whole.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, odd, empty):
    out = bpe.encode_documents(odd, queries.tokenizer_path()).collect()
    assert len(out) == odd.count() and all((r.n_tokens == 0) == (not r.decoded) for r in out)
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}
    for r in out:
        if r.doc_id is not None:
            assert r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(empty, queries.tokenizer_path()).count() == 0


# 3: n-gram join


def brute_join(rows, spec):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = word.findall(lowered(t))
        sets.append(frozenset(tuple(w[k : k + spec.width]) for k in range(len(w) - spec.width + 1)) if len(w) >= spec.width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and spec.den * len(a & b) >= spec.num * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("spec,block", [(ngram_join.Spec(4, 85, 100), 4096), (ngram_join.Spec(5, 80, 100), 7)])
def test_join_equals_brute_force(spark, spec, block):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 9, 14, 30, 70, 200]))]
        passage = vocab[:60] if family % 3 == 0 else []
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words + passage)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " ", "Q r", "q R"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(docs, spec, block=block).collect()}
    assert got == brute_join(rows, spec)
    want = brute_join(rows, spec)
    stay = sorted(r.doc_id for r in ngram_join.one_per_component(docs, spec, block=block).collect())
    assert stay == sorted(d for d, (_, low, _) in want.items() if d == low)


def test_join_on_odd_rows(odd, empty):
    out = ngram_join.jaccard_components(odd).collect()
    assert len(out) == odd.count()
    assert all(r.component_id == 3 and r.n_links == 3 for r in out if r.doc_id in (3, 4))
    once = ngram_join.one_per_component(odd)
    assert once.columns == odd.columns
    assert once.where("text = 'A b C d e f'").count() == 1 and once.where("text is null").count() == 2
    assert ngram_join.jaccard_components(empty).count() == 0 and ngram_join.one_per_component(empty).count() == 0


def test_long_groups_come_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "_LONG", 5)
    sig = [1, 1] + [2] * 17 + [3, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(sig[k : k + 4], pa.int64()), pa.array(range(k, k + len(sig[k : k + 4])), pa.int64())], ["s", "k"]) for k in range(0, len(sig), 4)]
    parts = list(ngram_join._aligned(batches, 1))
    seen = collections.defaultdict(set)
    for key, (rows,), whole in parts:
        for s, r in zip(key, rows):
            seen[s].add(r)
        if whole:
            assert 2 not in set(key)
        else:
            assert set(key) == {2} and rows[0] == 2
    assert {s: len(v) for s, v in seen.items()} == dict(collections.Counter(sig))


# 5, 8: rules and licences


def test_rules_on_odd_rows(odd, empty):
    out = {r.doc_id: r for r in rules.ledger(rules.measure(odd)).collect()}
    assert (out[0].n_words, out[1].n_words, out[2].n_words) == (0, 0, 0) and out[8].n_dup_lines == 2
    assert out[5].n_repeat_words == out[5].n_words == 40000
    assert rules.ledger(rules.measure(empty)).count() == 0


def test_ablations(spark):
    led = rules.ledger(rules.measure(spark.read.parquet(f"{DATA}/documents.parquet")))
    rows, bits = rules.ablations(led, "v2").collect(), [r.fail_bits for r in led.select("fail_bits").collect()]
    for r in rows:
        others = rules.mask([n for n in rules.POLICIES["v2"] if n != r.rule])
        assert r.n_kept_without == sum(b & others == 0 for b in bits) and r.n_failed == sum(b & rules.mask([r.rule]) != 0 for b in bits)


def test_licenses(spark, odd, empty):
    texts = ["x\nReleased under the MIT License.\nAll rights reserved.", "Licensed under CC BY-NC 4.0.", "ALL RIGHTS RESERVED!", "all rights are reserved", None,
             "Redistributions of source code must retain the above copyright notice. Other. Redistributions in binary form must reproduce the above copyright notice."]
    out = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.verdict for r in out] == ["conflict", "noncommercial", "restricted", "none", "none", "permissive"] and out[5].license == "BSD"
    assert license_scan.scan_licenses(odd).where("verdict <> 'none'").count() == 0 and license_scan.scan_licenses(empty).count() == 0


# 6: shards


def test_permutation():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 9)
        assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 9, inverse=True) == np.arange(n)).all()
    big = (1 << 61) + 12345
    some = np.array([0, 1, big - 1, big // 3])
    assert (sharding.permute(sharding.permute(some, big, 4), big, 4, inverse=True) == some).all()


def test_shards(spark, odd, empty):
    rows = queries.op6_feistel_shards(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    order = sorted((r.doc_id, r.text_crc32, r.size) for r in rows)
    place = sharding.permute(np.arange(len(rows)), len(rows), queries.SEED)
    want = {k[0]: (int(p % 40), int(p // 40)) for k, p in zip(order, place)}
    assert all((r.shard, r.slot) == want[r.doc_id] for r in rows)
    assert all(r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    few = sharding.shard(sharding.document_sizes(odd), 5, ["doc_id", "text_crc32", "size"]).collect()
    assert sorted((r.slot, r.shard) for r in few) == [(k // 5, k % 5) for k in range(len(few))] and len(few) == odd.count()
    assert sharding.shard(sharding.document_sizes(empty), 5, ["doc_id"]).count() == 0
    same = spark.range(0, 9000, 1, 4).select(F.lit(7).alias("doc_id"), F.lit("s").alias("slot"), F.lit("t").alias("_tie"))
    rows, n = sharding.numbered(same, ["doc_id"])
    assert n == 9000 and rows.select("row_number").distinct().count() == n and rows.select(F.spark_partition_id()).distinct().count() > 1
    assert sharding.shard(same, 5, ["doc_id"]).select("shard", "slot").distinct().count() == n


# 7: urls


def test_cascade_is_exact(spark):
    keys = [f"k{k}.example" for k in range(5000)]
    listed = keys[::7]
    c = urlfilter.build_cascades(spark.createDataFrame([(k,) for k in keys + keys[:50]] + [(None,)], "key string"), {"a": listed, "b": []})
    assert (c["a"].test(urlfilter.hashes(np.array(keys, object))) == np.isin(keys, listed)).all() and len(c["a"].levels) > 1
    assert not c["b"].test(urlfilter.hashes(np.array(keys, object))).any()


def test_urls(spark):
    urls = [None, "no scheme", "http://COM/en/1", "https://a.b.Example.com/en/77?x#y", "http://x.net/de/8", "http://example.net/de/88", "ftp://m.spam-farm.example.org", "http://notexample.com/en", "x://e.org/es/?q=://z", "http:///p"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, host string")
    out = urlfilter.judge_urls(pages, queries.BLOCK_RULES, queries.ALLOW_RULES, queries.BLOCKED_HOSTS).orderBy("page_id").collect()
    assert [r.rule for r in out] == [None, None, "com/en/", "example.com/en/7", "net/de/", "example.net/de/8", None, None, "org/es/", None]
    assert [r.verdict for r in out] == ["allow", "allow", "block", "allow", "allow", "block", "block", "allow", "block", "allow"]
    assert (out[3].host, out[3].path) == ("a.b.example.com", "/en/77") and (out[0].host, out[0].path) == ("", "")
    assert urlfilter.judge_urls(pages.limit(0), queries.BLOCK_RULES, [], []).count() == 0
    wide = pages.select("page_id", F.concat(F.lit("http://"), F.repeat(F.lit("a."), 200000), F.lit("e.org/es/x\x00")).alias("url"))
    assert {(r.rule, r.verdict) for r in urlfilter.judge_urls(wide, queries.BLOCK_RULES, [], ["q" * 9000 + ".e"]).collect()} == {("org/es/", "block")}


# 9: decontamination


def test_decontamination_blocks_and_offsets(spark, odd, empty):
    items = spark.createDataFrame([(1, "One TWO three"), (2, " ".join(f"t{k}" for k in range(14))), (3, None), (4, "--"), (5, "one two three")], "item_id long, text string")
    text = "É!one, Two... three! " + " ".join(f"T{k}" for k in range(2, 14))
    docs = spark.createDataFrame([(1, text, "x"), (2, "one two", None), (3, None, None)], "doc_id long, text string, items string")
    for words in (10**6, 1):
        out = {r.doc_id: r for r in decontam.decontaminate(docs, items, block_words=words).collect()}
        assert out[1]["items"] == ["1", "2", "5"] and out[1].n_hit == 15 and out[1].n_words == 16
        assert text[out[1].char_spans[0].begin :].startswith("one,") and out[2].n_hit == 0 and out[3].n_words == 0
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]
    assert decontam.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0 and decontam.decontaminate(empty, items).count() == 0


# the pipeline


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (5, 6), (6, 5)]
    got = {r.node: r.root for r in _cluster.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1000 for k in range(1000, 1100)}, 5: 5, 6: 5}


def test_pipeline_against_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    tox = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))).where("score < 0.7").collect()}
    left = docs.where(F.col("doc_id").isin(list(tox)))
    model = quality.fit(docs, quality.combined_grades(labels), "grade")
    assert len(model.thresholds) == 2
    good = {r.doc_id for r in quality.judge(left, model, 2.0, 0.4).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    first = {d for d, (_, low, _) in brute_join(rows, ngram_join.Spec(5, 80, 100)).items() if d == low}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [word.findall(lowered(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}

    def hit(t):
        w = word.findall(lowered(t))
        return any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1))

    want = {d for d, t in rows if d in first and not hit(t)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got.keys() == want
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    for d, t in rows:
        if d in want:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("bare", ["documents", "labels", "benchmark"])
def test_pipeline_of_empty_tables(spark, tmp_path, bare):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows.limit(0 if name == bare else 60).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert kept == 0 if bare == "documents" else kept > 0


def test_pipeline_stages_keep_columns(spark, odd, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert os.path.exists(queries.tokenizer_path())
