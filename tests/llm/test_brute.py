"""The classifiers, long texts and large lists against plain versions, and rows that only some operators meet."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _sample, bpe, decontam, langid, ngram_join, quality, queries, rules, sharding, toxicity, urlfilter
from corpusloom.llm._sample import fold
from tests.llm.test_llm import DATA, SMALL, brute_join

BROKEN = b"ok \xff\xfe text \xc3"


def small(spark, d=SMALL):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def spelled(text):
    """Lower-cased letters, anything else a blank."""
    return [(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32 for c in text or ""]


def grams(codes, orders):
    """(order, hash) of each n-gram, by one loop over places."""
    for n in orders:
        for i in range(len(codes) - n + 1):
            h = 0
            for k in range(1, n + 1):
                h = (h * 0x01000193 + (codes[i + k - 1] ^ (k * 0x9E37)) * 0x85EBCA6B) & 0xFFFFFFFF
            x = h ^ (h >> 15)
            yield n, (x * 0x2C1B3C6D) & 0xFFFFFFFF


def sampled(docs, labels, col, most=10**9):
    texts = {r.doc_id: r.text for r in docs.collect()}
    return [(texts[r.doc_id], r[col]) for r in labels.collect() if r.doc_id in texts]


def test_toxicity_is_the_plain_version(spark):
    docs, labels = small(spark, DATA)
    docs = docs.where("length(text) < 1000")
    labels = labels.where(fold("doc_id", 3) != 1).join(docs.select("doc_id"), "doc_id")
    model = toxicity.fit(docs, labels, min_z=3.0)
    rows = sampled(docs, labels, "toxic")
    sets = [{key for _, key in grams(spelled(t), range(4, 7))} for t, _ in rows]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    count = collections.Counter((key, y) for s, (_, y) in zip(sets, rows) for key in s)
    found = []
    for key in {k for k, _ in count}:
        p, q = (count[key, 1] + 1) / (n[1] + 2), (count[key, 0] + 1) / (n[0] + 2)
        m = (count[key, 0] + count[key, 1] + 2) / (n[0] + n[1] + 4)
        z = (p - q) / math.sqrt(m * (1 - m) * (1 / n[0] + 1 / n[1]))
        if abs(z) >= 3.0:
            found.append((-round(abs(z), 9), key, math.log(p / q)))
    kept = {key: r for _, key, r in found}
    assert len(kept) > 10 and len(set(kept) & set(model.keys.tolist())) >= 0.98 * len(kept)  # ties in the last place
    kept = {k: r for k, r in ((k, {key: r for _, key, r in found}[k]) for k in model.keys.tolist())}
    w, b = dict.fromkeys(kept, 0.0), 0.0
    m1, m2, mb, vb = dict.fromkeys(kept, 0.0), dict.fromkeys(kept, 0.0), 0.0, 0.0
    has = [sorted(s & set(kept)) for s in sets]
    for step in range(1, 301):
        g, gb = {k: 1e-3 * w[k] for k in kept}, 0.0
        for keys, (_, y) in zip(has, rows):
            e = (1 / (1 + math.exp(-(sum(w[k] * kept[k] for k in keys) + b))) - y) * 0.5 / n[y]
            gb += e
            for k in keys:
                g[k] += e * kept[k]
        rate = 0.05 / (1 + step / 100)
        for k in kept:
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g[k], 0.999 * m2[k] + 0.001 * g[k] ** 2
            w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (math.sqrt(m2[k] / (1 - 0.999**step)) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-9)
    plain = {}
    for r in docs.collect():
        keys = {key for _, key in grams(spelled(r.text), range(4, 7))} & set(kept)
        plain[r.doc_id] = 1 / (1 + math.exp(-(sum(w[k] * kept[k] for k in keys) + b)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got.keys() == plain.keys() and max(abs(got[k] - plain[k]) for k in plain) < 1e-5


def frequencies(codes, orders, bits):
    n, counts = 0, collections.Counter()
    for _, key in grams(codes, orders):
        counts[key >> (32 - bits)] += 1
        n += 1
    return {k: math.sqrt(c / n) for k, c in counts.items()}


def test_languages_are_decoded_as_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 2000")
    model = langid.fit(docs, docs.where(fold("doc_id", 5) != 0).select("doc_id", "lang"))
    for r, t in zip(langid.identify(docs, model).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        f = frequencies(spelled(t.text), range(1, 4), model.bits)
        margin = [sum(v * float(model.weights[k, j]) for k, v in f.items()) + float(model.bias[j]) for j in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * s)) for m, s in zip(margin, word)) for word in model.code.tolist()]
        share = [math.exp(min(loss) - x) for x in loss]
        best = max(range(len(loss)), key=lambda k: share[k])
        assert r.lang_pred == model.langs[best] and abs(r.score - share[best] / sum(share)) < 1e-3


def test_quality_is_judged_as_by_hand(spark):
    docs, labels = small(spark)
    grades = quality.combined_grades(labels)
    assert {r.grade for r in grades.collect()} == {0, 1, 2}
    model = quality.fit(docs, grades, "grade")
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    some = docs.where("length(text) < 1500")
    for r, t in zip(quality.judge(some, model, 2.0, 0.4).orderBy("doc_id").collect(), some.orderBy("doc_id").collect()):
        text, f = t.text, frequencies([ord(c) for c in t.text], range(1, 4), model.bits)
        z = sum(v * float(model.weights[k]) for k, v in f.items())
        if text:
            lines, upper = text.encode().split(b"\n"), sum("A" <= c <= "Z" for c in text)
            letter, space = upper + sum("a" <= c <= "z" or ord(c) >= 128 for c in text), text.count(" ")
            shape = [1 - len(set(lines)) / len(lines), upper / max(1, letter), 1 - (letter + space) / len(text), 1 / (1 + space)]
            z += sum(x * float(model.weights[(1 << model.bits) + k]) for k, x in enumerate(shape))
        below = [1 / (1 + math.exp(-(x - z))) for x in model.thresholds]
        p = [below[0], below[1] - below[0], 1 - below[1]]
        assert abs(r.expected_grade - (p[1] + 2 * p[2])) < 2e-3 and abs(r.tail_prob - p[2]) < 2e-3 and r.kept == (r.tail_prob >= 0.4)


def test_quality_held_out_grades(spark):
    out = queries.op1_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    good, low = out.where("quality = 1 AND toxic = 0"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and low.where("kept").count() <= 0.06 * low.count()
    assert good.agg(F.avg("expected_grade")).first()[0] > low.agg(F.avg("expected_grade")).first()[0] + 0.7


def test_bpe_of_long_documents_is_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 3000").select("doc_id", "text")
    glued = docs.unionByName(docs.agg(F.lit(-1).cast("bigint").alias("doc_id"), F.regexp_replace(F.array_join(F.collect_list("text"), " "), r"\s", "").alias("text")))
    out = {r.doc_id: r for r in bpe.encode_documents(glued, path, leaf=1024).collect()}
    for r in glued.collect():
        ids = whole.encode(r.text, add_special_tokens=False).ids
        assert out[r.doc_id].ids == ids and out[r.doc_id].decoded == whole.decode(ids, skip_special_tokens=False)


def test_labels_are_the_first_by_hash(spark):
    """Chosen by cells, not by ranking all rows; also with more labels than any table of literals would hold."""
    n = 30000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 > 0, "hot").otherwise(F.concat(F.lit("l"), F.col("doc_id") % 7)).alias("y"))
    got = collections.defaultdict(set)
    for r in _sample.labelled_texts(docs, labels, "y", 50).collect():
        got[r.label].add(r.id)
    place = {r.doc_id: (r.p, r.y) for r in labels.select("doc_id", "y", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("p")).collect()}
    by = collections.defaultdict(list)
    for k, (p, y) in place.items():
        by[y].append((p, k))
    assert got == {y: {k for _, k in sorted(ks)[:50]} for y, ks in by.items()}
    many = docs.limit(12000).select("doc_id", F.col("doc_id").cast("string").alias("y"))
    assert _sample.labelled_texts(docs, many, "y", 3).count() == 12000


def test_hot_signatures_are_dealt_out(spark, monkeypatch):
    """A third of the texts share a signature and more; blocks of three classes, and of a few bytes, give the same links."""
    monkeypatch.setattr(ngram_join, "FOREST", 3)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(80):
        words = list(base) if k % 3 else [f"q{rng.randrange(500)}" for _ in range(40)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
        rows.append((k, " ".join(words)))
    spec = ngram_join.Spec(4, 85, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(docs, spec, block=5, block_bytes=3000).collect()}
    assert got == brute_join(rows, spec)


def test_points_rule_out_unrelated_sets():
    rng = np.random.default_rng(3)
    for n in (300, 1000, 1800, 3000, 20000):
        sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for _ in range(24)]
        tree = ngram_join.CountRTree(sets, ngram_join.Spec())
        assert sum(len(tree.survivors(i)) for i in range(24)) == 24  # each only itself
        left, _ = ngram_join.allowed_forest([ngram_join.point_of(u) for u in sets], tree.n, ngram_join.Spec())
        assert not left


def test_lists_above_the_bound_are_split(spark):
    keys = [f"k{k}.example/{'abc'[k % 3]}" for k in range(3000)]
    pages = spark.createDataFrame([(k, f"http://sub.{key}x") for k, key in enumerate(keys)], "`page id` long, url string")
    block, allow, hosts = keys[::5], keys[::7], [k.split("/")[0] for k in keys[::11]]
    passes = list(urlfilter.cascade_passes(spark.createDataFrame([(k,) for k in keys], "key string"), {"a": block, "b": []}, max_bytes=200))
    assert len(passes) > 2 and all(sum(c.size() for c in p.values()) <= 200 for p in passes)
    got = {r["page id"]: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, block, allow, hosts, "page id", max_bytes=400).collect()}
    for k, key in enumerate(keys):
        rule = key if key in set(block) | set(allow) else None
        assert got[k] == (rule, "block" if key in block or rule is None and key.split("/")[0] in hosts else "allow")


def test_benchmark_in_blocks_and_items_without_ids(spark):
    words = [f"b{k}" for k in range(900)]
    items = [(k, " ".join(words[k * 30 : k * 30 + 30])) for k in range(30)] + [(None, "no id has this item of eleven words in all, you see")]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, (_, t) in enumerate(items)] + [(99, "clean")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (10**6, 100):
        out = {r.doc_id: r for r in decontam.decontaminate(docs, table, block_words=size).collect()}
        assert all(out[k]["items"] == [str(k)] and out[k].n_hit == 30 for k in range(30)) and not out[99].contaminated
        assert out[30]["items"] == [] and out[30].n_hit == 12 and out[30].contaminated
    assert sorted(r.doc_id for r in decontam.clean_documents(docs, table).collect()) == [99]
    calls = []
    for _ in range(2):
        decontam.patterns_of("n", lambda: calls.append(1) or [(1, "a b")], 10)
    decontam.patterns_of("m", lambda: calls.append(1) or [(1, "a b")], 10)
    assert len(calls) == 2 and list(decontam._built) == ["m"]  # one build for a block, and the last block only


@pytest.mark.parametrize("name", ["a b", "score", "lang_pred", "text2"])
def test_broken_texts_and_odd_names(spark, name):
    docs = spark.createDataFrame([(1, bytearray(BROKEN)), (2, None)], f"`{name}` long, raw binary").select(F.col(f"`{name}`"), F.expr("cast(raw as string)").alias("text"))
    learn = docs.select(F.col(f"`{name}`"), F.lit("en").alias("lang"))
    text = BROKEN.decode("utf-8", "replace")
    assert [r.decoded for r in bpe.encode_documents(docs, queries.tokenizer_path(), name).orderBy(f"`{name}`").collect()] == [text, ""]
    assert langid.identify(docs, langid.fit(docs, learn, id_col=name), id_col=name).columns[0] == name
    labels = docs.select(F.col(f"`{name}`"), (F.col(f"`{name}`") - 1).cast("int").alias("toxic"))
    assert toxicity.score(docs, toxicity.fit(docs, labels, id_col=name), keep=(name,)).count() == 2
    assert toxicity.clean_documents(docs, toxicity.fit(docs, labels, id_col=name)).columns == docs.columns
    assert quality.judge(docs, quality.fit(docs, labels, "toxic", id_col=name), keep=(name,)).count() == 2
    rows = docs.withColumnRenamed(name, "doc_id")
    assert {r.n_words for r in decontam.decontaminate(rows, rows.select(F.col("doc_id").alias("item_id"), "text")).collect()} == {0, 4}
    assert {r.n_shingles for r in ngram_join.jaccard_components(rows).collect()} == {0, 1}
    assert rules.ledger(rules.measure(rows)).count() == sharding.document_sizes(rows).count() == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as N

    from corpusloom.llm import _cluster

    df = N(sparkSession=N(sparkContext=N(getCheckpointDir=lambda: None, master="spark://h:1"), conf=N(get=lambda *a: None, set=lambda *a: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _cluster.checkpointed(df)
