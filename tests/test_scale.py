"""Work that must not grow with the number of blocks, of pairs or of groups."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import rules
from corpusloom.functions import text
from corpusloom.operators import chunking, corpus, ordered, query, ranges, retrieval


def test_texts_are_read_once_for_any_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 2)
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, f"word{k % 7} word{k % 5} word{k % 3}") for k in range(40)], "doc_id long, text string")
    asked = rows.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    found = retrieval.bm25_top(rows.mapInArrow(read, rows.schema), asked, 3).collect()
    assert len(found) == 30 and seen.value == 40


def test_terms_of_few_documents_take_no_column_of_the_product():
    terms, n = [f"t{k}" for k in range(1000)], 64
    question, term = np.repeat(np.arange(n), 1000), np.tile(np.arange(1000), n)
    block = retrieval.TermBlock(terms, np.full(1000, np.log(1e6)), question, term, n)
    scores, step = block.prepare()
    out = scores(np.array([0, 0, 1]), np.array([3, 5, 3]), np.array([1.0, 2.0, 4.0]), 2)
    assert step == retrieval._CELLS // 2 // n and np.array_equal(out, np.repeat([[3.0], [4.0]], n, 1))


def test_rare_terms_are_added_up_a_few_rows_at_a_time():
    """Long texts share many terms with many questions: what is held is bounded by a part, not by all rows that are scored at once."""
    n, terms, rows = 512, 600, 128
    question, term = np.repeat(np.arange(n), terms), np.tile(np.arange(terms), n)
    scores, step = retrieval.TermBlock([f"t{k}" for k in range(terms)], np.full(terms, np.log(1e6)), question, term, n).prepare()
    assert step >= rows
    value = np.arange(rows * terms, dtype=float)
    tracemalloc.start()
    out = scores(np.repeat(np.arange(rows), terms), np.tile(np.arange(terms), rows), value, rows)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(out, np.repeat(value.reshape(rows, terms).sum(1)[:, None], n, 1))
    assert held < 100 << 20  # 39 million sums, 8 bytes for each array of them


def test_rare_terms_are_added_up_for_rows_in_any_order():
    """A stored index has its parts by term, not by row."""
    n, terms, rows = 512, 60, 128
    question, term = np.repeat(np.arange(n), terms), np.tile(np.arange(terms), n)
    scores, _ = retrieval.TermBlock([f"t{k}" for k in range(terms)], np.full(terms, np.log(1e6)), question, term, n).prepare()
    value = np.arange(rows * terms, dtype=float).reshape(rows, terms)
    out = scores(np.tile(np.arange(rows), terms), np.repeat(np.arange(terms), rows), value.T.ravel(), rows)
    assert np.array_equal(out, np.repeat(value.sum(1)[:, None], n, 1))


def test_best_rows_of_some_questions():
    rnd = np.random.default_rng(5)
    scores, ids = np.round(rnd.random((300, 4)), 2), np.arange(300)
    best = retrieval._Best(4, 5, 0.0)
    for a in range(0, 300, 60):
        best.add(scores[a : a + 60, :2], ids[a : a + 60], np.array([0, 2]))
        best.add(scores[a : a + 60, 2:], ids[a : a + 60], np.array([1, 3]))
    got = list(zip(*(x.tolist() for x in best.rows)))
    assert got == [(q, -s, k) for q, c in enumerate((0, 2, 1, 3)) for s, k in sorted(zip((-scores[:, c]).tolist(), range(300)))[:5]]


def test_equal_texts_tie_in_any_order_of_words(spark):
    """Sums of many terms differ in their last bits by the order of the terms: texts of the same words must tie all the same."""
    rnd = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(40):
        own = [words[k] for k in rnd.choice(400, 60, replace=False) for _ in range(1 + k % 3)]
        rows += [(3 * g + c, " ".join(rnd.permutation(own))) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    got = retrieval.bm25_top(docs, asked, 120).collect()
    of = {}
    for r in got:
        of.setdefault((r.query_id, r.doc_id // 3), set()).add(r.bm25)
    assert len(got) == 40 * 120 and all(len(x) == 1 for x in of.values())


def test_scores_in_a_shard_do_not_depend_on_who_else_asks():
    rnd = np.random.default_rng(8)
    n, n_terms = 40, 200
    question, term = np.nonzero(rnd.random((n, n_terms)) < 0.4)
    block = retrieval.TermBlock([f"t{k}" for k in range(n_terms)], rnd.random(n_terms) * 8, question, term, n)
    row, at = np.nonzero(rnd.random((30, n_terms)) < 0.5)
    value = rnd.random(len(row)) * 10
    whole = block.ready()[0](row, at, value, 30)
    live = rnd.random(n) < 0.3
    assert np.array_equal(block.prepare(live)[0](row, at, value, 30), whole[:, live])


def test_sums_in_ranges_equal_the_sums_of_the_pairs(spark):
    rnd = np.random.default_rng(2)
    cells = spark.createDataFrame([("ab"[k % 2], int(r), int(c), int(v)) for k, (r, c, v) in enumerate(rnd.integers(0, 30, (500, 3)))], "sheet string, row int, col int, v long")
    boxes = spark.createDataFrame([("ab"[k % 2], k, int(r), int(c), int(r + h), int(c + w)) for k, (r, c, h, w) in enumerate(rnd.integers(-1, 20, (90, 4)).clip([0, 0, -1, -1]))],
        "sheet string, name int, row1 int, col1 int, row2 int, col2 int")
    want = ranges.cells_in_ranges(cells, boxes, ["sheet"]).groupBy("name").agg(F.count("*"), F.sum("v"))
    got = ranges.sums_in_ranges(cells, boxes, ["sheet"], "v").select("name", "n", "total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30


def test_pieces_of_ranges_are_not_sent_to_the_driver(spark):
    cells = spark.range(1000).selectExpr("1 AS sheet", "cast(id AS int) AS row", "cast(id % 50 AS int) AS col", "id AS v")
    boxes = spark.range(100).selectExpr("1 AS sheet", "id AS name", "0 AS row1", "0 AS col1", "cast(id AS int) AS row2", "7 AS col2")
    for met in (ranges.cells_in_ranges(cells, boxes, ["sheet"]), ranges.sums_in_ranges(cells, boxes, ["sheet"], "v")):
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_a_tally_measures_texts_once_for_all_policies(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, "a b c d " * (k % 30)) for k in range(60)], "doc_id long, text string")
    counts = rules.tally(rules.ledger(rules.measure(rows.mapInArrow(read, rows.schema))))
    got = {v: sorted(map(tuple, rules.ablations(counts, v).collect())) for v in rules.POLICIES}
    assert seen.value == 60
    led = rules.ledger(rules.measure(rows))
    assert all(sorted(map(tuple, rules.ablations(led, v).collect())) == x for v, x in got.items())


def test_labels_are_found_once_and_only_where_a_phrase_stands(spark):
    rows = spark.createDataFrame([(1, "Ab, bc"), (2, "abx bc"), (3, "x"), (4, None), (5, "wide AB")], "k int, t string")
    phrases = {"one": ["ab"], "two": ["bc", "zz"], "wide": ["wide"]}
    found = query.tax_labels(F.col("t"), phrases, "wide", ("one",))
    assert found._jc.toString().lower().count("rlike") == 3
    assert {r.k: r.x for r in rows.select("k", found.alias("x")).collect()} == {1: ["one", "two"], 2: ["two"], 3: [], 4: [], 5: ["one"]}


def _records(spark, n, words):
    """A source and n records of it, each with a text of so many words."""
    sources = spark.createDataFrame([("a",)], "id string").withColumns({c: F.lit(None).cast("string") for c in (
        "title", "source_url", "tax_year", "document_version", "authority_level", "language", "status", "form_code", "document_type", "sha256")} | {
        c: F.lit(None).cast("date") for c in ("published_date", "effective_from", "effective_to")} | {"authority_rank": F.lit(1)} | {
        c: F.array(F.lit("x")) for c in ("tax_types", "taxpayer_types", "supersedes", "tags", "aliases", "workflow_ids")})
    texts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.concat(F.sha2(k.cast("string"), 256), F.lit(". "))), "")
    made = spark.range(n).select(F.lit("a").alias("source_id"), F.col("id").cast("int").alias("ordinal"), texts.alias("content"), F.lit("text").alias("content_kind"),
        F.lit(1).alias("page"), F.lit(1).alias("page_end"), *[F.lit(None).cast("string").alias(c) for c in ("section", "sheet", "cell_range")],
        *[F.array().cast("array<string>").alias(c) for c in ("title_path", "table_headers", "warnings")])
    return sources, made


def test_texts_are_not_repeated_for_their_pieces(spark, monkeypatch):
    seen, grouped = [], ordered.greedy_groups
    monkeypatch.setattr(ordered, "greedy_groups", lambda df, *a, **k: seen.append(df.columns) or grouped(df, *a, **k))
    sources, records = _records(spark, 2, 300)
    assert chunking.build_chunks(corpus.normalize_records(records), sources).count() == 10
    assert "piece" in seen[0] and "content" not in seen[0] and "content_hash" not in seen[0]


def test_what_a_build_stores_grows_with_the_text(spark):
    """Ten times as long a text has ten times as many pieces: its bytes must not grow a hundredfold."""
    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("part-*"))

    folder, bytes_of = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")), []
    for words in (600, 6000):
        before = size(folder)
        assert chunking.build_chunks(*_records(spark, 1, words)[::-1]).count() > 0
        bytes_of.append(size(folder) - before)
    assert bytes_of[1] < 15 * bytes_of[0]


def test_few_texts_are_python_objects_at_once():
    texts = pa.array(["\u00e9" + "a" * 20_000] * 2000)
    tracemalloc.start()
    out = text._nfkc.func(texts)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.equals(texts) and held < 20 << 20
    assert text._nfkc.func(pa.array([None, "\ufb01"])).to_pylist() == [None, "fi"] and len(text._nfkc.func(pa.array([], pa.string()))) == 0


def test_the_first_row_of_a_key_is_held_once(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "c"), (1, None, "a"), (None, 3, "z"), (None, 3, "y")], "k int, o int, t string")
    found = ordered.first_of(rows, ["k"], F.col("o"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, None, "a"), (None, 3, "y")], key=str)
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()  # it holds the row beside the order, which ends with the row


def test_vectors_without_a_direction_push_no_others_out(spark):
    """Cosines are rounded when they are kept, not all of them: a task with more empty directions than places still finds its best."""
    rows = [(k, [0.0, 0.0] if k % 2 else [1.0, k / 100]) for k in range(200)] + [(900, [float("nan"), 1.0]), (901, [1.0, 0.1234567894999])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = vectors.where("vec_id IN (0, 1, 900)").selectExpr("vec_id AS query_id", "embedding AS query_vec")
    found = retrieval.cosine_top(vectors, asked, 8).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, k) for k in (0, 2, 4, 6, 8, 10, 12, 901)]
    assert all(r.cosine == round(r.cosine, 9) for r in found)
