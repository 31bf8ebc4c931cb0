"""Whole answers with providers made for the test, the corpus build and its settings on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, images, rag, retrieval, upload


def embed(texts):
    return [[1.0, float("vat" in t.lower())] for t in texts]


def generate(prompts):
    if any("BUSY" in p for p in prompts):
        raise upload.ProviderError(429, "", "slow down")
    out = []
    for p in prompts:
        step = {"title": "Open", "instruction": "Do it [SOURCE_1]", "image_id": "IMAGE_1", "citation_markers": []}
        out.append("broken" if "broken" in p else json.dumps({"answer": "See [SOURCE_1] [SOURCE_9].", "guide": {"steps": [step]} if "IMAGE_1" in p else None}))
    return out


@pytest.fixture(scope="module")
def corpus_rows(spark):
    base = [("c1", "How to file VAT returns: step by step", "act", "s1", 1, None, None), ("c2", "VAT of 2024", "act", "s2", 2, "2024/2025", None), ("c3", "income tax", "act", "s3", 3, None, None),
            ("i1", "Figure of VAT form", "guide_image", "s1", 1, None, "pic"), ("i2", "Figure of other VAT page", "guide_image", "s9", 9, None, "pic2")]
    rows = spark.createDataFrame([(*r, f"https://m.example/{r[0]}.webp" if r[6] else None, "alt" if r[6] else None, "current", "en") for r in base],
                                 "id string, content string, content_type string, source_id string, page int, tax_year string, image_id string, image_url string, image_alt_text string, status string, language string")
    vectors = spark.createDataFrame([(r[0], [1.0, 1.0 if "VAT" in r[1] else 0.0]) for r in base], "id string, embedding array<double>")
    return retrieval.row_defaults(rows), vectors


def test_answers(spark, corpus_rows):
    chunks, vectors = corpus_rows
    said = [(1, 1, "user", "How do I file VAT?"), (2, 1, "user", "hello"), (2, 2, "assistant", "hi"), (3, 1, "user", "x" * 9000), (4, 1, "user", "broken VAT answer please, for 2025/26"), (5, 1, "user", " ")]
    settings = corpus.Settings(dimensions=2, media_base_url="https://m.example/")
    ask = lambda rows, c, v: {r.query_id: r for r in rag.answer_questions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), c, v, embed, generate, settings, lambda s: None).collect()}
    got = ask(said, chunks, vectors)
    assert got[1].answer == "See [SOURCE_1] ." and [c.source_id for c in got[1].citations] == ["s1"] and got[1].error is None
    assert [(s.number, s.citation_ids, s.image.id) for s in got[1].guide.steps] == [(1, ["1"], "pic")]
    assert {k: r.error.code for k, r in got.items() if r.error} == {2: "REQUEST_INVALID", 3: "REQUEST_TOO_LARGE", 4: "ANSWER_INVALID", 5: "REQUEST_INVALID"}
    alone = ask(said[:1], None, None)
    assert alone[1].answer == "See  ." and alone[1].citations == [] and alone[1].guide is None
    busy = ask([(1, 1, "user", "BUSY VAT question, what is it about?")], chunks, vectors)
    assert busy[1].error.code == "USAGE_LIMIT" and busy[1].answer is None
    assert ask([], chunks, vectors) == {}


def test_search_filters_by_the_period_that_is_asked_for(spark, corpus_rows):
    chunks, vectors = corpus_rows
    asked = spark.createDataFrame([(1, "VAT", [1.0, 1.0], "2024/2025"), (2, "VAT", [1.0, 1.0], "2025/2026"), (3, "VAT", [1.0, 1.0], None)], "query_id int, query_text string, query_vec array<double>, tax_year string")
    found = retrieval.hybrid(asked, chunks, vectors, 8).groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ids")).collect()
    assert {r.query_id: r.ids for r in found} == {1: ["c1", "c2", "c3"], 2: ["c1", "c3"], 3: ["c1", "c2", "c3"]}


def test_settings_and_candidates(spark, tmp_path):
    assert corpus.Settings(search_endpoint="e", search_key_present=True).search_configured and corpus.Settings().missing() == ["search_endpoint", "search_key", "model_key"]
    for bad in ({"max_images": 9}, {"timeout_seconds": 0}, {"min_score": 1.5}):
        with pytest.raises(ValueError):
            corpus.Settings(**bad)
    rows = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("a", 1, "z")], "source_id string, page int, image_id string")
    images.write_candidates(rows, f"{tmp_path}/c")
    lines = [json.loads(r.value)["image_id"] for r in spark.read.text(f"{tmp_path}/c").collect()]
    assert sorted(lines) == ["x", "y", "z"]
    schema = corpus.index_schema(8)
    assert len(schema) == 34 and schema["embedding"].metadata == {"searchable": True, "dimensions": 8} and schema["id"].metadata["key"]
    with pytest.raises(ValueError):
        corpus.index_schema(0)


def test_builds_stop_at_registry_errors(spark):
    sources = spark.createDataFrame([("s1", "approved", "current"), ("s2", "draft", "current"), ("s3", "approved", None)], "id string, review_status string, status string")
    assert [r.id for r in corpus.eligible(sources).collect()] == ["s1"]
    none = {"title": "t", "document_type": "d", "source_url": "https://h/x"}
    full = sources.withColumns({k: F.lit(v) for k, v in none.items()} | {c: F.lit(None).cast("string") for c in ("published_date", "effective_from", "effective_to", "tax_year", "document_version", "authority_level", "language", "form_code", "sha256")}
                               | {c: F.expr("cast(array() as array<string>)") for c in ("tax_types", "taxpayer_types", "supersedes", "tags", "aliases", "workflow_ids")} | {"authority_rank": F.lit(1)})
    records = spark.createDataFrame([("s1", "r1", 1, "p", [], "text", 1, None, None, None, None, [], "pdf_text", ["W"]), ("s1", "r2", 2, "p", [], " ", 1, None, None, None, None, [], "pdf_text", [])],
                                    "source_id string, record_id string, ordinal int, content_kind string, title_path array<string>, content string, page int, page_end int, section string, sheet string, cell_range string, table_headers array<string>, extraction_method string, warnings array<string>")
    good = corpus.build(full, records)
    assert (good.records.count(), good.chunks.count()) == (1, 1) and [r.code for r in good.issues.collect()] == ["W"]
    stopped = corpus.build(full, records, requested=["s1", "zz"])
    assert stopped.chunks.count() == 0 and [r.code for r in stopped.issues.collect()] == ["UNKNOWN_SOURCE"]
    cached = corpus.build(full, records.limit(0), cached=records)
    assert cached.records.count() == 1
    assert corpus.totals(corpus.build(full, records.limit(0))).first()["chunk_count"] == 0


def test_quota_ends_a_run(spark):
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(1)
        raise upload.ProviderError(429, "", "quota exceeded")

    rows = spark.range(200).select(F.col("id").cast("string").alias("content_hash"), F.lit("t").alias("embedding_text"))
    out = upload.embed_waves(rows, provider, 2, lambda name, df: spark.createDataFrame(df.collect(), df.schema), waves=5, sleep=lambda s: None)
    assert {r.kind for r in out.collect()} == {"quota_exhausted"} and out.count() == 200
    assert asked.value <= spark.sparkContext.defaultParallelism + 1  # the tasks of the first part only
