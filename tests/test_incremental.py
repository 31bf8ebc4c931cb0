"""Builds that keep their stages against builds of everything."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, corpus, incremental, snapshots

COLUMNS = ("published_date", "effective_from", "effective_to", "tax_year", "document_version", "authority_level", "language", "form_code")
RECORD = "source_id string, record_id string, ordinal int, content_kind string, title_path array<string>, content string, page int, page_end int, section string, sheet string, cell_range string, table_headers array<string>, extraction_method string, warnings array<string>"


def registry(spark, rows):
    full = spark.createDataFrame(rows, "id string, title string, sha256 string, status string").withColumns(
        {"review_status": F.lit("approved"), "document_type": F.lit("d"), "source_url": F.lit("https://h/x"), "authority_rank": F.lit(1)} | {c: F.lit(None).cast("string") for c in COLUMNS})
    return full.withColumns({c: F.expr("cast(array() as array<string>)") for c in ("tax_types", "taxpayer_types", "supersedes", "tags", "aliases", "workflow_ids")})


def records(spark, texts):
    rows = [(s, f"{s}-{k}", k, "p", [], t, 1, None, None, None, None, [], "pdf_text", []) for s, ts in texts.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, RECORD)


class Reader:
    """Extraction of texts that notes what it is asked for."""

    def __init__(self, spark, texts):
        self.spark, self.texts, self.asked = spark, texts, []

    def __call__(self, sources):
        ids = [r.id for r in sources.select("id").collect()]
        self.asked.append(sorted(ids))
        return records(self.spark, {s: self.texts[s] for s in ids})


def whole(spark, sources, texts):
    own = corpus.eligible(sources)
    rows = corpus.normalize_records(records(spark, texts).join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi"))
    return sorted(map(str, chunking.build_chunks(rows, own).collect()))


def test_only_what_changed_is_read_and_written(spark, tmp_path):
    path = f"{tmp_path}/b"
    texts = {f"s{k}": [f"text {j} of {k}. " * 40 for j in range(3 * k + 1)] for k in range(5)}
    rows = {s: (s, f"T {s}", f"h-{s}", "current") for s in texts}
    read = Reader(spark, texts)
    state = lambda: sorted(map(str, incremental.load(spark, path).collect()))
    build = lambda **k: incremental.build(registry(spark, list(rows.values())), path, read, **k)
    first = build()
    assert first.changed == sorted(texts) and state() == whole(spark, registry(spark, list(rows.values())), texts)
    assert build() == incremental.Step([], [], 5, 0) and len(read.asked) == 1
    texts["s1"] = ["another text."]
    rows["s1"] = ("s1", "T s1", "h-new", "current")
    before = snapshots.manifest(spark, f"{path}/chunks").folders
    second = build()
    assert second.changed == ["s1"] and read.asked[-1] == ["s1"] and second.bytes < first.bytes / 2
    now = snapshots.manifest(spark, f"{path}/chunks").folders
    assert [k for k in now if now[k] != before[k]] == [1]  # the bucket of s1 alone
    assert state() == whole(spark, registry(spark, list(rows.values())), texts)
    rows["s2"] = ("s2", "T s2", "h-s2", "excluded")
    rows["s9"] = ("s9", "new", "h-9", "current")
    texts["s9"] = ["nine " * 900]
    third = build()
    assert (third.changed, third.removed, third.kept) == (["s9"], ["s2"], 4) and read.asked[-1] == ["s9"]
    assert state() == whole(spark, registry(spark, list(rows.values())), texts)
    assert sorted({r.source_id for r in incremental.load(spark, path, "records").collect()}) == ["s0", "s1", "s3", "s4", "s9"]
    assert build(settings="v2").changed == ["s0", "s1", "s3", "s4", "s9"] and build(settings="v2", force=True).kept == 0
    assert state() == whole(spark, registry(spark, list(rows.values())), texts)


def test_a_build_that_dies_leaves_the_last_one(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/b"
    texts = {"s0": ["old."], "s1": ["one."]}
    read = Reader(spark, texts)
    incremental.build(registry(spark, [("s0", "a", "h0", "current"), ("s1", "b", "h1", "current")]), path, read)
    before = sorted(map(str, incremental.load(spark, path).collect()))
    changed = registry(spark, [("s0", "a", "h2", "current"), ("s1", "b", "h1", "current")])
    texts["s0"] = ["new."]
    real = snapshots._swap

    def dies(spark, where, m):
        if where.endswith("lineage"):
            raise OSError("killed")
        real(spark, where, m)

    monkeypatch.setattr(snapshots, "_swap", dies)
    with pytest.raises(OSError):
        incremental.build(changed, path, read)
    monkeypatch.setattr(snapshots, "_swap", real)
    assert sorted(map(str, incremental.load(spark, path).collect())) == before
    assert incremental.build(changed, path, read).changed == ["s0"]
    assert sorted(map(str, incremental.load(spark, path).collect())) == whole(spark, changed, texts)


def test_no_sources(spark, tmp_path):
    none = registry(spark, [("s0", "a", "h0", "excluded")])
    step = incremental.build(none, f"{tmp_path}/b", Reader(spark, {}))
    assert step.changed == [] and incremental.load(spark, f"{tmp_path}/b").count() == 0
    assert incremental.build(registry(spark, [("s0", "a", "h0", "current")]), f"{tmp_path}/b", Reader(spark, {"s0": ["x"]})).changed == ["s0"]
    assert incremental.load(spark, f"{tmp_path}/b").count() == 1
