"""Registry, constraint catalogues, files, upload and parsed answers on golden rows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions import checks as K
from corpusloom.operators import answer, constraints, registry, upload
from corpusloom.sources import files

H = ["%064x" % k for k in range(9)]
ITEM = "position struct<m:int,p:int>, url string, final_url string, status string, content_type string, sha256 string, local_file string"
BASE = "https://www.ird.gov.lk/en/"


def item(p, url, status="downloaded", kind="application/pdf", h=0, final=None):
    return ((0, p), url, final, status, kind, H[h], f"f{p}")


def test_build(spark):
    rows = [
        item(0, BASE + "Acts/Income_2025_2026.pdf", h=1), item(1, BASE + "x/again.pdf", h=1), item(2, "https://other.example/a.pdf", h=2),
        item(3, BASE + "WHT/Schedule.xlsm", "failed", "text/html", 3), item(4, "https://www.ird.gov.lk/si/Page.html", kind="text/html; charset=utf-8", h=4),
        item(5, BASE + "y/Income_2025_2026.pdf", h=5), item(6, BASE + "z.png", kind="image/png", h=6), item(7, BASE + "f.pdf", "failed", h=7), item(8, None, h=8),
    ]
    out = registry.build(spark.createDataFrame(rows, ITEM), broken_url=BASE + "WHT/Schedule.xlsm")
    got = {r["local_file"]: r for r in out.collect()}
    assert set(got) == {"f0", "f3", "f4", "f5"}
    assert got["f0"]["aliases"] == [BASE + "x/again.pdf"] and got["f0"]["document_type"] == "act" and got["f0"]["tax_year"] == "2025/2026"
    assert got["f0"]["id"] == "ird-income-2025-2026" and got["f5"]["id"] == "ird-income-2025-2026-00000000"
    assert got["f3"]["status"] == "excluded" and got["f3"]["document_type"] == "spreadsheet_template" and got["f3"]["review_status"] == "rejected"
    assert got["f4"]["language"] == "si" and got["f4"]["status"] == "excluded"
    assert registry.build(spark.createDataFrame([], ITEM)).count() == 0


def test_classify(spark):
    cases = [
        ("https://h/Gazette/a.pdf", "application/pdf", "t"), ("https://h/eservices/Guide_2324.pdf", "application/pdf", "Portal v 1.2"),
        ("https://h/a.html", "text/html", "VAT return"), ("https://h/a.pdf", "application/pdf", "Quick Guide"), ("https://h/x/Asmt_CIT_001.pdf", "application/pdf", "ASMT_CIT_001 form"), (None, None, None),
    ]
    rows = registry.classify(spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, source_url string, media_type string, title string")).orderBy("k").collect()
    assert [r["document_type"] for r in rows] == ["gazette", "portal_guide", "official_webpage", "return_guide", "return_form", "official_webpage"]
    assert rows[1]["status"] == "historical" and rows[1]["document_version"] == "v1.2" and rows[1]["tax_year"] == "2023/2024"
    assert rows[4]["form_code"] == "ASMT_CIT_001" and rows[4]["taxpayer_types"] == ["company"] and rows[2]["tax_types"] == ["vat"]


def test_signature(spark):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("xl/workbook.xml", "x")
    cases = [(b"%PDF-1", "pdf"), (data.getvalue(), "xlsm"), (b"PK\x03\x04", "unknown"), (b" \n<!DOCTYPE html>", "html"), (b"", "unknown")]
    df = spark.createDataFrame([(k, bytearray(c)) for k, (c, _) in enumerate(cases)], "k int, c binary")
    assert [r[0] for r in df.orderBy("k").select(registry.signature(F.col("c"))).collect()] == [x for _, x in cases]


SOURCE = (
    "id string, title string, local_file string, source_url string, final_url string, sha256 string, tax_year string, supersedes array<string>, superseded_by array<string>,"
    "render_pages array<int>, authority_level string, authority_rank int, effective_from date, effective_to date, status string, review_status string, exclusion_reason string, media_type string"
)


def source(**changes):
    row = {"id": "a-b", "title": "T", "local_file": "f", "source_url": "https://h/x", "final_url": None, "sha256": H[1], "tax_year": None, "supersedes": [], "superseded_by": [],
           "render_pages": [1], "authority_level": "gazette", "authority_rank": 90, "effective_from": None, "effective_to": None, "status": "current", "review_status": "approved",
           "exclusion_reason": None, "media_type": "application/pdf"} | changes
    return tuple(row.values())


def test_registry_issues(spark):
    rows = [
        source(), source(id="b", supersedes=["b", "zz"]), source(id="Bad Id", authority_rank=1), source(id="c", source_url="http://h/x", sha256="x", tax_year="2025"),
        source(id="d", status="excluded", render_pages=[2, 2, 0]), source(id="d"), source(id="e", source_url="https://evil/x", title=" "), source(id=None, title=None, source_url=None),
    ]
    df = spark.createDataFrame(rows, SOURCE)
    got = {(r["id"], r["code"]) for r in constraints.registry_issues(df, ["h"]).collect()}
    assert got == {
        ("b", "SUPERSEDES_ITSELF"), ("b", "RELATED_ID_UNKNOWN"), ("Bad Id", "ID_NOT_SLUG"), ("Bad Id", "RANK_MISMATCH"), ("c", "SOURCE_URL_NOT_HTTPS"), ("c", "HASH_INVALID"), ("c", "PERIOD_INVALID"),
        ("d", "EXCLUSION_REASON_MISSING"), ("d", "RENDER_PAGES_REPEATED"), ("d", "RENDER_PAGE_NOT_POSITIVE"), ("d", "ID_REPEATED"), ("e", "HOST_NOT_ALLOWED"), ("e", "TITLE_EMPTY"),
        (None, "ID_NOT_SLUG"), (None, "TITLE_EMPTY"), (None, "SOURCE_URL_NOT_HTTPS"), (None, "HOST_NOT_ALLOWED"),
    }
    assert constraints.host_issues(["h", "H.", "a/b", ""]) == ["HOST_EMPTY", "HOST_NOT_BARE", "HOST_REPEATED"]


def test_file_issues(spark):
    df = spark.createDataFrame([source(), source(id="b", local_file="g", sha256=H[2]), source(id="c", local_file="h", sha256=H[3], render_pages=[9]), source(id="d", local_file="../e/h", status="excluded")], SOURCE)
    disk = spark.createDataFrame([("f", H[1], "pdf", 3), ("h", H[4], "html", 3)], "local_file string, file_sha256 string, signature string, page_count int")
    found = constraints.file_issues(df, disk, "data")
    climbs = constraints.file_issues(df, disk).where("code = 'PATH_ESCAPES'").collect()
    assert [r["id"] for r in climbs] == ["d"]
    assert {(r["id"], r["code"]) for r in found.collect()} == {
        ("b", "FILE_MISSING"), ("c", "CHECKSUM_MISMATCH"), ("c", "SIGNATURE_MISMATCH"), ("c", "RENDER_PAGE_OUTSIDE"), ("d", "EXCLUDED_WITHOUT_FILE"), ("a-b", "HASH_REPEATED"), ("d", "HASH_REPEATED")}
    assert constraints.registry_summary(df, found).first()["valid"] is False


def test_url_checks(spark):
    urls = ["https://m/x/a.webp", "https://m/xy/a.webp", "https://u@m/x/a.webp", "https://m/x/a.webp?q", "https://m/x/../a.webp", "https://m/x/a.png", None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "k int, u string").orderBy("k")
    assert [r[0] for r in df.select(K.public_image(F.col("u"), F.lit("https://m/x"))).collect()] == [True] + [False] * 7
    steps = spark.createDataFrame([([1, 2],), ([2],), ([],), (None,)], "n array<int>")
    assert [r[0] for r in steps.select(K.not_counted(F.col("n"))).collect()] == [False, True, False, False]


def test_jsonl(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    df = spark.createDataFrame([("a", 1), ("b", None)], schema)
    files.write_jsonl(df, str(tmp_path / "x"), "id")
    lines = [x for p in sorted((tmp_path / "x").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == ['{"id":"a","n":1}', '{"id":"b","n":null}']
    rows, faults = files.read_jsonl(spark, str(tmp_path / "x"), schema, "id")
    assert files.strict(rows, faults).count() == 2
    (tmp_path / "y").write_text('{"id":"a","n":1}\n{"id":"a","n":2}\n{"id":\n\n{"n":3}\n')
    rows, faults = files.read_jsonl(spark, str(tmp_path / "y"), schema, "id")
    assert sorted(r["code"] for r in faults.collect()) == ["KEY_MISSING", "KEY_REPEATED", "LINE_MALFORMED"] and rows.count() == 3
    with pytest.raises(ValueError):
        files.strict(rows, faults)
    wanted = spark.createDataFrame([("a",)], "id string")
    assert files.reusable(spark, str(tmp_path / "y"), schema, wanted, "id").count() == 0 and files.reusable(spark, str(tmp_path / "none"), schema, wanted, "id").count() == 0
    assert [r["id"] for r in files.reusable(spark, str(tmp_path / "x"), schema, wanted, "id").collect()] == ["a"]
    files.write_report(str(tmp_path / "r.json"), {"b": 1, "a": 2})
    assert (tmp_path / "r.json").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n' and len(list(tmp_path.glob(".r*"))) == 0
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"url": "u", "status": "downloaded"}, {"url": "v"}]}))
    found = registry.manifest_rows(files.manifests(spark, [str(tmp_path / "m.json"), str(tmp_path / "no.json")]))
    assert [(r["position"]["p"], r["url"]) for r in found.orderBy("position").collect()] == [(0, "u"), (1, "v")]


def test_embed_policy():
    calls, naps = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(texts) > 4 or calls.count(len(texts)) == 1:
            raise upload.ProviderError(503)
        return [[1.0, 2.0] for _ in texts]

    out = upload.embed_batch([str(k) for k in range(6)], ["t"] * 6, flaky, 2, naps.append)
    assert all(v == [1.0, 2.0] for _, v, _ in out) and calls == [6, 6, 6, 6, 4, 4, 2, 2] and naps[0] >= 0.25

    def spent(texts):
        raise upload.ProviderError(429, "RESOURCE_EXHAUSTED", "quota")

    assert upload.embed_batch(["a"], ["t"], spent, 2, naps.append) == [("a", None, "quota_exhausted")]
    assert upload.embed_batch(["a"], ["t"], lambda ts: [[True, 1.0]], 2) == [("a", None, "provider_error")]
    assert upload.embed_batch(["a"], ["t"], lambda ts: [], 2) == [("a", None, "provider_error")]


def test_run_upload(spark):
    chunks = spark.createDataFrame([("1", "s", "h1", "one"), ("2", "s", "h2", "two"), ("3", "s", "h1", "one")], "id string, source_id string, content_hash string, embedding_text string")
    cache = spark.createDataFrame([("h2", [1.0, 0.0])], "content_hash string, vector array<float>")
    index = spark.createDataFrame([("9", "s", "h9", "old", [0.0, 1.0]), ("8", "other", "h8", "old", [0.0, 1.0])], "id string, source_id string, content_hash string, embedding_text string, vector array<float>")
    stored = {}

    def write(name, df):
        stored[name] = df
        return df

    report = upload.run_upload(chunks, cache, index, upload.hashing_provider(2), 2, write, delete_scope_faults=[])
    assert report == {"chunks": 3, "failed": 0, "failures": {}, "stale_deleted": True, "stopped_on_quota": False}
    assert sorted(r["id"] for r in stored["index"].collect()) == ["1", "2", "3", "8"] and stored["cache"].count() == 2
    report = upload.run_upload(chunks, cache, index, upload.hashing_provider(2), 2, write, delete_scope_faults=["SCOPE_DIFFERS"])
    assert not report["stale_deleted"] and stored["index"].count() == 5

    def fails(texts):
        raise upload.ProviderError(400)

    report = upload.run_upload(chunks, cache, index, fails, 2, write, delete_scope_faults=[])
    assert report["failed"] == 2 and report["failures"] == {"provider_error": 1} and not report["stale_deleted"]


def test_scope(spark):
    src = spark.createDataFrame([("a", "approved", "current"), ("b", "approved", "excluded")], "id string, review_status string, status string")
    chunks = spark.createDataFrame([("a",)], "source_id string")
    scope = upload.scope_row(src, "m", "c", [], True, True)
    approved = src.where("status <> 'excluded'")
    assert scope["source_ids"] == ["a"] and upload.scope_faults(scope, approved, chunks, "m", "c") == []
    assert upload.scope_faults(scope | {"complete": False, "requested_source_ids": ["z"]}, approved, chunks, "x", "c") == ["BUILD_INCOMPLETE", "BUILD_OF_SUBSET", "MANIFEST_DIFFERS"]
    assert upload.scope_faults(scope | {"source_ids": ["b"]}, approved, chunks, "m", "c") == ["SCOPE_DIFFERS", "CHUNKS_OUTSIDE_SCOPE"]
    assert upload.scope_faults(None, approved, chunks, "m", "c") == ["SCOPE_MISSING"]


def test_generated(spark):
    step = {"title": "t", "instruction": "i", "image_id": None, "citation_markers": ["SOURCE_1"]}
    good = [{"answer": "x"}, {"answer": "x", "guide": None}, {"answer": "x", "guide": {"steps": [step]}}, {"answer": "x", "guide": {"title": "g", "steps": [{"title": "t", "instruction": "i"}]}}]
    bad = [
        {"answer": " "}, {"guide": None}, {"answer": "x", "more": 1}, {"answer": 1}, {"answer": "x", "guide": {"steps": []}}, {"answer": "x", "guide": {"steps": [step | {"title": " "}]}},
        {"answer": "x", "guide": {"steps": [step | {"z": 1}]}}, {"answer": "x", "guide": {"title": "g"}}, {"answer": "x", "guide": {"steps": [step | {"instruction": 3}]}}, [1], "x",
    ]
    texts = [*map(json.dumps, good), *map(json.dumps, bad), "{", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    got = [r[0] for r in df.select(answer.parse_generated(F.col("t"))).collect()]
    assert [g is not None for g in got] == [True] * len(good) + [False] * (len(bad) + 3)
    assert got[2]["guide"]["steps"][0]["citation_markers"] == ["SOURCE_1"]


def test_step_images(spark):
    image = "array<struct<marker:string,image_id:string,image_url:string,image_alt_text:string,image_caption:string,source_id:string,page:int,content_type:string,status:string>>"
    row = lambda n, url, **o: tuple({"m": str(n), "i": f"p{n}", "u": url, "a": "alt", "c": None, "s": "s", "p": 1, "t": "guide_image", "st": None, **o}.values())
    images = [row(1, "https://m/x/a.webp"), row(2, "https://n/x/a.webp"), row(3, "https://m/x/c.webp", st="Historical"), row(4, "https://m/x/d.webp", a="")]
    cases = ["IMAGE_1", " [IMAGE_1] ", "p1", "IMAGE_2", "p3", "IMAGE_4", "IMAGE_9", None, ""]
    rows = spark.createDataFrame([(k, c, images) for k, c in enumerate(cases)], f"k int, image_id string, images {image}")
    got = rows.orderBy("k").select(answer.step_image(F.col("image_id"), F.col("images"), "https://m/x").alias("i")).collect()
    assert [r.i and r.i.id for r in got] == ["p1", "p1", "p1", None, None, None, None, None, None]
    assert all(r.i is None for r in rows.select(answer.step_image(F.col("image_id"), F.col("images"), "").alias("i")).collect())
