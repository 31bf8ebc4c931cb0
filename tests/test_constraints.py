"""Catalogues of records, chunks and images; snapshots of failed workbooks."""

import random

from corpusloom.operators import constraints, registry
from corpusloom.operators.sync import issues

H = "a" * 64


def codes(spark, schema, rows, catalogue, key):
    got: dict = {}
    for r in issues(spark.createDataFrame(rows, schema), catalogue, key).collect():
        got.setdefault(r[key], set()).add(r["code"])
    return got


def test_extraction(spark):
    schema = "record_id string, source_id string, content string, title_path array<string>, table_headers array<string>, content_hash string, extraction_method string, page int, page_end int, sheet string"
    rows = [
        ("ok", "a-b", "x", ["t"], [], H, "pdf_text", 1, 2, None), ("p", "a", "x", [" "], None, H, "pdf_ocr", None, None, None), ("w", "a", " ", [], ["", "h"], "x", "xlsm_xml", None, 3, ""), ("r", "A", "x", None, None, H, "html", 3, 1, None),
    ]
    assert codes(spark, schema, rows, constraints.extraction_checks(), "record_id") == {
        "p": {"TITLE_PATH_BLANK", "PDF_WITHOUT_PAGE"}, "w": {"CONTENT_EMPTY", "TABLE_HEADERS_BLANK", "HASH_INVALID", "WORKBOOK_WITHOUT_SHEET", "PAGE_END_WITHOUT_PAGE"}, "r": {"SOURCE_ID_NOT_SLUG", "PAGES_REVERSED"}}


def test_chunks(spark):
    schema = ("id string, source_id string, content string, title string, embedding_text string, source_url string, tax_year string, supersedes array<string>, authority_level string, authority_rank int,"
              "effective_from date, effective_to date, content_hash string, sheet string, cell_range string, section string, page int, page_end int")
    ok = ("ok", "a", "x", "t", "e", "https://h/x", "2025/2026", [], "gazette", 90, None, None, H, None, None, "s", None, None)
    rows = [ok, ("b", *ok[1:5], None, "x", ["B"], "gazette", 1, None, None, None, "s", None, None, None, None), ("c", *ok[1:15], None, None, None)]
    assert codes(spark, schema, rows, constraints.chunk_checks(), "id") == {
        "b": {"URL_MISSING", "PERIOD_INVALID", "RELATED_ID_NOT_SLUG", "RANK_MISMATCH", "HASH_MISSING", "SHEET_RANGE_INCOMPLETE"}, "c": {"LOCATOR_MISSING"}}


def test_images(spark):
    schema = "image_id string, source_id string, title string, alt_text string, source_url string, page int, effective_from date, effective_to date, review_status string, public_url string"
    ok = ("i-1", "a", "t", "alt", "https://h/x", 1, None, None, "approved", "https://m/x/a.webp")
    rows = [ok, ("i-2", *ok[1:3], None, *ok[4:9], "https://n/a.webp"), ("i-3", *ok[1:5], None, None, None, "draft", None)]
    assert codes(spark, schema, rows, constraints.image_checks("https://m/x/"), "image_id") == {"i-2": {"ALT_TEXT_EMPTY", "PUBLIC_URL_INVALID"}, "i-3": {"PAGE_NOT_POSITIVE"}}
    facts = "image_id string, binary_sha256 string, byte_size bigint, width int, height int, file_sha256 string, file_bytes bigint, file_width int, file_height int, file_format string"
    assert codes(spark, facts, [("a", H, 1, 2, 3, H, 1, 2, 3, "webp"), ("b", H, 1, 2, 3, "x", None, 2, 4, "png")], constraints.image_file_checks(), "image_id") == {
        "b": {"IMAGE_HASH_MISMATCH", "IMAGE_SIZE_MISMATCH", "IMAGE_DIMENSIONS_MISMATCH", "IMAGE_FORMAT_MISMATCH"}}


def test_snapshots(spark):
    failed = spark.createDataFrame([("https://h/en/WHT_Schedule.xlsm",), ("https://h/none.xlsm",)], "url string")
    pages = spark.createDataFrame([("/r/b/x-wht-schedule.html",), ("/r/a/wht_schedule_1.html",), ("/r/z.html",)], "path string")
    got = {r["url"]: r["path"] for r in registry.error_snapshots(failed, pages).collect()}
    assert got == {"https://h/en/WHT_Schedule.xlsm": "/r/a/wht_schedule_1.html", "https://h/none.xlsm": None}
    assert registry.error_snapshots(failed.limit(0), pages).count() == 0


def test_containment_equals_brute_force(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abc-", k=n))
    texts = sorted({word(rnd.randint(1, 30)) for _ in range(300)} | {"page-" + word(4) for _ in range(100)})
    keys = sorted({word(rnd.randint(1, 9)) for _ in range(150)} | {"page", "page-", "zzz", texts[0]})
    found = registry.containing(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(map(tuple, found.collect())) == sorted((k, t) for k in keys for t in texts if k in t)
