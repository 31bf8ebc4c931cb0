"""Guide images, YAML scans and the streaming index."""

import hashlib
import json
import struct

from pyspark.sql import functions as F

from corpusloom.operators import images as I
from corpusloom.sources import yaml_files as Y
from corpusloom.streaming import sync as S

IMAGE = ("image_id string, source_id string, title string, alt_text string, caption string, source_url string, page int, workflow_id string, tax_types array<string>, taxpayer_types array<string>,"
         "effective_from date, effective_to date, status string, review_status string, public_url string, page_text string, binary_sha256 string, byte_size bigint, width int, height int")
SOURCE = ("id string, title string, document_type string, source_url string, final_url string, status string, review_status string, render_pages array<int>, tax_types array<string>,"
          "taxpayer_types array<string>, authority_level string, authority_rank int, sha256 string")
URL, MEDIA = "https://h/a", "https://m/x/a.webp"


def image(**own):
    row = dict(image_id="i", source_id="s", title="T", alt_text="A", caption=None, source_url=URL, page=2, workflow_id=None, tax_types=[], taxpayer_types=[], effective_from=None, effective_to=None,
               status="current", review_status="approved", public_url=MEDIA, page_text=None, binary_sha256=None, byte_size=None, width=None, height=None)
    return tuple((row | own).values())


def test_image_chunks(spark):
    sources = spark.createDataFrame([
        ("s", "Guide", "return_guide", "https://h/0", URL, "current", "approved", [2], ["vat"], None, "guide", 40, "h"),
        ("d", "Guide", "return_guide", URL, None, "current", "draft", None, None, None, None, None, None),
        ("x", "Guide", "return_guide", URL, None, "excluded", "approved", [], None, None, None, None, None),
    ], SOURCE)
    rows = [
        image(image_id="ok", caption="C", workflow_id="w", page_text="a  \r\nb\r\n\r\n\r\n\r\nc\n"), image(image_id="own", tax_types=["paye", "wht"]), image(image_id="draft", review_status="draft"), image(image_id="null", review_status=None),
        image(image_id="page", page=3), image(image_id="none", page=None), image(image_id="who", source_id="?"), image(image_id="src", source_id="d"), image(image_id="out", source_id="x"),
        image(image_id="url", source_url="https://h/1"), image(image_id="ex", status="excluded"), image(image_id="pub", public_url="https://m/y/a.webp"),
    ]
    chunks, found = I.image_chunks(spark.createDataFrame(rows, IMAGE), sources, "https://m/x/")
    got = {r.image_id: r for r in chunks.collect()}
    assert set(got) == {"ok", "own"}
    text = "T\nA\nC\nWorkflow: w\nReviewed page text:\na\nb\n\nc"
    digest = hashlib.sha256(json.dumps({"content": text, "locator": "s:page:2:image:ok"}, separators=(",", ":")).encode()).hexdigest()
    ok = got["ok"]
    assert (ok.content, ok.chunk_hash, ok.id) == (text, digest, f"guide-image-ok-{digest[:24]}")
    assert ok.embedding_text == f"Document: Guide\nDocument type: return_guide\nTax type: vat\nPage: 2\nWorkflow: w\n\n{text}"
    assert (ok.tax_types, ok.taxpayer_types, ok.page_end, ok.authority_rank, ok.image_url) == (["vat"], [], 2, 40, MEDIA)
    assert got["own"].tax_types == ["paye", "wht"] and "Tax type: paye, wht" in got["own"].embedding_text and "Tax type: vat" in ok.embedding_text
    codes = {}
    for r in found.collect():
        codes.setdefault(r.image_id, set()).add(r.code)
    assert codes == {"page": {"PAGE_NOT_RENDERED"}, "none": {"PAGE_MISSING", "PAGE_NOT_RENDERED"}, "who": {"SOURCE_UNKNOWN"}, "src": {"SOURCE_NOT_APPROVED"}, "out": {"SOURCE_EXCLUDED"},
                     "url": {"SOURCE_URL_MISMATCH"}, "ex": {"IMAGE_EXCLUDED"}, "pub": {"PUBLIC_URL_INVALID"}}


def riff(kind, body):
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


WEBP = {
    "x": (riff(b"VP8X", b"\0" * 4 + (1919).to_bytes(3, "little") + (70000).to_bytes(3, "little")), (1920, 70001)),
    "lossy": (riff(b"VP8 ", b"\0" * 3 + b"\x9d\x01\x2a" + struct.pack("<HH", 640 | 1 << 14, 481) + b"\0" * 4), (640, 481)),
    "lossless": (riff(b"VP8L", b"\x2f" + struct.pack("<I", (1233) | (4567 << 14)) + b"\0" * 9), (1234, 4568)),
    "png": (b"\x89PNG" + b"\0" * 40, None), "short": (b"RIFF", None), "empty": (b"", None), "null": (None, None),
}


def test_webp_headers(spark):
    df = spark.createDataFrame([(k, bytearray(v[0]) if v[0] is not None else None) for k, v in WEBP.items()], "name string, content binary")
    got = {r.name: r.f and (r.f.width, r.f.height) for r in df.select("name", I.webp_facts(F.col("content")).alias("f")).collect()}
    assert got == {k: v[1] for k, v in WEBP.items()}


def test_publish_plan(spark, tmp_path):
    rows, data = [], WEBP["lossy"][0]
    digest = hashlib.sha256(data).hexdigest()
    for k in ("ok", "size", "gone", "twice", "bare"):
        if k != "gone":
            (tmp_path / f"{k}.{digest[:16]}.webp").write_bytes(data)
        fact = dict(binary_sha256=digest, byte_size=len(data) + (k == "size"), width=640, height=481) if k != "bare" else {}
        rows += [image(image_id=k, **fact)] * (2 if k == "twice" else 1)
    files = I.image_files(spark.read.format("binaryFile").load(str(tmp_path)))
    plan, found = I.publish_plan(spark.createDataFrame(rows, IMAGE), files, "https://m/", "guides")
    assert [(r.image_id, r.public_url) for r in plan.collect()] == [("ok", f"https://m/guides/ok.{digest[:16]}.webp")]
    assert {(r.image_id, r.code) for r in found.collect()} == {("size", "IMAGE_SIZE_MISMATCH"), ("gone", "FILE_MISSING"), ("twice", "IMAGE_ID_REPEATED"),
                                                               ("bare", "HASH_INVALID"), ("bare", "FACTS_MISSING"), ("bare", "FILE_MISSING")}


def test_yaml(spark, tmp_path):
    for name, text in {
        "a.yaml": "workflow_id: w\ntitle: T\njurisdiction: LK\nreview_status: approved\nsteps: [one, two]\nnotes: [n]\nportal_version: 2025-01-02\n", "b.yml": "workflow_id: v\ntitle: U\njurisdiction: LK\nreview_status: approved\nsteps: [é]\n",
        "c.yaml": "a: [", "d.yaml": "- 1", "e.yaml": "jurisdiction: XX", "f.yaml": "jurisdiction: LK\nreview_status: draft", "g.txt": "a: 1", "h.yaml": "jurisdiction: LK\nreview_status: approved",
    }.items():
        (tmp_path / name).write_text(text)
    good, bad = Y.guides(spark, str(tmp_path))
    got = {r.workflow_id: r for r in good.collect()}
    assert got["w"].content == "Workflow: T\nSteps:\n1. one\n2. two\nNotes:\n- n" and got["v"].content == "Workflow: U\nSteps:\n1. é" and got["w"].portal_version == "2025-01-02"
    assert {(r.path[-6:], r.code) for r in bad.collect()} == {("c.yaml", "YAML_INVALID"), ("d.yaml", "YAML_INVALID"), ("e.yaml", "JURISDICTION_OTHER"), ("f.yaml", "NOT_APPROVED"), ("h.yaml", "GUIDE_INCOMPLETE")}
    Y.write_yaml(f"{tmp_path}/m/r.yaml", {"schema_version": 1, "images": [{"image_id": "i", "page": 2, "caption": None, "tax_types": []}]})
    (tmp_path / "m" / "old.yaml").write_text("schema_version: 9\nimages: []\n")
    items, faults = Y.read_items(spark, f"{tmp_path}/m", "images", "image_id: string, page: int")
    assert [(r.position, r.image_id, r.page) for r in items.collect()] == [(0, "i", 2)] and [r.code for r in faults.collect()] == ["VERSION_UNSUPPORTED"]
    assert (tmp_path / "m" / "r.yaml").read_text() == "schema_version: 1\nimages:\n- image_id: i\n  page: 2\n"


def test_stream_sync(spark, tmp_path):
    inbox, index, mark = tmp_path / "in", f"{tmp_path}/index", f"{tmp_path}/mark"
    inbox.mkdir()

    def arrive(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps({"id": a, "content": b}) for a, b in rows))
        S.sync_stream(S.chunk_stream(spark, str(inbox), "id string, content string"), index, mark).awaitTermination()

    arrive("1.json", ("a", "1"), ("b", "1"), ("b", "1"), (None, "x"))
    arrive("2.json", ("a", "2"), ("c", "1"))
    want = {("a", "2"), ("b", "1"), ("c", "1")}
    assert sorted(map(tuple, S.current(spark, index).collect())) == sorted(want)
    S.sync_stream(S.chunk_stream(spark, str(inbox), "id string, content string"), index, mark).awaitTermination()
    S.compact(spark, index, f"{tmp_path}/new")
    assert sorted(map(tuple, S.current(spark, f"{tmp_path}/new").collect())) == sorted(want) and spark.read.parquet(f"{tmp_path}/new").count() == 3
