"""Golden rows for operators whose edge cases the synthetic tables lack."""

import collections
import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls
from corpusloom.operators import chunking, ordered, query, retrieval, sync
from corpusloom.sources import html


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_periods(spark):
    assert column(spark, ["for 2025/26 now", "2025-2026", "YA 2526", "in 2025", "none", ""], T.period) == ["2025/2026", "2025/2026", "2025/2026", "2025", None, None]
    assert column(spark, ["x_2025_2026.pdf", "a_25_26.pdf", "a_25_27", "ya2526.pdf", "2021/x", "1234"], T.file_period) == ["2025/2026", "2025/2026", None, "2025/2026", None, None]


def test_labels_and_aliases(spark):
    got = column(spark, ["Corporate Income Tax and VAT", "the income tax", "vatican", "advance income tax"], query.tax_labels)
    assert got == [["corporate_income_tax", "vat"], ["income_tax"], [], ["income_tax", "apit", "ait"]]
    assert column(spark, ["file VAT", "private"], query.expand_aliases) == ["file VAT Value Added Tax", "private"]


def test_normalized(spark):
    texts = ["soft\u00adhyphen\r\nwraps here\n\n\n- item\nnext", None, "End.\nlower", "\n\n a \n \n\nb\nc\n1) d\ne\n", "\ufb01n\nish \u2013\nno", ""]
    want = ["softhyphen wraps here\n\n- item\nnext", "", "End.\nlower", "a\n\nb c\n1) d\ne", "fin ish \u2013\nno", ""]
    assert column(spark, texts, T.normalize_text) == want
    assert column(spark, texts[3:4], lambda c: T.normalize_text(c, False)) == ["a\n\nb\nc\n1) d\ne"]
    assert column(spark, [" a \t\r\nb\r\n\r\n\r\nc ", None], T.page_text) == ["a\nb\n\nc", ""]


def test_greedy_steps_from_many_states():
    rule, rng = ordered.Greedy(36, 30, 2), random.Random(1)
    for _ in range(2000):
        state, n = rng.randint(-1, 29), rng.randint(0, 50)
        now, begins = rule.step(state, n)
        many, begun = rule.steps(np.arange(-1, 30), n)
        assert (many[state + 1], begun[state + 1]) == (now, begins)


def test_order_work_over_many_ranges(spark):
    """Numbers, runs and greedy groups of keys that are spread over all ranges, null keys included."""
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, "x"]) if rng.random() < 0.02 else "x", rng.choice([0, 3, 9, 40]), rng.random() < 0.01) for k in range(3000)]
    rows += [(3000 + k, "one", "x", rng.choice([1, 2, 5]), False) for k in range(2000)]  # whole ranges in one run
    df = spark.createDataFrame(rows, "k long, s string, key string, len int, alone boolean").repartition(5)
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    number, run, first = {}, {}, {}
    for rs in by.values():
        place, prev, state, n_run, start = 0, None, None, 0, None
        for k, s, key, n, alone in rs:
            place, number[k] = place + 1, place + 1
            n_run += prev is None or prev[0] != key
            run[k] = n_run
            if alone or state is None or prev[0] != key or state + 2 + n > 36:
                start, state = k, n
            else:
                state += 2 + n
            first[k], prev = start, (key,)
            state = None if alone or state >= 30 else state
    assert {r.k: r.n for r in ordered.numbered(df, ["s"], ["k"]).collect()} == number
    assert {r.k: r.run for r in ordered.runs(df, ["key"], ["s"], "k").collect()} == run
    got = ordered.greedy_groups(df, ["s"], ["key"], "k", "len", "alone", 36, 30)
    assert got.columns == [*df.columns, "first"] and {r.k: r["first"] for r in got.collect()} == first
    empty = df.limit(0)
    assert ordered.numbered(empty, ["s"], ["k"]).count() == ordered.runs(empty, ["key"], ["s"], "k").count() == 0
    assert ordered.greedy_groups(empty, ["s"], ["key"], "k", "len", "alone", 36, 30).count() == 0


def test_split_limits(spark):
    split = lambda t, **o: column(spark, [t], lambda c: chunking.split_pieces(c, **o))[0]
    for n in (3596, 3597, 3600, 3601, 4200):
        assert split("a" * n) == ["a" * n]
    assert [len(p) for p in split("a" * 4201)] == [4200, 401] and split(None) == [""] and split("") == [""]
    assert split("word " * 3000)[0] == "word " * 839 + "word"
    assert split("a. " + "b" * 4195 + "\n\nc. d") == ["a. " + "b" * 4195, "c. d"]
    assert split("S one. " * 700)[0] == "\n\n".join(["S one."] * 525)
    table = split("x. " * 3000, kind=F.lit("table"), headers=F.array(F.lit("A"), F.lit("B")))
    assert len(table) > 1 and all(p.startswith("Headers: A | B\n") for p in table)
    assert column(spark, ["  a \u2028\n b\x85c", None], lambda c: chunking.fixed_windows(c, 3, 1)) == [["a", "b", "b\nc"], []]


def test_dedupe_keeps_nulls_and_one_of_ties(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "k", "b"), (3, "k", "a"), (None, "k", "c"), (None, "z", "d")], "o int, k string, v string")
    got = {(r.o, r.k, r.v) for r in chunking.dedupe(rows, ["k"], "o").collect()}
    assert got == {(1, None, "a"), (3, "k", "a"), (None, "z", "d")}


def test_build_chunks(spark):
    record = "source_id string, ordinal int, content_kind string, title_path array<string>, content string, page int, page_end int, section string, sheet string, cell_range string, table_headers array<string>"
    rows = [("s", 1, "p", ["T"], "one", 1, None, "A b", None, None, []), ("s", 2, "p", [], "two", 1, None, "A b", None, None, []), ("s", 3, "p", [], "x" * 4201, 2, None, None, None, None, []),
            ("s", 4, "table", [], "t", None, None, None, "S 1", "A1:B2", ["h"]), ("none", 1, "p", [], "lost", 1, None, None, None, None, []), ("s", 4, "table", [], "t", None, None, None, "S 1", "A1:B2", ["h"])]
    source = "id string, title string, document_type string, source_url string, published_date date, effective_from date, effective_to date, tax_year string, document_version string, authority_level string, authority_rank int, tax_types array<string>, taxpayer_types array<string>, language string, status string, supersedes array<string>, form_code string, tags array<string>, aliases array<string>, workflow_ids array<string>, sha256 string"
    sources = spark.createDataFrame([("s", "Title", "act", "https://a/x", None, None, None, None, None, "act", 1, ["vat"], [], "en", "current", [], None, [], [], ["w1", "w2"], "h")], source)
    got = chunking.build_chunks(spark.createDataFrame(rows[:5], record), sources).orderBy("position").collect()
    assert [(r.locator, r.content[:9], r.page, r.page_end) for r in got] == [
        ("o1-2-p1-1-section-a-b", "one\n\ntwo", 1, 1), ("o300000-p2-2", "x" * 9, 2, 2), ("o300001-p2-2", "x" * 9, 2, 2), ("o4-sheet-s-1-range-a1-b2", "t", None, None)]
    assert all(r.workflow_id == "w1" and r.id == f"s-{r.locator}-{r.chunk_hash[:24]}" for r in got)
    assert got[0].embedding_text == "Document: Title\nDocument type: act\nTax type: vat\nSection: T\n\none\n\ntwo"
    assert chunking.build_chunks(spark.createDataFrame([], record), sources).count() == 0


def candidates(spark, rows):
    schema = (
        "query_id int, original_rank int, id string, source_id string, status string, tax_year string, effective_from date, effective_to date,"
        "tax_types array<string>, authority_level string, authority_rank int, q_tax_year string, q_tax_types array<string>, q_text string, q_procedural boolean, q_historical boolean"
    )
    base = {"query_id": 1, "status": "current", "tax_year": None, "effective_from": None, "effective_to": None, "tax_types": [], "authority_level": None,
            "authority_rank": 0, "q_tax_year": None, "q_tax_types": [], "q_text": "", "q_procedural": False, "q_historical": False}
    full = [{**base, "original_rank": k, **r} for k, r in enumerate(rows)]
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema)


def ranked(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_rerank(spark):
    one = [{"id": c, "source_id": s} for c, s in (("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"))]
    assert ranked(retrieval.rerank(candidates(spark, one))) == ["a", "b", "d"]
    old = [{"id": "a", "source_id": "x", "status": "superseded"}, {"id": "b", "source_id": "y", "status": None}, {"id": "c", "source_id": "z", "status": "excluded"}]
    assert ranked(retrieval.rerank(candidates(spark, old))) == ["b"]
    assert ranked(retrieval.rerank(candidates(spark, old[:1]))) == ["a"]
    assert ranked(retrieval.rerank(candidates(spark, [{**r, "q_historical": True} for r in old]))) == ["a", "b"]
    day = datetime.date
    years = [{"id": "a", "source_id": "a", "tax_year": "2020/2021"}, {"id": "b", "source_id": "b", "effective_from": day(2020, 1, 1)}, {"id": "c", "source_id": "c", "tax_year": "2025/2026"}, {"id": "d", "source_id": "d"}]
    assert ranked(retrieval.rerank(candidates(spark, [{**r, "q_tax_year": "2025/2026"} for r in years]))) == ["c", "b", "d", "a"]


def test_failure_kinds(spark):
    rows = [(429, "RESOURCE_EXHAUSTED", "x"), (429, "RESOURCE_EXHAUSTED", "rate limit"), (429, "", "quota, see rate limit"), (503, None, None), (None, "UNAVAILABLE", None), (400, None, "bad")]
    df = spark.createDataFrame(rows, "c int, s string, m string")
    got = [r[0] for r in df.select(sync.failure_kind(F.col("c"), F.col("s"), F.col("m"))).collect()]
    assert got == ["quota_exhausted", "transient", "quota_exhausted", "transient", "transient", "provider_error"]


def blocks(spark, *pages):
    rows = spark.createDataFrame([(f"p{k}", "https://h/p", p) for k, p in enumerate(pages)], "`page id` string, url string, html string")
    out = collections.defaultdict(list)
    for r in html.html_blocks(rows, "page id").orderBy("page id", "ordinal").collect():
        out[r["page id"]].append((r.kind, r.title_path, r.content))
    return [out[f"p{k}"] for k in range(len(pages))]


def test_html(spark):
    page = """<html><head><title>T</title></head><body><nav>no</nav><main><h1>One</h1><p>See <a href="/x">link</a><b>open
    <p>Next</p><table><tr><th>A<th>B</tr><tr><td>1</td><td>2</td></tr></table><ul><li>u<ol><li>v</ol></ul><dl><dt>t<dd>d</dl><h2>Two</h2><div style="display: none">no</div>free</main></body></html>"""
    got = blocks(spark, page)[0]
    assert got == [
        ("heading", ["One"], "One"), ("paragraph", ["One"], "See [link](https://h/x)open"), ("paragraph", ["One"], "Next"),
        ("table", ["One"], "Headers: A | B\nRow: 1 | 2"), ("list", ["One"], "- u\n  1. v"), ("definition_list", ["One"], "t: d"),
        ("heading", ["One", "Two"], "Two"), ("paragraph", ["One", "Two"], "free"),
    ]


def test_html_hides_and_lays_out(spark):
    gone = "".join(f"<p {a}>no</p>" for a in ('class="d-none"', 'class="x visually-hidden"', 'style="visibility : hidden"', 'aria-hidden="true"', 'class="site-footer"', 'id="nav"', 'class="ms-hide"'))
    layout = "<table><tr><td><div>a</div></td><td><p>b</p></td></tr></table>"
    kept = '<form class="search"><p>in form</p></form><p class="navigate">stays</p>'
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    place = '<div class="left">side</div><div id="DeltaPlaceHolderMain"><p>main</p></div>'
    table = "<table class='in-table'><tr><td><p>1</p></td></tr></table>"
    got = blocks(spark, f"<body>{gone}{kept}</body>", f"<body>{layout}</body>", deep, f"<body>{place}</body>", None, "", f"<body>{table}</body>", "<ul><li>" * 2000 + "x")
    assert [[b[2] for b in page] for page in got[:7]] == [["in form", "stays"], ["a", "b"], ["deep"], ["main"], [], [], ["Row: 1"]]
    assert got[7][0][2].endswith("- x") and got[1][0] == ("paragraph", ["https://h/p"], "a")


def test_page_links(spark):
    pages = [(1, "https://h/a/b?q", "<a href='/x'>X <b>y</b></a><a href='../c'> </a><a href='https://other/z'>o</a><a href='//H/n'>n</a><a href='mailto:a'>m</a><a href='?k'>k</a>"),
             (2, "https://h/a/", "<a href='x'>x</a><a href='/x'>X y</a><a href='#f'>f</a><a name='q'>q</a>"), (3, None, "<a href='https://h/1'>l</a>"), (4, "https://h/", None)]
    got = {(r.source, r.label, r.url) for r in html.page_links(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {("https://h/a/", "X y", "https://h/x"), ("https://h/a/b?q", "Unlabelled link", "https://h/c"), ("https://h/a/b?q", "n", "https://H/n"), ("https://h/a/b?q", "k", "https://h/a/b?k"),
                   ("https://h/a/", "x", "https://h/a/x"), ("https://h/a/", "f", "https://h/a/#f")}


def test_urls(spark):
    links = ["https://A.b/x/../y z?q=1&r=#f", None]
    assert column(spark, ["https://a.lk/x", "http://a.lk", "https://b.a.lk:1/", "https://xa.lk", None], lambda c: urls.official(c, "a.lk")) == [True, False, True, False, False]
    stems = column(spark, links, urls.safe_stem)
    assert stems[0].startswith("a.b-x-..-y-z-q-1-") and len(stems[0]) == len("a.b-x-..-y-z-q-1-") + 10
    kinds = spark.createDataFrame([("https://h/a.PDF", "x"), ("https://h/a", "Text/HTML; charset=x"), ("https://h/a", None), ("https://h/a", "text/csv")], "u string, t string")
    assert [r[0] for r in kinds.select(urls.extension(F.col("u"), F.col("t"))).collect()] == [".pdf", ".html", ".bin", ".csv"]
    assert column(spark, ["d/My File.v2.pdf", ".hidden", "a/../b", "../x", "a/../../x", "/x", "a\\b", None], urls.source_id_of)[:2] == ["my-file-v2", "hidden"]
    assert column(spark, ["a/../b", "../x", "a/../../x", "/x", "a\\b", "./a", None], urls.escapes) == [False, True, True, True, True, False, False]
