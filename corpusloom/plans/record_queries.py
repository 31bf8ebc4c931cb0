"""Registered queries of sources and upkeep: pages as blocks, headings, workbooks, the registry, checks of records, uploads."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators import answer, constraints, images, registry, sync, upload
from corpusloom.operators.ordered import stored
from corpusloom.plans.corpus_queries import NONE, made, strings
from corpusloom.plans.search_queries import register, table
from corpusloom.sources import files, html, paged, workbook, yaml_files


def faults(*cases: tuple[str, str], id_sql: str = "doc_id") -> str:
    """SQL of (id, code): for each document the codes whose condition holds."""
    found = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in cases)
    return f"SELECT id, code FROM (SELECT {id_sql} AS id, unnest(list_filter([{found}], lambda x: x IS NOT NULL)) AS code FROM documents)"


def numbered(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    """Documents as bare rows, and a function of (every n-th row, value there, value else)."""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return rows, lambda n, bad, good: F.when(F.col("doc_id") % n == 0, F.lit(bad)).otherwise(F.lit(good))


# checks of records: words, lengths and languages of the texts stand in for the fields

#: w: the first word, v: the first run of small letters, y: the first word that begins with `que`, if any.
_WORDS = """SELECT doc_id, text, lang, CAST(n_chars AS int) AS n, regexp_extract(text, '[A-Za-z]+', 0) AS w, regexp_extract(text, '[a-z]+', 0) AS v,
  regexp_extract(text, 'que[a-z]*', 0) AS y, CASE lang WHEN 'en' THEN 'https://a.example/x' WHEN 'fr' THEN 'https://b.example/' WHEN 'es' THEN 'http://a.example' END AS url
  FROM documents"""
_MIXED = "CASE WHEN n % 2 = 0 THEN w ELSE v END"
_DATES = "make_date(2000 + n % 20, 1, 1) AS effective_from, make_date(2000 + length(w), 1, 1) AS effective_to"
_YEAR = "CASE WHEN lang <> 'en' THEN concat(CAST(2000 + n % 120 AS string), '/2025') END AS tax_year"
_RANK = "CASE lang WHEN 'en' THEN 'gazette' WHEN 'fr' THEN 'legislation' WHEN 'es' THEN 'strange' END AS authority_level, CASE WHEN length(w) > 5 THEN 90 ELSE 100 END AS authority_rank"
_SPANS = "nullif(CAST(floor(n / 2000) AS int), 0) AS page, nullif(length(w) - 3, 0) AS page_end"
_EXTRACTED = f"""SELECT doc_id, y AS record_id, {_MIXED} AS source_id, regexp_extract(text, '[.] [A-Z]', 0) AS content, w, y, v,
  CASE WHEN lang = 'fr' THEN upper(sha256(text)) ELSE sha256(text) END AS content_hash, {_SPANS},
  CASE lang WHEN 'en' THEN 'pdf_text' WHEN 'fr' THEN 'pdf_ocr' ELSE 'xlsm_xml' END AS extraction_method, CASE WHEN n % 5 > 0 THEN y END AS sheet FROM ({_WORDS}) f"""
_CHUNKED = f"""SELECT doc_id, y AS id, {_MIXED} AS source_id, regexp_extract(text, '[.] [A-Z]', 0) AS content, w AS title, y AS embedding_text, url AS source_url, w, {_YEAR}, {_RANK},
  {_DATES}, y AS content_hash, y AS sheet, CASE WHEN n % 2 = 0 THEN v END AS cell_range, {_SPANS}, CASE WHEN n % 4 = 0 THEN w END AS section FROM ({_WORDS}) f"""
_IMAGED = f"""SELECT doc_id, {_MIXED} AS image_id, v AS source_id, w AS title, y AS alt_text, url AS source_url, CAST(floor(n / 1000) AS int) AS page, {_DATES},
  CASE WHEN lang IN ('en', 'fr') THEN 'approved' ELSE 'draft' END AS review_status, concat(CASE WHEN n % 3 = 2 THEN 'https://other/' ELSE 'https://m/' END, lower(w),
  CASE WHEN n % 3 = 1 THEN '.png' ELSE '.webp' END) AS public_url, sha256(text) AS binary_sha256, sha256(replace(text, 'x', '')) AS file_sha256, n AS byte_size,
  length(replace(text, 'é', 'ee')) AS file_bytes, length(w) AS width, length(v) + 1 AS file_width, n % 7 AS height, n % 7 AS file_height,
  CASE WHEN y = '' THEN 'png' ELSE 'webp' END AS file_format FROM ({_WORDS}) f"""
_ISSUED = f"SELECT doc_id, y AS code, w AS message, CASE lang WHEN 'en' THEN 'error' WHEN 'fr' THEN 'warning' ELSE lang END AS severity, w, y FROM ({_WORDS}) f"
_LISTED = f"""SELECT doc_id, lower(w) AS id, y AS title, v AS local_file, url AS source_url, CASE WHEN n % 3 = 0 THEN url END AS final_url,
  CASE WHEN lang = 'fr' THEN upper(sha256(text)) ELSE sha256(text) END AS sha256, y, w, {_YEAR}, {_RANK}, {_DATES}, CASE WHEN n % 4 = 0 THEN 'excluded' ELSE 'current' END AS status,
  y AS exclusion_reason FROM ({_WORDS}) f"""


def _facts(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return made(spark, d, re.sub(r"sha256\((text|replace\([^()]*\))\)", r"sha2(\1, 256)", sql))


def judged(facts: str, *cases: tuple[str, str], key: str = "doc_id") -> str:
    """SQL of (id, code): the codes whose condition on the facts holds."""
    found = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in cases)
    own = facts.replace("string)", "VARCHAR)")
    return f"SELECT id, code FROM (SELECT {key} AS id, unnest(list_filter([{found}], lambda x: x IS NOT NULL)) AS code FROM ({own}) g)"


def _no_slug(c: str) -> str:
    return f"NOT regexp_matches({c}, '^[a-z0-9]+(-[a-z0-9]+)*$')"


_NOT_HTTPS, _BAD_HASH = "source_url NOT LIKE 'https://%'", "NOT regexp_matches({}, '^[0-9a-f]{{64}}$')"
_PAGED = (("PAGE_END_WITHOUT_PAGE", "page_end IS NOT NULL AND page IS NULL"), ("PAGES_REVERSED", "page_end < page"))
_RANKED = "authority_level IS NOT NULL AND NOT coalesce(authority_rank = CASE authority_level WHEN 'gazette' THEN 90 WHEN 'legislation' THEN 100 END, false)"
_PERIOD = "NOT regexp_matches(tax_year, '^20[0-9][0-9]/20[0-9][0-9]$')"


@register(judged(
    _EXTRACTED, ("RECORD_ID_EMPTY", "record_id = ''"), ("SOURCE_ID_NOT_SLUG", _no_slug("source_id")), ("CONTENT_EMPTY", "content = ''"), ("TITLE_PATH_BLANK", "w = '' OR y = ''"),
    ("TABLE_HEADERS_BLANK", "v = ''"), ("HASH_INVALID", _BAD_HASH.format("content_hash")), ("PDF_WITHOUT_PAGE", "extraction_method <> 'xlsm_xml' AND page IS NULL"),
    ("WORKBOOK_WITHOUT_SHEET", "extraction_method = 'xlsm_xml' AND coalesce(sheet, '') = ''"), *_PAGED))
def extraction_record_checks(spark, d):
    rows = _facts(spark, d, _EXTRACTED).withColumns({"title_path": F.array("w", "y"), "table_headers": F.array("v")})
    return sync.issues(rows, constraints.extraction_checks(), "doc_id").select(F.col("doc_id").alias("id"), "code")


@register(judged(
    _CHUNKED, ("ID_EMPTY", "id = ''"), ("SOURCE_ID_NOT_SLUG", _no_slug("source_id")), ("CONTENT_EMPTY", "content = ''"), ("TITLE_EMPTY", "title = ''"), ("EMBEDDING_TEXT_EMPTY", "embedding_text = ''"),
    ("SOURCE_URL_NOT_HTTPS", _NOT_HTTPS), ("PERIOD_INVALID", _PERIOD), ("RELATED_ID_NOT_SLUG", _no_slug("w")), ("RANK_MISMATCH", _RANKED), ("DATES_REVERSED", "effective_to < effective_from"),
    ("HASH_MISSING", "content_hash = ''"), ("SHEET_RANGE_INCOMPLETE", "(sheet = '') <> (coalesce(cell_range, '') = '')"), *_PAGED, ("URL_MISSING", "source_url IS NULL"),
    ("LOCATOR_MISSING", "page IS NULL AND coalesce(section, '') = '' AND sheet = ''")))
def chunk_record_checks(spark, d):
    rows = _facts(spark, d, _CHUNKED).withColumn("supersedes", F.array("w"))
    return sync.issues(rows, constraints.chunk_checks(), "doc_id").select(F.col("doc_id").alias("id"), "code")


@register(judged(
    _IMAGED, ("IMAGE_ID_NOT_SLUG", _no_slug("image_id")), ("SOURCE_ID_NOT_SLUG", _no_slug("source_id")), ("TITLE_EMPTY", "title = ''"), ("ALT_TEXT_EMPTY", "alt_text = ''"),
    ("SOURCE_URL_NOT_HTTPS", f"source_url IS NULL OR {_NOT_HTTPS}"), ("PAGE_NOT_POSITIVE", "page < 1"), ("DATES_REVERSED", "effective_to < effective_from"),
    ("PUBLIC_URL_INVALID", "review_status = 'approved' AND NOT (starts_with(public_url, 'https://m/') AND ends_with(public_url, '.webp'))"),
    ("IMAGE_HASH_MISMATCH", "binary_sha256 <> file_sha256"), ("IMAGE_SIZE_MISMATCH", "byte_size <> file_bytes"),
    ("IMAGE_DIMENSIONS_MISMATCH", "width <> file_width OR height <> file_height"), ("IMAGE_FORMAT_MISMATCH", "file_format <> 'webp'")))
def image_record_checks(spark, d):
    """Rules of images and of their files in one pass."""
    found = sync.issues(_facts(spark, d, _IMAGED), constraints.image_checks("https://m") | constraints.image_file_checks(), "doc_id")
    return found.select(F.col("doc_id").alias("id"), "code")


@register(judged(
    _ISSUED, ("CODE_EMPTY", "code = ''"), ("MESSAGE_EMPTY", "message = ''"), ("SEVERITY_UNKNOWN", "severity NOT IN ('warning', 'error')"), ("STEPS_NOT_NUMBERED", "length(w) <> 5"),
    ("STEP_TITLE_EMPTY", "w = '' OR y = ''")))
def issue_and_guide_checks(spark, d):
    step = lambda n, title: F.struct(n.alias("number"), title.alias("title"))
    rows = _facts(spark, d, _ISSUED).withColumn("steps", F.array(step(F.lit(1), F.col("w")), step(F.length("w") - 3, F.col("y"))))
    checks = constraints.issue_checks() | constraints.guide_checks(F.col("steps"))
    return sync.issues(rows, checks, "doc_id").select(F.col("doc_id").alias("id"), "code")


@register(judged(
    _LISTED, ("ID_NOT_SLUG", _no_slug("id")), ("TITLE_EMPTY", "title = ''"), ("LOCAL_FILE_EMPTY", "local_file = ''"), ("SOURCE_URL_NOT_HTTPS", f"source_url IS NULL OR {_NOT_HTTPS}"),
    ("FINAL_URL_NOT_HTTPS", _NOT_HTTPS.replace("source_url", "final_url")), ("HASH_INVALID", _BAD_HASH.format("sha256")), ("PERIOD_INVALID", _PERIOD), ("RELATED_ID_NOT_SLUG", _no_slug("y")),
    ("RENDER_PAGES_REPEATED", "length(w) - 4 = 2"), ("RENDER_PAGE_NOT_POSITIVE", "length(w) - 4 < 1"), ("RANK_MISMATCH", f"authority_level IS NULL OR {_RANKED}"),
    ("DATES_REVERSED", "effective_to < effective_from"), ("SUPERSEDES_ITSELF", "y = id"), ("EXCLUSION_REASON_MISSING", "status = 'excluded' AND exclusion_reason = ''"),
    ("HOST_NOT_ALLOWED", "source_url IS NULL OR source_url NOT LIKE '%://a.example%'"), key="id") + f"""
UNION ALL SELECT id, 'ID_REPEATED' FROM (SELECT lower(w) AS id FROM ({_WORDS}) f) GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT lower(w), 'RELATED_ID_UNKNOWN' FROM ({_WORDS}) f WHERE y NOT IN (SELECT lower(w) FROM ({_WORDS}) g)""")
def registry_validation(spark, d):
    """Registry rows made of documents: ids are their first words, of which many are found again, related ids other words."""
    rows = _facts(spark, d, _LISTED).withColumns({"supersedes": F.array("y"), "superseded_by": F.expr(NONE), "render_pages": F.array(F.length("w") - 4, F.lit(2))})
    return constraints.registry_issues(rows, ["a.example"]).select("id", "code")


@register("""WITH f AS (SELECT lang IN ('en', 'fr') AS approved, n_chars % 5 = 0 AS excluded, n_chars < 200 AS bad, lang = 'es' AS odd FROM documents)
SELECT count(*) AS source_count, count(*) FILTER (approved) AS approved_count, count(*) FILTER (excluded) AS excluded_count, count(*) FILTER (bad) AS errors,
  count(*) FILTER (odd) AS warnings, count(*) FILTER (bad) = 0 AS valid FROM f""")
def registry_counts(spark, d):
    rows = table(spark, d, "documents")
    of = lambda cond, severity: rows.where(cond).select(F.lit(severity).alias("severity"))
    sources = rows.select(F.when(F.col("lang").isin("en", "fr"), "approved").otherwise("draft").alias("review_status"),
        F.when(F.col("n_chars") % 5 == 0, "excluded").otherwise("current").alias("status"))
    return constraints.registry_summary(sources, of("n_chars < 200", "error").unionByName(of("lang = 'es'", "warning")))


# pages, headings

_TEXTS = {"page": "chr(10)", "lines": ["'1. Scope of this part' || chr(10) || 'text, and so on.'", "'1.2 Rates' || chr(10) || 'more text; here'",
    "'GENERAL RULES 2024' || chr(10) || 'x'", "'no heading here at all, is there.'", "'2) Last Part' || chr(10) || '2.1.1 Deep'"]}
_PAGES = "SELECT doc_id, doc_id // 10 AS source_id, CAST(doc_id % 10 + 1 AS int) AS page, CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {x}" for k,
    x in enumerate(_TEXTS["lines"])) + " END AS text FROM documents"
#: A numbered heading made of the first word of a text, above the whole text; files are sources, one of them with a third of all pages.
_FILES = """SELECT doc_id, source AS source_id, doc_id AS page, concat(repeat('1.', cast(length(coalesce(text, '')) % 4 AS int)), '2 ',
  coalesce(nullif(regexp_extract(text, '[A-Za-z]+', 0), ''), 'none'), chr(10), coalesce(text, '')) AS text FROM documents"""
_HEADINGS_SQL = r"""pg AS (""" + _FILES + r"""),
ln AS (SELECT doc_id, source_id, page, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS raw,
  generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1) AS k FROM pg),
vl AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS v FROM ln),
nm AS (SELECT *, regexp_extract(v, '^(\d+(?:\.\d+){0,5})\s*[.)-]?\s+[^.!?;:]{2,160}$', 1) AS num, string_split(v, ' ') AS ws FROM vl WHERE v <> '' AND length(v) <= 160),
hd AS (SELECT *, CASE WHEN num <> '' THEN length(num) - length(replace(num, '.', '')) + 1
  WHEN regexp_matches(v, '^[A-Z][A-Z0-9][A-Z0-9 /&()''\-]{2,119}$') OR (len(ws) BETWEEN 2 AND 12 AND regexp_matches(v, '[\p{L}\p{N}]$')
    AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '^(?:\p{Lu}|\p{Lt}|[^\p{L}]|$)'))) = 0) THEN 1 END AS depth FROM nm),
sq AS (SELECT source_id, page, v, depth, row_number() OVER (PARTITION BY source_id ORDER BY page, k) AS n FROM hd WHERE depth IS NOT NULL),
st(source_id, n, page, stack) AS (SELECT source_id, n, page, [v] FROM sq WHERE n = 1
  UNION ALL SELECT sq.source_id, sq.n, sq.page, list_append(st.stack[1:sq.depth - 1], sq.v) FROM st JOIN sq ON sq.source_id IS NOT DISTINCT FROM st.source_id AND sq.n = st.n + 1),
en AS (SELECT source_id, page, arg_max(stack, n) AS stack FROM st GROUP BY source_id, page)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, _PAGES.replace("doc_id // 10", "doc_id div 10").replace("chr(10)", "char(10)"))


@register(f"WITH RECURSIVE {_HEADINGS_SQL} SELECT pg.doc_id, coalesce(array_to_string(last_value(stack IGNORE NULLS) OVER (PARTITION BY pg.source_id ORDER BY pg.page), ' > '), '') AS title_path "
    "FROM pg LEFT JOIN en ON en.source_id IS NOT DISTINCT FROM pg.source_id AND en.page = pg.page")
def heading_paths(spark, d):
    """Open headings at the end of each page."""
    return paged.heading_paths(made(spark, d, _FILES.replace("chr(10)", "char(10)"))).select("doc_id", F.array_join("title_path", " > ").alias("title_path"))


@register(f"""WITH p AS ({_PAGES}), r AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM p) SELECT doc_id, CASE WHEN n >= 80
  THEN 'pdf_text' WHEN doc_id % 3 = 0 THEN 'pdf_ocr' ELSE 'pdf_text' END AS extraction_method,
CASE WHEN n >= 80 THEN '' WHEN doc_id % 3 = 0 THEN 'OCR_USED' ELSE 'OCR_WEAKER_THAN_NATIVE' END AS warnings, sha256(CASE WHEN n < 80
  AND doc_id % 3 = 0 THEN repeat('ocr text ', 20)[1:179] ELSE text END) AS content_hash
FROM r WHERE n >= 20 OR doc_id % 3 = 0""")
def page_records(spark, d):
    """Pages with native and OCR text to records."""
    rows = _pages(spark, d).withColumn("ocr_text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("ocr text "), 20)))
    out = paged.page_records(rows)
    place = rows.select("doc_id", "source_id", "page")
    return out.join(place, ["source_id", "page"]).select("doc_id", "extraction_method", F.array_join("warnings", ",").alias("warnings"),
        "content_hash")


@register(f"""WITH p AS ({_PAGES}), n AS (SELECT source_id, max(page) + 2 AS pages FROM p GROUP BY 1), a AS (SELECT source_id, unnest(range(1,
  pages + 1)) AS page FROM n)
SELECT a.source_id, a.page::INT AS page FROM a LEFT JOIN p ON p.source_id = a.source_id AND p.page = a.page AND p.doc_id % 2 = 0
  WHERE p.page IS NULL""")
def ocr_required(spark, d):
    """Pages without a record of 80 visible characters; every second page has one."""
    rows = _pages(spark, d)
    counts = rows.groupBy("source_id").agg((F.max("page") + 2).alias("page_count"))
    return paged.ocr_required(counts, rows.where("doc_id % 2 = 0").select("source_id", "page", F.repeat(F.lit("word "), 30).alias("content")))


@register("""SELECT 's' || source AS source_id, page FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) , unnest([2,
  5]) AS t(page) WHERE (length(source) + ascii(right(source, 1))) % 3 > 0""")
def render_pages(spark, d):
    rows = table(spark, d, "documents").where("source is not null").select("source").distinct()
    keep = (F.length("source") + F.ascii(F.substring("source", -1, 1))) % 3 > 0
    sources = rows.select(F.concat(F.lit("s"), "source").alias("id"), F.when(keep, "approved").otherwise("draft").alias("review_status"),
        F.lit("current").alias("status"), F.lit("application/pdf").alias("media_type"),
                          F.array(F.lit(5), F.lit(2), F.lit(5), F.lit(0)).alias("render_pages"))
    return paged.render_candidates(sources)


#: A page's text with its blocks apart: H and P begin headings and paragraphs, what else there is has no text.
_MARKED = r"regexp_replace(regexp_replace(html, '(?s)<head>.*</head>|<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<!--.*?-->', '', 'g'), '<br>', chr(2), 'g')"
for _tag, _mark in (("<h1>", "chr(1) || 'H'"), ("<p>", "chr(1) || 'P'"), ('<div class="ad">', "chr(1) || 'P'"), ("</h1>", "chr(1)"),
    ("</p>", "chr(1)"), ("</div>", "chr(1)"), ("<article>", "chr(1)"), ("</article>", "chr(1)")):
    _MARKED = f"replace({_MARKED}, '{_tag}', {_mark})"
_PLAIN = r"regexp_replace(regexp_replace(x[2:], '<[^>]*>', '', 'g'), '\s+', ' ', 'g')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
    _PLAIN = f"replace({_PLAIN}, '&{_name};', '{_char}')"


@register(rf"""WITH b AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, unnest(string_split({_MARKED},
  chr(1))) AS x, generate_subscripts(string_split({_MARKED}, chr(1)), 1) AS i FROM pages),
c AS (SELECT page_id, i, x[1:1] AS k, trim(regexp_replace(regexp_replace({_PLAIN}, ' ?' || chr(2) || ' ?', chr(10), 'g'), ' +', ' ', 'g'), ' '
  || chr(10)) AS content, trim(replace(title, '&amp;', '&')) AS title FROM b WHERE x[1:1] IN ('H', 'P')),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ordinal, last_value(CASE WHEN k = 'H'
  THEN content END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS head FROM c WHERE content <> '')
SELECT page_id, ordinal::INT AS ordinal, CASE k WHEN 'H' THEN 'heading' ELSE 'paragraph' END AS kind, coalesce(head, title) AS title_path,
  sha256(content) AS content_hash FROM o""")
def html_block_rows(spark, d):
    b = html.html_blocks(table(spark, d, "pages"))
    return b.select("page_id", "ordinal", "kind", F.array_join("title_path", " > ").alias("title_path"), F.sha2("content", 256).alias("content_hash"))


# workbooks

#: Workbooks of 40 cells in three columns, with an empty row after each four rows; every tenth value is a formula without a result.
_CELLS = """SELECT doc_id // 40 AS book, CAST(doc_id % 40 AS int) AS k, CAST((doc_id % 40) // 3 + 1 + ((doc_id % 40) // 3) // 4 AS int) AS r,
  CAST(doc_id % 40 % 3 + 1 AS int) AS c,
  CASE WHEN doc_id % 40 % 10 = 9 THEN '=A1' ELSE concat('v', doc_id) END AS value, CASE WHEN doc_id % 11 = 0 THEN 'note' ELSE '' END AS comment,
  CASE WHEN doc_id % 13 = 0 THEN '0%' ELSE 'General' END AS format FROM documents"""
_SHOWN_SQL = f"""ce AS (SELECT *, chr(64 + c) || r AS address, concat_ws(' | ', value, CASE WHEN comment <> '' THEN 'Comment: ' || comment END,
  CASE WHEN format = '0%' THEN 'Expected format: 0%' END) AS t FROM ({_CELLS})),
li AS (SELECT book, r, (r - 1) // 5 AS island, string_agg(address || ': ' || t, ' | ' ORDER BY c) AS line, min(c) AS c1, max(c) AS c2,
  bool_or(value = '=A1') AS formula FROM ce GROUP BY book, r),
al AS (SELECT book, r, min(value) AS v FROM ce GROUP BY book, r HAVING count(*) = 1)"""


def _workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Parsed workbooks, each with one sheet and one named range."""
    rows = made(spark, d, _CELLS.replace("//", "div"))
    cell = F.struct(F.lit(1).alias("sheet_no"), F.lit("Sheet A").alias("sheet"), F.col("r").alias("row"), F.col("c").alias("col"), "value", "comment",
        F.lit("").alias("validation"), F.lit(False).alias("partial"), "format")
    name = F.struct(F.lit("Some range").alias("name"), F.lit("Sheet A").alias("sheet"), F.lit(1).alias("sheet_no"), F.lit(2).alias("row1"),
        F.lit(2).alias("col1"), F.lit(3).alias("row2"), F.lit(3).alias("col2"))
    want = StructType.fromDDL(workbook.PARSED)
    books = rows.groupBy(F.concat(F.lit("book"), "book").alias("source_id")).agg(F.collect_list(cell).alias("cells"))
    full = books.select("source_id", F.lit(None).cast("string").alias("error"), F.lit(False).alias("hidden"),
        F.array(F.lit("x")).alias("loose_sheets"), "cells", F.array(name).alias("names"))
    fit = lambda items, kind: F.transform(items, lambda x: F.struct(*[x[f.name].alias(f.name) for f in kind.elementType]))
    return full.withColumns({"cells": fit(F.col("cells"), want["cells"].dataType), "names": fit(F.col("names"), want["names"].dataType)})


@register(f"""WITH {_SHOWN_SQL}, g AS (SELECT book, island, min(r) AS r1, max(r) AS r2, min(c1) AS c1, max(c2) AS c2, string_agg(line, chr(10)
  ORDER BY r) AS lines, bool_or(formula) AS formula FROM li GROUP BY book, island)
SELECT 'book' || book AS source_id, r1 AS first_row, chr(64 + c1) || r1 || ':' || chr(64 + c2) || r2 AS cell_range, CASE WHEN formula
  THEN 'FORMULA_WITHOUT_CACHED_VALUE' ELSE '' END AS warnings,
sha256('Sheet: Sheet A' || chr(10) || lines) AS content_hash FROM g""")
def workbook_regions(spark, d):
    out = workbook.regions(_workbooks(spark, d))
    return out.select("source_id", "first_row", "cell_range", F.array_join("warnings", ",").alias("warnings"), "content_hash")


@register(f"""WITH {_SHOWN_SQL}, n AS (SELECT book, r, string_agg(address || ': ' || t, ' | ' ORDER BY c) AS line FROM ce WHERE r BETWEEN 2 AND 3
  AND c BETWEEN 2 AND 3 GROUP BY book, r), b AS (SELECT DISTINCT book FROM ce),
a AS (SELECT book, string_agg(line, chr(10) ORDER BY r) AS lines FROM n GROUP BY book)
SELECT 'book' || b.book AS source_id, 'Named range: Some range' AS section, sha256('Sheet: Sheet A' || chr(10) || 'Named range: Some range'
  || chr(10) || 'Range: B2:C3' || chr(10) || coalesce(lines, '[named range contains no visible cell values]')) AS content_hash
FROM b LEFT JOIN a ON a.book = b.book""")
def workbook_named_ranges(spark, d):
    return workbook.named_ranges(_workbooks(spark, d)).select("source_id", "section", "content_hash")


@register(f"""WITH {_SHOWN_SQL} SELECT 'book' || book AS source_id, address, t AS text FROM ce""")
def workbook_cells(spark, d):
    return workbook.cells(_workbooks(spark, d)).select("source_id", "address", "text")


# the registry

_MANIFEST = """SELECT page_id, regexp_replace(url, '://[^/?#:]*[.]example[.]com', '://www.example.com') AS url, CASE WHEN page_id % 7 = 0
  THEN 'failed' ELSE 'downloaded' END AS status, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html; charset=utf-8'
  ELSE 'application/pdf' END AS content_type,
  concat('h', page_id % 40) AS h FROM pages"""


@register(f"""WITH m AS (SELECT *, regexp_extract(url, '://([^/?#:]*)', 1) AS host FROM ({_MANIFEST})), o AS (SELECT * FROM m
  WHERE host = 'www.example.com' AND status = 'downloaded'),
u AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n FROM o WHERE content_type <> 'image/png'), f AS (SELECT * FROM u WHERE n = 1)
SELECT f.url AS source_url, sha256(f.h) AS sha256, CASE WHEN f.content_type LIKE 'text/html%' THEN 'text/html'
  ELSE 'application/pdf' END AS media_type,
coalesce((SELECT string_agg(z.url, ',' ORDER BY z.pos) FROM (SELECT o.h, o.url, min(o.page_id) AS pos FROM o GROUP BY 1, 2) z WHERE z.h = f.h
  AND z.url <> f.url AND z.pos > f.page_id), '') AS aliases FROM f""")
def registry_build(spark, d):
    """A registry of downloaded pages: one row for each content, with the urls of later copies as aliases."""
    m = made(spark, d, _MANIFEST, "pages")
    items = m.select(F.struct(F.lit(0).alias("m"), "page_id").alias("position"), "url", F.lit(None).cast("string").alias("final_url"), "status",
        "content_type", F.sha2("h", 256).alias("sha256"), F.lit("f").alias("local_file"))
    out = registry.build(items, ["www.example.com"])
    return out.select("source_url", "sha256", "media_type", F.array_join("aliases", ",").alias("aliases"))


@register(r"""WITH p AS (SELECT page_id, trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(url, '://([^/?#]*)',
  1) AS host FROM pages)
SELECT page_id, trim(regexp_replace(CASE WHEN path = '' THEN host ELSE regexp_replace(string_split(path, '/')[-1], '\.(pdf|xlsm|aspx?|html?)$',
  '') END, '[_-]+', ' ', 'g')) AS title FROM p""")
def url_titles(spark, d):
    return table(spark, d, "pages").select("page_id", registry.url_title(F.col("url")).alias("title"))


#: Captured pages, some behind the marks of other files, as the length of a page and its url will have it.
_CAPTURED = """SELECT page_id, concat(CASE length(html) % 5 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'PK' WHEN 2 THEN '  ' WHEN 3 THEN url ELSE '' END,
  CASE WHEN length(url) % 2 = 0 THEN '[Content_Types].xml xl/workbook.xml' ELSE '' END, html) AS content FROM pages"""


@register(rf"""WITH c AS ({_CAPTURED}), h AS (SELECT *, lower(ltrim(content[1:4096], chr(32) || chr(9) || chr(10) || chr(13))) AS head FROM c)
SELECT page_id, CASE WHEN starts_with(content, '%PDF') THEN 'pdf' WHEN starts_with(content, 'PK') AND contains(content, '[Content_Types].xml') AND contains(content, 'xl/workbook.xml')
  THEN 'xlsm' WHEN regexp_matches(head, '^(?:<!doctype|<html|<[?]xml|<head|<body)') THEN 'html' ELSE 'unknown' END AS signature FROM h""")
def file_signatures(spark, d):
    rows = made(spark, d, _CAPTURED, "pages")
    return rows.select("page_id", registry.signature(F.col("content").cast("binary")).alias("signature"))


_NOTES = "SELECT concat('see [', url, '](', regexp_replace(url, '^http:', 'https:'), ') or <', url, '>, ', html) AS value FROM pages"


@register(rf"""SELECT DISTINCT url FROM (SELECT unnest(regexp_extract_all(value, 'https://[^\s)\]>"'']+')) AS url FROM ({_NOTES}))""")
def markdown_urls(spark, d):
    """The https urls of notes about pages, which hold the pages."""
    return files.markdown_links(made(spark, d, _NOTES, "pages"))


@register("""SELECT doc_id, sha256('{"a":' || doc_id || ',"b":' || coalesce(to_json(nullif(lang, 'en')), 'null') || ',"c":' || to_json(text) || ',"d":["' || source || '"]}') AS line_sha FROM documents""")
def json_lines(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.struct(F.array("source").alias("d"), F.col("text").alias("c"), F.nullif("lang", F.lit("en")).alias("b"), F.col("doc_id").alias("a")).alias("r"))
    return own.select("doc_id", "r.*").select("doc_id", F.sha2(files.json_line(own.select("r.*")), 256).alias("line_sha"))


# uploads

def _provider(texts: list[str]) -> list[list[float]]:
    """Vectors of two numbers: the length of a text, and 1. Batches of more than four with a text of over 9,000 characters are
    refused as a whole, and a text with `que` gets a vector of one number."""
    if len(texts) > 4 and any(len(t) > 9000 for t in texts):
        raise upload.ProviderError(503, "", "")
    return [[1.0] if "que" in t else [float(len(t)), 1.0] for t in texts]


@register("""SELECT sha256(text) AS key, CASE WHEN NOT contains(text, 'que') THEN length(text)::DOUBLE END AS size, CASE WHEN contains(text, 'que') THEN 'provider_error' END AS kind
FROM documents GROUP BY text""")
def embed_misses(spark, d):
    """Embeddings of texts, each content once; some batches are refused as a whole and go through in parts, some vectors are wrong."""
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("embedding_text"))
    out = upload.embed(rows, _provider, 2, sleep=lambda s: None)
    return out.select("key", F.get("vector", F.lit(0)).cast("double").alias("size"), "kind")


@register("""SELECT sha256(text) AS id, bool_or(lang = 'en') AS cached FROM documents WHERE NOT contains(text, 'que') OR lang = 'en' GROUP BY text""")
def cache_upkeep(spark, d):
    """A cache after a sync: English texts had vectors, others get new ones, but for those whose vectors are wrong."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("embedding_text"), "lang")
    cache = docs.where("lang = 'en'").select("content_hash", F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float")).alias("vector")).distinct()
    joined = sync.cache_join(docs.drop("lang"), cache, "content_hash", 2)
    fresh = upload.embed(joined.where("vector is null").drop("vector"), _provider, 2, sleep=lambda s: None).where("vector is not null").select(
        F.col("key").alias("content_hash"), "vector")
    return sync.upsert(cache, fresh, "content_hash").select(F.col("content_hash").alias("id"), (F.get("vector", F.lit(1)) == 0).alias("cached"))


@register("""WITH c AS (SELECT doc_id, text, lang, bool_or(lang = 'en') OVER (PARTITION BY text) AS cached FROM documents),
f AS (SELECT *, NOT cached AND contains(text, 'que') AS failed FROM c)
SELECT 'chunks' AS what, count(*) AS n FROM f UNION ALL SELECT 'failed', count(*) FILTER (failed) FROM f UNION ALL SELECT 'provider_error', count(DISTINCT text) FILTER (failed) FROM f
UNION ALL SELECT 'cache', count(DISTINCT text) FILTER (NOT failed) FROM f UNION ALL SELECT 'index', count(*) FILTER (lang <> 'es' OR NOT failed) FROM f""")
def upload_run(spark, d):
    """The report of a whole sync: English texts have vectors in the cache, the index lacks Spanish ones, and some embeddings are refused."""
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("embedding_text"))
    zero = F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))
    cache = docs.where("lang = 'en'").select(F.sha2("text", 256).alias("content_hash"), zero.alias("vector")).distinct()
    index = chunks.join(docs.where("lang <> 'es'").select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("vector", zero)
    kept = {}

    def write(name, df):
        kept[name] = stored(df)
        return kept[name]

    report = upload.run_upload(chunks, cache, index, _provider, 2, write, sleep=lambda s: None)
    told = [("chunks", report["chunks"]), ("failed", report["failed"]), ("provider_error", report["failures"].get("provider_error", 0))]
    counts = [kept[name].agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name in ("cache", "index")]
    return spark.createDataFrame(told, "what string, n bigint").unionByName(counts[0]).unionByName(counts[1])


@register("""SELECT 'SCOPE_DIFFERS' AS code WHERE EXISTS (SELECT 1 FROM documents WHERE source = 'src1')
UNION ALL SELECT 'CHUNKS_OUTSIDE_SCOPE' WHERE EXISTS (SELECT 1 FROM documents WHERE source = 'src1' AND lang = 'en')""")
def delete_scope_faults(spark, d):
    """A scope of all sources but one may not delete: it differs from the approved ones, and (English) chunks lie outside of it."""
    ids = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("id")).distinct()
    scope = upload.scope_rows(ids.where(F.col("id") != "src1").withColumns({"review_status": F.lit("approved"), "status": F.lit("current")}), "m",
        "c", [], True, True)
    chunks = table(spark, d, "documents").where("source is not null and lang = 'en'").select(F.col("source").alias("source_id"))
    return upload.scope_issues(scope, ids, chunks, "m", "c")


@register("""SELECT sha256(text) AS content_hash, CASE WHEN n_chars % 3 = 0 THEN n_chars ELSE 1 END AS version FROM documents WHERE n_chars % 2 = 0 OR n_chars % 3 = 0 GROUP BY text, n_chars""")
def cache_store(spark, d):
    """A cache of two models after vectors of one of them were put, some of them invalid; what is read back of that model."""
    docs = table(spark, d, "documents").select("n_chars", F.sha2("text", 256).alias("content_hash")).distinct()
    vec = lambda x: F.array(x.cast("float"), F.lit(0.0).cast("float"))
    had = docs.where("n_chars % 2 = 0").select(F.explode(strings("m", "other")).alias("model"), F.lit(2).alias("dimensions"), "content_hash", vec(F.lit(1)).alias("vector"))
    new = docs.select("content_hash", F.when(F.col("n_chars") % 3 == 0, vec(F.col("n_chars"))).otherwise(vec(F.lit(float("nan")))).alias("vector"))
    out = sync.cached_vectors(sync.cache_put(had, new, "m", 2), "m", 2)
    return out.select("content_hash", F.get("vector", F.lit(0)).cast("bigint").alias("version"))


@register("""SELECT 'i' || doc_id AS image_id, 'p/i' || doc_id || '.webp' AS blob_name, CASE WHEN contains(text, 'que') THEN 'provider_error' END AS kind FROM documents WHERE lang <> 'en'""")
def image_publish(spark, d):
    """Contents put under their names; those with `que` are refused."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("i"), "doc_id").alias("image_id"), "lang", "text")
    name = F.concat("image_id", F.lit(".webp"))
    plan = docs.where("lang <> 'en'").select("image_id", name.alias("file_name"), F.concat(F.lit("p/"), name).alias("blob_name"), F.concat(F.lit("https://m/p/"), name).alias("public_url"))
    scan = docs.select(F.concat(F.lit("file:/x/"), name).alias("path"), F.col("text").cast("binary").alias("content"))
    return images.publish(plan, scan, _put, sleep=lambda s: None).select("image_id", "blob_name", "kind")


def _put(blob: str, content: bytes) -> None:
    if b"que" in content:
        raise upload.ProviderError(400, "", "refused")


# files

def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where the session keeps its checkpoints, which all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        stored(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@register("""SELECT doc_id, sha256(coalesce(text, '')) AS text_sha, lang, 'row' AS kind FROM documents
UNION ALL SELECT NULL, NULL, CASE k WHEN 0 THEN 'LINE_MALFORMED' ELSE 'KEY_REPEATED' END, 'issue' FROM unnest([0, 1]) AS t(k)""")
def jsonl_round_trip(spark, d):
    """Documents written as JSON lines and read back; a malformed line and a repeated key beside them are issues."""
    path = _folder(spark, "lines")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    files.write_jsonl(docs, path)
    more = spark.createDataFrame([('{"doc_id": "x', ), ('{"doc_id": -1, "text": "a"}', ), ('{"doc_id": -1, "text": "a"}', )], "value string")
    more.write.mode("append").text(path)
    rows, faults_ = files.read_jsonl(spark, path, docs.schema, "doc_id")
    out = rows.where("doc_id >= 0").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), "lang", F.lit("row").alias("kind"))
    none = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(faults_.select(none("bigint").alias("doc_id"), none("string").alias("text_sha"), F.col("code").alias("lang"), F.lit("issue").alias("kind")))


@register("""SELECT source AS id, 'T ' || source AS title, (row_number() OVER (ORDER BY source) - 1)::INT AS position FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
def yaml_registry_scan(spark, d):
    """The sources of the documents written as a YAML manifest and read back."""
    path = _folder(spark, "yaml")
    names = table(spark, d, "documents").where("source is not null").select("source").distinct()
    lines = F.array(F.concat(F.lit("- id: "), "source"), F.concat(F.lit("  title: T "), "source"))
    body = names.select(F.lit(1).alias("part"), "source", F.posexplode(lines).alias("at", "value"))
    head = spark.createDataFrame([(0, "", 0, "schema_version: 1"), (0, "", 1, "sources:")], "part int, source string, at int, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("part", "source", "at").select("value").write.text(path)
    rows, _ = yaml_files.read_items(spark, path, "sources", "id:string,title:string", pattern="part-*")
    return rows.select("id", "title", "position")


@register("""SELECT page_id % 2 AS m, url || CASE k WHEN 0 THEN '' ELSE '#again' END AS url, k::INT AS p FROM pages, unnest([0, 1]) AS t(k)""")
def manifest_union(spark, d):
    """Rows of two lists of download manifests, each manifest with two entries, with their places."""
    pages = table(spark, d, "pages")
    entries = F.array(F.struct("url"), F.struct(F.concat("url", F.lit("#again")).alias("url")))
    rows = registry.manifest_rows([pages.where(F.col("page_id") % 2 == k).select(entries.alias("sources")) for k in (0, 1)])
    return rows.select(F.col("position.m").cast("bigint").alias("m"), "url", F.col("position.p").alias("p"))


# parts of answers

@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
SELECT doc_id AS query_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS number, trim(line, ' ') AS title FROM l WHERE trim(line, ' ') <> ''""")
def guide_step_numbers(spark, d):
    """The lines of a text as steps."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.explode(answer.guide_steps(F.split("text", "\n"))).alias("s"))
    return rows.select("query_id", "s.number", "s.title")


#: Answers that cite two or three sources, chosen by the length of a text and of its first word.
_CITING = """SELECT doc_id AS query_id, concat('[SOURCE_', CAST(1 + n_chars % 4 AS string), '] ', text, ' [SOURCE_', CAST(1 + length(regexp_extract(text, '[A-Za-z]+', 0)) % 4 AS string),
  '] [SOURCE_2] [SOURCE_x]') AS answer FROM documents"""


@register(rf"""WITH a AS ({_CITING.replace("string)", "VARCHAR)")}), u AS (SELECT query_id, unnest(regexp_extract_all(answer, '\[(SOURCE_[1-9][0-9]*)\]', 1)) AS marker,
  generate_subscripts(regexp_extract_all(answer, '\[(SOURCE_[1-9][0-9]*)\]', 1), 1) AS k FROM a),
f AS (SELECT query_id, marker, min(k) AS k FROM u WHERE marker IN ('SOURCE_1', 'SOURCE_2', 'SOURCE_3') GROUP BY query_id, marker)
SELECT query_id, marker, (row_number() OVER (PARTITION BY query_id ORDER BY k))::INT AS "order", 's' || right(marker, 1) AS source_id FROM f""")
def citation_rows(spark, d):
    """Known markers of answers in the order of their first use."""
    answers = made(spark, d, _CITING)
    marks = answers.select("query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    marked = marks.select("query_id", F.concat(F.lit("SOURCE_"), "n").alias("marker"), F.col("n").alias("id"), F.concat(F.lit("s"), "n").alias("source_id"))
    return answer.citations(answers, marked).select("query_id", "marker", "order", "source_id")


_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@register(rf"""WITH f AS (SELECT DISTINCT url, {_SLUG.format("regexp_replace(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '[.][^.]*$', '')")} AS s FROM pages WHERE page_id % 3 = 0),
k AS (SELECT url, CASE WHEN length(s) < 3 THEN s || '-source' ELSE s END AS key FROM f),
p AS (SELECT 'snap/' || regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') || '.html' AS path, regexp_replace({_SLUG.format('url')}[1:100], '-+$', '') AS slug FROM pages)
SELECT url, min(path) AS path FROM k LEFT JOIN p ON contains(p.slug, k.key) GROUP BY url""")
def error_snapshots(spark, d):
    """Pages captured under names made of their urls, for the urls of every third page."""
    pages = table(spark, d, "pages")
    names = pages.select(F.concat(F.lit("snap/"), F.regexp_replace("url", "[^A-Za-z0-9]+", "_"), F.lit(".html")).alias("path"))
    return registry.error_snapshots(pages.where("page_id % 3 = 0").select("url"), names)
