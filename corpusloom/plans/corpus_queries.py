"""Registered queries of the corpus build, the answers and the checks of records, each with the DuckDB SQL of the same rows.

Rows that an operator needs and the tables lack are made of documents, pages and events by SQL that both engines run; what
the operator does to them is stated once as DataFrames and once, in other words, as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab
from corpusloom.functions import urls
from corpusloom.operators import answer, chunking, constraints, corpus, images, query, registry, retrieval, sync, upload
from corpusloom.plans.search_queries import _GREEDY_SQL, _NORMAL_SQL, _PIECES_SQL, register, table
from corpusloom.sources import html, paged, workbook

NONE = "cast(array() as array<string>)"


def made(spark: SparkSession, d: str, sql: str, name: str = "documents") -> DataFrame:
    """The rows of `sql` over one table."""
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, d, name)})


def strings(*values: str):
    return F.array(*map(F.lit, values)) if values else F.expr(NONE)


# questions

#: Questions and file names with years that follow from the length of a text, in the forms that are known and in some that are not.
_ASK = """SELECT doc_id, CASE lang WHEN 'en' THEN concat('Tax for ', CAST(1990 + n_chars % 60 AS string), '/', CAST(10 + n_chars % 90 AS string), ', ', text)
  WHEN 'fr' THEN concat('the YA ', CAST(10 + n_chars % 80 AS string), CAST(10 + n_chars % 79 AS string), ' return ', text)
  WHEN 'es' THEN concat('in ', CAST(1950 + n_chars % 200 AS string), ' only: ', text) ELSE concat('x', CAST(n_chars AS string), 'y') END AS q,
  concat(source, CASE lang WHEN 'en' THEN concat('_', CAST(1990 + n_chars % 60 AS string), '_', CAST(2000 + n_chars % 60 AS string))
  WHEN 'fr' THEN concat('-', CAST(10 + n_chars % 80 AS string), '_', CAST(10 + (n_chars + n_chars % 3) % 80 AS string)) ELSE concat('_', CAST(1000 + n_chars % 9000 AS string)) END, '.pdf') AS f
  FROM documents"""


@register(r"""WITH a AS (""" + _ASK.replace("string)", "VARCHAR)") + r"""), p AS (SELECT *, regexp_extract(q, '\b(20\d{2})\s*[/-]\s*(20\d{2}|\d{2})\b', 1) AS y1,
  regexp_extract(q, '\b(20\d{2})\s*[/-]\s*(20\d{2}|\d{2})\b', 2) AS y2, regexp_extract(q, '\bYA\s*[''-]?\s*(\d{2})(\d{2})\b', 1, 'i') AS s1,
  regexp_extract(q, '\bYA\s*[''-]?\s*(\d{2})(\d{2})\b', 2, 'i') AS s2, regexp_extract(q, '\b(20\d{2})\b', 1) AS y,
  regexp_extract(f, '(20\d{2})[_-](20\d{2})', 1) AS l1, regexp_extract(f, '(20\d{2})[_-](20\d{2})', 2) AS l2,
  regexp_extract(f, '(?:^|\D)(\d{2})[_-](\d{2})(?:\D|$)', 1) AS c1, regexp_extract(f, '(?:^|\D)(\d{2})[_-](\d{2})(?:\D|$)', 2) AS c2,
  regexp_extract(f, '(?:^|\D)(\d{4})(?:\D|$)', 1) AS r FROM a)
SELECT doc_id, CASE WHEN y1 <> '' THEN y1 || '/' || CASE WHEN length(y2) = 2 THEN y1[1:2] || y2 ELSE y2 END WHEN s1 <> '' THEN '20' || s1 || '/20' || s2
  WHEN y <> '' THEN y END AS asked,
CASE WHEN l1 <> '' THEN l1 || '/' || l2 WHEN c1 <> '' AND c2::INT = (c1::INT + 1) % 100 THEN '20' || c1 || '/20' || c2
  WHEN r <> '' AND r::INT >= 1000 AND NOT r::INT BETWEEN 1900 AND 2099 AND r::INT % 100 = (r::INT // 100 + 1) % 100 THEN '20' || r[1:2] || '/20' || r[3:4] END AS of_file
FROM p""")
def periods(spark, d):
    return made(spark, d, _ASK).select("doc_id", T.period(F.col("q")).alias("asked"), T.file_period(F.col("f")).alias("of_file"))


_PHRASES = ["How do I file VAT?", "income tax of a company", "Corporate Income Tax rate", "vatican city", "previous WHT for partners",
    "stamp duty and SSCL: the Act", "personal taxpayer, APIT", "profile"]
#: A phrase, chosen by the length of a text, before the text.
_QUESTIONS = "SELECT doc_id, concat(CASE n_chars % 8 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PHRASES)) + " END, ' ', text) AS retrieval_text FROM documents"


def _labels_sql(patterns: dict[str, list[str]]) -> str:
    found = ", ".join("CASE WHEN regexp_matches(low, '(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(ps) + ")(?:$|[^\\p{L}\\p{N}_])') THEN '" + n + "' END" for n, ps in patterns.items())
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


_EXPANDED_SQL = "concat_ws(' ', retrieval_text, " + ", ".join(
    f"CASE WHEN regexp_matches(retrieval_text, '(?:^|[^A-Za-z0-9]){a}(?:$|[^A-Za-z0-9])', 'i') THEN '{x}' END" for a, x in vocab.ALIASES.items()) + ")"


@register(rf"""WITH q AS ({_QUESTIONS}), l AS (SELECT *, lower(retrieval_text) AS low FROM q), t AS (SELECT *, {_labels_sql(vocab.TAX_LABELS)} AS ts FROM l)
SELECT doc_id, array_to_string(CASE WHEN list_has_any(ts, {vocab.SPECIFIC_LABELS}) THEN list_filter(ts, lambda x: x <> '{vocab.BROAD_LABEL}') ELSE ts END, ',') AS tax_types,
  array_to_string({_labels_sql(vocab.TAXPAYER_LABELS)}, ',') AS taxpayer_types, regexp_matches(retrieval_text, '\b(?:{"|".join(vocab.PROCEDURAL_VERBS)})\b', 'i') AS procedural,
  regexp_matches(retrieval_text, '\b(?:{vocab.HISTORICAL})\b', 'i') AS historical, regexp_matches(low, '\b(?:{vocab.LEGAL})\b') AS legal, sha256({_EXPANDED_SQL}) AS expanded FROM t""")
def question_labels(spark, d):
    rows = made(spark, d, _QUESTIONS).withColumn("legal", query.matches(F.lower("retrieval_text"), vocab.LEGAL))
    out = query.analyze(rows)
    return out.select("doc_id", F.array_join("tax_types", ",").alias("tax_types"), F.array_join("taxpayer_types", ",").alias("taxpayer_types"),
        F.col("procedural_intent").alias("procedural"), F.col("historical_intent").alias("historical"), "legal", F.sha2("retrieval_text", 256).alias("expanded"))


@register(r"""SELECT doc_id, CASE WHEN length(t) > 42 THEN t[1:42] || '…' ELSE t END AS title, length('CONVERSATION:' || chr(10) || 'USER: '
  || doc_id || chr(10) || 'ASSISTANT: ') AS n_head,
  'RETRIEVED CONTEXT (SOURCE and IMAGE blocks are separate):' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE '(none retrieved)' END
  || chr(10) || chr(10) || 'CONVERSATION:' || chr(10) || 'USER: ' || doc_id || chr(10)
  || 'ASSISTANT: ' || t[1:10] || chr(10) || chr(10) || 'Answer the latest user question using the required JSON response shape.' AS prompt
FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x85\xa0]+', ' ', 'g')) AS t FROM documents)""")
def prompts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"),
        T.strip(F.regexp_replace("text", r"(?U)\s+", " ")).alias("t"), "text")
    talk = F.array(F.struct(F.lit("user").alias("role"), F.col("id").alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.substring("t", 1, 10).alias("text")))
    context = F.when(F.col("doc_id") % 2 == 0, "c").when(F.col("doc_id") % 3 == 0, "")
    n = F.length(F.concat(F.lit("CONVERSATION:\nUSER: "), "id", F.lit("\nASSISTANT: "))).cast("bigint")
    return rows.select("doc_id", answer.question_title(F.col("text")).alias("title"), n.alias("n_head"), answer.prompt(talk, context).alias("prompt"))


# searches and answers

_SEEN = """SELECT doc_id - doc_id % 20 AS query_id, doc_id AS id, concat('s', doc_id % 3) AS source_id, CAST(doc_id % 4 AS int) AS page, CASE
  WHEN doc_id % 7 = 0 THEN concat('flow', doc_id % 2) WHEN doc_id % 7 = 1 THEN ' ' END AS workflow_id,
  doc_id % 20 + 1 AS rank FROM documents WHERE doc_id % 20 < 6"""
_PICTURES = """SELECT doc_id - doc_id % 20 AS query_id, doc_id AS id, concat('s', doc_id % 2) AS source_id, CAST(doc_id % 5 AS int) AS page, CASE
  WHEN doc_id % 3 = 0 THEN concat('flow', doc_id % 2) WHEN doc_id % 3 = 1 THEN 'flow0 ' END AS workflow_id,
  CASE doc_id % 11 WHEN 0 THEN 'historical' WHEN 1 THEN NULL ELSE 'Current' END AS status, CASE WHEN doc_id % 6 = 5 THEN 'text'
  ELSE 'guide_image' END AS content_type, doc_id % 20 AS original_rank,
  CASE doc_id % 4 WHEN 1 THEN '2024/2025' WHEN 2 THEN '2025/2026' END AS tax_year, CASE WHEN doc_id % 5 > 0 THEN 'gazette' END AS authority_level,
  CAST(doc_id % 90 AS int) AS authority_rank,
  CASE doc_id % 3 WHEN 0 THEN 'vat' WHEN 1 THEN 'wht' END AS tax_type, CASE WHEN (doc_id - doc_id % 20) % 3 = 0 THEN '2025/2026' END AS q_tax_year
  FROM documents WHERE doc_id % 20 >= 3"""


def _pictures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kinds = F.array_compact(F.array("tax_type"))
    rows = made(spark, d, _PICTURES).withColumns({"tax_types": kinds, "q_tax_types": strings("vat"), "q_text": F.lit(""),
        "q_procedural": F.lit(False), "q_historical": F.lit(False),
                                                  "effective_from": F.lit(None).cast("date"), "effective_to": F.lit(None).cast("date")})
    return rows, made(spark, d, _SEEN)


@register(f"""WITH i AS ({_PICTURES}), e AS ({_SEEN}), a AS (SELECT i.*, EXISTS (SELECT 1 FROM e WHERE e.query_id = i.query_id
  AND e.source_id = i.source_id AND e.page = i.page) AS by_page,
  EXISTS (SELECT 1 FROM e WHERE e.query_id = i.query_id AND trim(e.workflow_id) <> '' AND trim(e.workflow_id) = trim(i.workflow_id)) AS by_flow,
  CASE WHEN q_tax_year IS NULL THEN (lower(status) = 'current')::INT WHEN tax_year = q_tax_year THEN 3 WHEN tax_year IS NULL THEN 1
  ELSE 0 END AS sp FROM i),
f AS (SELECT *, CASE WHEN by_page THEN 2 WHEN trim(workflow_id) = workflow_id THEN 1 ELSE 0 END AS association, coalesce(sp, 0) AS p,
  CASE WHEN tax_type IS NULL THEN 1 WHEN tax_type = 'vat' THEN 2 ELSE 0 END AS st, CASE WHEN authority_level = 'gazette' THEN 7
  ELSE least(authority_rank // 10, 8) END AS sa
  FROM a WHERE (by_page OR by_flow) AND content_type = 'guide_image' AND coalesce(lower(status), '') <> 'historical' AND (q_tax_year IS NULL OR coalesce(sp, 0) > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY association DESC, p DESC, st DESC, sa DESC, original_rank, id) AS rank FROM f)
SELECT query_id, id, rank, association::BIGINT AS association FROM r WHERE rank <= 4""")
def image_rerank(spark, d):
    rows, seen = _pictures(spark, d)
    out = retrieval.rerank_images(rows, seen)
    return out.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.col("association").cast("bigint").alias("association"))


_FOUND = """SELECT doc_id - doc_id % 20 AS query_id, doc_id AS id, source AS source_id, CAST(doc_id % 4 AS int) AS page, concat('flow',
  doc_id % 3) AS workflow_id, 'text' AS content_type,
  CASE WHEN doc_id % 9 = 0 THEN 0.005 ELSE 0.02 END AS score, doc_id % 20 AS original_rank, CASE WHEN doc_id % 10 = 9 THEN 'excluded'
  ELSE 'current' END AS status FROM documents"""
_ALL_PICTURES = _FOUND.replace("'text' AS", "'guide_image' AS").replace("doc_id AS id", "doc_id + 1 AS id").replace("doc_id % 4 AS int",
    "doc_id % 3 AS int")


@register(f"""WITH f AS ({_FOUND}), g AS ({_ALL_PICTURES}), e AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id
  ORDER BY original_rank, id) AS n FROM f WHERE score >= 0.01 AND status <> 'excluded'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY original_rank, id) AS rank FROM e WHERE n <= 2), ev AS (SELECT * FROM r
  WHERE rank <= 8),
w AS (SELECT g.*, EXISTS (SELECT 1 FROM ev WHERE ev.query_id = g.query_id AND ev.source_id = g.source_id AND ev.page = g.page) AS p,
  EXISTS (SELECT 1 FROM ev WHERE ev.query_id = g.query_id AND ev.workflow_id = g.workflow_id) AS f FROM g WHERE g.query_id % 40 = 0
  AND score >= 0.01 AND status <> 'excluded'),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, original_rank, id) AS rank FROM w WHERE p OR f)
SELECT query_id, 'evidence' AS kind, id, rank FROM ev UNION ALL SELECT query_id, 'image', id, rank FROM i WHERE rank <= 4""")
def retrieval_with_images(spark, d):
    """Evidence and, where the question asks how, images: one orchestration over what two searches found."""
    more = {"tax_types": F.expr(NONE), "tax_year": F.lit(None).cast("string"), "effective_from": F.lit(None).cast("date"),
        "effective_to": F.lit(None).cast("date"),
            "authority_level": F.lit(None).cast("string"), "authority_rank": F.lit(0)}
    found, pictures = (made(spark, d, x).withColumns(more) for x in (_FOUND, _ALL_PICTURES))
    asked = found.select("query_id").distinct().withColumns({
        "tax_year": F.lit(None).cast("string"), "tax_types": F.expr(NONE), "retrieval_text": F.lit("x"),
            "procedural_intent": F.col("query_id") % 40 == 0, "historical_intent": F.lit(False)})
    evidence, shown = retrieval.retrieve(retrieval.with_year(asked, F.lit(None).cast("string")), found, pictures)
    row = lambda df, kind: df.select("query_id", F.lit(kind).alias("kind"), "id", F.col("rank").cast("bigint").alias("rank"))
    return row(evidence, "evidence").unionByName(row(shown, "image"))


_INDEX = """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text END AS content, CASE WHEN doc_id % 3 = 0 THEN 'x'
  ELSE CAST(doc_id AS string) END AS page,
  CASE doc_id % 4 WHEN 0 THEN '2024-05-06T10:00:00Z' WHEN 1 THEN '2024-13-01' WHEN 2 THEN '2024-01-02' END AS published_date, CASE
  WHEN doc_id % 5 > 0 THEN lang END AS tags FROM documents"""


@register(f"""WITH i AS ({_INDEX.replace('AS string)', 'AS VARCHAR)')})
SELECT id::VARCHAR AS id, length(coalesce(content, '')) AS n_chars, 'document' AS content_type, try_cast(page AS INT) AS page,
CASE id % 4 WHEN 0 THEN DATE '2024-05-06' WHEN 2 THEN DATE '2024-01-02' END AS published_date, coalesce(tags, '') AS tags,
  (tags IS NOT NULL)::INT AS n_tags, 0 AS n_tax_types, '' AS title FROM i""")
def index_row_defaults(spark, d):
    """Old index rows, with texts in place of numbers, dates and lists and without most columns, as typed rows."""
    out = retrieval.row_defaults(made(spark, d, _INDEX))
    return out.select("id", F.length("content").cast("bigint").alias("n_chars"), "content_type", "page", "published_date",
        F.array_join("tags", ",").alias("tags"), F.size("tags").alias("n_tags"),
                      F.size("tax_types").alias("n_tax_types"), "title")


def _answer_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each document as a question: three pieces of evidence (the last repeats the first), two images, a generated text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    rows = docs.select("query_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"))
    base = retrieval.row_defaults(rows.select(
        F.col("rank").cast("string").alias("id"), F.concat(F.lit("text "), F.col("rank") % 3).alias("content"), F.lit("act").alias("content_type"),
            F.concat(F.lit("T"), "rank").alias("title"),
        F.concat(F.lit("s"), F.col("rank") % 2).alias("source_id"), F.col("rank").alias("page"), F.lit(None).cast("int").alias("page_end"),
            F.lit("Sec").alias("section"), F.col("query_id").cast("string").alias("document_version")))
    evidence = base.withColumns({"query_id": F.col("document_version").cast("bigint"), "rank": F.col("id").cast("int")})
    evidence = evidence.withColumns({"content": F.when(F.col("rank") == 3, " text 1 ").otherwise(F.col("content")),
        "source_id": F.when(F.col("rank") == 3, "s1").otherwise(F.col("source_id"))})
    kinds = F.col("rank") == 2
    pictures = evidence.where("rank < 3").withColumns({
        "content_type": F.lit("guide_image"), "image_id": F.concat(F.lit("pic-"), "rank"),
            "image_alt_text": F.when(kinds & (F.col("query_id") % 3 == 0), "").otherwise("alt"),
        "image_url": F.concat(F.when(F.col("query_id") % 5 == 0, "http://m.example/").otherwise("https://m.example/x/"), "rank", F.lit(".webp")),
            "image_caption": F.lit("cap")})
    step = '{"title": " T ", "instruction": "Do [SOURCE_2] it [SOURCE_9]", "image_id": "%s", "citation_markers": ["SOURCE_1", "[2]", "x", "7"]}'
    texts = [
        '{"answer": "So [SOURCE_2, SOURCE_1] and [SOURCE_4] ![i](http://x) [IMAGE_1]."}',
        '{"answer": "One [SOURCE_1]", "guide": {"title": " ", "steps": [%s, %s]}}' % (step % "IMAGE_2", step % "pic-1"),
        '{"answer": "None [SOURCE_x] [SOURCE_1 ]", "guide": null}', '{"answer": 5}',
    ]
    generated = docs.select("query_id", F.get(F.array(*map(F.lit, texts)), F.pmod("query_id", F.lit(4)).cast("int")).alias("text"))
    return generated, evidence, pictures


@register("""SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN 'So [SOURCE_2] [SOURCE_1] and   .' WHEN 1 THEN 'One [SOURCE_1]' WHEN 2
  THEN 'None  [SOURCE_1 ]' END AS answer,
CASE doc_id % 4 WHEN 0 THEN '2:T2:2,1:T1:1' WHEN 1 THEN '1:T1:1,2:T2:2' WHEN 2 THEN '' END AS cited, CASE doc_id % 4 WHEN 1
  THEN 'Guide' END AS guide_title,
CASE doc_id % 4 WHEN 1 THEN '1;T;Do [SOURCE_2] it;1,2|2;T;Do [SOURCE_2] it;1,2' END AS steps,
CASE doc_id % 4 WHEN 1 THEN CASE WHEN doc_id % 5 = 0 THEN '-|-' WHEN doc_id % 3 = 0 THEN '-|pic-1' ELSE 'pic-2|pic-1' END END AS pictures
  FROM documents""")
def answer_responses(spark, d):
    """Generated answers to responses: cleaned texts, citations, guides with citations and images of their steps."""
    generated, evidence, pictures = _answer_inputs(spark, d)
    out = answer.answer_rows(generated, answer.build_context(evidence, pictures), "https://m.example/x")
    cited = F.transform("citations", lambda c: F.concat_ws(":", c["id"], c["title"], c["page"].cast("string")))
    steps = F.transform("guide.steps", lambda s: F.concat_ws(";", s["number"].cast("string"), s["title"], s["instruction"],
        F.array_join(s["citation_ids"], ",")))
    shown = F.transform("guide.steps", lambda s: F.coalesce(s["image"]["id"], F.lit("-")))
    return out.select("query_id", "answer", F.array_join(cited, ",").alias("cited"), F.col("guide.title").alias("guide_title"),
        F.array_join(steps, "|").alias("steps"), F.array_join(shown, "|").alias("pictures"))


@register("""SELECT doc_id AS query_id, '[SOURCE_1]' || chr(10) || 'Title: T1' || chr(10) || 'Type: act' || chr(10) || 'Section: Sec' || chr(10)
  || 'Page: 1' || chr(10) || 'Content: text 1' || chr(10) || chr(10) ||
'[SOURCE_2]' || chr(10) || 'Title: T2' || chr(10) || 'Type: act' || chr(10) || 'Section: Sec' || chr(10) || 'Page: 2' || chr(10) || 'Content: text 2' || chr(10) || chr(10) ||
'[IMAGE_1]' || chr(10) || 'Title: T1' || chr(10) || 'Type: guide_image' || chr(10) || 'Section: Sec' || chr(10) || 'Page: 1' || chr(10) || 'Image ID: pic-1' || chr(10) || 'Reviewed alt text: alt' || chr(10) || 'Reviewed caption: cap'
|| CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || '[IMAGE_2]' || chr(10) || 'Title: T2' || chr(10) || 'Type: guide_image' || chr(10)
  || 'Section: Sec' || chr(10) || 'Page: 2' || chr(10) || 'Image ID: pic-2' || chr(10) ||
'Reviewed alt text: alt' || chr(10) || 'Reviewed caption: cap' END AS context FROM documents""")
def answer_contexts(spark, d):
    _, evidence, pictures = _answer_inputs(spark, d)
    return answer.build_context(evidence, pictures).select("query_id", "context")


@register("""SELECT doc_id AS query_id, n::INT AS number, k::INT AS at, (k + 1)::BIGINT AS cited, 'T' || (k + 1) AS title FROM documents, unnest([1,
  2]) AS s(n), unnest([0, 1]) AS t(k) WHERE doc_id % 4 = 1""")
def step_citations(spark, d):
    generated, evidence, pictures = _answer_inputs(spark, d)
    rows = answer.step_rows(answer.answer_rows(generated, answer.build_context(evidence, pictures)))
    return rows.select("query_id", "number", "at", F.col("id").cast("bigint").alias("cited"), "title")


#: An HTTP code of a provider by the size of an event's value.
_CODES = "CASE WHEN value < 5 THEN 429 WHEN value < 10 THEN 408 WHEN value < 20 THEN 504 WHEN value < 40 THEN 500 END"


@register(f"""WITH e AS (SELECT event_id, {_CODES} AS c FROM events)
SELECT event_id, CASE WHEN c = 429 THEN 'USAGE_LIMIT' WHEN c IN (408, 504) THEN 'TIMEOUT' ELSE 'SEARCH_ERROR' END AS code, CASE WHEN c = 429 THEN 429 WHEN c IN (408, 504) THEN 504 ELSE 503 END AS status
FROM e""")
def provider_errors(spark, d):
    told = table(spark, d, "events").select("event_id", answer.provider_error(F.expr(_CODES), "SEARCH_ERROR").alias("e"))
    return told.select("event_id", "e.code", "e.status")


# the corpus build

_SOURCES = """SELECT source AS id, concat('Title of ', source) AS title, CASE WHEN count(*) % 2 = 0 THEN 'act'
  ELSE 'gazette' END AS document_type, concat('https://h.example/', source) AS source_url,
  CASE WHEN count(*) % 9 = 0 THEN 'excluded' ELSE 'current' END AS status, CASE WHEN count(*) % 7 = 0 THEN 'draft'
  ELSE 'approved' END AS review_status, 'f' AS local_file, CAST(NULL AS date) AS published_date,
  CAST(NULL AS date) AS effective_from, CAST(NULL AS date) AS effective_to, CASE WHEN count(*) % 3 = 0 THEN '2025/2026' END AS tax_year,
  'gazette' AS authority_level, 90 AS authority_rank, 'en' AS language,
  CASE WHEN count(*) % 4 = 0 THEN 'F1' END AS form_code, max(source) AS x FROM documents WHERE source IS NOT NULL GROUP BY source"""
_RECORDS = """SELECT doc_id, source AS source_id, concat('r', doc_id) AS record_id, doc_id AS ordinal, CASE WHEN doc_id % 31 = 0 THEN 'table'
  ELSE 'page' END AS content_kind, text AS content, CAST(doc_id // 300 AS int) AS page,
  CAST(NULL AS int) AS page_end, CASE WHEN doc_id % 200 < 150 THEN concat('Part ', doc_id // 400) END AS section, CAST(NULL AS string) AS sheet,
  CAST(NULL AS string) AS cell_range,
  CASE doc_id % 3 WHEN 0 THEN 'pdf_ocr' ELSE 'pdf_text' END AS extraction_method FROM documents"""


def _corpus(spark: SparkSession, d: str, sources_sql: str = _SOURCES) -> tuple[DataFrame, DataFrame]:
    """(sources, records) made of documents."""
    none = lambda kind: F.lit(None).cast(kind)
    sources = made(spark, d, sources_sql).drop("x").withColumns({
        "final_url": none("string"), "sha256": F.sha2("id", 256), "supersedes": F.expr(NONE), "superseded_by": F.expr(NONE),
            "render_pages": F.expr("cast(array() as array<int>)"), "document_version": none("string"),
        "exclusion_reason": F.when(F.col("status") == "excluded", "r"), "tax_types": strings("vat"), "taxpayer_types": F.expr(NONE),
            "tags": F.expr(NONE), "aliases": F.expr(NONE), "workflow_ids": strings("w1", "w2"),
    })
    records = made(spark, d, _RECORDS.replace("//", "div")).drop("doc_id").withColumns({
        "title_path": F.when(F.col("ordinal") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.expr(NONE)),
            "table_headers": F.when(F.col("content_kind") == "table", strings("H")).otherwise(F.expr(NONE)),
        "warnings": F.when(F.col("ordinal") % 5 == 0, strings("TABLE_LAYOUT_LOSS")).otherwise(F.expr(NONE)),
    })
    return sources, records


#: Records with normalised contents, their pieces, and greedy chunks of a source: see `_GREEDY_SQL`.
_BUILD_SQL = f"""src AS ({_SOURCES}), el AS (SELECT * FROM src WHERE review_status = 'approved' AND status <> 'excluded'),
  rec0 AS ({_RECORDS.replace('string', 'VARCHAR')}), {_NORMAL_SQL},
rec AS (SELECT rec0.* REPLACE (nt.text AS content) FROM rec0 JOIN nt USING (doc_id) JOIN el ON el.id = rec0.source_id WHERE nt.text <> ''),
  docs2 AS (SELECT doc_id, content AS text FROM rec),
{_PIECES_SQL.replace('FROM documents', 'FROM docs2')},
pn AS (SELECT rec.source_id AS source, to_json({{'a': page, 's': section, 'k': content_kind}})::VARCHAR AS lang, doc_id, part,
  doc_id * 100000 + part AS pos,
  CASE WHEN content_kind = 'table' AND count(*) OVER (PARTITION BY doc_id) > 1 AND NOT starts_with(piece, 'Headers: H') THEN 'Headers: H'
  || chr(10) || piece ELSE piece END AS piece,
  count(*) OVER (PARTITION BY doc_id) > 1 AS alone, row_number() OVER (PARTITION BY rec.source_id ORDER BY doc_id, part) AS i FROM pieces
  JOIN rec USING (doc_id)),
{_GREEDY_SQL[_GREEDY_SQL.index('gr AS'):]},
ch0 AS (SELECT gr.source AS source_id, gr.first, string_agg(pn.piece, chr(10) || chr(10) ORDER BY gr.pos) AS content, min(gr.pos) AS p1,
  max(gr.pos) AS p2, bool_or(pn.alone) AS alone
  FROM gr JOIN pn ON pn.source = gr.source AND pn.i = gr.i GROUP BY 1, 2),
ch1 AS (SELECT ch0.*, rec.page, rec.section, rec.content_kind, 'o' || CASE WHEN alone THEN p1::VARCHAR WHEN p1 = p2 THEN (p1 // 100000)::VARCHAR
  ELSE (p1 // 100000) || '-' || (p2 // 100000) END
  || ':p' || page || '-' || page || CASE WHEN section IS NULL THEN '' ELSE ':section-' || section END AS loc FROM ch0
  JOIN rec ON rec.doc_id = p1 // 100000),
ch2 AS (SELECT *, sha256('{{"content":' || to_json(content) || ',"metadata":{{"source_id":"' || source_id || '","locator":"' || loc || '","page":'
  || page || CASE WHEN section IS NULL THEN '' ELSE ',"section":"' || section || '"' END
  || ',"table_headers":' || CASE WHEN content_kind = 'table' THEN '["H"]' ELSE '[]' END || '}}}}') AS chunk_hash, trim(regexp_replace(lower(loc),
  '[^a-z0-9]+', '-', 'g'), '-') AS locator FROM ch1),
chunks2 AS (SELECT ch2.source_id || '-' || locator || '-' || chunk_hash[1:24] AS id, ch2.*, concat_ws(chr(10), 'Document: ' || el.title,
  'Document type: ' || el.document_type, 'Tax type: vat', 'Tax year: ' || el.tax_year,
  'Section: ' || CASE WHEN (p1 // 100000) % 2 = 0 THEN 'A: B' ELSE section END, 'Form: ' || el.form_code, '', ch2.content) AS embedding_text
  FROM ch2 JOIN el ON el.id = ch2.source_id)"""


@register(f"""WITH RECURSIVE {_BUILD_SQL} SELECT id, source_id, locator, chunk_hash, page, page AS page_end, 'w1' AS workflow_id,
  length(content) AS n_chars, sha256(embedding_text) AS embedding_sha FROM chunks2""")
def chunk_build(spark, d):
    """Records to chunks: normalised, split, merged, placed, hashed and joined with their sources."""
    sources, records = _corpus(spark, d)
    out = chunking.build_chunks(corpus.normalize_records(records), corpus.eligible(sources))
    return out.select("id", "source_id", "locator", "chunk_hash", "page", "page_end", "workflow_id",
        F.length("content").cast("bigint").alias("n_chars"), F.sha2("embedding_text", 256).alias("embedding_sha"))


#: What an audit finds: warnings of records, chunks without a place (none: all have pages) and one given issue, twice.
_AUDIT_SQL = f"""{_BUILD_SQL}, iss AS (SELECT source_id, record_id, 'TABLE_LAYOUT_LOSS' AS code, 'warning' AS severity FROM rec WHERE doc_id % 5 = 0
  UNION ALL SELECT id, NULL, 'OCR_REQUIRED', 'error' FROM el WHERE tax_year IS NOT NULL)"""


def _built(spark: SparkSession, d: str) -> corpus.Build:
    sources, records = _corpus(spark, d)
    scans = corpus.issue_rows(corpus.eligible(sources).where("tax_year is not null").select("id", F.lit("OCR_REQUIRED").alias("code"),
        F.lit("error").alias("severity")), F.col("id"))
    return corpus.build(sources, records, extraction_issues=scans.unionByName(scans))


@register(f"""WITH RECURSIVE {_AUDIT_SQL} SELECT (SELECT count(*) FROM el) AS source_count, (SELECT count(*) FROM rec) AS extraction_record_count,
  count(*) AS chunk_count,
sum((length(embedding_text) + 3) // 4)::BIGINT AS embedding_tokens, (SELECT count(*) FROM iss WHERE severity = 'error') AS error_count,
  (SELECT count(*) FROM iss WHERE severity = 'warning') AS warning_count FROM chunks2""")
def corpus_audit(spark, d):
    return corpus.totals(_built(spark, d))


@register(f"""WITH RECURSIVE {_AUDIT_SQL}, r AS (SELECT source_id, count(*) AS n, count(*) FILTER (extraction_method = 'pdf_ocr') AS o FROM rec
  GROUP BY 1), c AS (SELECT source_id, count(*) AS n FROM chunks2 GROUP BY 1),
i AS (SELECT source_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM iss GROUP BY 1)
SELECT el.id AS source_id, coalesce(r.n, 0) AS extraction_record_count, coalesce(c.n, 0) AS chunk_count, coalesce(e, 0) AS error_count,
  coalesce(w, 0) AS warning_count,
concat_ws(',', CASE WHEN o > 0 THEN 'pdf_ocr:' || o END, CASE WHEN r.n > o THEN 'pdf_text:' || (r.n - o) END) AS methods
FROM el LEFT JOIN r ON r.source_id = el.id LEFT JOIN c ON c.source_id = el.id LEFT JOIN i ON i.source_id = el.id""")
def corpus_source_report(spark, d):
    entries = F.transform(F.array_sort(F.map_entries("extraction_methods")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    out = corpus.source_report(_built(spark, d)).withColumn("methods", F.array_join(entries, ","))
    return out.drop("extraction_methods")


@register(f"""WITH s AS ({_SOURCES}) SELECT id, 'UNKNOWN_SOURCE' AS kind FROM (SELECT unnest(['src1', 'nowhere', 'lost']) AS id)
  WHERE id NOT IN (SELECT id FROM s)
UNION ALL SELECT id, 'eligible' FROM s WHERE review_status = 'approved' AND status <> 'excluded' AND id IN ('src1', 'src2', 'src3', 'src4',
  'src5') UNION ALL SELECT id, 'approved' FROM s WHERE review_status = 'approved' AND status <> 'excluded'""")
def source_selection(spark, d):
    sources, _ = _corpus(spark, d)
    of = lambda df, kind: df.select("id", F.lit(kind).alias("kind"))
    return of(corpus.unknown_ids(sources, ["src1", "nowhere", "lost", "lost"]), "UNKNOWN_SOURCE").unionByName(
        of(corpus.eligible(sources, ["src1", "src2", "src3", "src4", "src5"]), "eligible")).unionByName(of(corpus.approved_ids(sources), "approved"))


_MEDIA = """SELECT doc_id AS id, CASE WHEN lang = 'en' AND n_chars < 3000 THEN 'application/pdf' WHEN lang IN ('en', 'fr') THEN 'text/html' WHEN lang = 'es' THEN 'x/y' END AS media_type, text
  FROM documents"""


@register(f"""WITH m AS ({_MEDIA}) SELECT id::VARCHAR AS id, CASE WHEN media_type = 'application/pdf' THEN 'pdf_text'
  WHEN media_type = 'text/html' THEN 'html' ELSE 'EXTRACTION_FAILED' END AS what FROM m""")
def media_dispatch(spark, d):
    none = spark.createDataFrame([], "source_id string, record_id string, code string, severity string, message string")
    read = lambda method: lambda s: (s.select(F.col("id").cast("string").alias("source_id"), F.lit(method).alias("extraction_method")),
        none)
    records, issues = corpus.dispatch(made(spark, d, _MEDIA), {"application/pdf": read("pdf_text"), "text/html": read("html")})
    return records.select(F.col("source_id").alias("id"),
        F.col("extraction_method").alias("what")).unionByName(issues.select(F.col("source_id").alias("id"), F.col("code").alias("what")))


@register("""WITH a AS (SELECT doc_id, n_chars % 6 AS m FROM documents), l AS (SELECT doc_id, 'A' AS code, 1 AS list FROM a WHERE m < 3
  UNION ALL SELECT doc_id, 'A', 2 FROM a WHERE m < 4 UNION ALL SELECT doc_id, 'B', 2 FROM a WHERE m = 5)
SELECT doc_id::VARCHAR AS source_id, code, CASE WHEN min(list) = 1 THEN 'error' ELSE 'warning' END AS severity FROM l GROUP BY doc_id, code""")
def issue_merge(spark, d):
    """Two lists of issues; what both have, even twice, counts once, as in the first list."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 6).alias("m"))
    of = lambda cond, code, sev: corpus.issue_rows(docs.where(cond).select("doc_id", F.lit(code).alias("code"), F.lit(sev).alias("severity")),
        F.col("doc_id"))
    first = of("m < 3", "A", "error")
    return corpus.merge_issues(first.unionByName(first), of("m < 4", "A", "warning").unionByName(of("m = 5", "B", "warning"))).select("source_id",
        "code", "severity")


@register("""WITH c AS (SELECT d.doc_id, coalesce(text, '') AS t, e.vec_id IS NOT NULL AND e.vec_id % 3 > 0 AS hit FROM documents d LEFT
  JOIN embeddings e ON e.vec_id = d.doc_id),
h AS (SELECT t, bool_or(hit) AS hit FROM c GROUP BY t) SELECT count(*) AS chunk_count, sum(length(c.t))::BIGINT AS estimated_characters,
  sum((length(c.t) + 3) // 4)::BIGINT AS estimated_tokens,
count(*) FILTER (h.hit) AS cache_hits, count(*) FILTER (NOT h.hit) AS cache_misses FROM c JOIN h USING (t)""")
def upload_estimate(spark, d):
    """A dry run; every third cached vector is of another model, and equal texts share one hash."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("embedding_text"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    cache = docs.join(vectors, "doc_id").select(F.when(F.col("doc_id") % 3 == 0, "old").otherwise("m").alias("model"), F.lit(64).alias("dimensions"),
        F.sha2("embedding_text", 256).alias("content_hash"), "vector")
    return corpus.estimate(docs, cache, "m", 64)


@register("""SELECT count(*) AS source_count, count(*) FILTER (value > 50) AS downloaded_count, count(*) FILTER (value <= 20) AS failed_count
  FROM events""")
def download_summary(spark, d):
    status = F.when(F.col("value") > 50, "downloaded").when(F.col("value") <= 20, "failed").otherwise("skipped")
    return corpus.download_counts(table(spark, d, "events").withColumn("status", status))


@register("SELECT sha256(text) AS sha256, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def duplicate_hashes(spark, d):
    return corpus.duplicate_groups(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id")


@register("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS batch FROM documents")
def embedding_batches(spark, d):
    return corpus.batches(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 16)


@register("""SELECT doc_id::VARCHAR AS id, sha256(text) AS content_sha, lang AS content_type, (n_chars % 9)::INT AS page, 34 AS n_fields
  FROM documents""")
def index_rows(spark, d):
    """Chunks in the columns of the index schema, with attributes as metadata of its fields."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("content_type"),
        (F.col("n_chars") % 9).alias("page"))
    out = corpus.index_rows(rows, 64)
    return out.select("id", F.sha2("content", 256).alias("content_sha"), "content_type", "page", F.lit(len(out.columns)).alias("n_fields"))


# registry, urls, pages

@register(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)',
  1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
s AS (SELECT *, trim(path, '/') AS pt, coalesce((SELECT string_agg(replace(kv, '=', '-'), '-' ORDER BY i) FROM (SELECT unnest(string_split(q,
  '&')) AS kv, generate_subscripts(string_split(q, '&'), 1) AS i) WHERE kv LIKE '%=_%'), '') AS qs FROM p)
SELECT page_id, lower(trim(regexp_replace(host || '-' || replace(CASE WHEN pt = '' THEN 'index' ELSE pt END, '/', '-') || CASE WHEN qs = ''
  THEN '' ELSE '-' || qs END, '[^A-Za-z0-9._-]+', '-', 'g'), '-.'))[1:150] || '-' || sha256(url)[1:10] AS stem,
CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.csv' ELSE '.bin' END AS extension, (url LIKE 'https://%'
  AND (lower(host) = 'example.com' OR lower(host) LIKE '%.example.com')) AS official FROM s""")
def url_files(spark, d):
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Text/HTML; charset=utf-8' WHEN 2 THEN 'text/csv' END")
    return table(spark, d, "pages").select("page_id", urls.safe_stem(F.col("url")).alias("stem"),
        urls.extension(F.col("url"), kind).alias("extension"), urls.official(F.col("url"), "example.com").alias("official"))


@register(r"""WITH l AS (SELECT page_id, url AS source, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html,
  '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html,
  '<a href="([^"]*)">([^<]*)</a>'), 1) AS i FROM pages),
u AS (SELECT page_id, source, i, replace(replace(replace(replace(label, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS label,
  CASE WHEN href LIKE 'http%' THEN href ELSE origin || href END AS url, origin FROM l WHERE href LIKE '/%' OR href LIKE 'http%'),
k AS (SELECT *, row_number() OVER (PARTITION BY label, url ORDER BY source, i) AS n FROM u WHERE regexp_extract(url, '^(https?://[^/?#]*)',
  1) = origin)
SELECT source, label, url FROM k WHERE n = 1""")
def page_links(spark, d):
    return html.page_links(table(spark, d, "pages")).select("source", "label", "url")


_BOOK = "application/vnd.ms-excel.sheet.macroEnabled.12"


@register(r"""WITH f AS (SELECT 'doc-' || doc_id AS id, unnest(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'PATH_ESCAPES' END, CASE
  WHEN doc_id % 4 = 0 AND doc_id % 5 > 0 THEN 'FILE_MISSING' END,
CASE WHEN doc_id % 4 = 0 AND doc_id % 5 = 0 THEN 'EXCLUDED_WITHOUT_FILE' END, CASE WHEN doc_id % 4 > 0 AND doc_id % 7 = 0
  THEN 'CHECKSUM_MISMATCH' END, CASE WHEN doc_id % 4 > 0 AND doc_id % 11 = 0 THEN 'SIGNATURE_MISMATCH' END,
CASE WHEN doc_id % 4 > 0 AND doc_id % 11 = 0 THEN 'WORKBOOK_IS_HTML' END, CASE WHEN doc_id % 4 > 0 AND doc_id % 13 = 0
  THEN 'RENDER_PAGE_OUTSIDE' END], lambda x: x IS NOT NULL)) AS code FROM documents)
SELECT id, code, CASE WHEN code = 'EXCLUDED_WITHOUT_FILE' THEN 'warning' ELSE 'error' END AS severity FROM f UNION ALL
SELECT 'doc-' || doc_id, 'HASH_REPEATED', 'warning' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def registry_file_checks(spark, d):
    """Registry rows against their files: a third of the paths climb out of the folder, a quarter of the files are missing."""
    c = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        c, F.concat(F.lit("doc-"), c).alias("id"), F.concat(F.when(c % 3 == 0, "a/../../f").otherwise("a/../f"), c).alias("local_file"),
            F.when(c % 5 == 0, "excluded").otherwise("current").alias("status"),
        F.sha2("text", 256).alias("sha256"), F.when(c % 11 == 0, _BOOK).otherwise("text/html").alias("media_type"),
            F.array(F.lit(1), F.lit(5)).alias("render_pages"))
    files = rows.where("doc_id % 4 > 0").select("local_file", F.when(c % 7 == 0, "x").otherwise(F.col("sha256")).alias("file_sha256"),
        F.lit("html").alias("signature"), F.when(c % 13 == 0, 4).otherwise(9).alias("page_count"))
    return constraints.file_issues(rows.drop("doc_id"), files)


@register(r"""SELECT doc_id, 'img-' || CASE WHEN doc_id % 2 = 0 THEN 'a-b' ELSE 'c' END AS image_slug, 'my-file-' || doc_id AS source_id, CASE
  WHEN lang IS NULL OR lang = '' THEN NULL WHEN doc_id % 3 = 0 THEN '2024-01-02T00:00:00Z' ELSE '2024-01-02T03:04' END AS at,
sha256(source || ':' || doc_id || ':' || text)[1:24] AS digest, length(regexp_replace(text, '[\s\x85\xa0]', '', 'g')) AS visible FROM documents""")
def text_ids(spark, d):
    """Slugs, ids of files and contents, dates and visible lengths."""
    docs = table(spark, d, "documents")
    title = F.when(F.col("doc_id") % 2 == 0, "Img  A/B").otherwise("IMG: c!")
    at = F.when(F.col("lang").isNull() | (F.col("lang") == ""), F.lit(None)).when(F.col("doc_id") % 3 == 0,
        "2024-01-02").otherwise("2024-01-02T03:04")
    stable = T.stable_id(F.col("source"), F.col("doc_id").cast("string"), F.col("text"))
    return docs.select("doc_id", T.slug(title).alias("image_slug"), urls.source_id_of(F.concat(F.lit("d/My File "), "doc_id",
        F.lit(".pdf"))).alias("source_id"), corpus.iso_time(at).alias("at"),
                       F.element_at(F.split(stable, "-"), -1).alias("digest"), T.visible_length(F.col("text")).alias("visible"))


@register(r"""WITH x AS (SELECT doc_id, regexp_replace(nfc_normalize(replace(text, chr(173), '')), '\r\n|\r', chr(10), 'g') AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '[^\S\n]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^\s+|\s+$', '', 'g')) AS page_sha FROM x""")
def page_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.page_text(F.col("text")), 256).alias("page_sha"))
