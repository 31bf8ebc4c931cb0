"""Constraint catalogues of the record contracts, and rules that span records, as rows of issues.

A catalogue is code -> (severity, column that is true where a row fails); `sync.issues` turns it into rows in one
pass without a shuffle. Rules over more than one record are aggregations by key or semi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import checks as K
from corpusloom.functions import vocab
from corpusloom.functions.urls import escapes
from corpusloom.operators.sync import issues

Catalogue = dict[str, tuple[str, Column]]


def _errors(**failing: Column) -> Catalogue:
    return {code: ("error", c) for code, c in failing.items()}


def source_checks(ranks: dict[str, int] | None = None) -> Catalogue:
    """Of registry rows: texts, ids, urls, hash, period, related ids, pages, rank, dates, exclusion."""
    c = F.col
    related = F.concat(F.coalesce("supersedes", F.array()), F.coalesce("superseded_by", F.array()))
    return _errors(
        ID_NOT_SLUG=K.unlike(c("id"), K.SLUG), TITLE_EMPTY=K.blank(c("title")), LOCAL_FILE_EMPTY=K.blank(c("local_file")),
        SOURCE_URL_NOT_HTTPS=K.not_https(c("source_url")), FINAL_URL_NOT_HTTPS=K.not_https(c("final_url"), needed=False),
        HASH_INVALID=K.unlike(c("sha256"), K.SHA256), PERIOD_INVALID=K.unlike_if_any(c("tax_year"), K.PERIOD),
        RELATED_ID_NOT_SLUG=K.any_unlike(related, K.SLUG), RENDER_PAGES_REPEATED=K.repeats(c("render_pages")),
        RENDER_PAGE_NOT_POSITIVE=K.sure(F.exists("render_pages", lambda p: p < 1)),
        RANK_MISMATCH=c("authority_rank").isNull() | c("authority_level").isNull() | K.rank_differs(c("authority_level"), c("authority_rank"),
            ranks or vocab.AUTHORITY_RANKS),
        DATES_REVERSED=K.before(c("effective_to"), c("effective_from")), SUPERSEDES_ITSELF=K.sure(F.array_contains(related, c("id"))),
        EXCLUSION_REASON_MISSING=K.sure(c("status") == "excluded") & K.blank(c("exclusion_reason")),
    )


def extraction_checks() -> Catalogue:
    """Of extraction records: texts, hash, and the locator that the method needs."""
    c = F.col
    return _errors(
        RECORD_ID_EMPTY=K.blank(c("record_id")), SOURCE_ID_NOT_SLUG=K.unlike(c("source_id"), K.SLUG), CONTENT_EMPTY=K.blank(c("content")),
        TITLE_PATH_BLANK=K.any_blank(c("title_path")), TABLE_HEADERS_BLANK=K.any_blank(c("table_headers")),
            HASH_INVALID=K.unlike(c("content_hash"), K.SHA256),
        PDF_WITHOUT_PAGE=K.sure(c("extraction_method").isin("pdf_text", "pdf_ocr")) & c("page").isNull(),
        WORKBOOK_WITHOUT_SHEET=K.sure(c("extraction_method") == "xlsm_xml") & K.blank(c("sheet")), **_locator(),
    )


def _locator() -> dict[str, Column]:
    page, end = F.col("page"), F.col("page_end")
    return {"PAGE_END_WITHOUT_PAGE": end.isNotNull() & page.isNull(), "PAGES_REVERSED": K.before(end, page)}


def chunk_checks(ranks: dict[str, int] | None = None) -> Catalogue:
    """Of chunks: texts, ids, url, period, related ids, locator, rank, dates; a chunk without a place gets a warning."""
    c = F.col
    place = F.coalesce("page", F.lit(None)).isNull() & K.blank(c("section")) & K.blank(c("sheet"))
    return _errors(
        ID_EMPTY=K.blank(c("id")), SOURCE_ID_NOT_SLUG=K.unlike(c("source_id"), K.SLUG), CONTENT_EMPTY=K.blank(c("content")),
            TITLE_EMPTY=K.blank(c("title")),
        EMBEDDING_TEXT_EMPTY=K.blank(c("embedding_text")), SOURCE_URL_NOT_HTTPS=K.not_https(c("source_url"), needed=False),
        PERIOD_INVALID=K.unlike_if_any(c("tax_year"), K.PERIOD), RELATED_ID_NOT_SLUG=K.any_unlike(c("supersedes"), K.SLUG),
        RANK_MISMATCH=K.rank_differs(c("authority_level"), c("authority_rank"), ranks or vocab.AUTHORITY_RANKS),
        DATES_REVERSED=K.before(c("effective_to"), c("effective_from")), HASH_MISSING=K.blank(c("content_hash")),
        SHEET_RANGE_INCOMPLETE=K.blank(c("sheet")) != K.blank(c("cell_range")), **_locator(),
    ) | {"URL_MISSING": ("warning", c("source_url").isNull()), "LOCATOR_MISSING": ("warning", place)}


def image_checks(base_url: str | None = None) -> Catalogue:
    """Of guide images: ids, alt text, page, dates; approved ones need a public url, below `base_url` if given."""
    c = F.col
    approved = K.sure(c("review_status") == "approved")
    return _errors(
        IMAGE_ID_NOT_SLUG=K.unlike(c("image_id"), K.SLUG), SOURCE_ID_NOT_SLUG=K.unlike(c("source_id"), K.SLUG), TITLE_EMPTY=K.blank(c("title")),
        ALT_TEXT_EMPTY=K.blank(c("alt_text")), SOURCE_URL_NOT_HTTPS=K.not_https(c("source_url")), PAGE_NOT_POSITIVE=~K.sure(c("page") >= 1),
        DATES_REVERSED=K.before(c("effective_to"), c("effective_from")),
        PUBLIC_URL_INVALID=approved & ~K.public_image(c("public_url"), F.lit(base_url.rstrip("/")) if base_url else None),
    )


def image_file_checks() -> Catalogue:
    """Of approved images joined with the facts of their files (file_sha256, file_bytes, file_width, file_height, file_format)."""
    pair = lambda said, real: ~K.sure(F.col(said) == F.col(real))
    return _errors(
        IMAGE_HASH_MISMATCH=pair("binary_sha256", "file_sha256"), IMAGE_SIZE_MISMATCH=pair("byte_size", "file_bytes"),
        IMAGE_DIMENSIONS_MISMATCH=pair("width", "file_width") | pair("height", "file_height"),
            IMAGE_FORMAT_MISMATCH=~K.sure(F.col("file_format") == "webp"),
    )


def issue_checks() -> Catalogue:
    return _errors(CODE_EMPTY=K.blank(F.col("code")), MESSAGE_EMPTY=K.blank(F.col("message")),
        SEVERITY_UNKNOWN=~K.sure(F.col("severity").isin("warning", "error")))


def guide_checks(steps: Column) -> Catalogue:
    """Of guides: steps numbered 1, 2, .. and with texts."""
    return _errors(
        STEPS_NOT_NUMBERED=K.not_counted(F.transform(steps, lambda s: s["number"])),
            STEP_TITLE_EMPTY=K.sure(F.exists(steps, lambda s: K.blank(s["title"]))),
    )


def publish_settings(base_url: str | None, container: str | None, prefix: str | None, publishing: bool, secret_present: bool) -> list[str]:
    """Names of settings that are missing or malformed; values are never told."""
    import re

    bad = [] if base_url and re.fullmatch(r"https://[^/?#\s@]+(?:/[^?#\s]*)?", base_url) else ["base_url"]
    bad += [] if container and re.fullmatch(r"[a-z0-9](?:-?[a-z0-9]){2,62}", container) else ["container"]
    bad += [] if prefix is None or re.fullmatch(r"[a-z0-9][a-z0-9/_-]*", prefix) and "//" not in prefix else ["prefix"]
    return bad + (["credentials"] if publishing and not secret_present else [])


def registry_issues(sources: DataFrame, allowed_hosts: list[str], ranks: dict[str, int] | None = None) -> DataFrame:
    """(id, code, severity) of all rules of a registry: those of a row, unique ids, allowed hosts, known related ids.

    Ids are counted by key with partial aggregation; related ids meet the known ones in a left anti join.
    """
    hosts = [h.strip().lower().rstrip(".") for h in allowed_hosts]
    own = source_checks(ranks) | _errors(HOST_NOT_ALLOWED=~K.sure(K.host(F.col("source_url")).isin(hosts)))
    row = lambda df, code: df.select("id", F.lit(code).alias("code"), F.lit("error").alias("severity"))
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    named = sources.select("id", F.explode(F.array_distinct(F.concat(F.coalesce("supersedes", F.array()),
        F.coalesce("superseded_by", F.array())))).alias("other"))
    unknown = named.join(sources.select(F.col("id").alias("other")).distinct(), "other", "left_anti").select("id").distinct()
    return issues(sources, own, "id").unionByName(row(twice, "ID_REPEATED")).unionByName(row(unknown, "RELATED_ID_UNKNOWN"))


def host_issues(allowed_hosts: list[str]) -> list[str]:
    """Codes of faults in a registry's list of hosts."""
    hosts = [h.strip().lower().rstrip(".") for h in allowed_hosts]
    found = {"HOST_EMPTY": any(not h for h in hosts), "HOST_NOT_BARE": any("/" in h for h in hosts), "HOST_REPEATED": len(set(hosts)) < len(hosts)}
    return [code for code, bad in found.items() if bad]


def file_issues(sources: DataFrame, files: DataFrame, folder: str = "") -> DataFrame:
    """(id, code, severity) of registry rows against their files (local_file, file_sha256, signature, page_count).

    folder: that of the registry below the root which no path may leave; paths are relative to it. One left join by
    file; a file without a row is missing. Repeated hashes are warned of once for each source.
    """
    expected = {"application/pdf": "pdf", "text/html": "html", "application/vnd.ms-excel.sheet.macroEnabled.12": "xlsm"}
    kind = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    c = F.col
    joined = sources.join(files.select("local_file", "file_sha256", "signature", "page_count", F.lit(True).alias("_there")), "local_file", "left")
    there, out = c("_there").isNotNull(), K.sure(c("status") == "excluded")
    book = K.sure(c("media_type") == "application/vnd.ms-excel.sheet.macroEnabled.12")
    below = F.when(c("local_file").startswith("/"), c("local_file")).otherwise(F.concat(F.lit(f"{folder.strip('/')}/" if folder else ""),
        c("local_file")))
    escape = escapes(below)
    found = {
        "PATH_ESCAPES": ("error", escape), "FILE_MISSING": ("error", ~there & ~out), "EXCLUDED_WITHOUT_FILE": ("warning", ~there & out),
        "CHECKSUM_MISMATCH": ("error", there & ~K.sure(c("file_sha256") == c("sha256"))),
        "SIGNATURE_MISMATCH": ("error", there & ~K.sure(F.try_element_at(kind, c("media_type")) == c("signature"))),
        "WORKBOOK_IS_HTML": ("error", there & book & K.sure(c("signature") == "html")),
        "RENDER_PAGE_OUTSIDE": ("error", there & c("page_count").isNotNull() & K.sure(F.exists("render_pages", lambda p: p > c("page_count")))),
    }
    shared = sources.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1 AND sha256 IS NOT NULL").select("sha256")
    again = sources.join(shared, "sha256", "left_semi").select("id", F.lit("HASH_REPEATED").alias("code"), F.lit("warning").alias("severity"))
    return issues(joined, found, "id").unionByName(again)


def registry_summary(sources: DataFrame, found: DataFrame) -> DataFrame:
    """One row: counts of sources, approved, excluded, errors, warnings, and whether the registry is valid."""
    s = sources.agg(F.count("*").alias("source_count"), F.count_if(F.col("review_status") == "approved").alias("approved_count"),
        F.count_if(F.col("status") == "excluded").alias("excluded_count"))
    i = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return s.crossJoin(i).withColumn("valid", F.col("errors") == 0)  # one row each
