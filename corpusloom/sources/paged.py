"""Paged documents (PDF) from rows of page texts: headings carried over pages, OCR decisions, coverage and audits.

Reading and OCR of the files are providers' work; a row here is (source_id, page, text) and, where a page was read by
OCR, ocr_text. All is native but for the order of headings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import looks_tabular, strip, visible_length
from corpusloom.operators.ordered import ranged
from corpusloom.operators.sync import ocr_decision

#: Forms of headings, numbered lines without sentence marks, and lines in capitals.
NUMBERED = r"^(\d+(?:\.\d+){0,5})\s*[.)-]?\s+[^.!?;:]{2,160}$"
CAPITALS = r"^[A-Z][A-Z0-9][A-Z0-9 /&()'\-]{2,119}$"


def heading(line: Column) -> Column:
    """struct(title, depth) of a line that looks like a heading, else null."""
    value = strip(F.regexp_replace(line, r"(?U)\s+", " "))
    number = F.regexp_extract(value, NUMBERED, 1)
    words = F.split(value, " ")
    titled = F.size(words).between(2, 12) & value.rlike(r"(?U)[\p{L}\p{N}]$") & F.forall(words, lambda w: w.rlike(r"^(?:\p{Lu}|\p{Lt}|[^\p{L}]|$)"))
    depth = F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."))) + 1).when(value.rlike(CAPITALS) | titled, 1)
    return F.when(depth.isNotNull() & (value != "") & (F.length(value) <= 160), F.struct(value.alias("title"), depth.cast("int").alias("depth")))


#: Fixed value: headings have six levels, so that at most six are open.
LEVELS = 6


class Opened:
    """What a run of headings makes of the headings open before it, for each number of these, 0 to LEVELS: how many of them
    stay, and what follows them. A heading of depth d keeps at most d - 1 open headings, so that more than their number
    plays no part; summaries of neighbouring runs compose."""

    def __init__(self, of: list[tuple[int, list[str]]] | None = None):
        self.of = of or [(n, []) for n in range(LEVELS + 1)]

    def push(self, title: str, depth: int) -> None:
        self.of = [(min(kept, depth - 1), added[: max(0, depth - 1 - kept)] + [title]) for kept, added in self.of]

    def then(self, later: Opened) -> Opened:
        out = []
        for kept, added in self.of:
            stay, more = later.of[kept + len(added)]
            out.append((min(kept, stay), added[: max(0, stay - kept)] + more))
        return Opened(out)

    def after(self, stack: list[str]) -> list[str]:
        kept, added = self.of[len(stack)]
        return stack[:kept] + added


def heading_paths(pages: DataFrame, source: str = "source_id", page: str = "page", text: str = "text") -> DataFrame:
    """`pages`, of which (source, page) is the key, with title_path: the open headings at the end of each page.

    A heading of depth d keeps at most d - 1 open headings and follows them; what is open stays so on later pages, nulls
    first. Headings, never texts, are put in ranges of (source, page), so that a file of any number of pages is spread over tasks; each range is
    summed up (`Opened`), the driver composes these, one for each range, and each range goes on from what was open before it.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    found = F.filter(F.transform(lines, heading), lambda h: h.isNotNull())
    slim = pages.select(F.col(source).alias("source"), F.col(page).alias("page"), found.alias("hs"), F.md5(F.to_json(F.struct(source))).alias("mark"))
    rows = ranged(slim, ["source"], ["page"])

    def summed(batches):
        part = first = mark = None
        whole, opened = True, Opened()
        for batch in batches:
            for p, m, hs in zip(*[batch.column(c).to_pylist() for c in ("_part", "mark", "hs")]):
                if part is None:
                    part, first = p, m
                elif m != mark:
                    whole, opened = False, Opened()
                mark = m
                for h in hs:
                    opened.push(h["title"], h["depth"])
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": mark, "whole": whole, "kept": [k for k, _ in opened.of],
                "added": [a for _, a in opened.of]}], schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("whole", pa.bool_()), ("kept", pa.list_(pa.int32())),
        ("added", pa.list_(pa.list_(pa.string())))])
    told = rows.select("_part", "mark", "hs").mapInArrow(summed, "part int, first string, last string, whole boolean, kept array<int>, added array<array<string>>")
    entry: dict[int, list[str]] = {}
    mark, stack = None, []
    for r in sorted(told.collect(), key=lambda r: r["part"]):  # a row for each range
        entry[r["part"]] = stack if r["first"] == mark else []
        opened = Opened([(k, list(a)) for k, a in zip(r["kept"], r["added"])])
        mark, stack = r["last"], opened.after(entry[r["part"]] if r["whole"] else [])
    shared = pages.sparkSession.sparkContext.broadcast(entry)

    def opened_at(batches):
        stack, mark = None, None
        for batch in batches:
            out = []
            for p, m, hs in zip(*[batch.column(c).to_pylist() for c in ("_part", "mark", "hs")]):
                stack = (shared.value[p] if stack is None else []) if m != mark else stack
                mark = m
                for h in hs:
                    stack = stack[: h["depth"] - 1] + [h["title"]]
                out.append(stack)
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("page"), pa.array(out, pa.list_(pa.string()))], ["source", "page", "path"])

    schema = StructType([rows.schema["source"], rows.schema["page"], *StructType.fromDDL("path array<string>")])
    paths = rows.mapInArrow(opened_at, schema).select(F.col("source").alias("_source"), F.col("page").alias("_page"), F.col("path").alias("title_path"))
    same = pages[source].eqNullSafe(F.col("_source")) & pages[page].eqNullSafe(F.col("_page"))
    return pages.join(paths, same, "left").drop("_source", "_page")


def page_records(pages: DataFrame) -> DataFrame:
    """Records of pages (source_id, page, text, ocr_text) that have text; the decision says which text was taken."""
    decided = pages.withColumn("decision", ocr_decision(F.col("text"), F.col("ocr_text")))
    taken = decided.withColumn("content", F.when(F.col("decision") == "OCR_USED", F.col("ocr_text")).otherwise(F.coalesce("text", F.lit(""))))
    paths = heading_paths(taken.withColumn("content", strip(F.col("content"))), text="content")
    code = F.when(F.col("decision").isin("OCR_USED", "OCR_WEAKER_THAN_NATIVE"), F.col("decision"))
    loss = F.when(looks_tabular(F.col("content")), F.lit("TABLE_LAYOUT_LOSS"))
    digest = F.sha2("content", 256)
    return paths.where("decision <> 'EMPTY_PAGE'").select(
        "source_id", "page", F.concat(F.col("source_id"), F.lit("-p"), F.col("page").cast("string"), F.lit("-"),
            F.substring(digest, 1, 16)).alias("record_id"),
        F.lit("page").alias("content_kind"), "title_path", F.get("title_path", F.size("title_path") - 1).alias("section"),
        "content", F.when(F.col("decision") == "OCR_USED", "pdf_ocr").otherwise("pdf_text").alias("extraction_method"),
        F.filter(F.array(code, loss), lambda x: x.isNotNull()).alias("warnings"), digest.alias("content_hash"),
    )


def audit(pages: DataFrame) -> DataFrame:
    """Per file: pages, pages with more than 20 characters, characters. One partial aggregation."""
    n = F.length(F.coalesce("text", F.lit("")))
    return pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(n > 20).alias("pages_with_text"),
        F.sum(n.cast("bigint")).alias("chars"))


def ocr_required(counts: DataFrame, records: DataFrame) -> DataFrame:
    """(source_id, page) of pages 1..page_count without a record of 80 visible characters, where OCR was off."""
    pages = counts.where("page_count >= 1").select("source_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    good = records.where(visible_length(F.col("content")) >= 80).select("source_id", F.col("page").cast("int").alias("page"))
    return pages.join(good, ["source_id", "page"], "left_anti")


def render_candidates(sources: DataFrame) -> DataFrame:
    """(source_id, page) to render: selected pages of approved PDFs that are not excluded, each once."""
    chosen = sources.where("review_status = 'approved' AND status <> 'excluded' AND media_type = 'application/pdf'")
    return chosen.select(F.col("id").alias("source_id"), F.explode(F.array_distinct("render_pages")).alias("page")).where("page >= 1")
