"""Macro workbooks as rows: one row a file parsed on the executors, then cells, regions and named ranges as DataFrames.

`parse` reads each archive once, within fixed size limits, and only with the standard library: macros and external
links are never opened, formulas stay text. All that follows (row regions, headings, records) is planned from the
cells with native expressions; every window and group is within one sheet, whose size the archive limits bound.
Where both regions and named ranges are wanted, write the parsed rows first, or archives are read twice.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import slug
from corpusloom.operators.ranges import cells_in_ranges

MAX_TOTAL, MAX_MEMBER, MAX_MEMBERS, MAX_RANGE = 100 << 20, 25 << 20, 10_000, 20_000
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "xl/workbook.xml")
_CELL = "sheet string, sheet_no int, row int, col int, value string, comment string, validation string, partial boolean, format string"
_NAME = "name string, sheet string, sheet_no int, row1 int, col1 int, row2 int, col2 int"
PARSED = f"source_id string, error string, hidden boolean, loose_sheets array<string>, cells array<struct<{_CELL.replace(' ', ':').replace(',:', ',')}>>, names array<struct<{_NAME.replace(' ', ':').replace(',:', ',')}>>"
_SHAPES = ("yy", "dd", "%", "$", "£", "€", "#,##0")
#: Number formats that the file format defines by number; those from 14 to 22 and 45 to 47 are dates or times.
_FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_ADDRESS = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?")


class Rejected(ValueError):
    """An archive that is not read; the argument is the issue code."""


#: A page in place of a file, as `registry.signature` tells it.
_PAGE = re.compile(rb"[ \t\n\r\x0b\x0c]*<(?:!doctype|html|\?xml|head|body)", re.I)


def opened(data: bytes | None) -> zipfile.ZipFile:
    """The archive, after all checks of its directory; raises Rejected."""
    if not data or not data.startswith((b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")):
        raise Rejected("WORKBOOK_IS_HTML" if data and _PAGE.match(data) else "WORKBOOK_NO_ZIP_SIGNATURE")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise Rejected("WORKBOOK_BAD_ZIP") from e
    infos = archive.infolist()
    names = {i.filename for i in infos}
    unsafe = any(not n or "\0" in n or "\\" in n or PurePosixPath(n).is_absolute() or ".." in PurePosixPath(n).parts for n in names)
    for bad, code in (
        (len(infos) > MAX_MEMBERS, "WORKBOOK_TOO_MANY_MEMBERS"),
        (unsafe, "WORKBOOK_UNSAFE_MEMBER"),
        (any(i.file_size > MAX_MEMBER for i in infos), "WORKBOOK_MEMBER_TOO_LARGE"),
        (sum(i.file_size for i in infos) > MAX_TOTAL, "WORKBOOK_TOO_LARGE"),
        (len(names) < len(infos), "WORKBOOK_DUPLICATE_MEMBERS"),
        (not names.issuperset(REQUIRED), "WORKBOOK_MISSING_MEMBERS"),
        (not any(n.startswith("xl/worksheets/") for n in names), "WORKBOOK_NO_SHEETS"),
    ):
        if bad:
            raise Rejected(code)
    return archive


def _xml(archive: zipfile.ZipFile, name: str):
    """Root of a member without namespaces, or None; entities are refused before parsing."""
    try:
        raw = archive.read(name)
    except KeyError:
        return None
    except (zipfile.BadZipFile, OSError, RuntimeError, ValueError) as e:
        raise Rejected("WORKBOOK_BAD_ZIP") from e
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw or b"\0" in raw[:64]:
        raise Rejected("WORKBOOK_UNSAFE_XML")
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise Rejected("WORKBOOK_UNSAFE_XML") from e
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
        node.attrib = {k.rpartition("}")[2]: v for k, v in node.attrib.items()}
    return root


def _text(value: str | None) -> str:
    out = value or ""
    for token, plain in (("_x000a_", "\n"), ("_x000d_", "\n"), ("_x0009_", "\t"), ("\r\n", "\n"), ("\r", "\n")):
        out = out.replace(token, plain)
    return out.strip()


def _runs(node) -> str:
    """Text of a rich string without its phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in ("t", "r") for t in part.iter("t"))


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def area(address: str) -> tuple[int, int, int, int] | None:
    """(row1, col1, row2, col2) of `A1` or `A1:B2`; None for anything else."""
    if not (m := _ADDRESS.fullmatch(address.strip())):
        return None
    c1, r1 = column_number(m[1]), int(m[2])
    c2, r2 = (column_number(m[3]), int(m[4])) if m[3] else (c1, r1)
    return (r1, c1, r2, c2) if 1 <= r1 <= r2 and 1 <= c1 <= c2 else None


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id -> (kind, member) of a part, external targets left out."""
    folder, _, name = part.rpartition("/")
    root = _xml(archive, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in root.iter("Relationship") if root is not None else ():
        if r.get("TargetMode") != "External":
            steps: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
            for step in r.get("Target", "").strip("/").split("/"):
                steps = steps[:-1] if step == ".." else [*steps, step]
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], "/".join(steps))
    return out


def _formats(archive: zipfile.ZipFile) -> list[str]:
    """Number format of each cell style."""
    root = _xml(archive, "xl/styles.xml")
    if root is None:
        return []
    own = {n.get("numFmtId"): n.get("formatCode", "") for n in root.iter("numFmt")}
    return [own.get(x.get("numFmtId", "0"), _FORMATS.get(int(x.get("numFmtId", "0") or 0),
        "General")) for xs in root.iter("cellXfs") for x in xs.iter("xf")]


def _number(raw: str, fmt: str, base: datetime) -> str:
    """A number as it is, or in ISO form where its format is one of a date or time."""
    try:
        n = float(raw)
    except ValueError:
        return raw
    bare = re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.', "", fmt.lower())
    if fmt != "General" and re.search(r"[ymdhs]", bare) and "e+" not in bare and 0 <= n < 2958466:
        at = base + timedelta(seconds=round((n + (base.year < 1904 and n < 60)) * 86400))
        return at.time().isoformat() if n < 1 else at.isoformat()
    return str(int(n)) if n.is_integer() and re.fullmatch(r"-?\d+", raw) else repr(n)


def _rule(v) -> tuple[str, bool]:
    """Text of a validation rule, and whether a part of it is not spelled out."""
    out = [f"{label}: {_text(v.get(key))}" for key, label in (("promptTitle", "Prompt title"), ("prompt", "Prompt"), ("errorTitle", "Error title"),
        ("error", "Error")) if v.get(key)]
    formula = (v.findtext("formula1") or "").strip()
    listed = [x.strip() for x in formula[1:-1].split(",") if x.strip()] if len(formula) > 1 and formula[0] == formula[-1] == '"' else []
    if listed:
        out.append("Allowed values: " + ", ".join(listed))
    return "; ".join(out), not listed and v.get("type") is not None


def _rules(root, last_row: int, last_col: int):
    """Texts of the validation rules by cell, cells with a partial one, and whether a range was not spelled out."""
    texts: dict[tuple[int, int], list[str]] = {}
    partial: set[tuple[int, int]] = set()
    loose = False
    for v in root.iter("dataValidation"):
        (said, part), room = _rule(v), MAX_RANGE
        for address in v.get("sqref", "").split():
            whole = re.fullmatch(r"\$?([A-Za-z]{1,3}):\$?([A-Za-z]{1,3})", address)
            box = (1, column_number(whole[1]), last_row, column_number(whole[2])) if whole else area(address)
            if box is None:
                loose = True
                continue
            r1, c1, r2, c2 = box
            for r in range(r1, min(r2, max(last_row, r1)) + 1):
                for c in range(c1, min(c2, max(last_col, c1)) + 1):
                    if room == 0:
                        loose = True
                        break
                    room -= 1
                    texts.setdefault((r, c), []).extend([said] if said else [])
                    if part:
                        partial.add((r, c))
                if room == 0 and loose:
                    break
    return texts, partial, loose


def _sheet_cells(archive, member: str, sheet: str, no: int, strings: list[str], formats: list[str], base: datetime):
    """(cells, loose) of one visible sheet: cells with a value, a comment or a validation; covered merged cells left out."""
    root = _xml(archive, member)
    if root is None:
        return [], False
    values: dict[tuple[int, int], tuple[str, str]] = {}
    row = 0
    for line in root.iter("row"):
        row, col = int(line.get("r") or row + 1), 0
        for c in line.iter("c"):
            at = area(c.get("r", ""))
            col = at[1] if at else col + 1
            style = int(c.get("s") or 0)
            fmt = formats[style] if style < len(formats) else "General"
            kind, raw, formula = c.get("t", "n"), c.findtext("v"), c.find("f")
            if formula is not None:
                value = "=" + (formula.text or "")
            elif kind == "inlineStr":
                value = "".join(_runs(s) for s in c.iter("is"))
            elif raw is None:
                value = ""
            elif kind == "s":
                value = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
            elif kind == "b":
                value = "TRUE" if raw == "1" else "FALSE"
            else:
                value = _number(raw, fmt, base) if kind == "n" else raw
            values[row, col] = (_text(value), fmt)
    comments: dict[tuple[int, int], str] = {}
    for kind, part in _relations(archive, member).values():
        notes = _xml(archive, part) if kind == "comments" else None
        for n in notes.iter("comment") if notes is not None else ():
            if at := area(n.get("ref", "")):
                comments[at[:2]] = _text("".join(_runs(t) for t in n.iter("text")))
    last = (max((r for r, _ in values), default=1), max((c for _, c in values), default=1))
    texts, partial, loose = _rules(root, *last)
    covered = set()
    for m in root.iter("mergeCell"):
        if (box := area(m.get("ref", ""))) and (box[2] - box[0] + 1) * (box[3] - box[1] + 1) <= 10 * MAX_RANGE:
            covered |= {(r, c) for r in range(box[0], box[2] + 1) for c in range(box[1], box[3] + 1)} - {box[:2]}
    kept = {at for at, (v, _) in values.items() if v} | set(comments) | set(texts)
    cells = []
    for at in sorted(kept - (covered - set(texts))):
        value, fmt = values.get(at, ("", "General"))
        cells.append((sheet, no, *at, value, comments.get(at, ""), "; ".join(texts.get(at, [])), at in partial, fmt))
    return cells, loose


def _names(book, sheets: dict[str, int]) -> list[tuple]:
    """Finite named ranges of visible sheets of this workbook, each once, in the order of the file."""
    out: dict[tuple, None] = {}
    for n in book.iter("definedName"):
        name, target = _text(n.get("name")), _text(n.text)
        if not name or name.lower().startswith("_xlnm.") or n.get("localSheetId") or re.search(r"[\[\]]|https?:", target):
            continue
        for sheet, quoted, address in re.findall(r"(?:^|,)(?:([^'!,]+)|'((?:[^']|'')+)')!([^,!]+)", target):
            title = sheet or quoted.replace("''", "'")
            box = area(address)
            if title in sheets and box and (box[2] - box[0] + 1) * (box[3] - box[1] + 1) <= MAX_RANGE:
                out[name, title, sheets[title], *box] = None
    return list(out)


def read(data: bytes | None) -> tuple:
    """(error, hidden, loose_sheets, cells, names) of one workbook; an error code instead of an exception."""
    try:
        archive = opened(data)
        for member in REQUIRED:
            _xml(archive, member)
        book, links = _xml(archive, REQUIRED[2]), _relations(archive, REQUIRED[2])
        shared = _xml(archive, "xl/sharedStrings.xml")
        strings = [_runs(s) for s in shared.iter("si")] if shared is not None else []
        formats = _formats(archive)
        base = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter("workbookPr")) else datetime(1899, 12, 30)
        cells, loose, visible, hidden = [], [], {}, False
        for no, s in enumerate(book.iter("sheet"), 1):
            title = s.get("name", "")
            if s.get("state", "visible") != "visible":
                hidden = True
                continue
            visible[title] = no
            got, is_loose = _sheet_cells(archive, links.get(s.get("id", ""), ("", ""))[1], title, no, strings, formats, base)
            cells += got
            loose += [title] if is_loose else []
        return None, hidden, loose, cells, _names(book, visible)
    except Rejected as e:
        return str(e), False, [], [], []
    except (ValueError, KeyError, TypeError, OverflowError):
        return "WORKBOOK_UNREADABLE", False, [], [], []


def parse(files: DataFrame, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """One row for each file (source_id, error, hidden, loose_sheets, cells, names); null content is an error row.

    Results leave one file at a time. What comes in is an Arrow batch: spark.sql.execution.arrow.maxBytesPerBatch bounds
    its bytes, and should be some tens of MB where files are large.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, data in zip(batch["source_id"], batch["content"]):
                yield pd.DataFrame([(sid, *read(data))], columns=["source_id", "error", "hidden", "loose_sheets", "cells", "names"])

    return files.select(F.col(source_id).cast("string").alias("source_id"), F.col(content).alias("content")).mapInPandas(run, PARSED)


def scan_files(spark, path: str, pattern: str = "*.xlsm") -> DataFrame:
    """Workbooks under a folder as (source_id, path, content): the id is the slug of the file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(slug(stem, 100).alias("source_id"), "path", "content")


def letters(col: Column) -> Column:
    """Column letters of a number from 1 to 18,278."""
    n = lambda x: F.char(F.lit(65) + x.cast("int"))
    z = col - 1
    two, three = F.floor(z / 26) - 1, F.floor((F.floor(z / 26) - 1) / 26) - 1
    return F.concat(F.when(z >= 702, n(three)).otherwise(""), F.when(z >= 26, n(F.pmod(two, F.lit(26)))).otherwise(""), n(F.pmod(z, F.lit(26))))


def display(value: Column, comment: Column, validation: Column, fmt: Column) -> Column:
    """Text of a cell: its value or what stands for a blank one, comment, validation, and a format that tells a shape."""
    known = lambda c: c != ""
    shown = F.when(known(value), value).when(known(validation), F.lit("[blank input]")).when(known(comment), F.lit("[blank cell]"))
    tells = F.lower(fmt).rlike("|".join(map(re.escape, _SHAPES))) & (fmt != "General")
    parts = F.concat_ws(" | ", shown, F.when(known(comment), F.concat(F.lit("Comment: "), comment)), F.when(known(validation), validation),
        F.when(tells, F.concat(F.lit("Expected format: "), fmt)))
    return F.when(shown.isNotNull(), parts)


def cells(parsed: DataFrame) -> DataFrame:
    """One row for each cell with its address and display text; cells without any are kept with a null."""
    flat = parsed.select("source_id", "hidden", "loose_sheets", F.explode("cells").alias("c")).select("source_id", "hidden", "loose_sheets", "c.*")
    said = F.when((F.col("validation") == "") & F.col("partial"), F.lit("Validation present (details not expanded)")).otherwise(F.col("validation"))
    return flat.withColumns({
        "address": F.concat(letters(F.col("col")), F.col("row").cast("string")),
        "text": display(F.col("value"), F.col("comment"), said, F.col("format")),
    })


def _lines(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """`lines` of each key: the cells of a row joined by ` | `, rows in order; cells are joined before rows are."""
    per_row = rows.groupBy(*keys, "row").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("col", F.concat_ws(": ", "address", "text").alias("t"))))).alias("ts"),
        F.min("col").alias("c1"), F.max("col").alias("c2"), F.bool_or(F.col("value").startswith("=")).alias("formula"),
            F.bool_or("partial").alias("partial"), *more,
    )
    line = F.when(F.size("ts") > 0, F.struct("row", F.array_join(F.transform("ts", lambda t: t["t"]), " | ").alias("t")))
    return per_row.groupBy(*keys).agg(
        F.array_sort(F.collect_list(line)).alias("ls"), F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("c1").alias("c1"),
            F.max("c2").alias("c2"),
        F.bool_or("formula").alias("formula"), F.bool_or("partial").alias("partial"), F.bool_or("hidden").alias("hidden"),
            F.bool_or("loose").alias("loose"), F.min_by("above", "row").alias("heading"),
    ).withColumn("lines", F.transform("ls", lambda x: x["t"])).drop("ls")


def regions(parsed: DataFrame) -> DataFrame:
    """A row for each run of neighbouring rows of a sheet that hold a cell: the record of it.

    heading: the nearest of the five rows above whose only value has at most 160 characters. Islands, headings and
    texts come from one shuffle by (source_id, sheet).
    """
    rows = cells(parsed).withColumn("loose", F.array_contains("loose_sheets", F.col("sheet")))
    sheet = ["source_id", "sheet_no", "sheet"]
    by_row = Window.partitionBy(*sheet).orderBy("row")
    filled = rows.withColumn("island", F.col("row") - F.dense_rank().over(by_row))
    one = Window.partitionBy(*sheet, "row")
    only = (F.count(F.nullif("value", F.lit(""))).over(one) == 1) & (F.max(F.length("value")).over(one) <= 160)
    titled = filled.withColumn("alone", F.when(only, F.max(F.nullif("value", F.lit(""))).over(one)))
    above = titled.withColumn("above", F.last("alone", ignorenulls=True).over(by_row.rangeBetween(-5, -1)))
    out = _lines(above, [*sheet, "island"], F.bool_or("hidden").alias("hidden"), F.bool_or("loose").alias("loose"),
        F.max("above").alias("above")).where(F.size("lines") > 0)
    heading = F.when(F.col("heading").isNotNull(), F.concat(F.lit("Heading: "), "heading"))
    warn = lambda c, code: F.when(c, F.lit(code))
    flagged = F.filter(F.array(warn(F.col("hidden"), "HIDDEN_SHEET_SKIPPED"), warn(F.col("partial") | F.col("loose"), "DATA_VALIDATION_PARTIAL"),
                               warn(F.col("formula"), "FORMULA_WITHOUT_CACHED_VALUE")), lambda x: x.isNotNull())
    return _records(
        out, F.concat_ws("\n", F.concat(F.lit("Sheet: "), "sheet"), heading, F.array_join("lines", "\n")), F.coalesce("heading", "sheet"),
        F.filter(F.array("sheet", "heading"), lambda x: x.isNotNull()), flagged, F.lit(""), 16,
    )


def named_ranges(parsed: DataFrame) -> DataFrame:
    """A row for each named range: the record of its cells, or of its lack of visible ones.

    Cells meet ranges by pieces of these, see `operators.ranges`, so that a sheet's cells are not multiplied by its ranges.
    """
    names = parsed.select("source_id", F.posexplode("names").alias("n", "r")).select("source_id", "n", "r.name", "r.sheet", "r.sheet_no", "r.row1",
        "r.col1", "r.row2", "r.col2")
    inside = cells_in_ranges(cells(parsed).drop("hidden", "loose_sheets"), names, ["source_id", "sheet", "sheet_no"])
    no = F.lit(False)
    lines = _lines(inside, ["source_id", "n"], F.bool_or(no).alias("hidden"), F.bool_or(no).alias("loose"),
        F.lit(None).cast("string").alias("above")).select("source_id", "n", "lines")
    rows = names.join(lines, ["source_id", "n"], "left").withColumnsRenamed({"row1": "r1", "col1": "c1", "row2": "r2", "col2": "c2"})
    empty = F.coalesce(F.size("lines") <= 0, F.lit(True))
    body = F.when(empty, F.lit("[named range contains no visible cell values]")).otherwise(F.array_join("lines", "\n"))
    title = F.concat(F.lit("Named range: "), "name")
    content = F.concat_ws("\n", F.concat(F.lit("Sheet: "), "sheet"), title, F.concat(F.lit("Range: "), _range()), body)
    return _records(rows, content, title, F.array(F.col("sheet"), title), F.expr("cast(array() as array<string>)"),
        F.concat(F.lit("named-"), _fragment(F.col("name")), F.lit("-")), 12)


def _range() -> Column:
    return F.concat(letters(F.col("c1")), F.col("r1").cast("string"), F.lit(":"), letters(F.col("c2")), F.col("r2").cast("string"))


def _fragment(c: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(cut == "", F.lit("sheet")).otherwise(cut)


def _records(rows: DataFrame, content: Column, section: Column, path: Column, warnings: Column, infix: Column, digits: int) -> DataFrame:
    full = rows.withColumn("content", content).withColumn("content_hash", F.sha2("content", 256))
    return full.select(
        "source_id", "sheet_no", F.col("r1").alias("first_row"),
        F.concat(F.col("source_id"), F.lit("-"), _fragment(F.col("sheet")), F.lit("-"), infix,
            F.substring("content_hash", 1, digits)).alias("record_id"),
        F.lit("worksheet").alias("content_kind"), path.alias("title_path"), "content", section.alias("section"), "sheet",
            _range().alias("cell_range"),
        F.lit("xlsm_xml").alias("extraction_method"), warnings.alias("warnings"), "content_hash",
    )


def issues(parsed: DataFrame) -> DataFrame:
    """(source_id, code, severity) of files that were not read."""
    return parsed.where("error IS NOT NULL").select("source_id", F.col("error").alias("code"), F.lit("error").alias("severity"))
