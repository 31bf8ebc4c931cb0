"""File scans and sinks: manifests, JSON lines with guards, binary files with signatures, reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.operators.registry import signature

MANIFEST = "sources array<struct<url:string,final_url:string,status:string,content_type:string,file:string,sha256:string,bytes:bigint>>"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifests(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Download manifests in the given order; those that are not there are left out."""
    return [spark.read.schema(MANIFEST).option("multiLine", "true").json(p) for p in paths if _exists(spark, p)]


def read_jsonl(spark: SparkSession, path: str, schema: StructType, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of JSON lines: malformed lines and, with `key`, repeated keys are issues (code, key, line), not rows lost in silence.

    Rows of a repeated key stay; callers that refuse a file with issues use `strict`.
    """
    bad = "_corrupt_record"
    raw = spark.read.schema(StructType([*schema.fields, StructField(bad, StringType())])).json(path)
    lines = spark.read.text(path).select(F.col("value")).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", raw.schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    rows = parsed.where(F.col(f"r.{bad}").isNull() & F.col("r").isNotNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    faults = parsed.where(F.col(f"r.{bad}").isNotNull() | F.col("r").isNull()).select(F.lit("LINE_MALFORMED").alias("code"),
        F.lit(None).cast("string").alias("key"), F.substring("value", 1, 200).alias("line"))
    if key:
        twice = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1 OR key IS NULL")
        faults = faults.unionByName(twice.select(F.when(F.col("key").isNull(), "KEY_MISSING").otherwise("KEY_REPEATED").alias("code"), "key",
            F.lit(None).cast("string").alias("line")))
    return rows, faults


def strict(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """`rows` if there are no faults, else a ValueError that names the first one."""
    if (first := faults.orderBy("code", "key").first()) is not None:
        raise ValueError(f"{first['code']}: {first['key'] or first['line']}")
    return rows


def reusable(spark: SparkSession, path: str, schema: StructType, wanted: DataFrame, source: str = "source_id") -> DataFrame:
    """Records of an earlier run for the wanted sources; a missing file, or one with any malformed line, gives none."""
    empty = spark.createDataFrame([], schema)
    if not _exists(spark, path):
        return empty
    rows, faults = read_jsonl(spark, path, schema)
    return rows.join(wanted.select(source).distinct(), source, "left_semi").select(*schema.fieldNames()) if faults.isEmpty() else empty


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(local_file, bytes, file_sha256, signature) of the files under a folder; contents are read once and not kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("local_file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("file_sha256"),
        signature(F.col("content")).alias("signature"))


def json_line(df: DataFrame):
    """A row as compact JSON with sorted keys; nulls stay."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a folder of parts, in `order` over all parts; the commit protocol makes the folder whole or absent."""
    (df.orderBy(*order) if order else df).select(json_line(df).alias("value")).write.mode("overwrite").text(path)


def write_atomically(path: str, text: str) -> None:
    """A small local file, replaced in one step: a temporary sibling is flushed to disk and renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_report(path: str, report: dict) -> None:
    """A report (aggregates, never rows of the corpus) as indented JSON with sorted keys."""
    write_atomically(path, json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def markdown_links(texts: DataFrame, column: str = "value") -> DataFrame:
    """Distinct sorted https urls in Markdown texts."""
    urls = F.regexp_extract_all(column, F.lit(r"https://[^\s)\]>\"']+"), F.lit(0))
    return texts.select(F.explode(urls).alias("url")).distinct().orderBy("url")
