"""YAML files as rows: registries, image manifests and portal guides.

Files are read by Spark from any store it knows, one row a file, and parsed on the executors into JSON that a schema
is applied to; a file that cannot be parsed is a row of issues, not a failed job. The parser is an optional library.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

GUIDE = "workflow_id string, title string, jurisdiction string, review_status string, portal_version string, source_url string, tags array<string>, steps array<string>, notes array<string>"


def _to_json(text: str | None) -> str | None:
    """A mapping as JSON with dates as ISO text; anything else, and text that is no YAML, gives None."""
    import yaml

    try:
        value = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return None
    return json.dumps(value, default=lambda x: x.isoformat(), ensure_ascii=False) if isinstance(value, dict) else None


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    return texts.map(_to_json).astype(object)


def read_yaml(spark: SparkSession, path: str, schema: str | StructType, pattern: str = "*.y*ml") -> tuple[DataFrame, DataFrame]:
    """(path and the columns of `schema` for each file, issues (path, code)) of the YAML files under `path`."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"),
        yaml_to_json("value").alias("json"))
    parsed = files.select("path", "json", F.from_json("json", schema).alias("r"))
    rows = parsed.where("json is not null").select("path", "r.*")
    return rows, parsed.where("json is null").select("path", F.lit("YAML_INVALID").alias("code"))


def read_items(spark: SparkSession, path: str, field: str, item: str, version: int = 1, pattern: str = "*.y*ml") -> tuple[DataFrame, DataFrame]:
    """(path, position and columns of each entry of the list `field`, issues) of manifests; other versions are issues.

    A manifest without schema_version counts as one of `version`.
    """
    rows, faults = read_yaml(spark, path, StructType.fromDDL(f"schema_version int, `{field}` array<struct<{item}>>"), pattern)
    right = F.coalesce("schema_version", F.lit(version)) == version
    out = rows.where(right).select("path", F.posexplode(field).alias("position", "r")).select("path", "position", "r.*")
    return out, faults.unionByName(rows.where(~right).select("path", F.lit("VERSION_UNSUPPORTED").alias("code")))


def guide_text(title: Column, steps: Column, notes: Column) -> Column:
    """A guide as text: its title, numbered steps and, if there are any, notes."""
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    more = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n")
    body = F.concat(F.lit("Workflow: "), title, F.lit("\nSteps:\n"), numbered)
    return F.concat(body, F.when(F.size(notes) > 0, F.concat(F.lit("\nNotes:\n"), more)).otherwise(F.lit("")))


def guides(spark: SparkSession, path: str, jurisdiction: str = "LK") -> tuple[DataFrame, DataFrame]:
    """(approved guides of the jurisdiction with their text, issues) of a folder of guide files."""
    rows, faults = read_yaml(spark, path, GUIDE)
    place, reviewed = F.coalesce(F.col("jurisdiction") == jurisdiction, F.lit(False)), F.coalesce(F.col("review_status") == "approved", F.lit(False))
    bare = F.col("workflow_id").isNull() | F.col("title").isNull() | F.col("steps").isNull()
    code = F.when(~place, "JURISDICTION_OTHER").when(~reviewed, "NOT_APPROVED").when(bare, "GUIDE_INCOMPLETE")
    marked = rows.withColumn("code", code)
    good = marked.where("code is null").drop("code").withColumn("content", guide_text(F.col("title"), F.col("steps"), F.col("notes")))
    return good, faults.unionByName(marked.where("code is not null").select("path", "code"))


def write_yaml(path: str, top: dict) -> None:
    """A small registry as YAML, keys in the given order and nulls, empty texts and lists left out, replaced in one step."""
    import yaml

    from corpusloom.sources.files import write_atomically

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if v is not None and v != "" and v != []}
        return [bare(v) for v in x] if isinstance(x, list) else x

    write_atomically(path, yaml.safe_dump(bare(top), sort_keys=False, allow_unicode=True))
