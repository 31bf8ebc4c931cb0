"""Tables kept in buckets with snapshots.

Rows are dealt into a fixed number of buckets by a hash of their key. A write stores the buckets that change in a folder of
its own and then puts a manifest, which names the folder of each bucket, in place with one rename: readers stay on the
manifest that they began with, a writer that dies before the rename leaves the table as it was, and of two writers that began
with the same manifest one fails. What is written follows what changed, not the size of the table.

    path/data/write=<id>/bucket=<k>/*.parquet     path/manifests/<version>.json

Folders are reached through Hadoop's file systems, so that any store that Spark writes to will do (renames must not
replace files). Keys of any type; rows with null keys are rows of one key, all of whose columns are null. A manifest has an entry for each
bucket and write, a few thousand at most.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusloom.operators.ordered import first_of


class Conflict(RuntimeError):
    """Another writer has put the next manifest in place."""


@dataclass(frozen=True)
class Manifest:
    """version, from 1; key and number of buckets; schema of the rows; folders: the write that has each bucket that has rows."""

    version: int
    key: tuple[str, ...]
    buckets: int
    schema: StructType
    folders: dict[int, str]


@dataclass(frozen=True)
class Change:
    """What a write did: its version, the buckets that it rewrote and the bytes that it wrote."""

    version: int
    buckets: list[int]
    bytes: int


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def bucket_of(key: tuple[str, ...] | list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version."""
    names = sorted(n for n in _children(spark, f"{path}/manifests") if n.endswith(".json"))
    if version is not None:
        names = [n for n in names if n == f"{version:010d}.json"]
    if not names:
        raise FileNotFoundError(f"no snapshot {version or ''} in {path}")
    fs, at = _files(spark, f"{path}/manifests/{names[-1]}")
    stream = fs.open(at)
    try:
        told = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return Manifest(told["version"], tuple(told["key"]), told["buckets"], StructType.fromJson(told["schema"]), {int(k): v for k, v in told["folders"].items()})


def _swap(spark: SparkSession, path: str, m: Manifest) -> None:
    text = json.dumps({"version": m.version, "key": list(m.key), "buckets": m.buckets, "schema": m.schema.jsonValue(),
        "folders": {str(k): v for k, v in sorted(m.folders.items())}})
    fs, draft = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    _, place = _files(spark, f"{path}/manifests/{m.version:010d}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise Conflict(f"version {m.version} of {path} is there already")


def _stored(spark: SparkSession, path: str, rows: DataFrame, schema: StructType, buckets: int, split: str | None = None) -> tuple[str, list[int], int]:
    """Writes rows (with `bucket`) into a folder of their own: its name, the buckets that have rows, bytes. A bucket is one task,
    or where `split` names a column it is cut by ranges of its hash, so that buckets may be of any size."""
    name = uuid.uuid4().hex
    where = f"{path}/data/write={name}"
    own = rows.select(*schema.names, "bucket")
    if split:
        dealt = own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", F.xxhash64(split)).sortWithinPartitions("bucket")
    else:
        dealt = own.repartition(buckets, "bucket")
    dealt.write.partitionBy("bucket").parquet(where)
    found = [int(n.split("=")[1]) for n in _children(spark, where) if n.startswith("bucket=")]
    fs, at = _files(spark, where)
    return name, found, fs.getContentSummary(at).getLength()


def create(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> Change:
    """Version 1 of a table of `rows`, one row of each key (of several the smallest)."""
    return create_raw(first_of(rows, key, F.lit(0)).withColumn("bucket", bucket_of(key, buckets)), path, key, buckets)


def create_raw(rows: DataFrame, path: str, key: list[str], buckets: int, split: str | None = None, version: int = 1) -> Change:
    """Version 1 (or `version`) of rows that have their `bucket` already; split: a column by whose hash large buckets are cut into tasks."""
    spark = rows.sparkSession
    schema = StructType([f for f in rows.schema if f.name != "bucket"])
    name, found, size = _stored(spark, path, rows, schema, buckets, split)
    _swap(spark, path, Manifest(version, tuple(key), buckets, schema, {k: name for k in found}))
    return Change(version, sorted(found), size)


def load(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None, with_bucket: bool = False,
    of: Manifest | None = None) -> DataFrame:
    """The rows of the newest snapshot, or of a version; with `buckets` those alone are read."""
    m = of or manifest(spark, path, version)
    folders = {k: v for k, v in m.folders.items() if buckets is None or k in set(buckets)}
    schema = StructType([*m.schema, StructField("write", StringType()), StructField("bucket", IntegerType())])
    if folders:
        paths = [f"{path}/data/write={v}/bucket={k}" for k, v in sorted(folders.items())]
        rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*paths)
    else:
        rows = spark.createDataFrame([], schema)
    return rows.select(*m.schema.names, *["bucket"] * with_bucket)


def newest(spark: SparkSession, path: str) -> int:
    """The number of the newest version; 0 where there is none."""
    return max((int(n.split(".")[0]) for n in _children(spark, f"{path}/manifests") if n.endswith(".json")), default=0)


def replace(spark: SparkSession, path: str, rows: DataFrame, buckets: list[int], of: Manifest, split: str | None = None, version: int | None = None) -> Change:
    """The next version after `of`, or `version`: `rows` (with `bucket`) instead of all rows of `buckets`; other buckets are neither read nor written."""
    name, found, size = _stored(spark, path, rows, of.schema, max(1, len(buckets)), split)
    folders = {k: v for k, v in of.folders.items() if k not in set(buckets)} | {k: name for k in found}
    version = version or of.version + 1
    _swap(spark, path, Manifest(version, of.key, of.buckets, of.schema, folders))
    return Change(version, sorted(buckets), size)


def upsert(spark: SparkSession, path: str, changes: DataFrame, deletes: DataFrame | None = None) -> Change:
    """The next version: `changes` take the place of rows of their keys or are added (of several of a key the smallest counts);
    then rows whose keys `deletes` has go. Only buckets of these keys are read and written."""
    m = manifest(spark, path)
    key = list(m.key)
    new = first_of(changes.select(*m.schema.names), key, F.lit(0)).withColumn("bucket", bucket_of(key, m.buckets))
    gone = None if deletes is None else deletes.select(*key).distinct().withColumn("bucket", bucket_of(key, m.buckets))
    touched = new.select("bucket") if gone is None else new.select("bucket").unionByName(gone.select("bucket"))
    buckets = sorted(r.bucket for r in touched.distinct().collect())  # numbers of buckets, of which there are few
    old = load(spark, path, buckets=buckets, with_bucket=True, of=m)
    rows = _without(old, new, key).unionByName(new)
    return replace(spark, path, rows if gone is None else _without(rows, gone, key), buckets, m)


def _without(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    keys = other.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(keys, same, "left_anti")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes manifests but the newest `keep`, and the folders that none of these names; readers of older snapshots fail then."""
    names = sorted(n for n in _children(spark, f"{path}/manifests") if n.endswith(".json"))
    fs, _ = _files(spark, path)
    for n in names[:-keep]:
        fs.delete(_files(spark, f"{path}/manifests/{n}")[1], False)
    used = {w for n in names[-keep:] for w in manifest(spark, path, int(n.split(".")[0])).folders.values()}
    unused = [n for n in _children(spark, f"{path}/data") if n.startswith("write=") and n.split("=")[1] not in used]
    for n in unused:
        fs.delete(_files(spark, f"{path}/data/{n}")[1], True)
    return unused
