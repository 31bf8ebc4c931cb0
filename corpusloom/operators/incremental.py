"""Corpus builds that keep their stages: only sources that changed are extracted, split and merged again.

A folder holds three tables with snapshots: records and chunks, in which each source is a bucket of its own, and lineage, a row for
each source with the digest of all that its chunks are made from (its registry row, its content's hash and the version of
the settings), its bucket, and the versions of the other tables that it goes with. A build compares digests, extracts the sources whose digest is new, writes
their records and chunks and then swaps the lineage: readers see whole builds only, and one that dies before the swap leaves
the last build in place. Sources that left the registry lose their rows without a write of data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, corpus, snapshots
from corpusloom.operators.ordered import stored


@dataclass(frozen=True)
class Step:
    """What a build did: sources extracted again, sources that left, sources that stayed, and the bytes that it wrote."""

    changed: list[str]
    removed: list[str]
    kept: int
    bytes: int


LINEAGE = "source_id string, digest string, place int, records bigint, chunks bigint"


def digest(sources: DataFrame, settings: str = "") -> DataFrame:
    """(source_id, digest): changes with any column of the source's row and with the settings."""
    told = F.to_json(F.struct(*sorted(sources.columns)), {"ignoreNullFields": "false"})
    return sources.select(F.col("id").alias("source_id"), F.sha2(F.concat_ws("\n", told, F.lit(settings)), 256).alias("digest"))


def build(sources: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame], settings: str = "", force: bool = False) -> Step:
    """Brings the build at `path` up to the eligible sources (see `corpus.eligible`); force: all are extracted again.

    extract: the extraction records of the given sources; called once, with those that changed. A source's row names the hash of its
    content (sha256), so that a new content is a change; settings: whatever else the records and chunks depend on. The
    registry has a row for each source, and lists of source ids, not rows of theirs, are what the driver holds.
    """
    spark = sources.sparkSession
    own = corpus.eligible(sources)
    now = {r.source_id: r.digest for r in digest(own, settings).collect()}
    at = snapshots.newest(spark, f"{path}/lineage")
    had = {r.source_id: r for r in snapshots.load(spark, f"{path}/lineage").collect()} if at else {}
    changed = sorted(s for s, d in now.items() if force or s not in had or had[s].digest != d)
    removed = sorted(s for s in had if s not in now)
    if at and not changed and not removed:
        return Step([], [], len(now), 0)
    free = max((r.place for r in had.values()), default=-1) + 1
    place = {s: had[s].place for s in now if s in had} | {s: free + k for k, s in enumerate(x for x in changed if x not in had)}
    places = spark.createDataFrame([(s, place[s]) for s in changed], "source_id string, bucket int")
    some = own.join(F.broadcast(places.select(F.col("source_id").alias("id"))), "id", "left_semi")
    records = stored(corpus.normalize_records(extract(some).join(F.broadcast(places.select("source_id")), "source_id", "left_semi")))
    chunks = chunking.build_chunks(records, some)
    touched = [place[s] for s in changed] + [had[s].place for s in removed]
    versions, size = {}, 0
    for name, rows, key in (("records", records, "record_id"), ("chunks", chunks, "id")):
        placed = rows.join(F.broadcast(places), "source_id").select(*rows.columns, "bucket")
        where = f"{path}/{name}"
        if had:
            old = snapshots.manifest(spark, where, next(iter(had.values()))[name])
            done = snapshots.replace(spark, where, placed, touched, old, split=key, version=snapshots.newest(spark, where) + 1)
        else:
            done = snapshots.create_raw(placed, where, ["source_id"], len(now), split=key, version=snapshots.newest(spark, where) + 1)
        versions[name], size = done.version, size + done.bytes
    lineage = spark.createDataFrame([(s, now[s], place[s], versions["records"], versions["chunks"]) for s in sorted(now)], LINEAGE).withColumn("bucket", F.lit(0))
    if at:
        snapshots.replace(spark, f"{path}/lineage", lineage, [0], snapshots.manifest(spark, f"{path}/lineage"))
    else:
        snapshots.create_raw(lineage, f"{path}/lineage", ["source_id"], 1)
    return Step(changed, removed, len(now) - len(changed), size)


def load(spark: SparkSession, path: str, name: str = "chunks") -> DataFrame:
    """The records or chunks of the last whole build."""
    first = snapshots.load(spark, f"{path}/lineage").first()
    if first is None:  # a build of no source
        return snapshots.load(spark, f"{path}/{name}").limit(0)
    return snapshots.load(spark, f"{path}/{name}", first[name])
