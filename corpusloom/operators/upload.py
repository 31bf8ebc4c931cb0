"""Embedding and upload with bounded retries, the gate of scoped deletes, and the sync that joins them.

Providers are callables that run on the executors, once for each batch of rows; what they raise is classified by
the same rules as `sync.failure_kind`. A run leaves rows of outcomes; nothing is collected but one count.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import sync
from corpusloom.operators.corpus import eligible

EMBED_BATCH, RETRY_BATCH, RETRIES = 16, 4, 3
OUTCOME = "key string, vector array<float>, kind string"


class ProviderError(Exception):
    """What a provider raises: an HTTP status code or None, a status name, a message."""

    def __init__(self, code: int | None = None, status: str = "", message: str = ""):
        super().__init__(message)
        self.code, self.status, self.message = code, status, message


def kind_of(e: ProviderError) -> str:
    """`sync.failure_kind` of one exception."""
    status, said = (e.status or "").upper(), (e.message or "").lower()
    quota, rate = (any(w in said for w in words) for words in (sync.QUOTA_WORDS, sync.RATE_WORDS))
    if e.code == 429 and (quota or (status == "RESOURCE_EXHAUSTED" and not rate)):
        return "quota_exhausted"
    named = e.code is None and status in ("RESOURCE_EXHAUSTED", "UNAVAILABLE", "DEADLINE_EXCEEDED")
    return "transient" if e.code == 429 or named or (e.code is not None and 500 <= e.code <= 599) else "provider_error"


def delay(attempt: int, jitter: float = 0.0) -> float:
    return min(8.0, 0.25 * 2**attempt) + jitter


def with_retries(call: Callable, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep):
    """(result, None), or (None, kind) once a failure is final or `retries` more attempts have failed."""
    for attempt in range(retries + 1):
        try:
            return call(), None
        except ProviderError as e:
            kind = kind_of(e)
            if kind != "transient" or attempt == retries:
                return None, kind
            sleep(delay(attempt, random.uniform(0, 0.25)))
    raise AssertionError


def embed_batch(keys: list[str], texts: list[str], provider, dims: int, sleep=time.sleep) -> list[tuple]:
    """(key, vector, kind) of one batch: the batch first; if that stays transient, sub-batches of four."""
    got, kind = with_retries(lambda: provider(texts), sleep=sleep)
    if kind == "transient" and len(texts) > RETRY_BATCH:
        return [row for k in range(0, len(texts), RETRY_BATCH) for row in embed_batch(keys[k : k + RETRY_BATCH], texts[k : k + RETRY_BATCH], provider,
            dims, sleep)]
    if kind is None and len(got) != len(texts):
        got, kind = None, "provider_error"
    if kind:
        return [(k, None, kind) for k in keys]
    fine = lambda v: v is not None and len(v) == dims and all(isinstance(x, (int, float)) and not isinstance(x,
        bool) and abs(x) < float("inf") for x in v)
    return [(k, list(map(float, v)), None) if fine(v) else (k, None, "provider_error") for k, v in zip(keys, got)]


def embed(misses: DataFrame, provider: Callable[[list[str]], list], dims: int, key: str = "content_hash", text: str = "embedding_text",
    sleep=time.sleep) -> DataFrame:
    """(key, vector, kind) of rows whose vectors are not cached. A task stops asking once its quota is spent.

    Rows of equal keys are asked for once, which is a partial aggregation before the shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = False
        for batch in batches:
            rows = []
            for at in range(0, len(batch), EMBED_BATCH):
                part = batch.iloc[at : at + EMBED_BATCH]
                keys = part["key"].tolist()
                rows += [(k, None, "quota_exhausted") for k in keys] if spent else embed_batch(keys, part["text"].tolist(), provider, dims, sleep)
                spent = spent or rows[-1][2] == "quota_exhausted"
            yield pd.DataFrame(rows, columns=["key", "vector", "kind"])

    once = misses.groupBy(F.col(key).cast("string").alias("key")).agg(F.first(F.coalesce(text, F.lit(""))).alias("text"))
    return once.mapInPandas(run, OUTCOME)


def hashing_provider(dims: int) -> Callable[[list[str]], list]:
    """A provider for tests and offline runs: signed counts of hashed words, scaled to length one."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h & (1 << 31) else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return run


def scope_row(sources: DataFrame, manifest_sha256: str, chunks_sha256: str, requested: list[str], complete: bool, includes_images: bool) -> dict:
    """The provenance of a build: whose sources it covers, from which files. Ids of sources, never chunks, come to the driver."""
    ids = sorted(r[0] for r in sources.where("review_status = 'approved' AND status <> 'excluded'").select("id").distinct().collect())
    return {"schema_version": 1, "complete": complete, "includes_images": includes_images, "source_ids": ids,
        "requested_source_ids": sorted(requested),
            "manifest_sha256": manifest_sha256, "chunks_sha256": chunks_sha256}


def scope_faults(scope: dict | None, approved: DataFrame, chunks: DataFrame, manifest_sha256: str, chunks_sha256: str) -> list[str]:
    """Why stale rows may not be deleted; an empty list is leave to do so.

    A delete needs the provenance of a complete build, images included, of exactly the approved sources (column id),
    from these very files, and chunks (source_id) of no other source.
    """
    if not isinstance(scope, dict) or scope.get("schema_version") != 1:
        return ["SCOPE_MISSING"]
    ids, asked = scope.get("source_ids"), scope.get("requested_source_ids")
    text = lambda xs: isinstance(xs, list) and all(isinstance(x, str) for x in xs)
    if not text(ids) or not text(asked):
        return ["SCOPE_MALFORMED"]
    spark = approved.sparkSession
    named = spark.createDataFrame([(x,) for x in ids], "id string")
    known = approved.select("id").distinct()
    differ = len(set(ids)) < len(ids) or not known.join(named, "id", "left_anti").isEmpty() or not named.join(known, "id", "left_anti").isEmpty()
    strange = not chunks.join(F.broadcast(named) if len(ids) < 100_000 else named, chunks["source_id"] == named["id"], "left_anti").isEmpty()
    found = {
        "BUILD_INCOMPLETE": scope.get("complete") is not True, "IMAGES_NOT_INCLUDED": scope.get("includes_images") is not True,
            "SCOPE_DIFFERS": differ,
        "BUILD_OF_SUBSET": set(asked) not in (set(), set(ids)), "MANIFEST_DIFFERS": scope.get("manifest_sha256") != manifest_sha256,
        "CHUNKS_DIFFER": scope.get("chunks_sha256") != chunks_sha256, "CHUNKS_OUTSIDE_SCOPE": strange,
    }
    return [code for code, bad in found.items() if bad]


def scope_rows(sources: DataFrame, manifest_sha256: str, chunks_sha256: str, requested: list[str], complete: bool,
    includes_images: bool) -> DataFrame:
    """The provenance of a build as a table: a row for each source that it covers or was asked for (source_id, included,
    asked), with the facts of the build in each; a build without any has one row without a source."""
    spark = sources.sparkSession
    own = eligible(sources, requested).select(F.col("id").alias("source_id")).distinct().withColumn("included", F.lit(True))
    asked = spark.createDataFrame([(x,) for x in sorted(set(requested))], "source_id string").withColumn("asked", F.lit(True))
    rows = own.join(asked, "source_id", "full").na.fill(False, ["included", "asked"])
    facts = {"schema_version": 1, "complete": complete, "includes_images": includes_images, "manifest_sha256": manifest_sha256,
        "chunks_sha256": chunks_sha256}
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])
    return one.join(rows, F.lit(True), "left")  # one row on the left


def scope_issues(scope: DataFrame, approved: DataFrame, chunks: DataFrame, manifest_sha256: str, chunks_sha256: str) -> DataFrame:
    """(code): why stale rows may not be deleted by a scope made by `scope_rows`; no row is leave to do so. See `scope_faults`.

    Every fault is one aggregated row; ids meet in anti joins and are not collected.
    """
    ids = scope.where("included").select(F.col("source_id").alias("id"))
    known = approved.select("id").distinct()
    some = lambda df, code: df.limit(1).select(F.lit(code).alias("code"))
    wrong = lambda cond, code: some(scope.where(cond), code)
    differ = known.join(ids, "id", "left_anti").unionByName(ids.join(known, "id", "left_anti"))
    strange = chunks.select(F.col("source_id").alias("id")).distinct().join(ids, "id", "left_anti")
    subset = scope.agg(F.bool_or("asked").alias("some"), F.bool_or(F.col("asked") != F.col("included")).alias("other")).where("some and other")
    parts = [
        some(scope.agg(F.count("*").alias("n"), F.max("schema_version").alias("v")).where("n = 0 or v <> 1"), "SCOPE_MISSING"),
            wrong("not complete", "BUILD_INCOMPLETE"),
        wrong("not includes_images", "IMAGES_NOT_INCLUDED"), some(differ, "SCOPE_DIFFERS"), some(subset, "BUILD_OF_SUBSET"),
            wrong(F.col("manifest_sha256") != manifest_sha256, "MANIFEST_DIFFERS"),
        wrong(F.col("chunks_sha256") != chunks_sha256, "CHUNKS_DIFFER"), some(strange, "CHUNKS_OUTSIDE_SCOPE"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def embed_waves(misses: DataFrame, provider, dims: int, write, key: str = "content_hash", waves: int = 4, sleep=time.sleep) -> DataFrame:
    """`embed` in `waves` parts by a hash of the key, each stored before the next one is asked for.

    Once a stored part says that the quota is spent, no provider is asked for the parts after it: their rows are
    quota_exhausted too. Tasks of the same part stop for themselves, each after its own refusal.
    """
    out, spent = None, False
    for k in range(waves):
        part = misses.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(waves)) == k)
        if spent:
            rows = part.select(F.col(key).cast("string").alias("key")).distinct().select("key", F.lit(None).cast("array<float>").alias("vector"),
                F.lit("quota_exhausted").alias("kind"))
        else:
            rows = write(f"embedded_{k}", embed(part, provider, dims, key, sleep=sleep))
            spent = not rows.where("kind = 'quota_exhausted'").isEmpty()
        out = rows if out is None else out.unionByName(rows)
    return out


def run_upload(chunks: DataFrame, cache: DataFrame, index: DataFrame, provider, dims: int, write, key: str = "content_hash",
    delete_scope_faults: list[str] | None = None, sleep=time.sleep, waves: int = 4) -> dict:
    """One sync of an index: cached vectors, embedded misses, upserted rows, stale rows of the scope.

    `write(name, df)` stores a DataFrame as table `name` and returns what was stored; each step reads the stored
    result of the one before, so a restart asks no provider twice. Stale rows go only where `delete_scope_faults`
    is an empty list and nothing failed. `index` and `chunks` have id, source_id and `key`.
    """
    joined = sync.cache_join(chunks, cache, key, dims)
    fresh = embed_waves(joined.where("vector IS NULL").drop("vector"), provider, dims, write, key, waves, sleep)
    got = fresh.where("vector IS NOT NULL").select(F.col("key").alias(key), "vector")
    cache_now = write("cache", sync.upsert(cache.where(sync.valid_vector(F.col("vector"), dims)).select(key, "vector"), got, key))
    ready = sync.cache_join(chunks, cache_now, key, dims)
    counts = ready.agg(F.count("*").alias("n"), F.count_if(F.col("vector").isNull()).alias("failed")).first()
    kinds = {r["kind"]: r["count"] for r in fresh.where("kind IS NOT NULL").groupBy("kind").count().collect()}
    new = sync.upsert(index, ready.where("vector IS NOT NULL"), "id")
    clean = delete_scope_faults == [] and counts["failed"] == 0
    if clean:
        new = new.join(sync.stale(index, chunks, "id", "source_id").select("id"), "id", "left_anti")
    write("index", new)
    return {"chunks": counts["n"], "failed": counts["failed"], "failures": kinds, "stale_deleted": clean,
        "stopped_on_quota": "quota_exhausted" in kinds}
