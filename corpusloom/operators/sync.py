"""Corpus upkeep: registry deduplication, embedding cache, index upserts and stale rows, failure classes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordered import first_of, numbered


def dedupe_with_aliases(rows: DataFrame, hash_col: str, order: str, alias: str) -> DataFrame:
    """One row for each hash: its first `order`, the `alias` of that row and the sorted other aliases."""
    return rows.groupBy(hash_col).agg(
        F.min(order).alias(order), F.min_by(alias, order).alias(alias), F.collect_set(alias).alias("_all"), F.count("*").alias("n")
    ).select(hash_col, order, alias, F.array_sort(F.array_except("_all", F.array(alias))).alias("aliases"), "n")


def unique_ids(rows: DataFrame, slug: str, digest: str, order: str) -> DataFrame:
    """`rows` with id: the slug; for later rows of a slug 8 digits of the digest more; then -2, -3 and so on.

    Rows are numbered in ranges (`ordered.numbered`), so a slug of any number of rows is no task of its own.
    """
    n = F.col("_nth")
    base = numbered(rows, [slug], [order], "_nth").withColumn("_base", F.when(n == 1,
        F.col(slug)).otherwise(F.concat_ws("-", slug, F.substring(digest, 1, 8)))).drop("_nth")
    again = F.col("_nth")
    named = numbered(base, ["_base"], [order], "_nth").withColumn("id", F.when(again == 1,
        F.col("_base")).otherwise(F.concat_ws("-", "_base", again.cast("string"))))
    return named.drop("_base", "_nth")


def valid_vector(c: Column, dims: int) -> Column:
    """Exactly `dims` finite numbers."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == dims) & finite, F.lit(False))


def cache_join(chunks: DataFrame, cache: DataFrame, key: str, dims: int, vector: str = "vector") -> DataFrame:
    """`chunks` with the cached vector, or null; invalid vectors are misses. Of a key's several vectors the smallest counts,
    so no chunk is multiplied; null keys are misses."""
    known = cache.where(valid_vector(F.col(vector), dims)).groupBy(key).agg(F.min(vector).alias(vector))
    return chunks.join(known, key, "left")


CACHE_KEY = ["model", "dimensions", "content_hash"]


def cached_vectors(cache: DataFrame, model: str, dims: int) -> DataFrame:
    """(content_hash, vector) of a cache (`CACHE_KEY`, vector) for one model and size; invalid vectors are left out."""
    own = cache.where((F.col("model") == model) & (F.col("dimensions") == dims))
    return own.where(valid_vector(F.col("vector"), dims)).groupBy("content_hash").agg(F.min("vector").alias("vector"))


def cache_put(cache: DataFrame, rows: DataFrame, model: str, dims: int) -> DataFrame:
    """The cache with valid vectors of `rows` (content_hash, vector) for one model and size, in place of those it had."""
    new = cached_vectors(rows.withColumns({"model": F.lit(model), "dimensions": F.lit(dims)}), model, dims)
    full = new.select(F.lit(model).alias("model"), F.lit(dims).alias("dimensions"), "content_hash", "vector")
    return cache.join(full.select(*CACHE_KEY), CACHE_KEY, "left_anti").select(*CACHE_KEY, "vector").unionByName(full)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row of each key of `new` (of several the smallest row; null is a key), and the rows of `old` whose key `new` does
    not have. Columns that one of them lacks are null there."""
    once = first_of(new, [key], F.lit(0))
    kept = old.join(once.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return kept.unionByName(once, allowMissingColumns=True)


def stale(index: DataFrame, chunks: DataFrame, key: str, scope: str) -> DataFrame:
    """Keys of the index that the chunks lack, within the scopes that the chunks have."""
    inside = index.join(chunks.select(scope).distinct(), scope, "left_semi")
    return inside.join(chunks.select(key), key, "left_anti")


QUOTA_WORDS, RATE_WORDS = ("quota", "billing"), ("rate limit", "per minute")


def failure_kind(status_code: Column, status: Column, message: Column) -> Column:
    """quota_exhausted (do not retry), transient (retry) or provider_error."""
    has = lambda words: F.coalesce(F.lower(message).rlike("|".join(words)), F.lit(False))
    out_of = (status_code == 429) & (has(QUOTA_WORDS) | ((F.upper(status) == "RESOURCE_EXHAUSTED") & ~has(RATE_WORDS)))
    named = status_code.isNull() & F.upper(status).isin("RESOURCE_EXHAUSTED", "UNAVAILABLE", "DEADLINE_EXCEEDED")
    again = (status_code == 429) | status_code.between(500, 599) | named
    return F.when(out_of, "quota_exhausted").when(again, "transient").otherwise("provider_error")


def retry_delay(attempt: Column) -> Column:
    return F.least(F.lit(8.0), 0.25 * F.pow(F.lit(2.0), attempt))


def issues(rows: DataFrame, checks: dict[str, tuple[str, Column]], *ids: str) -> DataFrame:
    """(ids, code, severity): a row for each check (code -> severity, condition of failure) that a row fails."""
    hits = F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, (sev, c) in checks.items()])
    return rows.select(*ids, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("i")).select(*ids, "i.code", "i.severity")


def source_summary(sources: DataFrame, records: DataFrame, found: DataFrame, key: str = "source_id") -> DataFrame:
    """A row for each source with the numbers of its records and issues; both are aggregated before they are joined."""
    n = records.groupBy(key).agg(F.count("*").alias("n_records"))
    e = found.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = {"n_records": 0, "errors": 0, "warnings": 0}
    return sources.select(key).distinct().join(n, key, "left").join(e, key, "left").na.fill(zero)


def ocr_decision(native: Column, ocr: Column) -> Column:
    """Which text of a page to take: native where it has 80 visible characters; OCR where it has 20 more; or none."""
    from corpusloom.functions.text import visible_length

    n, o = visible_length(F.coalesce(native, F.lit(""))), visible_length(F.coalesce(ocr, F.lit("")))
    return (
        F.when(n >= 80, "NATIVE").when((n < 20) & (o < 20), "EMPTY_PAGE").when(o >= n + 20, "OCR_USED").otherwise("OCR_WEAKER_THAN_NATIVE")
    )
