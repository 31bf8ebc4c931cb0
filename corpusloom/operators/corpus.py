"""The corpus build, from registry rows and records to chunks, issues and audit reports, as one plan of DataFrames.

Issues are rows (source_id, record_id, code, severity, message). Nothing is collected; every count is an aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_text, token_estimate
from corpusloom.operators import chunking, constraints, ordered, sync

ISSUE = ("source_id", "record_id", "code", "severity", "message")


def eligible(sources: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Approved sources that are not excluded, of `requested` ids if there are any; null statuses are not approved."""
    own = sources.where((F.col("review_status") == "approved") & F.coalesce(F.col("status") != "excluded", F.lit(False)))
    if not requested:
        return own
    wanted = sources.sparkSession.createDataFrame([(x,) for x in sorted(set(requested))], "id string")
    return own.join(wanted, "id", "left_semi")


def approved_ids(sources: DataFrame) -> DataFrame:
    return eligible(sources).select("id").distinct()


def unknown_ids(sources: DataFrame, requested: list[str]) -> DataFrame:
    """(id) of requested sources that the registry lacks, each once; a left anti join."""
    wanted = sources.sparkSession.createDataFrame([(x,) for x in sorted(set(requested))], "id string")
    return wanted.join(sources.select("id"), "id", "left_anti")


def issue_rows(found: DataFrame, source: Column, record: Column | None = None, message: Column | None = None) -> DataFrame:
    """Rows of issues from (code, severity, ..)."""
    none = F.lit(None).cast("string")
    return found.select(source.cast("string").alias("source_id"), (none if record is None else record.cast("string")).alias("record_id"), "code",
        "severity",
                        F.coalesce(none if message is None else message, "code").alias("message"))


def record_warnings(records: DataFrame) -> DataFrame:
    """An issue for each warning of each record."""
    rows = records.select("source_id", "record_id", F.explode("warnings").alias("code")).withColumn("severity", F.lit("warning"))
    return issue_rows(rows, F.col("source_id"), F.col("record_id"), F.concat("code", F.lit(" on record")))


def failure_issue(source: Column, error: Column) -> Column:
    """The issue of a source that could not be extracted. error: struct<code, kind>; contents are never told."""
    return F.struct(source.alias("source_id"), F.lit(None).cast("string").alias("record_id"),
        F.coalesce(error["code"], F.lit("EXTRACTION_FAILED")).alias("code"),
                    F.lit("error").alias("severity"), F.concat(F.lit("extraction failed: "),
                        F.coalesce(error["kind"], F.lit("Exception"))).alias("message"))


def merge_issues(*lists: DataFrame) -> DataFrame:
    """Issues of several lists, each (code, source, record, message) once: that of the first list that has it (null-safe)."""
    rows = [d.select(*ISSUE).withColumn("_list", F.lit(k)) for k, d in enumerate(lists)]
    out = rows[0]
    for d in rows[1:]:
        out = out.unionByName(d)
    return ordered.first_of(out, ["code", "source_id", "record_id", "message"], F.col("_list")).drop("_list")


def locator_checks() -> constraints.Catalogue:
    """Of chunks in an audit: a place of one kind or another, and whole sheet ranges."""
    c = F.col
    known = lambda name: F.coalesce(c(name) != "", F.lit(False))
    place = c("page").isNotNull() | known("section") | (known("sheet") & known("cell_range"))
    return {"MISSING_CHUNK_LOCATOR": ("error", ~place), "INCOMPLETE_CHUNK_LOCATOR": ("error", place & (known("sheet") != known("cell_range")))}


def normalize_records(records: DataFrame) -> DataFrame:
    """Records with normalised contents and their hashes; those without content then are left out."""
    made = F.transform(F.array(normalize_text(F.col("content"))), lambda t: F.struct(t.alias("content"), F.sha2(t, 256).alias("content_hash")))
    rest = [F.col(f"`{c}`") for c in records.columns if c not in ("content", "content_hash")]
    # rows without content vanish in the explosion; a filter would normalise twice
    return records.select(*rest, F.explode(F.filter(made, lambda x: x["content"] != "")).alias("_n")).select(*rest, "_n.*")


def dispatch(sources: DataFrame, readers: dict, key: str = "media_type") -> tuple[DataFrame, DataFrame]:
    """(records, issues) of sources by media type. readers: type -> function of the sources of that type that returns
    (records, issues). Sources of any other type give an issue; null is another type."""
    parts = [read(sources.where(F.col(key) == kind)) for kind, read in readers.items()]
    strange = sources.where(~F.coalesce(F.col(key).isin(*readers), F.lit(False)))
    issue = issue_rows(strange.select("id", F.lit("EXTRACTION_FAILED").alias("code"), F.lit("error").alias("severity")), F.col("id"),
        message=F.lit("unsupported media type"))
    records = parts[0][0]
    for more, _ in parts[1:]:
        records = records.unionByName(more, allowMissingColumns=True)
    for _, found in parts:
        issue = issue.unionByName(found.select(*ISSUE))
    return records, issue


@dataclass
class Build:
    """What a build made. complete: a column of `totals` too."""

    records: DataFrame
    chunks: DataFrame
    issues: DataFrame
    sources: DataFrame
    names: list[str] = field(default_factory=list)


def build(sources: DataFrame, extracted: DataFrame, extraction_issues: DataFrame | None = None, requested: list[str] | None = None,
    image_chunks: DataFrame | None = None,
          image_issues: DataFrame | None = None, cached: DataFrame | None = None, allowed_hosts: list[str] | None = None) -> Build:
    """Records, chunks and issues of the eligible sources.

    extracted, cached: extraction records; a source with cached records is not taken from `extracted`. Registry rules
    (with `allowed_hosts`), unknown requested ids and warnings of records are issues beside those given. Records of other
    sources are left out. The registry's own errors and unknown ids leave records and chunks empty.
    """
    spark = sources.sparkSession
    none = spark.createDataFrame([], "source_id string, record_id string, code string, severity string, message string")
    rules = issue_rows(constraints.registry_issues(sources, allowed_hosts), F.col("id")) if allowed_hosts is not None else none
    strange = unknown_ids(sources, requested or []).select("id", F.lit("UNKNOWN_SOURCE").alias("code"), F.lit("error").alias("severity"))
    unknown = issue_rows(strange, F.col("id"), message=F.concat(F.lit("unknown source ID: "), "id"))
    own = eligible(sources, requested)
    stop = ordered.stored(rules.unionByName(unknown).where("severity = 'error'").limit(1).select(F.lit(True).alias("_stop")))
    if not stop.isEmpty():
        own = own.limit(0)
    ids = F.broadcast(own.select(F.col("id").alias("source_id")))  # sources are few and have many records each, so contents stay where they are
    fresh = extracted.join(ids, "source_id", "left_semi")
    if cached is not None:
        fresh = fresh.join(cached.select("source_id").distinct(), "source_id", "left_anti").unionByName(cached.join(ids, "source_id", "left_semi"),
            allowMissingColumns=True)
    records = normalize_records(fresh)
    chunks = chunking.build_chunks(records, own)
    if image_chunks is not None:
        chunks = chunks.unionByName(image_chunks, allowMissingColumns=True)
    placed = issue_rows(sync.issues(chunks, locator_checks(), "source_id", "id"), F.col("source_id"), F.col("id"))
    lists = [rules, unknown, extraction_issues, record_warnings(records), image_issues, placed]
    return Build(records, chunks, merge_issues(*[x for x in lists if x is not None]), own)


def totals(b: Build) -> DataFrame:
    """One row: numbers of sources, records, chunks, errors, warnings and estimated tokens of the embedding texts."""
    n = lambda df, name, *more: df.agg(F.count("*").alias(name), *more)
    tokens = F.coalesce(F.sum(token_estimate(F.col("embedding_text"))), F.lit(0)).alias("embedding_tokens")
    counted = b.issues.agg(F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"))
    parts = [n(b.sources, "source_count"), n(b.records, "extraction_record_count"), n(b.chunks, "chunk_count", tokens), counted]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def code_counts(issues: DataFrame) -> DataFrame:
    """(severity, code, n)."""
    return issues.groupBy("severity", "code").agg(F.count("*").alias("n"))


def source_report(b: Build) -> DataFrame:
    """A row for each source: records, chunks, errors, warnings, and methods (map of method -> records).

    Every input is aggregated by source before it is joined, so no row is multiplied.
    """
    methods = b.records.groupBy("source_id", "extraction_method").agg(F.count("*").alias("n")).where("extraction_method is not null")
    histogram = methods.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extraction_method",
        "n")))).alias("extraction_methods"))
    records = b.records.groupBy("source_id").agg(F.count("*").alias("extraction_record_count"))
    chunks = b.chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    issues = b.issues.groupBy("source_id").agg(F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"))
    out = b.sources.select(F.col("id").alias("source_id"))
    for part in (records, chunks, issues):
        out = out.join(part, "source_id", "left")
    zero = {"extraction_record_count": 0, "chunk_count": 0, "error_count": 0, "warning_count": 0}
    return out.na.fill(zero).join(histogram, "source_id", "left").withColumn("extraction_methods",
        F.coalesce("extraction_methods", F.expr("map()").cast("map<string,bigint>")))


def estimate(chunks: DataFrame, cache: DataFrame | None, model: str, dims: int) -> DataFrame:
    """One row of a dry run: chunks, characters and tokens to embed, cache hits and misses. Nothing is written.

    cache: model, dimensions, content_hash, vector; a chunk hits a valid vector of its text's hash; repeated cache rows
    count once. Without a cache every chunk is a miss.
    """
    rows = chunks.select(F.coalesce("embedding_text", F.lit("")).alias("t")).withColumn("content_hash", F.sha2("t", 256))
    if cache is None:
        known = rows.withColumn("hit", F.lit(False))
    else:
        valid = cache.where((F.col("model") == model) & (F.col("dimensions") == dims) & sync.valid_vector(F.col("vector"), dims))
        known = rows.join(valid.select("content_hash").distinct().withColumn("_hit", F.lit(True)), "content_hash", "left").withColumn("hit",
            F.col("_hit").isNotNull())
    return known.agg(
        F.count("*").alias("chunk_count"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("estimated_characters"),
            F.coalesce(F.sum(token_estimate(F.col("t"))), F.lit(0)).alias("estimated_tokens"),
        F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))


def download_counts(results: DataFrame) -> DataFrame:
    """One row: downloads asked for, done and failed."""
    return results.agg(F.count("*").alias("source_count"), F.count_if(F.col("status") == "downloaded").alias("downloaded_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"))


def duplicate_groups(rows: DataFrame, digest: str = "sha256", id_col: str = "id") -> DataFrame:
    """(digest, n, first): contents that several ids have, with their number and the smallest id; null digests are none."""
    ids = rows.where(F.col(digest).isNotNull()).groupBy(digest, id_col).agg(F.lit(1).alias("_one"))
    return ids.groupBy(digest).agg(F.count("*").alias("n"), F.min(id_col).alias("first")).where("n > 1")


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """`rows` with batch: numbers from 0 of slices of `size` rows in order, for each key of `by`."""
    return ordered.numbered(rows, by, order, "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


#: Fields of the index with their attributes: k key, s searchable, f filterable, t sortable, c facetable.
INDEX_FIELDS = (
    ("id", "string", "kf"), ("content", "string", "s"), ("content_type", "string", "fc"), ("title", "string", "sf"), ("source_id", "string", "f"),
        ("source_url", "string", ""),
    ("blob_path", "string", ""), ("page", "int", "f"), ("page_end", "int", "f"), ("section", "string", "sf"), ("sheet", "string", "sf"),
        ("cell_range", "string", ""),
    ("published_date", "timestamp", "ft"), ("effective_from", "timestamp", "ft"), ("effective_to", "timestamp", "ft"), ("tax_year", "string", "fc"),
        ("document_version", "string", "f"),
    ("workflow_id", "string", "f"), ("authority_level", "string", "fc"), ("authority_rank", "int", "ft"), ("tax_types", "array<string>", "sfc"),
        ("taxpayer_types", "array<string>", "sfc"),
    ("language", "string", "fc"), ("status", "string", "fc"), ("supersedes", "array<string>", "f"), ("form_code", "string", "sf"),
        ("tags", "array<string>", "sfc"), ("source_hash", "string", "f"),
    ("chunk_hash", "string", "f"), ("image_id", "string", "f"), ("image_url", "string", ""), ("image_alt_text", "string", "s"),
        ("image_caption", "string", "s"), ("embedding", "array<float>", "s"),
)
_ATTRIBUTES = {"k": "key", "s": "searchable", "f": "filterable", "t": "sortable", "c": "facetable"}


def index_schema(dims: int, fields=INDEX_FIELDS):
    """The schema of an index table; attributes of a field, and the dimensions of the vector, are its metadata."""
    from pyspark.sql.types import StructField, StructType

    if dims < 1:
        raise ValueError("dimensions must be positive")
    out = []
    for name, kind, marks in fields:
        data = {_ATTRIBUTES[m]: True for m in marks} | ({"dimensions": dims} if name == "embedding" else {})
        out.append(StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType, name != "id", data))
    return StructType(out)


def index_rows(chunks: DataFrame, dims: int) -> DataFrame:
    """Chunks in the columns and types of `index_schema`; columns that they lack are null."""
    schema = index_schema(dims)
    return chunks.select(*[(F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name,
        metadata=f.metadata) for f in schema])


def iso_time(value: Column) -> Column:
    """A date or time as a text with a time: midnight UTC where it has none; null and empty give null."""
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.when(text.contains("T"), text).otherwise(F.concat(text, F.lit("T00:00:00Z")))


@dataclass(frozen=True)
class Settings:
    """Parameters of searches and answers with their bounds; see `bounds`."""

    timeout_seconds: int = 10
    max_output_tokens: int = 1024
    dimensions: int = 768
    min_score: float = 0.01
    initial_top: int = 24
    vector_k: int = 24
    image_top_k: int = 8
    max_evidence: int = 8
    max_images: int = 4
    max_message_chars: int = 8000
    max_history_messages: int = 12
    media_base_url: str = ""
    search_endpoint: str = ""
    search_key_present: bool = False
    model_key_present: bool = False

    #: Least and largest value of each number.
    bounds = {
        "timeout_seconds": (1, 120), "max_output_tokens": (64, 8192), "dimensions": (1, 3072), "min_score": (0, 1), "initial_top": (1, 100),
            "vector_k": (1, 100),
        "image_top_k": (1, 50), "max_evidence": (1, 24), "max_images": (1, 8), "max_message_chars": (100, 50_000), "max_history_messages": (1, 50),
    }

    def __post_init__(self):
        for name, (least, most) in self.bounds.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be from {least} to {most}")
        object.__setattr__(self, "media_base_url", self.media_base_url.rstrip("/"))

    @property
    def search_configured(self) -> bool:
        return bool(self.search_endpoint and self.search_key_present)

    def missing(self) -> list[str]:
        """Names, never values, of what has to be set before questions can be answered from the corpus."""
        found = {"search_endpoint": bool(self.search_endpoint), "search_key": self.search_key_present, "model_key": self.model_key_present}
        return [name for name, there in found.items() if not there]
