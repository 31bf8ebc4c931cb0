"""Guide images: provenance against the registry, chunks of approved images, facts of image files, publishing plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import checks as K
from corpusloom.functions.text import strip
from corpusloom.operators.sync import issues


def page_text(c: Column) -> Column:
    """One kind of line end, no blanks at line ends, no more than one empty line at once, trimmed; null is empty."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), r"[ \t\f\x0B]+(?=\n|$)", "")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def with_sources(images: DataFrame, sources: DataFrame) -> DataFrame:
    """Images with the registry row of their source as the struct `source`, null where there is none.

    sources: one row for each id. A left join by source id; neither side is collected or forced to be broadcast.
    """
    known = sources.select(F.col("id").alias("source_id"), F.struct(*sources.columns).alias("source"))
    return images.join(known, "source_id", "left")


def provenance_checks(base_url: str | None = None) -> dict[str, tuple[str, Column]]:
    """Of approved images joined by `with_sources`: what keeps an image from becoming a chunk."""
    c = F.col
    s = lambda name: c(f"source.{name}")
    known, pages = s("id").isNotNull(), s("render_pages")
    own_url = K.sure(c("source_url") == s("source_url")) | K.sure(c("source_url") == s("final_url"))
    found = {
        "PAGE_MISSING": c("page").isNull(), "SOURCE_UNKNOWN": ~known, "SOURCE_NOT_APPROVED": known & ~K.sure(s("review_status") == "approved"),
        "SOURCE_EXCLUDED": K.sure(s("status") == "excluded"), "SOURCE_URL_MISMATCH": known & ~own_url,
        "PAGE_NOT_RENDERED": K.sure(F.size(pages) > 0) & ~K.sure(F.array_contains(pages, c("page"))),
            "IMAGE_EXCLUDED": K.sure(c("status") == "excluded"),
        "PUBLIC_URL_INVALID": ~K.public_image(c("public_url"), F.lit(base_url.rstrip("/")) if base_url else None),
    }
    return {code: ("error", bad) for code, bad in found.items()}


def image_chunks(images: DataFrame, sources: DataFrame, base_url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, issues) of the approved images; drafts and rejected ones give neither.

    A chunk has the reviewed texts of its image, labels of the image or else of its source, and an id made of the
    image's and 24 digits of the chunk's hash. Images with an issue give no chunk.
    """
    c = F.col
    joined = with_sources(images.where(c("review_status") == "approved"), sources)
    checks = provenance_checks(base_url)
    bad = F.lit(False)
    for _, wrong in checks.values():
        bad = bad | wrong
    s = lambda name: c(f"source.{name}")
    none = F.expr("cast(array() as array<string>)")
    labels = lambda name: F.when(F.size(c(name)) > 0, c(name)).otherwise(F.coalesce(s(name), none))
    line = lambda label, value: F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(label), value.cast("string")))
    workflow = line("Workflow: ", c("workflow_id"))
    content = F.concat_ws("\n", "title", "alt_text", line("", c("caption")), workflow, line("Reviewed page text:\n", page_text(c("page_text"))))
    head = F.concat_ws("\n", F.concat(F.lit("Document: "), s("title")), line("Document type: ", s("document_type")),
        line("Tax type: ", F.array_join(labels("tax_types"), ", ")), line("Page: ", c("page")), workflow)
    place = F.concat_ws(":", "source_id", F.lit("page"), c("page").cast("string"), F.lit("image"), "image_id")
    rows = joined.where(~bad).select(
        "image_id", "source_id", "title", "source_url", "page", c("page").alias("page_end"), "workflow_id", "effective_from", "effective_to",
            "status",
        labels("tax_types").alias("tax_types"), labels("taxpayer_types").alias("taxpayer_types"), content.alias("content"), "source",
            place.alias("_place"),
        c("public_url").alias("image_url"), c("alt_text").alias("image_alt_text"), c("caption").alias("image_caption"),
    )
    digest = F.sha2(F.to_json(F.struct("content", c("_place").alias("locator"))), 256)
    out = rows.withColumn("chunk_hash", digest).select(
        F.concat(F.lit("guide-image-"), "image_id", F.lit("-"), F.substring("chunk_hash", 1, 24)).alias("id"),
            F.concat(head, F.lit("\n\n"), "content").alias("embedding_text"),
        F.lit("guide_image").alias("content_type"), s("authority_level").alias("authority_level"), s("authority_rank").alias("authority_rank"),
        s("sha256").alias("source_hash"), *[x for x in rows.columns if x not in ("source", "_place")], "chunk_hash",
    )
    return out, issues(joined, checks, "image_id")


def _byte(content: Column, at: int) -> Column:
    """The byte at a place from 0."""
    return F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("int")


def webp_facts(content: Column) -> Column:
    """struct<format, width, height> from the header of a WebP file of any of its three kinds; null for other files.

    Canvas and frame sizes stand at fixed places: 24 bits less one in the extended form, 14 bits in the lossy one,
    14 bits less one after another in the lossless one.
    """
    b = lambda at: _byte(content, at)
    text = lambda at: F.substring(content, at + 1, 4).cast("string")
    three = lambda at: b(at) + b(at + 1) * 256 + b(at + 2) * 65536 + 1
    two = lambda at: (b(at) + b(at + 1) * 256) % 16384
    size = lambda w, h: F.struct(F.lit("webp").alias("format"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    packed = F.shiftright(b(22), 6) + b(23) * 4 + (b(24) % 16) * 1024 + 1
    kind = (
        F.when(text(12) == "VP8X", size(three(24), three(27)))
        .when((text(12) == "VP8 ") & (F.hex(F.substring(content, 24, 3)) == "9D012A"), size(two(26), two(28)))
        .when((text(12) == "VP8L") & (b(20) == 0x2F), size(b(21) + (b(22) % 64) * 256 + 1, packed))
    )
    return F.when((text(0) == "RIFF") & (text(8) == "WEBP") & (F.length(content) >= 30), kind)


def image_files(files: DataFrame) -> DataFrame:
    """(file_name, file_sha256, file_bytes, file_format, file_width, file_height) of rows of a binary scan (path, length, content)."""
    facts = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_sha256"),
        F.col("length").alias("file_bytes"), webp_facts(F.col("content")).alias("f"))
    return facts.select("file_name", "file_sha256", "file_bytes", F.col("f.format").alias("file_format"), F.col("f.width").alias("file_width"),
        F.col("f.height").alias("file_height"))


def publish_plan(images: DataFrame, files: DataFrame, base_url: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, file_name, blob_name, public_url) of approved images whose file is what the manifest says, and issues.

    files: see `image_files`; a file is named after the image and 16 digits of its hash. Repeated ids are all issues.
    """
    c = F.col
    name = F.concat("image_id", F.lit("."), F.substring("binary_sha256", 1, 16), F.lit(".webp"))
    approved = images.where(c("review_status") == "approved").withColumn("file_name", name)
    twice = approved.groupBy("image_id").agg((F.count("*") > 1).alias("_twice"))
    joined = approved.join(files, "file_name", "left").join(twice, "image_id")
    there = c("file_sha256").isNotNull()
    differs = lambda said, real: there & ~K.sure(c(said) == c(real))
    checks = {
        "IMAGE_ID_REPEATED": c("_twice"), "IMAGE_EXCLUDED": K.sure(c("status") == "excluded"), "PAGE_MISSING": c("page").isNull(),
        "HASH_INVALID": K.unlike(c("binary_sha256"), K.SHA256), "FACTS_MISSING": c("byte_size").isNull() | c("width").isNull() | c("height").isNull(),
        "FILE_MISSING": ~there, "IMAGE_SIZE_MISMATCH": differs("byte_size", "file_bytes"),
            "IMAGE_HASH_MISMATCH": differs("binary_sha256", "file_sha256"),
        "IMAGE_FORMAT_MISMATCH": there & ~K.sure(c("file_format") == "webp"),
            "IMAGE_DIMENSIONS_MISMATCH": differs("width", "file_width") | differs("height", "file_height"),
    }
    bad = F.lit(False)
    for wrong in checks.values():
        bad = bad | wrong
    blob = F.concat(F.lit(f"{prefix.rstrip('/')}/"), "file_name")
    plan = joined.where(~bad).select("image_id", "file_name", blob.alias("blob_name"),
        F.concat(F.lit(f"{base_url.rstrip('/')}/"), blob).alias("public_url"))
    return plan, issues(joined, {code: ("error", x) for code, x in checks.items()}, "image_id")


def publish(plan: DataFrame, files: DataFrame, put, sleep=None) -> DataFrame:
    """(image_id, blob_name, public_url, kind): images of a `publish_plan` whose contents were put; kind is null, or how it failed.

    files: a binary scan (path, content); put(blob_name, content) runs on the executors, is retried as `upload` says and
    may be called again for the same blob after a lost task, so it has to replace what is there. Contents move from the
    scan to the provider and nowhere else.
    """
    import pandas as pd

    from corpusloom.operators import upload

    wait = {} if sleep is None else {"sleep": sleep}
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")

    def run(batches):
        for batch in batches:
            kinds = [upload.with_retries(lambda b=b, c=c: put(b, bytes(c)), **wait)[1] for b, c in zip(batch["blob_name"], batch["content"])]
            yield pd.DataFrame({"image_id": batch["image_id"], "blob_name": batch["blob_name"], "public_url": batch["public_url"],
                "kind": pd.Series(kinds, dtype=object)})

    return plan.join(named, "file_name").select("image_id", "blob_name", "public_url", "content").mapInPandas(run,
        "image_id string, blob_name string, public_url string, kind string")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Rendered candidates (source_id, page, image_id, ..) as JSON lines in the order of source, page and id."""
    from corpusloom.sources.files import write_jsonl

    write_jsonl(candidates, path, "source_id", "page", "image_id")


def image_step(images: DataFrame | None, sources: DataFrame, base_url: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(chunks, issues) of the images of a build for `corpus.build`; without a manifest neither."""
    from corpusloom.operators.corpus import issue_rows

    if images is None:
        return None, None
    chunks, found = image_chunks(images, sources, base_url)
    return chunks, issue_rows(found, F.lit(None), F.col("image_id"))
