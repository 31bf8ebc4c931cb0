"""Functions of urls and file names, as columns. Null urls give null or an empty text, as said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.checks import host, sure, url_part
from corpusloom.functions.text import slug, strip


def official(url: Column, root: str) -> Column:
    """Whether a url is https and its host is `root` or below it; false for null."""
    return sure((F.lower(url_part(url, "PROTOCOL")) == "https") & ((host(url) == root) | host(url).endswith(f".{root}")))


def absolute(href: Column, base: Column) -> Column:
    """`href` seen from the page `base`: whole urls stay, `//host`, `/path`, `?query` and relative paths are completed, dots in
    paths are followed. Null if there is no base to complete it."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    own = F.regexp_extract(href, "^([^?#]*)", 1)
    rest = F.substring(href, F.length(own) + 1, F.length(href))
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    parts = F.slice(F.split(joined, "/"), 2, F.size(F.split(joined, "/")))

    def climb(stack: Column, p: Column) -> Column:
        return F.when(p == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(p == ".",
            stack).otherwise(F.concat(stack, F.array(p)))

    walked = F.aggregate(parts, F.expr("cast(array() as array<string>)"), climb)
    folder_end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    relative = F.concat(origin, F.lit("/"), F.array_join(walked, "/"), folder_end, rest)
    plain = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(origin == "", F.lit(None)).when(href == "", plain)
        .when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("#"), F.concat(plain, href))
        .when(href.startswith("?"), F.concat(origin, path, href)).otherwise(relative)
    )


def safe_stem(url: Column) -> Column:
    """A file name without its extension: host, path and query in letters, digits, `.`, `_` and `-`, at most 150
    characters, and 10 digits of the url's hash."""
    raw = F.coalesce(url_part(url, "AUTHORITY"), F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "^/+|/+$", "")
    query = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*[?]([^#]*)", 1), "&"), lambda kv: kv.rlike("=."))
    pair = lambda x: F.concat_ws("-", *[F.coalesce(F.try_url_decode(p), p) for p in (F.substring_index(x, "=", 1),
        F.substr(x, F.locate("=", x) + F.lit(1)))])
    named = F.concat_ws("-", raw, F.replace(F.when(path == "", "index").otherwise(path), F.lit("/"), F.lit("-")),
        F.nullif(F.array_join(F.transform(query, pair), "-"), F.lit("")))
    clean = F.lower(F.regexp_replace(F.regexp_replace(named, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", ""))
    return F.concat(F.substring(clean, 1, 150), F.lit("-"), F.substring(F.sha2(url, 256), 1, 10))


#: Extensions of media types besides PDF and HTML.
EXTENSIONS = {
    "text/plain": ".txt", "text/csv": ".csv", "text/css": ".css", "text/xml": ".xml", "application/xml": ".xml", "application/json": ".json",
        "application/zip": ".zip",
    "application/msword": ".doc", "application/vnd.ms-excel": ".xls", "application/vnd.ms-powerpoint": ".ppt", "image/png": ".png",
        "image/jpeg": ".jpg",
    "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "application/octet-stream": ".bin",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
}


def extension(url: Column, content_type: Column, known: dict[str, str] | None = None) -> Column:
    """The extension of a download: `.pdf` and `.html` by type (or the url's path), else by `known`, else `.bin`."""
    media = F.lower(strip(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    path = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in (known or EXTENSIONS).items() for x in kv])
    return (
        F.when((media == "application/pdf") | path.endswith(".pdf"), ".pdf").when(media.isin("text/html", "application/xhtml+xml"), ".html")
        .otherwise(F.coalesce(F.try_element_at(table, media), F.lit(".bin")))
    )


def source_id_of(path: Column) -> Column:
    """The id of a file without a registry row: the slug of its name without the extension, at most 100 characters."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return slug(stem, 100, default="source")


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its folder: absolute, with a backslash or NUL, or with more `..` than folders before
    them. Null does not."""
    parts = F.split(path, "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")), lambda s, p: F.struct(
        (s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
        F.least(s["least"], s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("least")), lambda s: s["least"])
    return sure(path.rlike(r"^/|\\|\x00") | (depth < 0))
