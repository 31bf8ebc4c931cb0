"""The registry: rows of download manifests, classified by ordered rules, deduplicated by content and given ids.

The rules are data (`vocab`-like tables below, all parameters): the first rule that fits decides. Everything is
native; a registry is planned by two aggregations by hash and by url and the id windows of `sync.unique_ids`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import checks as K
from corpusloom.functions import vocab
from corpusloom.functions.text import file_period, slug, strip
from corpusloom.operators import sync

WORKBOOK = "application/vnd.ms-excel.sheet.macroEnabled.12"
MEDIA = ("application/pdf", "text/html", WORKBOOK)
#: Hosts whose files are taken.
HOSTS = ("www.ird.gov.lk", "ird.gov.lk", "eservices.ird.gov.lk")
#: Fixed values: (pattern, what it is matched with, media type or None, document type, authority); the first wins.
KINDS = (
    ("acts_|_acts/|/acts/", "path", None, "act", "legislation"),
    ("gazette", "path", None, "gazette", "gazette"),
    ("circular", "path", None, "circular", "official_circular"),
    ("latest%20news|latest news|/pn_", "text", None, "public_notice", "official_notice"),
    ("tax_calendar|tax calendar", "text", None, "tax_calendar", "official_calendar"),
    ("", "text", WORKBOOK, "spreadsheet_template", "official_form"),
    ("eservices", "path", "application/pdf", "portal_guide", "official_guide"),
    ("", "text", "text/html", "official_webpage", "official_webpage"),
    ("guide|guideline|quick guide|tax table", "text", None, "return_guide", "official_guide"),
    ("/forms_|/asmt_|/downloads/it_", "path", None, "return_form", "official_form"),
    ("return", "text", None, "return_form", "official_form"),
)
OTHER_KIND = ("official_webpage", "official_webpage")
#: Label of each pattern, in order.
TAX_PATTERNS = {
    "apit": "apit", "wht": "wht", "vat": "vat", "sscl": "sscl", "stamp_duty": "stamp|sd[_-]", "corporate_income_tax": "(?<![a-z])cit(?![a-z])",
    "partnership_income_tax": "(?<![a-z])pit(?![a-z])", "individual_income_tax": "(?<![a-z])iit(?![a-z])", "income_tax": "income",
}
TAXPAYER_PATTERNS = {"individual": "individual|iit", "company": "corporate|cit", "partnership": "partnership|pit"}
LANGUAGES = {"si": r"/si/|_s\.(?:pdf|html?)$", "ta": "/ta/"}
FORM_CODE = r"(?<![A-Z])(ASMT_[A-Z]+_\d{3}|APIT_T\d+|SSCL_\d+|CLR_\d{3}_[A-Z]|RFN_[A-Z]+_\d+)(?![A-Z0-9])"
#: Fixed value: the period before which guides are historical.
CURRENT_PERIOD = "2025/2026"


def signature(content: Column) -> Column:
    """pdf, xlsm, html or unknown, from a file's bytes; archives by the member names that zip directories spell out."""
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"^[ \t\n\r\x0b\x0c]+", ""))
    member = lambda name: F.contains(content, F.lit(name.encode()))
    first = lambda n: F.hex(F.substring(content, 1, n))
    book = (first(2) == "504B") & member("[Content_Types].xml") & member("xl/workbook.xml")
    return F.when(first(4) == "25504446", "pdf").when(book, "xlsm").when(head.rlike("^(?:<!doctype|<html|<[?]xml|<head|<body)"),
        "html").otherwise("unknown")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_title(url: Column, host_default: str = "Official webpage") -> Column:
    """The last part of a url's path as words, else its host."""
    last = F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(url_path(url), r"([^/]+)/*$", 1), F.lit("+"), F.lit("%2B"))),
        F.regexp_extract(url_path(url), r"([^/]+)/*$", 1))
    words = strip(F.regexp_replace(F.regexp_replace(F.when(last != "", last).otherwise(K.host(url)), r"(?i)\.(?:pdf|xlsm|aspx?|html?)$", ""), "[_-]+",
        " "))
    return F.coalesce(F.nullif(words, F.lit("")), F.lit(host_default))


def labels(text: Column, patterns: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())


def classify(rows: DataFrame, url: str = "source_url", media_type: str = "media_type", title: str = "title", kinds=KINDS) -> DataFrame:
    """`rows` with type, authority and its rank, language, period, version, form code, labels and status."""
    text, path = F.lower(F.concat_ws(" ", url, title)), F.lower(url_path(F.col(url)))

    def cascade(k: int) -> Column:
        fits = lambda p, of, media: ((path if of == "path" else text).rlike(p) if p else F.lit(True)) & (F.col(media_type) == media if media else F.lit(True))
        out = F
        for rule in kinds:
            out = out.when(K.sure(fits(*rule[:3])), F.lit(rule[3 + k]))
        return out.otherwise(F.lit(OTHER_KIND[k]))

    ranks = F.create_map(*[F.lit(x) for kv in vocab.AUTHORITY_RANKS.items() for x in kv])
    language = reduce(lambda c, kv: c.when(path.rlike(kv[1]), F.lit(kv[0])), LANGUAGES.items(), F).otherwise("en")
    version = F.regexp_extract(text, r"\b(v\s*[0-9]+(?:[._-][0-9]+)*)\b", 1)
    found = rows.withColumns({"document_type": cascade(0), "authority_level": cascade(1), "tax_year": file_period(text)})
    old = (F.col("document_type") == "portal_guide") & (F.col("tax_year") < CURRENT_PERIOD)
    return found.withColumns({
        "authority_rank": F.try_element_at(ranks, F.col("authority_level")), "language": language,
        "document_version": F.nullif(F.regexp_replace(version, r"\s+", ""), F.lit("")),
            "form_code": F.nullif(F.regexp_extract(F.upper(text), FORM_CODE, 1), F.lit("")),
        "tax_types": labels(text, TAX_PATTERNS), "taxpayer_types": labels(text, TAXPAYER_PATTERNS),
            "status": F.when(K.sure(old), "historical").otherwise("current"),
    })


def manifest_rows(manifests: list[DataFrame]) -> DataFrame:
    """Rows of manifests, each a DataFrame with one `sources` array, with `position`: (number of the manifest, of the row)."""
    flat = [m.select(F.posexplode("sources").alias("_p", "s")).select(F.struct(F.lit(k).alias("m"), F.col("_p").alias("p")).alias("position"),
        "s.*") for k, m in enumerate(manifests)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)


def build(items: DataFrame, hosts=HOSTS, titles: DataFrame | None = None, prefix: str = "ird-", broken_url: str | None = None) -> DataFrame:
    """Registry rows of manifest rows (position, url, final_url, status, content_type, sha256, local_file).

    Rows of other hosts, failed downloads, other media and malformed hashes go, but for `broken_url`: the workbook
    whose answer was a web page stays as an excluded row. Of equal contents the first row stays, with the urls of
    the others as aliases. `titles` (url, title) is joined by url. Null urls, statuses and hashes drop a row.
    """
    broken = K.sure((F.col("url") == broken_url) & (F.coalesce("status", F.lit("")) != "downloaded")) if broken_url else F.lit(False)
    media = F.split(F.coalesce("content_type", F.lit("")), ";")[0]
    own = items.withColumns({"broken": broken, "media_type": F.when(broken, WORKBOOK).otherwise(media)}).where(
        K.sure(K.host(F.col("url")).isin(list(hosts))) & (broken | K.sure(F.col("status") == "downloaded")) & K.sure(F.col("sha256").rlike(K.SHA256)))
    # a repeated content is an alias of the first row of a medium that is read
    usable = own.where(F.col("broken") | F.col("media_type").isin(*MEDIA))
    row = F.struct("url", "final_url", "media_type", "local_file")
    first = usable.where("NOT broken").groupBy("sha256").agg(F.min("position").alias("position"), F.min_by(row, "position").alias("r"))
    urls = own.where("NOT broken").groupBy("sha256", "url").agg(F.min("position").alias("at"))
    others = urls.join(first.select("sha256", F.col("position").alias("_first"), F.col("r.url").alias("_url")),
        "sha256").where("url <> _url AND at > _first")
    aliases = others.groupBy("sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda s: s["url"]).alias("aliases"))
    none = F.expr("cast(array() as array<string>)")
    kept = first.select("sha256", "position", "r.*", F.lit(False).alias("broken")).join(aliases, "sha256", "left").withColumn("aliases",
        F.coalesce("aliases", none))
    rows = kept.unionByName(usable.where("broken").select("sha256", "position", "url", "final_url", "media_type", "local_file", "broken",
        none.alias("aliases")))
    named = rows.withColumn("title", url_title(F.col("url")))
    if titles is not None:
        known = titles.groupBy("url").agg(F.last("title").alias("_title"))
        named = named.join(known, "url", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")
    done = classify(named.withColumnRenamed("url", "source_url").withColumn("_slug", slug(F.concat(F.lit(prefix), "title"))))
    out = F.col("broken") | (F.col("language") != "en")
    reason = F.when(F.col("broken"), "The workbook's url answered with a web page.").when(F.col("language") != "en",
        "Kept in the registry; its language is not one of the corpus.")
    full = sync.unique_ids(done, "_slug", "sha256", "position").withColumns({
        "status": F.when(out, "excluded").otherwise(F.col("status")), "review_status": F.when(F.col("broken"), "rejected").otherwise("approved"),
            "exclusion_reason": reason,
        "media_type": F.when(F.col("broken"), "text/html").otherwise(F.col("media_type")),
            "final_url": F.when(F.col("final_url") != F.col("source_url"), F.col("final_url")),
        "jurisdiction": F.lit("LK"),
    })
    return full.drop("_slug", "broken")


#: Characters of the parts of slugs by which failed files and pages meet; shorter slugs meet by all their characters.
GRAM = 5


def _grams(c: Column, n: Column) -> Column:
    """The different parts of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))


def containing(keys: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(key, text) where text contains key. keys: (key), texts: (text), each value once, none of them null or empty.

    A key and a text that contains it share each part of `gram` characters of the key (or the key, if it is shorter).
    They meet by the part of the key that the fewest texts have, and the pair is checked; keys with a part that no
    text has meet none. No list of keys goes to the driver or into a plan.
    """
    n = F.least(F.length("key"), F.lit(gram))
    sized = keys.select("key", n.alias("n"))
    parts = sized.select("key", "n", F.explode(_grams(F.col("key"), F.col("n"))).alias("part"))
    lengths = sized.select("n").distinct()  # at most `gram` rows
    seen = texts.join(F.broadcast(lengths), F.length("text") >= F.col("n")).select("text", F.explode(_grams(F.col("text"), F.col("n"))).alias("part"))
    counts = seen.groupBy("part").agg(F.count("*").alias("texts"))
    rarest = parts.join(counts, "part", "left").groupBy("key").agg(F.min_by("part", F.struct(F.coalesce("texts", F.lit(0)), "part")).alias("part"))
    met = seen.join(rarest, "part")
    return met.where(F.contains("text", F.col("key"))).select("key", "text")


def error_snapshots(failed: DataFrame, pages: DataFrame) -> DataFrame:
    """Failed urls with the first captured page (path) whose slug holds that of the url's file name, or null.

    Pages of one slug are one page, the first; slugs have at least three characters.
    """
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(F.try_url_decode(url_path(F.col("url"))), F.lit("")), r"([^/]+)/*$", 1), r"\.[^.]*$", "")
    wanted = failed.select("url", slug(stem, 70).alias("key")).distinct()
    name = slug(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), 100)
    captured = pages.where("path is not null").select("path", name.alias("text")).groupBy("text").agg(F.min("path").alias("path"))
    pairs = containing(wanted.select("key").distinct(), captured.select("text"))
    first = pairs.join(captured, "text").groupBy("key").agg(F.min("path").alias("path"))
    return wanted.join(first, "key", "left").drop("key")
