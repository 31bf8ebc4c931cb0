"""Boolean columns that constraints are made of. Each is true where the value is wrong, and never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

#: Patterns of the record contracts.
SLUG, SHA256, PERIOD = r"^[a-z0-9]+(?:-[a-z0-9]+)*$", "^[0-9a-f]{64}$", r"^20\d{2}/20\d{2}$"


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | sure(strip(c) == "")


def unlike(c: Column, pattern: str) -> Column:
    """A value that does not match; null counts as wrong."""
    return ~sure(c.rlike(pattern))


def unlike_if_any(c: Column, pattern: str) -> Column:
    return c.isNotNull() & ~sure(c.rlike(pattern))


def not_https(c: Column, needed: bool = True) -> Column:
    return (unlike if needed else unlike_if_any)(c, r"(?i)^https://[^/?#\s]+")


def any_unlike(c: Column, pattern: str) -> Column:
    """An array with a member that does not match, or is null."""
    return sure(F.exists(c, lambda x: unlike(x, pattern)))


def any_blank(c: Column) -> Column:
    return sure(F.exists(c, blank))


def repeats(c: Column) -> Column:
    return sure(F.size(F.array_distinct(c)) < F.size(c))


def before(later: Column, earlier: Column) -> Column:
    """Both known, and the later one comes first."""
    return sure(later < earlier)


def rank_differs(level: Column, rank: Column, ranks: dict[str, int]) -> Column:
    """A known level whose rank is known and not that of `ranks`."""
    expected = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return level.isNotNull() & rank.isNotNull() & ~sure(F.try_element_at(expected, level) == rank)


def not_counted(c: Column) -> Column:
    """Numbers that are not 1, 2, .. in order."""
    return sure(F.size(c) > 0) & ~sure(c.cast("array<int>") == F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))))


def url_part(c: Column, part: str) -> Column:
    return F.try_parse_url(c, F.lit(part))


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(url_part(c, "HOST")), r"\.$", "")


def under(url: Column, base: Column) -> Column:
    """Whether a url has the scheme and authority of `base`, no user, and a path at or below that of it."""
    path, root = F.coalesce(url_part(url, "PATH"), F.lit("")), F.regexp_replace(F.coalesce(url_part(base, "PATH"), F.lit("")), "/+$", "")
    same = (url_part(url, "PROTOCOL") == url_part(base, "PROTOCOL")) & (url_part(url, "AUTHORITY") == url_part(base, "AUTHORITY"))
    climbs = path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)")
    return sure(same & url_part(url, "USERINFO").isNull() & ~climbs & ((path == root) | path.startswith(F.concat(root, F.lit("/")))))


def public_image(url: Column, base: Column | None = None) -> Column:
    """Whether a url is an https one of a .webp file, without user, query and fragment, and below `base` if given."""
    good = url.rlike(r"(?i)^https://") & url_part(url, "HOST").isNotNull() & F.lower(url_part(url, "PATH")).endswith(".webp")
    bare = url_part(url, "USERINFO").isNull() & url_part(url, "QUERY").isNull() & url_part(url, "REF").isNull()
    return sure(good & bare) & (under(url, base) if base is not None else F.lit(True))
