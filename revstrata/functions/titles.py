"""Titles of page-view records: normalisation and filters; and decoding of the compact series of counts."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANYWHERE = ["//upload", "Wikipedia#", "Wikipedia/", "Wikipedia:", "hr:", "hu:", "simple:", *(f"http{s}://" for s in ("", "s"))]
_ENGLISH = "Category File Help Portal Portal_talk Special Talk Template Translate User".split()
_GERMAN = "Benutzer Datei Diskussion Hilfe Kategorie Portal Spezial Vorlage".split()
#: Begins of titles of namespaces and languages that have no articles, by language of the project, sorted.
NOT_ARTICLES = {
    "en": sorted([*_ANYWHERE, *(f"{x}:" for x in _ENGLISH), *(f"/{x}:" for x in ("File", "Template", "Template_talk", "Wikipedia_talk"))]),
    "de": sorted([*_ANYWHERE, *(f"{x}:" for x in _GERMAN)]),
}
_EITHER_CASE = "bmp css gif jpg ogg php svg txt".split()
#: Endings of files and of service pages.
FILE_ENDINGS = sorted({f".{e}" for e in _EITHER_CASE} | {f".{e.upper()}" for e in _EITHER_CASE} | {".html", ".ogv", ".webm", "HTML"})


def _any(parts: list[str]) -> str:
    return "(?:" + "|".join("".join("\\" + c if not c.isalnum() and c not in "_/:" else c for c in p) for p in parts) + ")"


def is_article(title: Column, language: str = "en") -> Column:
    """Neither a namespace's page nor a talk page, file or service page."""
    return ~title.rlike("^" + _any(NOT_ARTICLES[language])) & ~title.rlike(_any(FILE_ENDINGS) + "$") & ~title.contains("/Talk:")


def decoded(title: Column) -> Column:
    """Percent escapes and + undone; null if they aren't valid."""
    return F.try_url_decode(title)


def normalised(title: Column) -> Column:
    """Cut at # and &, one leading # or _ and one trailing _ dropped, quotes or wiki/ dropped, runs of blanks as _, first letter A-Z.

    A title of quotes only is the empty string.
    """
    t = title
    for pattern, kept in ((r"(?s)^([^#]+)#.*$", "$1"), (r"(?s)^([^&]+)&.*$", "$1"), (r"^[#_]", ""), (r"_$", "")):
        t = F.regexp_replace(t, pattern, kept)  # each step names the one before once, so the expression stays small

    def unquoted(x: Column) -> Column:
        inside = lambda n: F.substring(x, F.lit(n + 1), F.greatest(F.length(x) - 2 * n, F.lit(0)))
        out = F.when(x.startswith("'''") & x.endswith("'''"), inside(3)).when(x.startswith("''") & x.endswith("''"), inside(2))
        out = out.when(x.startswith('"') & x.endswith('"'), inside(1))
        return out.when(x.startswith("wiki/"), F.substring(x, F.lit(6), F.length(x))).otherwise(x)

    t = F.get(F.transform(F.array(t), unquoted), F.lit(0))
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+", "_")
    capital = lambda x: F.concat(F.translate(F.substring(x, 1, 1), string.ascii_lowercase, string.ascii_uppercase), F.substring(x, F.lit(2), F.length(x)))
    return F.get(F.transform(F.array(t), capital), F.lit(0))


def day_segments(compact: Column) -> Column:
    """array<struct<day, hours>>: day 1..31 and its hour counts as text."""
    segments = F.filter(F.split(compact, ","), lambda s: s.rlike(r"^[A-_]"))
    return F.transform(segments, lambda s: F.struct((F.ascii(s) - 64).alias("day"), F.substring(s, F.lit(2), F.length(s)).alias("hours")))


def hour_counts(hours: Column) -> Column:
    """array<struct<hour, views>> of A12B3...; a missing count (?) is left out."""
    items = F.regexp_extract_all(hours, F.lit(r"[A-X][0-9]+"), F.lit(0))
    return F.transform(items, lambda x: F.struct((F.ascii(x) - 65).alias("hour"), F.substring(x, F.lit(2), F.length(x)).cast("bigint").alias("views")))


def day_total(hours: Column) -> Column:
    return F.aggregate(hour_counts(hours), F.lit(0).cast("bigint"), lambda a, x: a + x["views"])


def fixed_series(entries: Column, width: int) -> Column:
    """array<bigint> of `width` slots from array<struct<slot, views>>, slots from 0, absent ones 0, repeated ones added."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(entries, lambda e: e["slot"] == i), F.lit(0).cast("bigint"), lambda a, e: a + e["views"]))
