"""Strings, tokens and domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels that are known; any other suffix is the last label. A short list, to be extended by the caller.
SUFFIXES = tuple(f"{a}.{b}" for b in ("uk", "jp", "kr", "nz", "za", "il", "th", "id") for a in ("ac", "co", "go", "or", "org", "net", "gov")) + (
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "com.br", "net.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "com.mx", "com.tr", "com.ar", "com.sg", "com.hk", "com.tw", "co.in", "github.io", "blogspot.com",
)


def cut_last(s: Column, n: int | Column) -> Column:
    """s without its last n characters; the empty string if it has fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.left(s, F.greatest(F.length(s) - n, F.lit(0)))


def domain(url: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain, a tab and its public suffix; null for what isn't a URL with such a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    n = F.when(two.isin(*suffixes), 2).otherwise(1)
    ok = (F.size(labels) > n) & host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$") & ~host.rlike(r"^[0-9.]+$")
    return F.when(ok, F.concat(F.array_join(F.slice(labels, -(n + 1), n + 1), "."), F.lit("\t"), F.array_join(F.slice(labels, -n, n), ".")))


def tokens(text: Column, analyzer: str = "lower") -> Column:
    """Tokens between white space, none empty. "plain" as they are, "lower" in lower case, "letters" runs of letters in lower
    case, "stop" those without frequent English words."""
    if analyzer == "plain":
        return F.filter(F.split(text, r"\s+"), lambda x: x != "")
    if analyzer == "lower":
        return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    if analyzer == "letters":
        return words
    if analyzer == "stop":
        return F.filter(words, lambda x: ~x.isin(*"a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()))
    raise ValueError(f"unknown analyzer {analyzer}")


def paragraphs(text: Column) -> Column:
    """Lines without the blank ones and without leading white space."""
    return F.filter(F.split(text, r"\n\s*"), lambda x: x != "")


def sentence_words(text: Column) -> Column:
    """array<array<string>>: words by sentence."""
    return F.sentences(text)


def change_score(length: Column, before: Column, minor: Column | None = None) -> Column:
    """Relative change of length: 1 if there was nothing before, else 0.0005 for a minor edit."""
    score = F.when(F.coalesce(before, F.lit(0)) == 0, F.lit(1.0))
    score = score if minor is None else score.when(minor, F.lit(0.0005))
    return score.otherwise(F.abs(length - before).cast("double") / before.cast("double"))


def request_parts(request: Column) -> Column:
    """struct<method, resource, protocol> of a request line; - and the empty string are null."""
    part = F.split(request, " ")
    get = lambda i: F.nullif(F.nullif(F.get(part, F.lit(i)), F.lit("-")), F.lit(""))
    return F.struct(get(0).alias("method"), get(1).alias("resource"), get(2).alias("protocol"))
