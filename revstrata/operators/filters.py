"""Predicates and projections over revisions; each is one narrow step that the scan can take over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revstrata.functions.dates import millis


def article_only(df: DataFrame, namespace: str = "page_namespace") -> DataFrame:
    return df.where(F.col(namespace) == 0)


def without_redirects(df: DataFrame, redirect: str = "redirect") -> DataFrame:
    return df.where(F.col(redirect).isNull())


def time_window(df: DataFrame, begin: str | int | None = None, end: str | int | None = None, ms: str = "ts_ms") -> DataFrame:
    """begin <= time < end; bounds as epoch milliseconds or ISO 8601."""
    if begin is not None:
        df = df.where(F.col(ms) >= millis(begin))
    return df if end is None else df.where(F.col(ms) < millis(end))


def strict_window(df: DataFrame, begin: str | int, end: str | int, ms: str = "ts_ms") -> DataFrame:
    """begin < time < end."""
    return df.where((F.col(ms) > millis(begin)) & (F.col(ms) < millis(end)))


def min_bytes(df: DataFrame, n: int = 10, length: str = "length") -> DataFrame:
    return df.where(F.col(length) >= n)


def length_bounds(df: DataFrame, text: str = "text", least: int = 11, most: int = 1 << 49) -> DataFrame:
    return df.where(F.length(text).between(least, most))


def complete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that have every field."""
    return df.dropna("any", subset=columns or df.columns)


def project(df: DataFrame, name: str = "en.z", column: str = "project") -> DataFrame:
    return df.where(F.lower(column) == name)


def non_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(column) != "")


def accepted_namespace(prefix: Column) -> Column:
    return F.lower(prefix).isin("w", "wikt", "wiktionary")


def bernoulli(df: DataFrame, share: float = 0.33, seed: int = 7) -> DataFrame:
    """Each row is kept with probability `share`."""
    return df.sample(share, seed)


def hashed_sample(df: DataFrame, key: str, share: float = 0.33) -> DataFrame:
    """Rows whose key falls into a share of its hashes: the same ones whenever it is computed again."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32)))


def mended_timestamps(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, rest) of lines whose first 13 characters are a timestamp, with or without a tab after it; others go."""
    ts = F.substring(column, 1, 13).try_cast("bigint")
    return lines.select(ts.alias("ts"), F.ltrim(F.substring(F.col(column), F.lit(14), F.length(column)), F.lit("\t")).alias("rest")).where("ts is not null")


def in_range(value: Column, low, high) -> Column:
    """low <= value <= high."""
    return value.between(low, high)


def seeds(df: DataFrame, ids: DataFrame, key: str = "page_id", anti: bool = False) -> DataFrame:
    """Rows whose key is (with anti: isn't) among the seeds; Spark broadcasts the seeds if their size allows."""
    return df.join(ids.select(F.col(ids.columns[0]).alias("__seed")).distinct(), F.col(key) == F.col("__seed"), "left_anti" if anti else "left_semi")
