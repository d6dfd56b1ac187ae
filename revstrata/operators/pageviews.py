"""Page-view series: decoding of compact lines, sums, joins with ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revstrata.functions import titles as T


def parsed(lines: DataFrame, project: str = "en.z", language: str = "en", longest: int = 50, column: str = "value") -> DataFrame:
    """(title, total, compact) of `project title total compact`; other projects, non-articles and undecodable or long titles go."""
    part = F.split(column, " ")
    rows = lines.where(F.lower(F.substring_index(column, " ", 1)) == project).select(T.decoded(F.get(part, F.lit(1))).alias("raw"), F.get(part, F.lit(2)).try_cast("bigint").alias("total"), F.get(part, F.lit(3)).alias("compact"))
    rows = rows.where(F.col("raw").isNotNull() & (F.length("raw") <= longest) & T.is_article(F.col("raw"), language))
    return rows.select(T.normalised(F.col("raw")).alias("title"), "total", "compact").where("title <> '' and compact is not null")


def daily(parsed_: DataFrame) -> DataFrame:
    """(title, day, views), added over lines of the same title."""
    rows = parsed_.select("title", F.explode(T.day_segments(F.col("compact"))).alias("s"))
    return rows.select("title", F.col("s.day").alias("day"), T.day_total(F.col("s.hours")).alias("v")).groupBy("title", "day").agg(F.sum("v").alias("views"))


def hourly(parsed_: DataFrame) -> DataFrame:
    """(title, day, hour, views)."""
    rows = parsed_.select("title", F.explode(T.day_segments(F.col("compact"))).alias("s"))
    rows = rows.select("title", F.col("s.day").alias("day"), F.inline(T.hour_counts(F.col("s.hours"))))
    return rows.groupBy("title", "day", "hour").agg(F.sum("views").alias("views"))


def daily_series(parsed_: DataFrame, days: int = 31) -> DataFrame:
    """(title, total, series): an array of `days` sums. Lines become fixed arrays in their row and are added slot by slot, so the
    sums are partial before the one shuffle."""
    e = F.transform(T.day_segments(F.col("compact")), lambda s: F.struct((s["day"] - 1).alias("slot"), T.day_total(s["hours"]).alias("views")))
    return summed(parsed_.select("title", "total", T.fixed_series(e, days).alias("series")), days)


def hourly_series(parsed_: DataFrame, days: int = 31) -> DataFrame:
    """(title, total, series) of 24 slots a day."""
    e = F.flatten(F.transform(T.day_segments(F.col("compact")), lambda s: F.transform(T.hour_counts(s["hours"]), lambda h: F.struct(((s["day"] - 1) * 24 + h["hour"]).alias("slot"), h["views"].alias("views")))))
    slots = parsed_.select("title", "total", e.alias("e"))
    long = slots.select("title", F.inline("e")).groupBy("title", "slot").agg(F.sum("views").alias("views"))
    packed = long.groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("slot", "views"))).alias("m"))
    totals = slots.groupBy("title").agg(F.sum("total").alias("total"))
    series = F.transform(F.sequence(F.lit(0), F.lit(24 * days - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("bigint"))
    return totals.join(packed, "title", "left").select("title", "total", series.alias("series"))


def summed(series: DataFrame, width: int, keys: tuple[str, ...] = ("title",)) -> DataFrame:
    """(keys, total, series): arrays of a fixed width added element by element."""
    sums = [F.sum(F.coalesce(F.get("series", F.lit(i)), F.lit(0))).alias(f"s{i}") for i in range(width)]
    rows = series.groupBy(*keys).agg(F.sum("total").alias("total"), *sums)
    return rows.select(*keys, "total", F.array(*[f"s{i}" for i in range(width)]).alias("series"))


def with_ids(series: DataFrame, ids: DataFrame) -> DataFrame:
    """Series by page id: titles join the id map (of equal titles the greatest id)."""
    one = ids.groupBy("title").agg(F.max("page_id").alias("page_id"))
    return series.join(one, "title")
