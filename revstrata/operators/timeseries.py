"""Co-occurrence counts and dense time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def destination_counts(events: DataFrame) -> DataFrame:
    """(src, day, dest, n) of (src, dest, day)."""
    return events.groupBy("src", "day", "dest").agg(F.count("*").alias("n"))


def cooccurrence(counts: DataFrame) -> DataFrame:
    """(pair, day, weight): for each source and day, pairs of destinations a@@b with a < b weigh the lesser of their counts; added
    over sources. Both sides of the join are one exchange by (src, day), which AQE splits where it is skewed."""
    c = counts.repartition("src", "day")
    a, b = c.alias("a"), c.alias("b")
    joined = a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.dest") < F.col("b.dest")))
    rows = joined.select(F.concat("a.dest", F.lit("@@"), "b.dest").alias("pair"), F.col("a.day").alias("day"), F.least("a.n", "b.n").alias("w"))
    return rows.groupBy("pair", "day").agg(F.sum("w").alias("weight"))


def dense(series: DataFrame, begin: str, end: str, key: str = "pair", value: str = "weight") -> DataFrame:
    """(key, series): a value for each day of [begin, end), 0 where there is none. Width is the window's, whatever the input."""
    inside = series.where((F.col("day") >= F.lit(begin).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
    m = F.map_from_entries(F.collect_list(F.struct("day", value)))
    days = F.expr(f"sequence(DATE'{begin}', DATE'{end}' - INTERVAL 1 DAY, INTERVAL 1 DAY)")
    return inside.groupBy(key).agg(m.alias("m")).select(key, F.transform(days, lambda d: F.coalesce(F.try_element_at("m", d.cast("date")), F.lit(0)).cast("bigint")).alias("series"))


def flat(series: DataFrame, key: str = "pair", value: str = "weight") -> DataFrame:
    """(key, day, value), sorted by key and day within partitions of the key."""
    return series.select(key, "day", value).repartition(key).sortWithinPartitions(key, "day")
