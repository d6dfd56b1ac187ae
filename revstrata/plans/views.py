"""Inputs of the operators, derived from the given tables: revisions, wiki text, anchors, clicks, page-view lines.

Twenty documents in a row are the revisions of a page, so the number of pages follows the input. The SQL in SQL_* makes the same
rows in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1293840001000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions_of(docs: DataFrame) -> DataFrame:
    """(page_id, rev_id, parent_id, ts_ms, ns, title, length, minor, text) of documents."""
    page = F.expr("doc_id div 20")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        page.alias("page_id"), (F.col("doc_id") + 1).alias("rev_id"), F.when(F.col("doc_id") % 20 > 0, F.col("doc_id")).otherwise(0).alias("parent_id"),
        (F.lit(EPOCH) + F.col("doc_id") % 20 * 432000000 + F.col("doc_id") % 997 * 60000).alias("ts_ms"), F.when(page % 10 == 0, 1).otherwise(0).alias("ns"),
        F.concat(F.lit("Page_"), page.cast("string")).alias("title"), F.octet_length(text).cast("bigint").alias("length"), (F.col("doc_id") % 7 == 0).alias("minor"), text.alias("text"), "source", "lang",
    )


def rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions_of(table(spark, sf_dir, "documents"))


SQL_REV = f"""rev AS (SELECT doc_id // 20 AS page_id, doc_id + 1 AS rev_id, CASE WHEN doc_id % 20 > 0 THEN doc_id ELSE 0 END AS parent_id,
 {EPOCH} + doc_id % 20 * 432000000 + doc_id % 997 * 60000 AS ts_ms, CASE WHEN doc_id // 20 % 10 = 0 THEN 1 ELSE 0 END AS ns, 'Page_' || (doc_id // 20) AS title,
 CAST(strlen(coalesce(text, '')) AS BIGINT) AS length, doc_id % 7 = 0 AS minor, coalesce(text, '') AS text, source, lang FROM documents)"""


def wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions whose text begins with links, templates and a reference."""
    s, g = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx"))
    head = F.concat(F.lit("[["), s, F.lit("|"), g, F.lit("]] [["), s, F.lit("#x]] [[File:"), g, F.lit("]] {{"), g, F.lit("}} {{"), g, F.lit(" icon}} '''b''' <!-- c --> http://e.org/"), F.col("rev_id").cast("string"), F.lit(" "))
    return rev(spark, sf_dir).withColumn("text", F.concat(head, "text"))


SQL_WIKI = (
    SQL_REV
    + r""", wiki AS (SELECT * EXCLUDE (text), '[[' || coalesce(source, 'none') || '|' || coalesce(lang, 'xx') || ']] [[' || coalesce(source, 'none') || '#x]] [[File:' || coalesce(lang, 'xx') || ']] {{' || coalesce(lang, 'xx')
 || '}} {{' || coalesce(lang, 'xx') || ' icon}} ''''''b'''''' <!-- c --> http://e.org/' || rev_id || ' ' || text AS text FROM rev)"""
)
SQL_ANCHOR = (
    SQL_WIKI
    + r""", raw AS (SELECT ts_ms AS ts, page_id AS pid, rev_id AS revid, parent_id AS parent, unnest(regexp_extract_all(text, '(?s)\[\[(.*?)\]\]', 1)) AS l FROM wiki),
 anchor AS (SELECT ts, pid, revid, parent, CASE WHEN instr(l, '|') > 0 THEN substr(l, instr(l, '|') + 1) ELSE t END AS anchor, t AS target
 FROM (SELECT *, regexp_replace(l, '(?s)[|#].*$', '') AS t FROM raw WHERE l <> '' AND instr(l, ':') = 0) x WHERE t <> ''),
 idmap AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS page_id, source AS title FROM documents WHERE source IS NOT NULL)"""
)


def idmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title) of the sources."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    return docs.select(F.substring("source", F.lit(4), F.length("source")).cast("bigint").alias("page_id"), F.col("source").alias("title")).distinct()


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dest, day) of events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dest"), F.to_date("ts").alias("day"))


SQL_CLICK = "click AS (SELECT user_id AS src, event_type AS dest, CAST(ts AS DATE) AS day FROM events)"


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dest, day): parts by order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").cast("string").alias("dest"), F.date_trunc("year", "l_shipdate").cast("date").alias("day"))


SQL_PURCHASE = "purchase AS (SELECT l_orderkey AS src, CAST(l_partkey AS VARCHAR) AS dest, CAST(date_trunc('year', l_shipdate) AS DATE) AS day FROM lineitem)"


def pageview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): `en.z user_1 total compact`, a line for each user and event type, from hourly counts of events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"))
    hours = e.groupBy("user_id", "event_type", "day", "hour").agg(F.count("*").alias("n"))
    item = F.concat(F.char(F.col("hour") + 65), F.col("n").cast("string"))
    days = hours.groupBy("user_id", "event_type", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hour", item.alias("i")))), lambda x: x["i"]), "").alias("s"), F.sum("n").alias("n"))
    segment = F.concat(F.char(F.col("day") + 64), "s")
    lines = days.groupBy("user_id", "event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", segment.alias("s")))), lambda x: x["s"]), ",").alias("c"), F.sum("n").alias("n"))
    return lines.select(F.concat_ws(" ", F.lit("en.z"), F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.col("n").cast("string"), "c").alias("value"))
