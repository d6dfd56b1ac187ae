"""Revision histories: XML dumps and JSON lines as DataFrames of `schemas.REVISION` (ts_ms in place of ts on request)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revstrata import schemas
from revstrata.functions.dates import parse_iso
from revstrata.operators import filters


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The page elements of dumps, plain or compressed (bz2, gz); a page's revisions are one row here."""
    return spark.read.format("xml").option("rowTag", "page").schema(schemas.PAGE_XML).load(path)


def read_xml(spark: SparkSession, path: str | list[str], only_articles: bool = False, skip_redirects: bool = False, begin: str | int | None = None, end: str | int | None = None) -> DataFrame:
    """A row for each revision. Options: namespace 0 only, no redirect pages, begin <= time < end (ISO 8601 or milliseconds).

    A missing parent is 0, a missing or unreadable contributor id -1, an anonymous contributor has ip and no user; an empty text
    is the empty string. length is in bytes. Page filters apply before revisions are exploded.
    """
    pages = read_pages(spark, path)
    if only_articles:
        pages = pages.where("ns = 0")
    if skip_redirects:
        pages = pages.where("redirect is null")
    rows = pages.select(F.col("id").alias("page_id"), F.col("title").alias("page_title"), F.col("ns").alias("page_namespace"), F.col("redirect._title").alias("redirect"), F.explode("revision").alias("r"))
    ts, text = parse_iso(F.col("r.timestamp")), F.coalesce("r.text._VALUE", F.lit(""))
    out = rows.select(
        "page_id", F.col("r.id").alias("rev_id"), F.coalesce("r.parentid", F.lit(0)).alias("parent_id"), ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), "page_title", "page_namespace",
        F.octet_length(text).alias("length"), F.col("r.minor").isNotNull().alias("minor"), text.alias("text"), F.col("r.contributor.username").alias("user"), F.coalesce("r.contributor.id", F.lit(-1)).alias("user_id"),
        F.col("r.contributor.ip").alias("ip"), F.col("r.comment._VALUE").alias("comment"), "redirect",
    )
    return filters.time_window(out, begin, end)


def read_json(spark: SparkSession, path: str | list[str], only_articles: bool = True, begin: str | int | None = None, end: str | int | None = None) -> DataFrame:
    """Revisions as JSON lines; lines that are malformed or lack a field are dropped."""
    rows = spark.read.schema(schemas.REVISION_JSON).option("mode", "DROPMALFORMED").json(path).dropna()
    rows = rows.withColumnRenamed("timestamp", "ts_ms").withColumn("length", F.octet_length("text"))
    rows = filters.time_window(rows, begin, end)
    return filters.article_only(rows) if only_articles else rows


def read_xml_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(page_id, rev_id, parent_id, ts_ms, page_title, page_namespace, minor): the parser passes over texts, so there is no length."""
    schema = schemas.PAGE_XML.replace("text:struct<_VALUE:string>, ", "")
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    rows = pages.select(F.col("id").alias("page_id"), F.col("title").alias("page_title"), F.col("ns").alias("page_namespace"), F.explode("revision").alias("r"))
    return rows.select("page_id", F.col("r.id").alias("rev_id"), F.coalesce("r.parentid", F.lit(0)).alias("parent_id"), F.unix_millis(parse_iso(F.col("r.timestamp"))).alias("ts_ms"), "page_title", "page_namespace", F.col("r.minor").isNotNull().alias("minor"))


def read_json_headers(spark: SparkSession, path: str | list[str], only_articles: bool = True) -> DataFrame:
    """JSON lines without texts, which the parser passes over; lines that lack another field are dropped."""
    schema = schemas.REVISION_JSON.replace(", text string", "")
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).dropna().withColumnRenamed("timestamp", "ts_ms")
    return filters.article_only(rows) if only_articles else rows


def headers(revs: DataFrame) -> DataFrame:
    """Without texts; length, where it is taken from them, makes the scan read them: see read_xml_headers."""
    return revs.select("page_id", "rev_id", "parent_id", "ts_ms", "page_title", "page_namespace", "length", *[c for c in ("minor",) if c in revs.columns])


def current_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(page_id, ns, title, text, is_redirect, len, is_disamb, is_article): the last revision of each page of a dump of pages."""
    pages = read_pages(spark, path)
    text = F.coalesce(F.element_at("revision", -1)["text"]["_VALUE"], F.lit(""))
    rows = pages.select(F.col("id").alias("page_id"), "ns", "title", text.alias("text"), F.col("redirect").isNotNull().alias("is_redirect"))
    disamb = F.lower("text").rlike(r"\{\{\s*(disambig|disambiguation|hndis|geodis)\s*[|}]") | F.lower("title").contains("(disambiguation)")
    return rows.withColumns({"len": F.octet_length("text"), "is_disamb": disamb, "is_article": F.col("ns") == 0})


def identities(revs: DataFrame) -> DataFrame:
    """One row for each (page, revision, namespace)."""
    return revs.dropDuplicates(["page_id", "rev_id", "page_namespace"])
