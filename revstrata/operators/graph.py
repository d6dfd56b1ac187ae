"""Anchors, id maps and temporal graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revstrata.functions.dates import iso_of_millis
from revstrata.functions.links import graph_key, link_contexts, links


def anchors(revs: DataFrame) -> DataFrame:
    """(ts, pid, revid, parent, anchor, target), a row for each link."""
    return revs.select(F.col("ts_ms").alias("ts"), F.col("page_id").alias("pid"), F.col("rev_id").alias("revid"), F.col("parent_id").alias("parent"), F.inline(links(F.col("text"))))


def anchors_with_context(revs: DataFrame) -> DataFrame:
    """(ts, page_id, rev_id, target, anchor, offset, pre, post)."""
    rows = revs.select(F.col("ts_ms").alias("ts"), "page_id", "rev_id", F.explode(link_contexts("text")).alias("x"))
    return rows.select("ts", "page_id", "rev_id", "x.target", "x.anchor", "x.offset", "x.pre", "x.post")


def id_map(revs: DataFrame) -> DataFrame:
    """Distinct (page_id, title)."""
    return revs.select("page_id", "title").distinct()


def temporal_graph(anchor: DataFrame, ids: DataFrame) -> DataFrame:
    """(ts, src, dst): a link whose target is a title. Spark broadcasts the id map if its size allows, else both shuffle."""
    return anchor.join(ids, F.col("target") == F.col("title")).select("ts", F.col("pid").alias("src"), F.col("page_id").alias("dst"))


def entity_relation(anchor: DataFrame, ids: DataFrame) -> DataFrame:
    """(time, src_title, dst_title): both ends' titles, the time as text."""
    to = ids.select(F.col("title").alias("dst_title"))
    frm = ids.select(F.col("page_id").alias("src_id"), F.col("title").alias("src_title"))
    joined = anchor.join(to, F.col("target") == F.col("dst_title")).join(frm, F.col("src_id") == F.col("pid"))
    return joined.select(iso_of_millis(F.col("ts")).alias("time"), "src_title", "dst_title")


def distinct_anchors(anchor: DataFrame, key: str = "target", approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return anchor.agg(n.alias("n_anchors"))


def resolve_redirects(ids: DataFrame, redirects: DataFrame) -> DataFrame:
    """(title, page_id): the page that a title's page redirects to in one hop, or its own. Of equal titles the greatest id counts."""
    one = ids.groupBy("title").agg(F.max("page_id").alias("page_id"))
    to = redirects.where("flag = 1").groupBy("from_id").agg(F.max("to_title").alias("to_title"))
    target = one.select(F.col("title").alias("to_title"), F.col("page_id").alias("to_id"))
    hop = to.join(target, "to_title").select("from_id", "to_id")
    return one.join(hop, one["page_id"] == hop["from_id"], "left").select("title", F.coalesce("to_id", "page_id").alias("page_id"))


def graph_keys(anchor: DataFrame) -> DataFrame:
    """(key, title, n): rows by target, with the target's key in a knowledge graph."""
    title = F.replace(F.trim("target"), F.lit(" "), F.lit("_"))
    return anchor.where(F.trim("target") != "").groupBy(title.alias("title")).agg(F.count("*").alias("n")).select(graph_key(F.col("title")).alias("key"), "title", "n")
