"""Term statistics, dictionaries, document vectors and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revstrata.functions.strings import tokens
from revstrata.operators.words import counted, per_revision


def occurrences(docs: DataFrame, key: str, words: Column, longest: int = 64) -> DataFrame:
    """(key, term, tf)."""
    rows = docs.select(key, F.explode(words).alias("term")).where(F.length("term") <= longest)
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, key: str = "doc_id", words: Column | None = None, df_min: int = 100, df_max: int | None = None) -> DataFrame:
    """(term, df, cf), for documents of a row each. A row gives each of its tokens for cf and each distinct one for df, so one
    shuffle, of partial sums, is enough: there is none by document and term."""
    words = tokens(F.col("text")) if words is None else words
    rows = docs.select(F.filter(words, lambda x: F.length(x) <= 64).alias("w"))
    one = lambda df, cf: lambda x: F.struct(x.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf"))
    rows = rows.select(F.inline(F.concat(F.transform("w", one(0, 1)), F.transform(F.array_distinct("w"), one(1, 0)))))
    out = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= df_min)
    return out if df_max is None else out.where(F.col("df") <= df_max)


def dictionary(stats: DataFrame) -> DataFrame:
    """(term, term_id, df, cf): ids from 1 by falling df, then by term.

    A rank without a global sort: terms are ranked within (df, first two characters), and these groups, few, get their offsets
    from running sums over their sizes.
    """
    rows = stats.withColumn("head", F.substring("term", 1, 2))
    sizes = rows.groupBy("df", "head").agg(F.count("*").alias("size"))
    up = Window.orderBy(F.col("df").desc(), "head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("df", "head", F.coalesce(F.sum("size").over(up), F.lit(0)).alias("offset"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("df", "head").orderBy("term")))
    return ranked.join(offsets, ["df", "head"]).select("term", (F.col("offset") + F.col("rank")).cast("bigint").alias("term_id"), "df", "cf")


def document_vectors(docs: DataFrame, terms: DataFrame, key: str = "doc_id", words: Column | None = None, least: int = 11) -> DataFrame:
    """(key, term_ids): ids in the order of the text, unknown terms left out; texts of fewer characters, or without a known term,
    have empty vectors. Spark broadcasts the dictionary if its size allows."""
    words = tokens(F.col("text")) if words is None else words
    rows = docs.select(key, F.posexplode_outer(F.when(F.length("text") >= least, words)).alias("pos", "term"))
    joined = rows.join(terms.select("term", "term_id"), "term", "left")
    ids = F.array_sort(F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("pos", "term_id"))))
    return joined.groupBy(key).agg(F.transform(ids, lambda x: x["term_id"]).alias("term_ids"))


def postings(revs: DataFrame) -> DataFrame:
    """(term, page_id, rev_id, ts_ms, tf), in lower case. Texts are shuffled, by page, and not a row for each of their terms."""
    rows = counted(revs, per_revision, ["page_id", "rev_id", "ts_ms"])
    return rows.select(F.col("word").alias("term"), "page_id", "rev_id", "ts_ms", F.col("n").alias("tf"))


def token_lengths(revs: DataFrame) -> DataFrame:
    """(page_id, rev_id, ts_ms, n_tokens)."""
    return revs.select("page_id", "rev_id", "ts_ms", F.size(tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


def anchor_vectors(anchor: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_ids, targets): anchors as vectors of ids, with the sorted targets that they name; an anchor with an unknown term goes."""
    distinct = anchor.select("anchor", "target").distinct()
    rows = distinct.select("anchor", "target", F.posexplode(tokens(F.col("anchor"))).alias("pos", "term"))
    joined = rows.join(terms.select("term", "term_id"), "term", "left")
    known = joined.groupBy("anchor", "target").agg(F.bool_and(F.col("term_id").isNotNull()).alias("known"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "term_id"))), lambda x: x["term_id"]).alias("term_ids")).where("known")
    return known.groupBy("term_ids").agg(F.array_sort(F.collect_set("target")).alias("targets"))
