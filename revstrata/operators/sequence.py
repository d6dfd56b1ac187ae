"""Operators over each page's ordered revisions: pairs, buckets, adaptive samples, differences, states in effect.

Order is (ts_ms, rev_id) everywhere. All of them shuffle once, by page_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revstrata.functions.dates import bucket
from revstrata.functions.diff import diff, rebuilt
from revstrata.functions.links import links
from revstrata.functions.strings import paragraphs, tokens
from revstrata.operators import words
from revstrata.operators.graph import anchors

MONTH_MS = 30 * 86_400_000
INTERVAL_MS = {"hour": 3_600_000, "day": 86_400_000, "week": 7 * 86_400_000, "month": MONTH_MS}


def by_page() -> Window:
    return Window.partitionBy("page_id").orderBy("ts_ms", "rev_id")


def pairs(revs: DataFrame, carried: tuple[str, ...] = ("rev_id", "ts_ms", "length")) -> DataFrame:
    """Each revision with the one before it, prev_*; the first with a dummy: id -1, time 0, length 0, text ''."""
    dummy = {"rev_id": F.lit(-1), "ts_ms": F.lit(0), "length": F.lit(0), "text": F.lit("")}
    before = F.lag(F.struct(*carried)).over(by_page())
    df = revs.withColumn("__before", before)
    columns = [F.coalesce(F.col("__before")[c], dummy.get(c, F.lit(None))).cast(revs.schema[c].dataType).alias(f"prev_{c}") for c in carried]
    return df.select("*", *columns).drop("__before")


def last_per_bucket(revs: DataFrame, unit: str) -> DataFrame:
    """(page_id, bucket, ts_ms, rev_id): the last revision of each hour, day, week or month. Aggregates before the shuffle."""
    at = bucket(F.timestamp_millis("ts_ms"), unit)
    best = revs.groupBy("page_id", at.alias("bucket")).agg(F.max(F.struct("ts_ms", "rev_id")).alias("last"))
    return best.select("page_id", "bucket", "last.ts_ms", "last.rev_id")


def bucket_pairs(revs: DataFrame, unit: str) -> DataFrame:
    """Consecutive last revisions of buckets; the first with a dummy."""
    return pairs(last_per_bucket(revs, unit), ("rev_id", "ts_ms"))


class Header(NamedTuple):
    """What a score sees of a revision."""

    ts_ms: int
    rev_id: int
    length: int
    minor: bool


def length_change(now: Header, base: Header, last: Header | None) -> float:
    """The score of the plain sampler: relative change of length to the base, 0.0005 for a minor edit."""
    return 0.0005 if now.minor else abs(now.length - base.length) / base.length


def length_change_by_interval(interval_ms: int) -> Callable[[Header, Header, Header | None], float]:
    """As length_change until a revision is emitted; then 0.0005 within the interval of the last emitted one, and beyond it the
    difference to the last emitted one, relative to the base."""

    def score(now: Header, base: Header, last: Header | None) -> float:
        if last is None:
            return length_change(now, base, last)
        return 0.0005 if now.ts_ms - last.ts_ms <= interval_ms else abs(now.length - last.length) / base.length

    return score


class Sampler:
    """The fold over a page's headers: `low` and `high` bound the scores of revisions that are dropped."""

    def __init__(self, score: Callable[[Header, Header, Header | None], float], low: float, high: float, least: int) -> None:
        self.score, self.low, self.high, self.least = score, low, high, least
        self.base: Header | None = None
        self.last: Header | None = None

    def take(self, now: Header) -> tuple[Header, Header | None] | None:
        """(revision, the one emitted before it) if the new revision makes the sampler emit its base."""
        if now.length < self.least:
            return None
        out = None
        if self.base is not None:
            score = self.score(now, self.base, self.last)
            if self.low <= score <= self.high:
                return None
            if score > self.high:
                out = (self.base, self.last)
                self.last = self.base
        self.base = now
        return out


def adaptive_steps(revs: DataFrame, low: float = 0.01, high: float = 0.1, least: int = 10, score: Callable[[Header, Header, Header | None], float] = length_change) -> DataFrame:
    """(page_id, rev_id, last_rev_id, last_ts): the revisions that matter, each with the one emitted before it (-1, 0 if none).

    Revisions shorter than `least` bytes are passed over; the first of the others is the base. A revision whose score is below
    `low` replaces the base; above `high`, the base is emitted and the revision is the new base; in between it is dropped. The
    last base is emitted. `score` is any function of three headers (the revision's, the base's, the last emitted one's).

    One shuffle, by page, of headers only, 25 bytes a revision; pages are folded as a stream of sorted batches, so a page may have
    any number of revisions. A null or absent `minor` is no minor edit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, sampler, out = None, Sampler(score, low, high, least), []
        row = lambda got: (page, got[0].rev_id, got[1].rev_id if got[1] else -1, got[1].ts_ms if got[1] else 0)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["page_id", "rev_id", "last_rev_id", "last_ts"])

        for batch in batches:
            for p, *header in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if p != page:
                    if sampler.base is not None:
                        out.append(row((sampler.base, sampler.last)))
                    page, sampler = p, Sampler(score, low, high, least)
                got = sampler.take(Header(*header))
                if got:
                    out.append(row(got))
            if out:
                yield packed()
                out = []
        if sampler.base is not None:
            out.append(row((sampler.base, sampler.last)))
            yield packed()

    minor = F.coalesce(F.col("minor"), F.lit(False)) if "minor" in revs.columns else F.lit(False)
    rows = revs.where((F.col("length") >= least) & F.col("page_id").isNotNull())
    rows = rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("page_id", "ts_ms", "rev_id", "length")], minor.alias("minor"))
    return rows.repartition("page_id").sortWithinPartitions("page_id", "ts_ms", "rev_id").mapInArrow(run, "page_id bigint, rev_id bigint, last_rev_id bigint, last_ts bigint")


def adaptive_sample(revs: DataFrame, low: float = 0.01, high: float = 0.1, least: int = 10, interval_ms: int | None = None) -> DataFrame:
    """(page_id, rev_id) of adaptive_steps by change of length, with an interval by length_change_by_interval."""
    score = length_change if interval_ms is None else length_change_by_interval(interval_ms)
    return adaptive_steps(revs, low, high, least, score).select("page_id", "rev_id")


def with_texts(sample: DataFrame, revs: DataFrame, columns: tuple[str, ...] = ("ts_ms", "text")) -> DataFrame:
    """The sampled revisions' columns: a join by page and revision."""
    return sample.join(revs.select("page_id", "rev_id", *columns), ["page_id", "rev_id"])


def sampled_links(revs: DataFrame, **options) -> DataFrame:
    """(ts, pid, revid, parent, anchor, target) of the links in the revisions that the adaptive sample keeps."""
    return anchors(with_texts(adaptive_sample(revs, **options), revs, ("ts_ms", "parent_id", "text")))


def added_links(revs: DataFrame) -> DataFrame:
    """(page_id, rev_id, ts_ms, anchor, target): links in the paragraphs that a revision adds or changes.

    The outer explode keeps Spark from making every diff twice, once to filter for those that aren't empty; inline drops its nulls.
    """
    d = revision_diffs(revs).select("page_id", "rev_id", "ts_ms", F.explode_outer("deltas").alias("d"))
    return d.select("page_id", "rev_id", "ts_ms", F.inline(links(F.array_join("d.rev", "\n"))))


def sampled_words(revs: DataFrame, interval: str = "month") -> DataFrame:
    """(page_id, rev_id, ts_ms, last_ts, word, n): added_words of each sampled revision against the one emitted before it."""
    sample = adaptive_sample(revs, interval_ms=INTERVAL_MS[interval])
    return added_words(with_texts(sample, revs))


def revision_diffs(revs: DataFrame, split: Column | None = None) -> DataFrame:
    """(page_id, rev_id, prev_rev_id, ts_ms, deltas) against the revision before, by paragraph (or what `split` makes of text)."""
    cut = paragraphs if split is None else split
    parts = revs.select("page_id", "rev_id", "ts_ms", cut(F.col("text")).alias("parts"))
    both = parts.withColumn("__b", F.lag(F.struct("rev_id", "parts")).over(by_page()))
    return both.select("page_id", "rev_id", F.coalesce("__b.rev_id", F.lit(-1)).alias("prev_rev_id"), "ts_ms", diff(F.col("__b.parts"), F.col("parts")).alias("deltas"))


def restored(revs: DataFrame) -> DataFrame:
    """(page_id, rev_id, parts): paragraphs of each revision, from those of the one before it and revision_diffs' deltas."""
    parts = revs.select("page_id", "rev_id", "ts_ms", paragraphs(F.col("text")).alias("parts")).withColumn("before", F.lag("parts").over(by_page()))
    return parts.select("page_id", "rev_id", rebuilt("before", "parts").alias("parts"))


def added_words(revs: DataFrame) -> DataFrame:
    """(page_id, rev_id, ts_ms, last_ts, word, n): words that a revision has more often than the one before it, and by how many.

    One shuffle, of texts by page, whose words are counted and compared as a stream of revisions in order.
    """
    rows = words.counted(revs, words.additions, ["page_id", "rev_id", "ts_ms", "last_ts"])
    return rows.select("page_id", "rev_id", "ts_ms", "last_ts", "word", "n")


def temporal_index(revs: DataFrame) -> DataFrame:
    """(word, page_id, last_ts, ts_ms, n): an inverted index of added words."""
    return added_words(revs).select("word", "page_id", "last_ts", "ts_ms", "n")


def concatenated(revs: DataFrame, unit: str = "week") -> DataFrame:
    """(page_id, rev_id, text, patches): the first revision of each bucket and the words that later ones of the bucket add, in order."""
    marked = revs.withColumn("bucket", bucket(F.timestamp_millis("ts_ms"), unit))
    in_bucket = Window.partitionBy("page_id", "bucket").orderBy("ts_ms", "rev_id")
    plain = tokens(F.col("text"), "plain")
    rows = marked.select("page_id", "bucket", "rev_id", "ts_ms", "text", plain.alias("w")).withColumn("prev", F.lag("w").over(in_bucket))
    patch = F.flatten(F.transform(diff("prev", "w"), lambda d: d["rev"]))
    rows = rows.select("page_id", "bucket", "rev_id", "ts_ms", F.when(F.col("prev").isNull(), F.col("text")).alias("text"), F.when(F.col("prev").isNull(), F.array().cast("array<string>")).otherwise(patch).alias("patch"))
    both = rows.groupBy("page_id", "bucket").agg(F.min(F.struct("ts_ms", "rev_id", "text")).alias("base"), F.array_sort(F.collect_list(F.struct("ts_ms", "rev_id", "patch"))).alias("all"))
    return both.select("page_id", "base.rev_id", "base.text", F.flatten(F.transform("all", lambda x: x["patch"])).alias("patches"))


def in_effect(points: DataFrame, revs: DataFrame, time: str = "at_ms") -> DataFrame:
    """As-of join: for each (page_id, time) the last revision at or before it, null if there is none.

    Union and running last value: one shuffle by page and a sort, whatever the number of revisions between points.
    """
    a = points.select("page_id", F.col(time).alias("__t"), F.lit(None).cast("bigint").alias("__rev"), F.lit(1).alias("__kind"))
    b = revs.select("page_id", F.col("ts_ms").alias("__t"), F.col("rev_id").cast("bigint").alias("__rev"), F.lit(0).alias("__kind"))
    w = Window.partitionBy("page_id").orderBy("__t", "__kind", "__rev").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("rev_id", F.last("__rev", ignorenulls=True).over(w))
    return rows.where("__kind = 1").select("page_id", F.col("__t").alias(time), "rev_id")
