"""Words of revisions counted in streams of sorted texts, without a row for each word before the result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch of results.
ROWS = 1 << 15


def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(page_id, ts_ms, rev_id, text) one by one."""
    for batch in batches:
        keys = [batch.column(k).to_pylist() for k in range(3)]
        texts = batch.column(3)
        for i, key in enumerate(zip(*keys)):
            yield *key, texts[i].as_py()


def per_revision(rows: Iterable[tuple]) -> Iterator[tuple[tuple, dict, dict]]:
    """((page_id, rev_id, ts_ms), counts, {}): equal revisions are counted together."""
    last, counts = None, Counter()
    for page, ts, rev, text in rows:
        key = (page, rev, ts)
        if key != last:
            if counts:
                yield last, counts, {}
            last, counts = key, Counter()
        counts.update(text.split())
    if counts:
        yield last, counts, {}


def additions(rows: Iterable[tuple]) -> Iterator[tuple[tuple, dict, dict]]:
    """((page_id, rev_id, ts_ms, last_ts), counts, counts in the revision before). Rows with the same revision and revision before
    are counted together; of a revision that has several rows, each is compared with the one before it."""
    page, before, last_ts = object(), None, -1
    group, counts = None, Counter()
    seen_of, seen = None, {}

    def old() -> dict:
        return seen if group[3] is not None and seen_of == (group[0], group[3]) else {}

    for p, ts, rev, text in rows:
        if p != page:
            page, before, last_ts = p, None, -1
        key = (p, rev, ts, before, last_ts)
        if key != group:
            if counts:
                yield (*group[:3], group[4]), counts, old()
            if group is not None:
                seen = {**seen, **counts} if seen_of == group[:2] else counts
                seen_of = group[:2]
            group, counts = key, Counter()
        counts.update(text.split())
        before, last_ts = rev, -1 if ts is None else ts
    if counts:
        yield (*group[:3], group[4]), counts, old()


def counted(revs: DataFrame, fold: Callable[[Iterable[tuple]], Iterator[tuple[tuple, dict, dict]]], keys: list[str]) -> DataFrame:
    """(word, keys, n): the words in lower case of which the fold has more in its first counts than in its second.

    One shuffle, of texts by page; each page is a stream sorted by time, of which the counts of two revisions are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers, of, sizes = [], [], [], []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for c in zip(*of)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *columns, pa.array(numbers, pa.int64())], ["word", *keys, "n"])

        for key, counts, old in fold(in_order(batches)):
            more = [(w, n - old.get(w, 0)) for w, n in counts.items() if n > old.get(w, 0)]
            for at in range(0, len(more), ROWS):
                some = more[at : at + ROWS]
                words += [w for w, _ in some]
                numbers += [n for _, n in some]
                of.append(key)
                sizes.append(len(some))
                if len(words) >= ROWS:
                    yield packed()
                    words, numbers, of, sizes = [], [], [], []
        if words:
            yield packed()

    rows = revs.select(*[F.col(c).cast("bigint").alias(c) for c in ("page_id", "ts_ms", "rev_id")], F.coalesce(F.lower("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.repartition("page_id").sortWithinPartitions("page_id", "ts_ms", "rev_id")
    out = rows.mapInArrow(run, f"word binary, {', '.join(f'{k} bigint' for k in keys)}, n bigint")
    return out.select(F.col("word").cast("string").alias("word"), *keys, "n")
