"""Token counts: the exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded (each task encodes each of its distinct words once and only keeps their numbers of tokens) and counted
by length. The histogram has a row for each length that occurs, few whatever the corpus; suffix sums over it give, at a limit
L: the documents longer than L, the tokens kept when texts are cut to L (tokens of shorter texts + L for each longer one),
and the share of documents up to L, i.e. every quantile. Between two lengths that occur, all of these but the tokens kept are
constant, and those are linear in L, so the table answers every limit: see `at_limit` and `quantile`.

Defined results: a null or empty text has length 0; rows are counted one by one, repeated or not, whatever their doc_id; an
empty table gives an empty histogram. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import groups, pieces, span_hash, strings
from .bpe import RANKS, split_pattern, tokenizer

#: Distinct words of which a task keeps the length at a time.
_KEPT = 1 << 20


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)._core_bpe.encode_single_piece
        names, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        for batch in batches:
            data, offsets, _ = strings(batch.column(1))
            out = []
            for i, j in groups(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, row = pieces(d, o, split_pattern())
                end = np.append(start[1:], len(d))
                unique, first, inverse = np.unique(span_hash(d, start, end), return_index=True, return_inverse=True)
                at = np.searchsorted(names, unique)
                known = names[np.minimum(at, len(names) - 1)] == unique if len(names) else np.zeros(len(unique), bool)
                size = np.empty(len(unique), np.int32)
                size[known] = sizes[at[known]]
                new = np.flatnonzero(~known)
                raw = d.tobytes()
                size[new] = [len(encode(raw[a:b])) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
                if len(names) > _KEPT:
                    names, sizes = unique, size
                elif len(new):
                    both, width = np.concatenate([names, unique[new]]), np.concatenate([sizes, size[new]])
                    order = np.argsort(both, kind="stable")
                    names, sizes = both[order], width[order]
                out.append(np.bincount(row, weights=size[inverse], minlength=j - i).astype(np.int64) if len(start) else np.zeros(j - i, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], ["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) of every row; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_lengths(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def length_histogram(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length."""
    return token_lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: (context, n_docs, docs_within, docs_beyond, tokens_total,
    tokens_within, tokens_kept, share_within). tokens_kept: of all texts cut to the limit."""
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return (
        histogram.withColumn("docs_within", F.sum("n_docs").over(up))
        .withColumn("tokens_within", F.sum(tokens).over(up))
        .withColumn("docs_beyond", F.coalesce(F.sum("n_docs").over(down), F.lit(0)))
        .withColumn("tokens_total", F.col("tokens_within") + F.coalesce(F.sum(tokens).over(down), F.lit(0)))
        .select(
            F.col("n_tokens").alias("context"), "n_docs", "docs_within", "docs_beyond", "tokens_total", "tokens_within",
            (F.col("tokens_within") + F.col("docs_beyond") * F.col("n_tokens")).alias("tokens_kept"),
            (F.col("docs_within") / (F.col("docs_within") + F.col("docs_beyond"))).alias("share_within"),
        )
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """(docs_within, docs_beyond, tokens_total, tokens_kept) for any limit, 0 for an empty histogram."""
    n, k = F.col("n_tokens"), F.col("n_docs")
    zero = F.lit(0)
    return histogram.agg(
        F.coalesce(F.sum(F.when(n <= limit, k).otherwise(zero)), zero).alias("docs_within"),
        F.coalesce(F.sum(F.when(n > limit, k).otherwise(zero)), zero).alias("docs_beyond"),
        F.coalesce(F.sum(n * k), zero).alias("tokens_total"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * k), zero).alias("tokens_kept"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """(context): the least length within which at least a share q of the documents lies; null for an empty histogram."""
    return limits(histogram).where(F.col("share_within") >= q).agg(F.min("context").alias("context"))
