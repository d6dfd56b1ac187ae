"""Event-time windows and the adaptive sampler as streams. Late rows follow the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revstrata.operators.sequence import Header, Sampler, length_change


def tumbling(events: DataFrame, keys: list[str], width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, n, total): counts and sums of value by window; with `slide`, windows overlap."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """(session_start, session_end, keys, n): rows of a key less than `gap` apart."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def adaptive_stream(revs: DataFrame, low: float = 0.01, high: float = 0.1, least: int = 10, timeout: str | None = "30 days", late: str = "1 day") -> DataFrame:
    """(page_id, rev_id) as operators.sequence.adaptive_sample emits them, of a stream of (page_id, rev_id, ts, length).

    State is a page's base, two numbers. Rows of a batch are taken in order of time; a base is emitted when a revision differs
    by more than `high`, and the last one when its page has been silent for `timeout` of event time, which ends its state.
    Without a timeout a last base is never emitted and its state stays. Rows without a page are passed over.
    """
    hold = None if timeout is None else int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            base = state.get
            state.remove()
            yield pd.DataFrame({"page_id": [key[0]], "rev_id": [base[0]]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "rev_id"])
        sampler, out = Sampler(length_change, low, high, least), []
        if state.exists:
            sampler.base = Header(0, *state.get, False)
        for rev, length, minor in zip(rows.rev_id.tolist(), rows.length.tolist(), rows.minor.tolist()):
            got = sampler.take(Header(0, rev, length, minor))
            if got:
                out.append(got[0].rev_id)
        if sampler.base is not None:
            state.update((sampler.base.rev_id, sampler.base.length))
            if hold is not None:
                end = max(int(rows.ts.max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1)
                state.setTimeoutTimestamp(end + hold)
        if out:
            yield pd.DataFrame({"page_id": key[0], "rev_id": out})

    minor = F.coalesce(F.col("minor"), F.lit(False)) if "minor" in revs.columns else F.lit(False)
    rows = revs.where("page_id is not null").select("page_id", "rev_id", "ts", F.col("length").cast("bigint").alias("length"), minor.alias("minor")).withWatermark("ts", late)
    return rows.groupBy("page_id").applyInPandasWithState(step, "page_id bigint, rev_id bigint", "rev_id bigint, length bigint", "append", GroupStateTimeout.NoTimeout if hold is None else GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take all that is there now, append it as Parquet and stop; run again, it goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
