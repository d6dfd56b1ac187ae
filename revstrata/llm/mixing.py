"""Mixing sources to target weights that vary over training: a curriculum by inverted cumulative demand.

Each source has weights at common knots of training time 0..1, linear between them; at each knot they are scaled to sum 1, so
they do at every time. The integral D_s(t) is piecewise quadratic. A budget of T tokens takes T * D_s(t) tokens of source s by
time t: the document of s before which c of its tokens lie, in the order of an md5 of doc_id, gets the position t at which
T * D_s(t) = c, in closed form. Documents are range-sorted by position. A source that has fewer tokens than its demand is
repeated (epoch 1, 2, ...); of one that has more, the rest isn't used.

The running sum over a source is taken in two levels (totals by source and md5 prefix, then within each prefix), so a source
that holds most of the corpus is still spread over all tasks.

Defined results: a null or empty text has 0 tokens and takes the position at which it lies; a null source is the source '';
documents with equal md5, as repeated rows, follow each other by doc_id; a null doc_id comes first in its source; with no
tokens at all every position is 0. In `mixed`, rows that share a doc_id come together, at the place of the one with the least
(source, tokens). Texts are read once: ids, sources and numbers of tokens are written before they are used. Columns other than doc_id, source and text are ignored by `positions` and kept by `mixed`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _exchange as X

#: Hexadecimal digits of the md5 by which a source's running sum is split.
DIGITS = 3
KNOTS = (0.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words, delimited by ASCII white space; 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def supplies(rows: DataFrame) -> DataFrame:
    """(source, supply) in tokens."""
    return rows.groupBy("source").agg(F.sum("tokens").alias("supply"))


def flattening(supply: DataFrame, power: float = 0.5) -> DataFrame:
    """A schedule from the sources' shares of tokens at time 0 to those shares to a power at time 1: (source, supply, weights)."""
    total = supply.agg(F.sum("supply").alias("total"))
    shares = supply.crossJoin(F.broadcast(total)).withColumn("share", F.coalesce(F.try_divide("supply", "total"), F.lit(0.0)))
    return shares.select("source", "supply", F.array("share", F.pow("share", F.lit(power))).alias("weights"))


def tilted(supply: DataFrame, late: Column, strength: float = 0.5) -> DataFrame:
    """A schedule that uses every document once: each source's mean weight is its share of tokens, and the weight rises with
    time for sources whose `late` (in 0..1) is above the mean by tokens, and falls for the others."""
    totals = supply.withColumn("late", late).agg(F.sum("supply").alias("total"), F.sum(F.col("late") * F.col("supply")).alias("moment"))
    rows = supply.withColumn("late", late).crossJoin(F.broadcast(totals))
    share = F.coalesce(F.try_divide("supply", "total"), F.lit(0.0))
    tilt = F.lit(strength) * (F.col("late") - F.coalesce(F.try_divide("moment", "total"), F.lit(0.0)))
    return rows.select("source", "supply", F.array(share * (1 - tilt), share * (1 + tilt)).alias("weights"))


def segments(schedule: DataFrame, knots: tuple[float, ...] = KNOTS) -> DataFrame:
    """(source, supply, demand, pieces): the integral of each source's scaled weights; a piece has time, length, weights at
    both ends and the integral at its begin."""
    k = len(knots)
    sums = schedule.agg(*[F.sum(F.col("weights")[i]).alias(f"z{i}") for i in range(k)])
    w = schedule.crossJoin(F.broadcast(sums)).withColumn("w", F.array(*[F.coalesce(F.try_divide(F.col("weights")[i], F.col(f"z{i}")), F.lit(0.0)) for i in range(k)]))
    done: Column = F.lit(0.0)
    pieces = []
    for i in range(k - 1):
        length = knots[i + 1] - knots[i]
        a, b = F.col("w")[i], F.col("w")[i + 1]
        pieces.append(F.struct(F.lit(float(knots[i])).alias("time"), F.lit(float(length)).alias("length"), a.alias("a"), b.alias("b"), done.alias("done")))
        done = done + (a + b) / 2 * length
    return w.select("source", "supply", done.alias("demand"), F.array(*pieces).alias("pieces"))


def inverse(share: Column, pieces: Column) -> Column:
    """The time at which the integral reaches a share of the budget."""
    p = F.element_at(F.filter(pieces, lambda s: s["done"] <= share), -1)
    y = share - p["done"]
    root = F.sqrt(F.greatest(p["a"] * p["a"] + 2 * (p["b"] - p["a"]) / p["length"] * y, F.lit(0.0)))
    return F.coalesce(F.least(p["time"] + F.coalesce(F.try_divide(2 * y, p["a"] + root), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def positions(rows: DataFrame, schedule: DataFrame, knots: tuple[float, ...] = KNOTS, budget: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, epoch, position) of each use of a document, for rows of doc_id, source and tokens.

    budget: tokens in all; None: as many as there are.
    """
    rows = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "tokens").withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("part", F.substring("order", 1, DIGITS))
    totals = rows.groupBy("source", "part").agg(F.sum("tokens").alias("in_part"))
    before = totals.select("source", "part", (F.sum("in_part").over(Window.partitionBy("source").orderBy("part")) - F.col("in_part")).alias("before"))
    rows = rows.withColumn("inside", F.sum("tokens").over(Window.partitionBy("source", "part").orderBy("order", F.col("doc_id").asc_nulls_first(), "tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    parts = segments(schedule, knots)
    total = F.lit(float(budget)) if budget is not None else F.col("whole").cast("double")
    parts = parts.crossJoin(F.broadcast(parts.agg(F.sum("supply").alias("whole")))).withColumn("budget", total)
    placed = rows.join(before, ["source", "part"]).join(parts, "source")
    epochs = F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide(F.col("budget") * F.col("demand"), F.col("supply")), F.lit(1.0)) - F.lit(1e-9))).cast("int")
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    at = F.col("before") + F.col("inside") + F.col("epoch") * F.col("supply")
    placed = placed.withColumn("share", F.coalesce(F.try_divide(at.cast("double"), F.col("budget")), F.lit(0.0)))
    # the least overshoot by rounding must not lose a document whose source is used up exactly
    placed = placed.where((F.col("share") < F.col("demand") + F.lit(1e-12)) | (F.col("budget") == 0))
    return placed.select("doc_id", "source", "tokens", "epoch", F.round(inverse(F.least("share", "demand"), F.col("pieces")), 9).alias("position"))


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens), written."""
    return X.written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), word_count(F.col("text")).alias("tokens")), "counted")


def curriculum(docs: DataFrame) -> DataFrame:
    """Positions of documents under the flattening schedule, in the order of training."""
    rows = _counted(docs)
    return positions(rows, flattening(supplies(rows))).orderBy("position", "source", "doc_id", "epoch")


def mixed(docs: DataFrame, strength: float = 0.5, schedule: Callable[[DataFrame], DataFrame] | None = None, knots: tuple[float, ...] = KNOTS, budget: int | None = None) -> DataFrame:
    """Every document once, all columns, range-sorted by its position; sources of longer documents come later on the whole.

    schedule: gives the target weights from (source, supply), as `flattening` does; then documents are repeated or left out
    as `positions` says, and a null doc_id stays once. None only orders: no source is raised or lowered.
    """
    key, place = X.free(docs, "__id"), X.free(docs, "__position")
    known = _counted(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")
    known = X.written(known, "known")
    stats = known.groupBy("source").agg(F.sum("tokens").alias("supply"), F.avg("tokens").alias("mean"))
    late = F.coalesce(F.try_divide("mean", F.col("mean") + F.lit(500.0)), F.lit(0.0))
    at = positions(known, schedule(supplies(known)), knots, budget) if schedule else positions(known, tilted(stats, late, strength))
    at = at.select(F.col("doc_id").alias(key), F.col("position").alias(place))
    joined = docs.join(at, docs["doc_id"] == F.col(key), "left")
    if schedule:
        joined = joined.where(docs["doc_id"].isNull() | F.col(place).isNotNull())
    return joined.orderBy(F.col(place).asc_nulls_first(), docs["doc_id"]).select(*[docs[c] for c in docs.columns])
