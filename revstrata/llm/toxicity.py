"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the hash of an n-gram of 3 to 5 characters (ASCII letters as lower case) in a table of 2**20, present or absent in
a text. Fitting: the features' document counts among toxic and other labelled texts give smoothed log-count ratios r; the
`kept` features whose counts differ most from what they would be without a relation to the label (by (observed - expected)^2 /
expected, at least `least`) are kept; a logistic regression is fitted on the presence of those, scaled by r. It uses a sample of
at most `most` labelled rows, in the order of a hash of doc_id, so its cost is bounded; the three are parameters. Scoring covers every document and its whole text in one pass, without a shuffle: the model is
broadcast, of fixed size.

Defined results: a null or empty text scores the model's bias alone, and a null text isn't toxic; a null doc_id is scored
like any other; labels with a null id, or other than 0 and 1, and of documents that aren't there, aren't used, nor do they use up the sample; for a document that is
labelled twice, toxic once makes it toxic; without labels of both kinds nothing is toxic (score 0). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from ._text import _R, LOWER, U64, groups, mix, powers, strings

ORDERS, BITS, KEPT, LEAST, MOST = (3, 4, 5), 20, 1 << 14, 4.0, 16_000
_SLICES = 16


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, row) of every n-gram of each text, one order after another; n-grams don't cross rows."""
    if not len(data):
        return
    power, inverse = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_R[LOWER][data] * power[:-1], out=prefix[1:])
    at = np.flatnonzero((data & 0xC0) != 0x80)
    row = np.searchsorted(offsets, at, "right") - 1
    at = np.append(at, len(data))
    value, scale = prefix[at], inverse[at[:-1]]
    for n in ORDERS:
        m = len(row) - n + 1
        if m <= 0:
            return
        h = (value[n:] - value[:m]) * scale[:m]
        h ^= h >> U64(31)
        h *= U64(0x9E3779B97F4A7C15 + 2 * n)
        feature = (h >> U64(64 - BITS)).astype(np.int32)
        ok = row[:m] == row[n - 1 :]
        yield feature[ok], row[:m][ok]


def presence(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), of the features in the mask `kept` if given."""
    found = []
    for feature, row in features(data, offsets):
        if kept is not None:
            at = np.flatnonzero(kept[feature])
            feature, row = feature[at], row[at]
        found.append((row.astype(np.int64) << BITS) | feature)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    """Weights of the kept features, on their presence (the ratios are multiplied in), and the bias; score = logistic of the sum."""

    kept: np.ndarray
    weight: np.ndarray
    bias: float
    threshold: float = 0.5

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mask = np.zeros(1 << BITS, bool)
        mask[self.kept] = True
        place = np.zeros(1 << BITS, np.float64)
        place[self.kept] = self.weight
        total = np.full(len(offsets) - 1, self.bias)
        for i, j in groups(offsets):
            row, feature = presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mask)
            total[i:j] += np.bincount(row, weights=place[feature], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of the sample; its ids are broadcast, at most `most`."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id is not null and __toxic in (0, 1)")
    ids = ids.join(docs.select(F.col("doc_id").cast("bigint").alias("__there")), F.col("__id") == F.col("__there"), "left_semi")
    ids = ids.groupBy("__id").agg(F.max("__toxic").alias("__toxic")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    docs = docs.select("doc_id", "text")
    return docs.join(F.broadcast(ids), docs["doc_id"] == F.col("__id")).select(F.col("text"), F.col("__toxic").alias("toxic")).where("text is not null")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BITS), np.int32)
    n = [0, 0]
    for batch in batches:
        data, offsets, _ = strings(batch.column(0))
        toxic = batch.column(1).to_numpy()
        for k in (0, 1):
            n[k] += int((toxic == k).sum())
        for i, j in groups(offsets):
            row, feature = presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in (0, 1):
                total[k] += np.bincount(feature[toxic[i:j][row] == k], minlength=1 << BITS).astype(np.int32)
    if sum(n):
        width = (1 << BITS) // _SLICES
        blobs = []
        for s in range(_SLICES):
            part = total[:, s * width : (s + 1) * width]
            at = np.flatnonzero(part.any(axis=0)).astype(np.int32)
            blobs.append(np.concatenate([at, part[0, at], part[1, at]]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n[0]] * _SLICES, pa.int64()), pa.array([n[1]] * _SLICES, pa.int64())], ["slice", "counts", "n0", "n1"])
    del total
    X.trim()


def _ratios(kept: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        s = table["slice"][0].as_py()
        width = (1 << BITS) // _SLICES
        total = np.zeros((2, width))
        for x in table["counts"]:
            at, a, b = np.split(np.frombuffer(x.as_py(), np.int32), 3)
            total[0, at] += a
            total[1, at] += b
        n0, n1 = (sum(table[c].to_pylist()) for c in ("n0", "n1"))
        r = np.log((total[1] + 0.5) / (n1 + 1)) - np.log((total[0] + 0.5) / (n0 + 1))
        # information that the presence carries: how far the counts are from what they would be without a relation
        seen = total.sum(axis=0)
        expected = seen * n1 / max(1, n0 + n1)
        weight = np.where(seen > 0, (total[1] - expected) ** 2 / np.maximum(expected, 0.5), 0)
        best = np.argsort(-weight, kind="stable")[:kept]
        best = best[weight[best] > least]
        return pa.table({"feature": (best + s * width).astype(np.int32), "ratio": r[best], "weight": weight[best], "n0": np.full(len(best), n0), "n1": np.full(len(best), n1)})

    return run


def _extract(place: np.ndarray):
    """The features of each text as places among the kept ones, 2 bytes each, or 4 if there are more than 2**16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = place >= 0
        for batch in batches:
            data, offsets, _ = strings(batch.column(0))
            lists = []
            for i, j in groups(offsets):
                row, feature = presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mask)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                at = place[feature].astype(_place_type(mask))
                lists += [at[ends[k] : ends[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), batch.column(1).cast(pa.int32())], ["features", "toxic"])
        X.trim()

    return run


def _place_type(mask: np.ndarray):
    return np.uint16 if np.count_nonzero(mask) <= 1 << 16 else np.uint32


def _logistic(column: np.ndarray, ends: np.ndarray, ratio: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-4, block: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and bias, by Adam on the whole sample; either class has half of the weight.

    Row r has the features column[ends[r]:ends[r + 1]]; rows are taken in blocks, so memory is that of `column` and a block.
    """
    width, n = len(ratio), len(y)
    w, bias = np.zeros(width), 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v, rate = np.zeros(width + 1), np.zeros(width + 1), 0.05
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + block, "right")) - 1))
    cuts[-1] = n
    for t in range(1, steps + 1):
        scaled, g = w * ratio, np.zeros(width)
        slope = 0.0
        for a, b in zip(cuts, cuts[1:]):
            some, size = column[ends[a] : ends[b]], np.diff(ends[a : b + 1])
            row = np.repeat(np.arange(b - a), size)
            z = np.bincount(row, weights=scaled[some], minlength=b - a) + bias
            err = share[a:b] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[a:b])
            g += np.bincount(some, weights=err[row], minlength=width)
            slope += err.sum()
        g = np.append(g * ratio + decay * w, slope)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, kept: int = KEPT, least: float = LEAST) -> Model:
    """The model of at most `most` labelled rows (see the module)."""
    none = Model(np.zeros(0, np.int64), np.zeros(0), -50.0)
    some = _labelled(docs, labels, most)
    found = some.mapInArrow(_count, "slice int, counts binary, n0 bigint, n1 bigint").groupBy("slice").applyInArrow(_ratios(kept, least), "feature int, ratio double, weight double, n0 bigint, n1 bigint").toPandas()
    if found.empty or not found.n0[0] or not found.n1[0]:
        return none
    found = found.sort_values(["weight", "feature"], ascending=[False, True]).head(kept)
    ids, ratio = found.feature.to_numpy(), found.ratio.to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    rows = some.mapInArrow(_extract(place), "features binary, toxic int").toArrow()
    y, blobs = rows["toxic"].to_numpy(), [x.as_py() for x in rows["features"]]
    del rows
    order = sorted(range(len(blobs)), key=lambda k: (blobs[k], y[k]))  # the fit doesn't depend on the order in which rows come
    kind = np.dtype(_place_type(place >= 0))
    ends = np.concatenate(([0], np.cumsum([len(blobs[k]) // kind.itemsize for k in order], dtype=np.int64)))
    column = np.frombuffer(b"".join(blobs[k] for k in order), kind)
    del blobs
    w, bias = _logistic(column, ends, ratio, y[order].astype(float))
    return Model(ids, w * ratio, bias)


def _scorer(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, null = strings(batch.column(columns.index("text")))
            score = model.score(data, offsets)
            arrays = [batch.column(i) for i, c in enumerate(columns) if c != "text"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(score), pa.array((score >= model.threshold) & ~null)], [*(c for c in columns if c != "text"), "score", "toxic"])
        X.trim()

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(model, ["doc_id", "text"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, toxic boolean")


def _filter(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, null = strings(batch.column(at))
            yield batch.filter(pa.array((model.score(data, offsets) < model.threshold) | null))
        X.trim()

    return run


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that the model doesn't reject: one narrow pass."""
    return docs.mapInArrow(_filter(model, docs.columns.index("text")), docs.schema)
