"""Exact top-k search: a KD-tree per shard, best-first traversal by box-to-query bounds, and a kth distance carried over shards.

1. Of equal vectors only the k + 1 least ids can be results, so only these are kept, by partial ranks before the shuffle; equal
   queries are asked once. A vector that many rows share thus weighs no more than others.
2. Vectors go to shards by the top of a KD-tree, whose median splits are those of a sample of `sample` vectors: as with range
   partitioning, the sample decides how even shards are and nothing else. There are at most `most_shards` of them, which grow
   with the table beyond that, so that the tables of splits and boxes have a bounded size.
3. Each shard builds its tree once (median splits of the widest dimension, tight bounding boxes at every node) and writes it. A
   query is answered by its own shard first: its kth distance there is an upper bound of the final one.
4. A query goes on to the shards whose tight boxes aren't farther than its kth distance, which the top tree, with a box for every
   node, finds without looking at each of them; it takes the kth distance along, and the traversal there starts with it.
5. A query's results are merged. Ties are broken by the neighbour's id.

Queries are traversed in blocks that lie near each other; distances are products of matrices first, and those that may count
are computed again in double precision, coordinate by coordinate, so that equal vectors are at equal distances.

Defined results: `queries`, a condition on the table's columns, says which rows ask (all if there is none); every row is a
possible neighbour of the others, not of itself; rows with a null id or a null or empty vector, with a null, NaN or infinite
coordinate, or of another dimension than the table's most common one, take no part; for rows that share an id the least vector
counts (and asks if any of them does); with k or fewer other rows all of them are returned. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _exchange as X
from ._text import U64, mix

K, SHARD_ROWS, MOST_SHARDS, SAMPLE, LEAF, BLOCK, ASKED = 10, 16_384, 4096, 20_000, 128, 256, 4096


def usable(vectors: DataFrame, id_column: str, vector_column: str, queries: Column | None, k: int) -> tuple[DataFrame, DataFrame, int]:
    """((id, vec) of the possible neighbours, written; (id, vec) of the queries, written; dimension)."""
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"), asks.alias("asks"))
    rows = rows.where("id is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 1
    rows = rows.where(F.size("vec") == d).select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"), "asks")  # -0.0 is 0.0
    rows = X.written(rows.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")), "vectors")
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    kept = rows.select("id", "vec").withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    return X.written(kept, "distinct"), rows.where("asks").select("id", "vec"), d


def asked_once(asked: DataFrame) -> DataFrame:
    """(id, vec) of each different query, id being the least of those that ask it; written."""
    return X.written(asked.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "asked")


def for_every_asker(found: DataFrame, asked: DataFrame, once: DataFrame, k: int) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest of each query, not itself, from the k + 1 nearest (asker, list of
    (d2, id)) of each different one."""
    near = once.join(found, once["id"] == found["asker"]).select(F.col("vec").alias("__vec"), "near")
    rows = asked.join(near, asked["vec"] == F.col("__vec")).select("id", F.filter("near", lambda x: x["id"] != F.col("id")).alias("near"))
    rows = rows.select(F.col("id").alias("vec_id"), F.posexplode(F.slice("near", 1, k)).alias("place", "x"))
    return rows.select("vec_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("neighbor_id"), F.round(F.sqrt("x.d2"), 6).alias("distance"))


class Tree:
    """Flat arrays of nodes; a leaf has left = -1 and rows begin..end of the reordered vectors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.lo, self.hi, self.left, self.right, self.begin, self.end = [], [], [], [], [], []
        place = np.arange(len(x))
        x = x[order]
        todo = [(0, len(x), -1, False)]
        while todo:
            b, e, parent, is_right = todo.pop()
            n = len(self.lo)
            own = x[place[b:e]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = n
            for c, v in ((self.lo, lo), (self.hi, hi), (self.left, -1), (self.right, -1), (self.begin, b), (self.end, e)):
                c.append(v)
            if e - b > leaf and (hi > lo).any():
                dim = int(np.argmax(hi - lo))
                m = (e - b) // 2
                place[b:e] = place[b:e][np.argpartition(own[:, dim], m)]
                todo += [(b, b + m, n, False), (b + m, e, n, True)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.x, self.ids = np.ascontiguousarray(x[place]), ids[order][place]
        self.norm = (self.x * self.x).sum(axis=1)

    @classmethod
    def load(cls, row: dict, d: int) -> Tree:
        """A tree from its flat arrays."""
        t = cls.__new__(cls)
        t.lo, t.hi, t.x = (np.frombuffer(row[c], float).reshape(-1, d) for c in ("lo", "hi", "vecs"))
        t.left, t.right, t.begin, t.end, t.ids = (np.frombuffer(row[c], np.int64) for c in ("left", "right", "begin", "end", "ids"))
        t.norm = (t.x * t.x).sum(axis=1)
        return t

    def search(self, q: np.ndarray, k: int, kth: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, ids) of the k nearest of each query that aren't beyond its kth distance; inf and -1 fill."""
        d, n = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        for b in range(0, len(q), block):
            s = slice(b, b + block)
            self._block(q[s], np.full(len(q[s]), np.inf) if kth is None else kth[s].copy(), d[s], n[s])
        return d, n

    def bound(self, q: np.ndarray, node: int) -> np.ndarray:
        """Squared distance of each query to the node's box."""
        away = np.maximum(np.maximum(self.lo[node] - q, q - self.hi[node]), 0)
        return np.einsum("ij,ij->i", away, away)

    def _block(self, q, kth, best, near) -> None:
        norm = (q * q).sum(axis=1)
        heap = [(float(self.bound(q, 0).min()), 0)]
        while heap:
            least, node = heapq.heappop(heap)
            if least > kth.max():
                return
            bound = self.bound(q, node)
            live = np.flatnonzero(bound <= kth)
            if not len(live):
                continue
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    at = self.bound(q[live], child)
                    at = at[at <= kth[live]]
                    if len(at):
                        heapq.heappush(heap, (float(at.min()), child))
                continue
            b, e = self.begin[node], self.end[node]
            rough = norm[live, None] + self.norm[None, b:e] - 2 * q[live] @ self.x[b:e].T
            some = rough <= kth[live, None] * (1 + 1e-9) + 1e-9 * (norm[live, None] + self.norm[None, b:e])
            r, c = np.nonzero(some)
            if not len(r):
                continue
            rows, cols = np.unique(r), np.unique(c)
            exact = np.full((len(rows), len(cols)), np.inf)
            diff = q[live[r]] - self.x[b + c]
            exact[np.searchsorted(rows, r), np.searchsorted(cols, c)] = (diff * diff).sum(axis=1)
            at = live[rows]
            both = np.concatenate([best[at], exact], axis=1)
            ids = np.concatenate([near[at], np.broadcast_to(self.ids[b + cols], exact.shape)], axis=1)
            order = np.lexsort((ids, both), axis=-1)[:, : best.shape[1]]
            best[at], near[at] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
            kth[at] = np.minimum(kth[at], best[at, -1])


def top_splits(x: np.ndarray, shards: int) -> list[tuple[int, float, float, int, int]]:
    """Nodes (dimension, value, share, left, right) of a tree with `shards` leaves; leaf i is -1 - i. Where the sample's vectors
    are all equal, dimension is -1 and the share of rows that goes left is taken by a hash of the id."""
    nodes: list[list] = []
    count = 0

    def grow(own: np.ndarray, parts: int) -> int:
        nonlocal count
        if parts == 1:
            count += 1
            return -count
        n, a = len(nodes), parts // 2
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(1)
        dim, value, low = -1, 0.0, np.arange(len(own)) < a / parts * len(own)
        if spread.max() > 0:
            dim = int(np.argmax(spread))
            value = float(np.quantile(own[:, dim], a / parts, method="higher"))
            if value == own[:, dim].min():  # ties: whatever is above the least
                value = float(own[own[:, dim] > value, dim].min())
            low = own[:, dim] < value
            a = min(parts - 1, max(1, round(parts * low.mean())))
        nodes.append([dim, value, a / parts, 0, 0])
        nodes[n][3], nodes[n][4] = grow(own[low], a), grow(own[~low], parts - a)
        return n

    grow(x, shards)
    return [tuple(n) for n in nodes]


def route(x: np.ndarray, ids: np.ndarray, nodes: list[tuple[int, float, float, int, int]]) -> np.ndarray:
    """The shard of each vector."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        n, rows = todo.pop()
        if n < 0:
            out[rows] = -1 - n
        elif len(rows):
            dim, value, share, left, right = nodes[n]
            low = x[rows, dim] < value if dim >= 0 else (mix(ids[rows].view(np.uint64) + U64(n)) >> U64(11)).astype(float) / 2**53 < share
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def inner_boxes(nodes: list[tuple[int, float, float, int, int]], boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The box of each node of the top tree, from those of the shards that have vectors; None if none of its shards has."""
    out: list = [None] * len(nodes)
    for n in range(len(nodes) - 1, -1, -1):  # children come after their parents
        both = [b for c in nodes[n][3:] if (b := boxes.get(-1 - c) if c < 0 else out[c]) is not None]
        if both:
            out[n] = (np.min([b[0] for b in both], axis=0), np.max([b[1] for b in both], axis=0))
    return out


def reached(q: np.ndarray, kth: np.ndarray, nodes, inner, boxes) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, queries) whose boxes aren't farther apart than the queries' kth distances."""
    todo = [(0 if nodes else -1, np.arange(len(q)))]
    while todo:
        n, rows = todo.pop()
        box = boxes.get(-1 - n) if n < 0 else inner[n]
        if box is None:
            continue
        away = np.maximum(np.maximum(box[0] - q[rows], q[rows] - box[1]), 0)
        rows = rows[np.einsum("ij,ij->i", away, away) <= kth[rows]]
        if n < 0 and len(rows):
            yield -1 - n, rows
        elif len(rows):
            todo += [(nodes[n][3], rows), (nodes[n][4], rows)]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)


_SHARD_SQL = "shard int, ids binary, vecs binary"


def _assign(nodes, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
            to = route(x, ids, nodes)
            order = np.argsort(to, kind="stable")
            rows = [(s, ids[order[i:j]].tobytes(), x[order[i:j]].tobytes()) for s, i, j in X.slices(to[order])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "ids", "vecs"])

    return run


def unpack(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in table["ids"]] or [np.zeros(0, np.int64)])
    x = np.concatenate([np.frombuffer(v.as_py(), float).reshape(-1, d) for v in table["vecs"]] or [np.zeros((0, d))])
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


_TREE_SQL = "shard int, ids binary, vecs binary, lo binary, hi binary, left binary, right binary, begin binary, end binary, box binary"


def _build(d: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x = unpack(table, d)
        t = Tree(x, ids)
        arrays = [t.ids, t.x, t.lo, t.hi, *(np.array(v, np.int64) for v in (t.left, t.right, t.begin, t.end)), np.concatenate([t.lo[0], t.hi[0]])]
        return pa.table({c.split()[0]: pa.array([v], pa.int32() if c.endswith(" int") else pa.binary()) for c, v in zip(_TREE_SQL.split(", "), [table["shard"][0].as_py(), *(v.tobytes() for v in arrays)])})

    return run


_FOUND_SQL = "ids binary, vecs binary, dist binary, near binary, shard int"


def _answer(d: int, k: int):
    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out = [], [], [], [], []
        if asked.num_rows and trees.num_rows:
            tree = Tree.load(trees.slice(0, 1).to_pylist()[0], d)
            for a in asked.to_pylist():
                q = np.frombuffer(a["vecs"], float).reshape(-1, d)
                dist, near = tree.search(q, k, np.frombuffer(a["kth"], float) if a["kth"] else None)
                for c, v in zip(out, (a["ids"], a["vecs"], dist.tobytes(), near.tobytes(), a["shard"])):
                    c.append(v)
        return pa.table({c.split()[0]: pa.array(v, pa.int32() if c.endswith(" int") else pa.binary()) for c, v in zip(_FOUND_SQL.split(", "), out)})

    return run


def _ask(nodes, boxes: dict[int, tuple[np.ndarray, np.ndarray]], d: int, k: int):
    """Queries, with the kth distance that they have so far, to the other shards that may have nearer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = inner_boxes(nodes, boxes)
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], float).reshape(-1, d)
                kth = np.frombuffer(row["dist"], float).reshape(-1, k)[:, -1] if row["dist"] else np.full(len(ids), np.inf)
                for shard, go in reached(x, kth, nodes, inner, boxes):
                    if shard != row["shard"]:
                        out = (shard, ids[go].tobytes(), x[go].tobytes(), kth[go].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (pa.int32(), *[pa.binary()] * 3))], ["shard", "ids", "vecs", "kth"])

    return run


def _flat(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asker = np.repeat(np.frombuffer(row["ids"], np.int64), k)
                dist, near = np.frombuffer(row["dist"], float), np.frombuffer(row["near"], np.int64)
                ok = np.isfinite(dist)
                yield pa.RecordBatch.from_arrays([pa.array(asker[ok]), pa.array(near[ok]), pa.array(dist[ok])], ["asker", "id", "d2"])

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """(asker, near): the k nearest of each different query, an array of (d2, id) in order, from packed results of the shards."""
    rows = found.select("ids", "dist", "near").mapInArrow(_flat(k), "asker bigint, id bigint, d2 double")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("asker").orderBy("d2", "id"))).where(F.col("place") <= k)
    return rows.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("near"))


def met(shards: DataFrame, asked: DataFrame, parts: int, f, schema: str) -> DataFrame:
    """f of each shard and its queries; a shard's queries are split over `parts` tasks."""
    asked = asked.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    shards = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return shards.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(f, schema)


def knn(vectors: DataFrame, k: int = K, queries: Column | None = None, shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest other vectors of each query, by Euclidean distance."""
    rows, asked, d = usable(vectors, id_column, vector_column, queries, k)
    once = asked_once(asked)
    n = rows.count()
    shards = min(most_shards, max(1, -(-n // shard_rows)))
    nodes = []
    if shards > 1:
        some = rows.orderBy(F.xxhash64("id")).limit(sample).select("vec").collect()
        nodes = top_splits(np.array([r["vec"] for r in some], float), shards)
    trees = X.written(rows.mapInArrow(_assign(nodes, d), _SHARD_SQL).groupBy("shard").applyInArrow(_build(d), _TREE_SQL), "kd-trees")
    parts = max(1, once.count() // max(ASKED, n // shards // 4))
    begun = once.mapInArrow(_assign(nodes, d), _SHARD_SQL).withColumn("kth", F.lit(None).cast("binary"))
    own = X.written(met(trees, begun, max(1, parts // shards), _answer(d, k + 1), _FOUND_SQL), "kd-own")
    boxes = {r["shard"]: tuple(np.frombuffer(r["box"], float).reshape(2, d)) for r in trees.select("shard", "box").collect()}
    found = own
    if shards > 1:
        # a query whose own shard is empty has no distance yet and asks everywhere
        missing = once.mapInArrow(_assign(nodes, d), _SHARD_SQL).where(~F.col("shard").isin(*boxes)) if len(boxes) < shards else None
        asks = own.select("ids", "vecs", "dist", "shard")
        if missing is not None:
            asks = asks.unionByName(missing.select("ids", "vecs", F.lit(None).cast("binary").alias("dist"), "shard"))
        more = asks.mapInArrow(_ask(nodes, boxes, d, k + 1), "shard int, ids binary, vecs binary, kth binary")
        found = own.unionByName(met(trees, more, parts, _answer(d, k + 1), _FOUND_SQL))
    return for_every_asker(merged(found, k + 1), asked, once, k)
