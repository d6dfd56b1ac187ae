"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, with shard results merged.

A shard's graph is flat arrays: for each level the nodes that it has and an int32 matrix of their neighbours, -1 where there
is none. Levels are drawn from a hash of the id, geometric with factor ln(M). Nodes are inserted in batches that double up to
a limit; a batch searches the graph before it, sees its own members by brute force, takes up to M diverse neighbours (one that
is nearer to a chosen neighbour than to the node is passed over while there are enough others), and links back, a full list
keeping its most diverse nearest. Searching descends the upper levels and then widens to `ef` candidates at the bottom; a
whole batch of queries moves in step, so the work is in numpy. Every query goes to every shard's graph, and its results
are merged, nearest first, ties by id.

Shards are a hash of the id, so that each is a fair sample; there are at most `most_shards`, which grow with the table beyond
that: as searching a graph takes about the logarithm of its size, the work then grows as the number of queries. Of equal
vectors the k + 1 least ids take part, and equal queries are asked once, as in kd_search. Every row is indexed. Recall against
brute force is tested to be at least 0.9, on the given table too.

Defined results: as the exact search (kd_search): `queries` says which rows ask; a row isn't its own neighbour; unusable rows
take no part; for rows that share an id the least vector counts; a shard of few vectors is searched exhaustively by ef; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import _exchange as X
from ._text import U64, mix
from .kd_search import _SHARD_SQL, asked_once, for_every_asker, matrix, merged, met, unpack, usable

K, M, EF_BUILD, EF, SHARD_ROWS, MOST_SHARDS, ASKED = 10, 20, 64, 96, 16_384, 512, 4096


class Graph:
    def __init__(self, x: np.ndarray, ids: np.ndarray, m: int = M, ef: int = EF_BUILD, batch: int = 512) -> None:
        self.x, self.ids, self.m = np.ascontiguousarray(x, np.float32), ids, m
        n = len(x)
        u = (mix(ids.astype(np.int64).view(np.uint64) + U64(12345)) >> U64(11)).astype(float) / 2**53
        level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)), 12).astype(int)
        self.order = np.argsort(-level, kind="stable")  # the top node first; upper levels are complete before lower ones
        self.x, self.ids, level = self.x[self.order], ids[self.order], level[self.order]
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.top = int(level[0]) if n else 0
        self.count = [int((level >= k).sum()) for k in range(self.top + 1)]
        self.links = [np.full((c, 2 * m if k == 0 else m), -1, np.int32) for k, c in enumerate(self.count)]
        done = 1
        while done < n:
            size = min(batch, done, n - done)
            self._insert(done, done + size, ef)
            done += size

    def _distance(self, q: np.ndarray, norm: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each query (row) to its nodes (columns)."""
        return norm[:, None] + self.norm[nodes] - 2 * np.einsum("ij,ikj->ik", q, self.x[nodes], optimize=False)

    def _level(self, q, norm, start, start_d, k: int, ef: int, have: int):
        """The ef nearest nodes found at level k from given starts: (distances, nodes), sorted, inf and 0 filling."""
        b = len(q)
        links = self.links[k]
        d, node = np.full((b, ef), np.inf, np.float32), np.zeros((b, ef), np.int32)
        s = min(ef, start.shape[1])
        d[:, :s], node[:, :s] = start_d[:, :s], start[:, :s]
        closed = ~np.isfinite(d)
        seen = np.zeros((b, min(self.count[k], have)), bool)
        r = np.repeat(np.arange(b), s)
        seen[r, start[:, :s].ravel()] = True
        live = np.arange(b)
        while len(live):
            open_d = np.where(closed[live], np.inf, d[live])
            pick = open_d.argmin(axis=1)
            ok = np.isfinite(open_d[np.arange(len(live)), pick])
            live, pick = live[ok], pick[ok]
            if not len(live):
                break
            closed[live, pick] = True
            near = links[node[live, pick]]
            fresh = near >= 0
            near = np.where(fresh, near, 0)
            fresh &= ~seen[live[:, None], near]
            any_ = fresh.any(axis=1)
            rows, near, fresh = live[any_], near[any_], fresh[any_]
            if not len(rows):
                continue
            rr, cc = np.nonzero(fresh)
            seen[rows[rr], near[rr, cc]] = True
            # the fresh ones go to the left
            width = int(fresh.sum(axis=1).max())
            left = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near, fresh = np.take_along_axis(near, left, 1), np.take_along_axis(fresh, left, 1)
            nd = np.where(fresh, self._distance(q[rows], norm[rows], near), np.inf).astype(np.float32)
            useful = (nd < d[rows, -1:]).any(axis=1)
            rows, near, nd = rows[useful], near[useful], nd[useful]
            if not len(rows):
                continue
            both = np.concatenate([d[rows], nd], axis=1)
            best = np.argpartition(both, ef - 1, axis=1)[:, :ef]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(both, best, 1), axis=1, kind="stable"), 1)
            d[rows] = np.take_along_axis(both, best, 1)
            node[rows] = np.take_along_axis(np.concatenate([node[rows], near], axis=1), best, 1)
            closed[rows] = np.take_along_axis(np.concatenate([closed[rows], ~np.isfinite(nd)], axis=1), best, 1)
        return d, node

    def _descend(self, q, norm, to: int, have: int):
        """Entry points at level `to`."""
        node = np.zeros((len(q), 1), np.int32)
        d = self._distance(q, norm, node).astype(np.float32)
        for k in range(self.top, to, -1):
            d, node = self._level(q, norm, node, d, k, 4, have)
            d, node = d[:, :1], node[:, :1]
        return d, node

    def _choose(self, node_d: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` diverse ones of sorted candidates of each row, then the nearest others; -1 fills."""
        b, c = near.shape
        x = self.x[near]
        norm = self.norm[near]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        valid = np.isfinite(node_d)
        chosen = np.zeros((b, c), bool)
        blocked = ~valid
        for j in range(c):
            take = ~blocked[:, j] & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            blocked[take] |= between[take, j] < node_d[take]
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(near, order, 1)
        return np.where(np.take_along_axis(valid, order, 1), out, -1).astype(np.int32)

    def _insert(self, begin: int, end: int, ef: int) -> None:
        q, norm = self.x[begin:end], self.norm[begin:end]
        own = np.arange(begin, end)
        inner = norm[:, None] + norm[None, :] - 2 * q @ q.T
        np.fill_diagonal(inner, np.inf)
        start_d, start = np.zeros((len(q), 1), np.float32), np.zeros((len(q), 1), np.int32)
        start_d = self._distance(q, norm, start).astype(np.float32)
        for k in range(self.top, -1, -1):
            there = np.flatnonzero(own < self.count[k])
            before = min(begin, self.count[k])
            if before == 0:
                continue
            go = ef if len(there) else 4
            d, near = self._level(q, norm, start, start_d, k, go, before)
            start_d, start = d[:, : min(go, 8)], near[:, : min(go, 8)]
            if not len(there):
                continue
            inside = inner[np.ix_(there, there)]
            few = min(ef // 2, len(there))
            mates = np.argpartition(inside, few - 1, axis=1)[:, :few]
            all_d = np.concatenate([d[there], np.take_along_axis(inside, mates, 1)], axis=1)
            all_n = np.concatenate([near[there], own[there][mates]], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            all_d, all_n = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_n, order, 1)
            picked = self._choose(all_d, all_n, self.m)
            links = self.links[k]
            links[own[there], : self.m] = picked
            self._link_back(k, np.repeat(own[there], self.m), picked.ravel())

    def _link_back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        links, width = self.links[k], self.links[k].shape[1]
        ok = target >= 0
        source, target = source[ok], target[ok]
        known = (links[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, new = np.unique(target, return_index=True, return_counts=True)
        have = (links[nodes] >= 0).sum(axis=1)
        column = np.arange(len(target)) - np.repeat(first, new)
        wide = np.full((len(nodes), width + int(new.max())), -1, np.int64)
        wide[:, :width] = links[nodes]
        wide[np.repeat(np.arange(len(nodes)), new), width + column] = source
        full = have + new > width
        some = np.flatnonzero(~full)
        left = np.argsort(wide[some] < 0, axis=1, kind="stable")[:, :width]
        links[nodes[some]] = np.take_along_axis(wide[some], left, 1)
        for b in range(0, int(full.sum()), 512):
            at = np.flatnonzero(full)[b : b + 512]
            near = wide[at]
            d = np.where(near >= 0, self._distance(self.x[nodes[at]], self.norm[nodes[at]], np.maximum(near, 0)), np.inf)
            rank = np.argsort(d, axis=1, kind="stable")[:, : 2 * width]
            links[nodes[at]] = self._choose(np.take_along_axis(d, rank, 1), np.maximum(np.take_along_axis(near, rank, 1), 0), width)

    def search(self, q: np.ndarray, k: int, ef: int = EF, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances in double precision, ids) of about the k nearest of each query."""
        dist, near = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        for b in range(0, len(q), batch):
            x = np.ascontiguousarray(q[b : b + batch], np.float32)
            norm = np.einsum("ij,ij->i", x, x)
            d, node = self._descend(x, norm, 0, len(self.x))
            d, node = self._level(x, norm, node, d, 0, max(ef, k + 1), len(self.x))
            ids = self.ids[node]
            diff = q[b : b + batch, None, :].astype(float) - self.x[node[:, : 2 * k + 2]].astype(float)
            exact = np.einsum("ikj,ikj->ik", diff, diff)
            ids = ids[:, : 2 * k + 2]
            exact[~np.isfinite(d[:, : 2 * k + 2])] = np.inf
            order = np.lexsort((ids, exact), axis=-1)[:, :k]
            dist[b : b + batch, : order.shape[1]] = np.take_along_axis(exact, order, 1)
            near[b : b + batch, : order.shape[1]] = np.take_along_axis(ids, order, 1)
        return dist, near


def _assign(shards: int, d: int, copies: bool):
    """Vectors packed by shard; with copies, as queries to every shard, in single precision as the graphs have them."""

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
            if copies:
                rows = [(s, ids.tobytes(), x.astype(np.float32).tobytes()) for s in range(shards)]
            else:
                to = (mix(ids.astype(np.int64).view(np.uint64) + U64(777)) % U64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                rows = [(s, ids[order[i:j]].tobytes(), x[order[i:j]].tobytes()) for s, i, j in X.slices(to[order])]
            for row in rows if len(ids) else []:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["shard", "ids", "vecs"])

    return run


_GRAPH_SQL = "shard int, ids binary, vecs binary, top int, counts binary, links binary"


def _build(d: int, m: int, ef: int):
    def run(table: pa.Table) -> pa.Table:
        g = Graph(unpack(table, d)[1], unpack(table, d)[0], m, ef)
        row = (table["shard"][0].as_py(), g.ids.tobytes(), g.x.tobytes(), g.top, np.array(g.count, np.int32).tobytes(), b"".join(x.tobytes() for x in g.links))
        return pa.table({c.split()[0]: pa.array([v], pa.int32() if c.endswith(" int") else pa.binary()) for c, v in zip(_GRAPH_SQL.split(", "), row)})

    return run


def load(row: dict, d: int, m: int) -> Graph:
    """A graph from its flat arrays."""
    g = Graph.__new__(Graph)
    g.m, g.top = m, row["top"]
    g.ids, g.x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.float32).reshape(-1, d)
    g.norm = np.einsum("ij,ij->i", g.x, g.x)
    g.count = np.frombuffer(row["counts"], np.int32).tolist()
    g.links, at = [], 0
    flat = np.frombuffer(row["links"], np.int32)
    for k, c in enumerate(g.count):
        width = 2 * m if k == 0 else m
        g.links.append(flat[at : at + c * width].reshape(c, width))
        at += c * width
    return g


def _answer(d: int, k: int, m: int, ef: int):
    def run(graph: pa.Table, asked: pa.Table) -> pa.Table:
        out = [], [], []
        if graph.num_rows:
            g = load(graph.to_pylist()[0], d, m)
            for a in asked.to_pylist():
                dist, near = g.search(np.frombuffer(a["vecs"], np.float32).reshape(-1, d), k, ef)
                for c, v in zip(out, (a["ids"], dist.tobytes(), near.tobytes())):
                    c.append(v)
        return pa.table({n: pa.array(c, pa.binary()) for n, c in zip(("ids", "dist", "near"), out)})

    return run


def ann(vectors: DataFrame, k: int = K, queries: Column | None = None, m: int = M, ef_build: int = EF_BUILD, ef: int = EF, shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): about the k nearest other vectors of each query, by Euclidean distance.

    Graphs are built once, written, and searched by as many tasks each as the number of queries asks for.
    """
    rows, asked, d = usable(vectors, id_column, vector_column, queries, k)
    once = asked_once(asked)
    shards = min(most_shards, max(1, -(-rows.count() // shard_rows)))
    graphs = rows.mapInArrow(_assign(shards, d, False), _SHARD_SQL).groupBy("shard").applyInArrow(_build(d, m, ef_build), _GRAPH_SQL)
    graphs = X.written(graphs, "hnsw")
    parts = max(1, once.count() // ASKED)
    found = met(graphs, once.mapInArrow(_assign(shards, d, True), _SHARD_SQL), parts, _answer(d, k + 1, m, ef), "ids binary, dist binary, near binary")
    return for_every_asker(merged(found, k + 1), asked, once, k)
