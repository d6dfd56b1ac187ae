"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, all of them and exactly, by a
size-aware heavy-light join.

1. Inverted lists over all n-grams, in packed form: an n-gram of one document only joins nothing and is dropped, and what is
   left of a document, its shared n-grams, goes back to it. A partner needs at least threshold * |A| of A's n-grams, so a
   document with fewer shared n-grams than that is dropped too: an exact filter, linear in the input, that leaves little but
   copies. Shared n-grams keep their document frequency; the global order is rarest first. Heavy n-grams, those whose list
   would be much longer than a bucket, are counted before, partially in each task, and known to every task by a table of
   bounded size: their entries go straight back to their documents, so no list of theirs is ever gathered.
2. Documents with the same shared n-grams and size are one class and take part once. Small sets enumerate subsets of `subset`
   n-grams of their prefix (two similar sets share their first `subset` common n-grams, which lie in the first
   |A| - ceil(threshold |A|) + subset of A's); large sets, and small ones that can match large ones, scan the inverted lists of
   their prefix. The size at which a set is large minimises the cost measured on all sets: subsets enumerated against list
   entries scanned. A list or subset links its sets in a chain by size, where sizes are compatible: linear in its length,
   whatever the number of pairs; sets of equal size are linked in the task that enumerates them, so that a list has an entry
   for each size and task.
3. The linked components hold all pairs. Each is joined by scanning the inverted lists of its sets with exact counts; a large
   component is split into blocks of probing sets. Copies aren't expanded: a class counts with its number of documents.

A word is a run of ASCII letters, digits and non-ASCII characters; ASCII letters count as lower case. A text with fewer than n
words, but some, has one n-gram, its words. N-grams, documents and classes are told apart by hashes of 52 to 64 bits. Defined
results: a null or empty text, or one without a word, matches nothing; a null doc_id isn't a document; a repeated row counts
once; rows that share a doc_id but not their text are documents of their own. Other columns are ignored, and kept by
`without_near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from ._text import ALNUM, U64, combine, groups, mix, rolling, sets, span_hash, strings, words

N, THRESHOLD, SUBSET, BLOCK = 4, 0.5, 2, 4096
_NAME = U64((1 << 56) - 1)
_SHIP = 16  # what sending a key costs, in list entries scanned
_FLUSH = 1_000_000
#: A document: doc_id, number of n-grams, hash of its text.
_DOC = np.dtype([("id", "<i8"), ("n", "<u4"), ("check", "<i8")])
#: A class of equal sets: its name, number of n-grams.
_NODE = np.dtype([("id", "<i8"), ("n", "<u4")])


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram names of each text, sorted: (names, offsets by text)."""
    rows = len(offsets) - 1
    start, end, row = words(data, offsets, ALNUM)
    h = span_hash(data, start, end, lower=True)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    m = max(0, len(h) - n + 1)
    grams = combine([h[k : k + m] for k in range(n)]) if m else np.zeros(0, np.uint64)
    ok = row[:m] == row[n - 1 :] if m else np.zeros(0, bool)
    names, at = grams[ok], row[:m][ok]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.array([mix(np.bitwise_xor.reduce(combine([h[f : f + c], np.arange(c, dtype=np.uint64)]))[None] + U64(c))[0] for f, c in zip(first, count[short])], np.uint64)
        names, at = np.concatenate([names, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        names, at = names[order], at[order]
    return sets(names, at, rows)


def _uid(docs: np.ndarray) -> np.ndarray:
    return combine([docs["id"].view(np.uint64) if docs["id"].flags.c_contiguous else docs["id"].astype(np.uint64), docs["n"].astype(np.uint64), docs["check"].astype(np.uint64)])


def _classes(df: np.ndarray) -> np.ndarray:
    """The first key of the order: frequency in eighths of an octave, above a name of 56 bits."""
    return (8 * np.log2(df)).astype(np.uint64) << U64(56)


def _send(keys: np.ndarray, refs: np.ndarray, docs: np.ndarray, n: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, keys, references, documents) of entries: packed by bucket of the key."""
    order = np.argsort(keys, kind="stable")
    keys, refs = keys[order], refs[order]
    for b, i, j in X.slices(X.bucket_of(keys, n)):
        used, ref = np.unique(refs[i:j], return_inverse=True)
        wide = np.uint16 if len(used) <= 1 << 16 else np.uint32
        yield b, X.pack_keys(keys[i:j], n), np.dtype(wide).char.encode() + ref.astype(wide).tobytes(), docs[used].tobytes()


_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary()), ("docs", pa.binary())])
_SENT_SQL = "bucket int, keys binary, refs binary, docs binary"
#: Marks of rows that hold no list entries: what goes straight to a document's bucket, and links found within a task.
_DIRECT, _LINKS = b"D", b"L"


def _batches(sent: Iterator[tuple[int, bytes, bytes, bytes]], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded size."""
    rows, size = [], 0
    for x in sent:
        rows.append(x)
        size += sum(map(len, x[1:]))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SENT)], schema=_SENT)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SENT)], schema=_SENT)


def _received(table: pa.Table, kind: np.dtype, mark: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[bytes, bytes, bytes]]]:
    """(keys, references, documents) of a bucket, and its rows that bear the mark."""
    keys, refs, docs, marked, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)], [], 0
    for k, r, d in zip(table["keys"], table["refs"], table["docs"]):
        r = r.as_py()
        if r[:1] == mark:
            marked.append((k.as_py(), r[1:], d.as_py()))
            continue
        keys.append(X.unpack_keys(k.as_py()))
        d = np.frombuffer(d.as_py(), kind)
        refs.append(np.frombuffer(r[1:], np.dtype(r[:1].decode())).astype(np.int64) + at)
        docs.append(d)
        at += len(d)
    return np.concatenate(keys), np.concatenate(refs), np.concatenate(docs), marked


def _names(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            data, offsets, _ = strings(batch.column(0))
            for i, j in groups(offsets):
                yield ngram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)[0]

    return run


def _scatter(n: int, buckets: int, heavy: np.ndarray):
    flush_at = max(_FLUSH, min(8 * _FLUSH, 16 * buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = rows = 0

        def flush():
            keys, refs, docs, at = [], [], [], 0
            for k, r, d in held:
                keys.append(k)
                refs.append(r + at)
                docs.append(d)
                at += len(d)
            keys, refs, docs = np.concatenate(keys), np.concatenate(refs), np.concatenate(docs)
            where = X.places(keys, heavy)
            known = where >= 0
            yield from _batches(_send(keys[~known], refs[~known], docs, buckets))
            if known.any():
                entry = _classes(heavy["count"][where[known]]) | (keys[known] >> U64(8))
                rows = ((t, e, _DIRECT + c, d) for t, d, c, e in _packs(entry, refs[known], docs, buckets))
                yield from _batches(rows)

        for batch in batches:
            ids, check = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offsets, _ = strings(batch.column(1))
            for i, j in groups(offsets):
                names, at = ngram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                count = np.diff(at)
                docs = np.zeros(j - i, _DOC)
                docs["id"], docs["n"], docs["check"] = ids[i:j], count, check[i:j]
                held.append((names, np.repeat(np.arange(j - i), count), docs))
                size += len(names)
                rows += j - i
                if size > flush_at or rows > 50_000:
                    if size:
                        yield from flush()
                    held, size, rows = [], 0, 0
        if size:
            yield from flush()
        held = []
        X.trim()

    return run


def _packs(entry: np.ndarray, refs: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket of the documents, documents, counts, entries) of entries with references to documents."""
    to = X.bucket_of(_uid(docs), buckets)
    rank = np.argsort(to, kind="stable")
    place = np.empty(len(docs), np.int64)
    place[rank] = np.arange(len(docs))
    where = place[refs]
    order = np.argsort(where, kind="stable")
    entry, where, docs, to = entry[order], where[order], docs[rank], to[rank]
    count = np.bincount(where, minlength=len(docs))
    ends = np.concatenate(([0], np.cumsum(count)))
    for t, i, j in X.slices(to):
        used = np.flatnonzero(count[i:j]) + i
        if len(used):
            yield t, docs[used].tobytes(), count[used].astype(np.uint32).tobytes(), entry[ends[i] : ends[j]].tobytes()


_PACK = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_PACK_SQL = "bucket int, docs binary, counts binary, keys binary"


def _shared(buckets: int):
    """Drop n-grams of one document; give the others, with their frequency, back to the documents' buckets."""
    bits = U64(buckets.bit_length() - 1)

    def run(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        keys, refs, docs, direct = _received(table, _DOC, _DIRECT)
        rows = [(b, d, c, k) for k, c, d in direct]
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, refs = keys[order], refs[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            df = np.diff(np.append(first, len(keys)))
            keep = np.repeat(df >= 2, df)
            name = ((U64(b) << (U64(64) - bits)) | ((keys[keep] << U64(64 - X.BITS)) >> bits)) >> U64(8)
            rows += _packs(np.repeat(_classes(df), df)[keep] | name, refs[keep], docs, buckets)
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PACK)], schema=_PACK)

    return run


_SETS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("check", pa.int64()), ("copies", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("node", pa.int64()), ("keys", pa.binary())])
_SETS_SQL = "uid bigint, doc_id bigint, check bigint, copies int, n int, size int, node bigint, keys binary"


def _gather(threshold: float):
    """The shared n-grams of each document, rarest first; documents that can't have a partner go."""

    def run(table: pa.Table) -> pa.Table:
        docs = np.concatenate([np.frombuffer(x.as_py(), _DOC) for x in table["docs"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64)
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]])
        uid, inverse = np.unique(_uid(docs), return_inverse=True)
        owner = np.repeat(inverse, counts)
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        one = np.zeros(len(uid), _DOC)
        one[inverse] = docs
        ends = np.searchsorted(owner, np.arange(len(uid) + 1))
        out = [[] for _ in _SETS]
        for i in np.flatnonzero(np.diff(ends) >= np.ceil(threshold * one["n"] - 1e-9)):
            s = np.sort(keys[ends[i] : ends[i + 1]])
            new = np.concatenate(([True], s[1:] != s[:-1]))
            copies = len(s) // max(1, int(new.sum()))  # a repeated row has every n-gram again
            s = s[new]
            n = int(one["n"][i])
            if len(s) >= math.ceil(threshold * n - 1e-9):
                node = mix(mix(s).sum(dtype=np.uint64)[None] + U64(n))[0]
                for c, x in zip(out, (int(uid[i].view(np.int64)), int(one["id"][i]), int(one["check"][i]), copies, n, len(s), int(node.view(np.int64)), s.tobytes())):
                    c.append(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SETS)], schema=_SETS)

    return run


def shared_sets(docs: DataFrame, n: int, threshold: float, heavy: int = 4096) -> DataFrame:
    """Step 1, written to the shared folder: (uid, doc_id, check, copies, n, size, node, keys) of each document that may have a
    partner. heavy: how often an n-gram must occur, at least, to be a heavy one."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("check")).where("doc_id is not null and text is not null")
    docs = X.rereadable(docs)
    b = X.buckets(docs)
    often = X.heavy_keys(docs.select("text").mapInArrow(X.count_frequent(_names(n), b, often=min(8, heavy)), X.COUNTED), b, heavy)
    sent = docs.mapInArrow(_scatter(n, b, often), _SENT_SQL)
    back = X.by_bucket(sent, b, _shared(b), _PACK_SQL)
    return X.written(X.by_bucket(back, b, _gather(threshold), _SETS_SQL), "shared-ngrams")


def _prefix(n: int, size: int, threshold: float, more: int) -> int:
    """How many of a document's `size` shared n-grams are in the prefix of its n; those of its own come first in the order."""
    return max(0, n - math.ceil(threshold * n - 1e-9) + more - (n - size))


def boundary(sizes: DataFrame, threshold: float, subset: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, by sums over all sets.

    sizes: a row for each n, with the sums over its sets of both costs: keys sent for the subsets of the prefix; keys sent for
    the prefix, and the entries of its inverted lists. A key sent counts as many entries scanned.
    """
    rows = sorted((r["n"], r["subsets"], r["scans"]) for r in sizes.collect())
    if not rows:
        return 0
    n, subsets, scans = (np.array(c, float) for c in zip(*rows))
    bounds = np.concatenate(([0], n))
    below = np.concatenate(([0], np.cumsum(subsets)))
    above = np.concatenate(([0], np.cumsum(scans)))
    scanned = above[-1] - above[np.searchsorted(n, np.where(bounds > 0, threshold * (bounds + 1), 0))]
    return int(bounds[np.argmin(below + scanned)])


def _costs(threshold: float, subset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_pylist()
            rows = [], [], []
            for size, keys in zip(n, batch.column(1)):
                df = 2.0 ** ((np.frombuffer(keys.as_py(), np.uint64) >> U64(56)) / 8)
                p, q = _prefix(size, len(df), threshold, subset), _prefix(size, len(df), threshold, 1)
                for c, x in zip(rows, (size, float(_SHIP * math.comb(p, subset)), float(_SHIP * q + df[:q].sum()))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.float64()), pa.array(rows[2], pa.float64())], ["n", "subsets", "scans"])

    return run


def _link_keys(threshold: float, subset: int, x: int, buckets: int):
    """Subset and single keys of each set, packed by bucket; of the sets of a task that have a key and size in common, one is
    sent and the others are linked to it."""

    def sent(names: list[np.ndarray], refs: list[np.ndarray], nodes: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        keys, at = np.concatenate(names), np.concatenate(refs)
        order = np.lexsort((nodes["n"][at], keys))
        keys, at = keys[order], at[order]
        same = (keys[1:] == keys[:-1]) & (nodes["n"][at[1:]] == nodes["n"][at[:-1]])
        root = X.forest(at[:-1][same], at[1:][same], len(nodes))
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        if len(linked):
            yield int(linked[0]) % buckets, nodes["id"][linked].tobytes(), _LINKS, nodes["id"][root[linked]].tobytes()
        first = np.concatenate(([True], ~same))
        yield from _send(keys[first], at[first], nodes, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, keys = (batch.column(i) for i in range(3))
            _, first = np.unique(node.to_numpy(), return_index=True)
            nodes = np.zeros(len(batch), _NODE)
            nodes["id"], nodes["n"] = node.to_numpy(), n.to_numpy()
            names, refs, held = [], [], 0
            for i in np.sort(first).tolist():
                size, s = int(nodes["n"][i]), np.frombuffer(keys[i].as_py(), np.uint64)
                before = len(names)
                if size <= x:
                    p = s[: _prefix(size, len(s), threshold, subset)]
                    if len(p) >= subset:
                        grid = np.stack(np.triu_indices(len(p), 1)) if subset == 2 else np.array([*combinations(range(len(p)), subset)]).T
                        names.append(combine([p[g] for g in grid]))
                        refs.append(np.full(grid.shape[1], i, np.int64))
                if size > x or size >= threshold * (x + 1) or size < subset * (1 + threshold) / threshold:
                    p = s[: _prefix(size, len(s), threshold, 1)]
                    names.append(mix(p.copy()))
                    refs.append(np.full(len(p), i, np.int64))
                held += sum(map(len, names[before:]))
                if held > _FLUSH // 4:
                    yield from _batches(sent(names, refs, nodes))
                    names, refs, held = [], [], 0
            if held:
                yield from _batches(sent(names, refs, nodes))
        X.trim()

    return run


def _chain(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        keys, refs, docs, linked = _received(table, _NODE, _LINKS)
        node, inverse = np.unique(docs["id"], return_inverse=True)
        size = np.zeros(len(node), np.int64)
        size[inverse] = docs["n"]
        refs = inverse[refs]
        order = np.lexsort((refs, size[refs], keys))
        keys, refs = keys[order], refs[order]
        near = (keys[1:] == keys[:-1]) & (size[refs[:-1]] >= threshold * size[refs[1:]] - 1e-9) & (refs[1:] != refs[:-1])
        root = X.forest(refs[:-1][near], refs[1:][near], len(node))
        at = np.flatnonzero(root != np.arange(len(node)))
        u = np.concatenate([node[at], *(np.frombuffer(k, np.int64) for k, _, _ in linked)])
        v = np.concatenate([node[root[at]], *(np.frombuffer(d, np.int64) for _, _, d in linked)])
        return pa.table({"u": u, "v": v}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def _similar(sets_: list[np.ndarray], n: np.ndarray, probe: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of similar sets, i probing: i < j, or j doesn't probe. Exact counts from inverted lists."""
    m = len(sets_)
    length = np.array([len(s) for s in sets_])
    owner = np.repeat(np.arange(m), length)
    _, item = np.unique(np.concatenate(sets_), return_inverse=True)
    order = np.argsort(item, kind="stable")
    member = owner[order]
    start = np.searchsorted(item[order], np.arange(item.max() + 2))
    ends = np.concatenate(([0], np.cumsum(length)))
    out = [], [], []
    for i in np.flatnonzero(probe):
        own = item[ends[i] : ends[i + 1]]
        size = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        shared = np.bincount(member[at], minlength=m)
        j = np.flatnonzero(shared)
        j = j[(j > i) | ~probe[j]]
        score = shared[j] / (n[i] + n[j] - shared[j])
        hit = score >= threshold
        out[0].append(np.full(hit.sum(), i))
        out[1].append(j[hit])
        out[2].append(score[hit])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64()), ("jaccard", pa.float64())])
_FOUND_SQL = "u bigint, v bigint, links bigint, jaccard double"


def _joined(threshold: float, pairs: bool):
    """Of each component in a bucket: (u, null, links) for each probing class, the documents in classes similar to it, and
    (u, v, jaccard) for every pair of classes, or, without pairs, for a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        comp, node, weight = (table[c].to_numpy() for c in ("root", "node", "weight"))
        n, probe, part = table["n"].to_numpy().astype(np.int64), table["probe"].to_numpy(), table["part"].to_numpy()
        blobs = table["keys"].combine_chunks() if table["keys"].num_chunks != 1 else table["keys"].chunk(0)
        order = np.lexsort((node, part, comp))
        u, v, links, score = [], [], [], []
        group = np.flatnonzero(np.concatenate(([True], (comp[order][1:] != comp[order][:-1]) | (part[order][1:] != part[order][:-1]))))
        for lo, hi in zip(group, np.append(group[1:], len(order))):
            own = order[lo:hi]
            m, name, w, asks = len(own), node[own], weight[own], probe[own]
            if m < 2:
                continue
            i, j, s = _similar([np.frombuffer(blobs[int(r)].as_py(), np.uint64) & _NAME for r in own], n[own], asks, threshold)
            i, j = i.astype(np.int64), j.astype(np.int64)
            if not len(i):
                continue
            back = asks[j]  # a pair of two probing classes is found once
            found = np.bincount(np.concatenate([i, j[back]]), weights=np.concatenate([w[j], w[i[back]]]), minlength=m).astype(np.int64)
            at = np.flatnonzero(found)
            u.append(name[at])
            v.append(np.full(len(at), -1))
            links.append(found[at])
            score.append(np.zeros(len(at)))
            if pairs:
                mine = back | (i < j)  # with blocks, a pair belongs to the block of its lesser class
                a, b, s = name[i[mine]], name[j[mine]], s[mine]
            else:
                root = X.forest(i, j, m)
                at = np.flatnonzero(root != np.arange(m))
                a, b, s = name[at], name[root[at]], np.zeros(len(at))
            u.append(a)
            v.append(b)
            links.append(np.full(len(a), -1))
            score.append(s)
        u, v, links, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((u, np.int64), (v, np.int64), (links, np.int64), (score, float)))
        none = links >= 0
        return pa.table({"u": u, "v": pa.array(v, mask=none), "links": pa.array(links, mask=~none), "jaccard": pa.array(score, mask=none)}, schema=_FOUND)

    return run


def _join(docs: DataFrame, n: int, threshold: float, subset: int, block: int, heavy: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, found), written: of shared_sets; (class, rep, docs, first, n, size); of _joined."""
    spark = docs.sparkSession
    some = shared_sets(docs, n, threshold, heavy)
    X.release(spark)
    costs = some.select("n", "keys").mapInArrow(_costs(threshold, subset), "n int, subsets double, scans double")
    x = boundary(costs.groupBy("n").agg(F.sum("subsets").alias("subsets"), F.sum("scans").alias("scans")), threshold, subset)
    b = X.buckets(some)
    links = X.by_bucket(some.select("node", "n", "keys").mapInArrow(_link_keys(threshold, subset, x, b), _SENT_SQL), b, _chain(threshold), "u bigint, v bigint")
    roots = X.components(links)
    roots = X.written(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "roots")
    classes = X.written(some.groupBy(F.col("node").alias("class")).agg(F.min("uid").alias("rep"), F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("size").alias("size")), "classes")
    parts = roots.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    asked = roots.join(parts, "root").join(classes, F.col("node") == F.col("class")).select("rep", "root", "parts", F.col("docs").alias("weight"))
    rows = some.select("uid", "node", "n", "keys").join(asked, F.col("uid") == F.col("rep")).drop("rep", "uid")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("probe", F.pmod(F.xxhash64("node"), F.col("parts")) == F.col("part")).drop("parts")
    rows = rows.withColumn("to", F.pmod(F.xxhash64("root", "part"), F.lit(4 * b)).cast("int"))
    return some, classes, X.written(X.by_bucket(rows, 4 * b, _joined(threshold, pairs), _FOUND_SQL, "to"), "similar")


def _self_similar(threshold: float):
    """Whether the documents of a class are similar to each other: all of their n-grams may be shared with others only."""
    return F.col("size") / (2 * F.col("n") - F.col("size")) >= threshold


def _groups(classes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(class, root, copies, links) of the classes with a similar document: root names the connected group."""
    edges = found.where("v is not null").select("u", "v")
    roots = X.components(edges)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    rows = classes.join(links, F.col("class") == F.col("u"), "left").join(roots, F.col("class") == F.col("node"), "left")
    same = F.when(_self_similar(threshold), F.col("docs") - 1).otherwise(0)
    rows = rows.select("class", F.coalesce("root", "class").alias("root"), "n", "size", "first", (same + F.coalesce("links", F.lit(0))).alias("links"))
    return rows.where("links > 0")


def ngram_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, subset: int = SUBSET, block: int = BLOCK, heavy: int = 4096) -> DataFrame:
    """(doc_id, class_id, n_links, copy_id) of every document that is similar to another one; docs has doc_id and text.

    n_links: the number of other documents at or above the threshold, copies among them. class_id: the least doc_id of the
    documents that such links connect. copy_id: the least doc_id of those with the same set of n-grams, of which not all links
    need be listed, for they have the same ones. A document without a row has no link and is a class of its own.
    """
    some, classes, found = _join(docs, n, threshold, subset, block, heavy, False)
    groups = X.written(_groups(classes, found, threshold), "groups")
    least = groups.groupBy("root").agg(F.min("first").alias("class_id"))
    rows = some.select("doc_id", "node", "n", "size").join(groups.join(least, "root").select("class", "class_id", "links", "first"), F.col("node") == F.col("class"))
    copy = F.when(F.col("n") == F.col("size"), F.col("first")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "class_id", F.col("links").alias("n_links"), copy.alias("copy_id"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, subset: int = SUBSET, block: int = BLOCK, heavy: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (class_a, class_b, jaccard), class_a < class_b, of all pairs of classes at or above the threshold, and
    (doc_id, class, within): the class of each document, and the similarity of its documents to each other (null if they aren't
    similar). A pair of documents is similar if their classes are, or if they are in a class that is similar within."""
    some, classes, found = _join(docs, n, threshold, subset, block, heavy, True)
    pairs = found.where("v is not null").select(F.least("u", "v").alias("class_a"), F.greatest("u", "v").alias("class_b"), "jaccard")
    within = F.when(_self_similar(threshold), F.col("size") / (2 * F.col("n") - F.col("size")))
    return pairs, some.select("doc_id", F.col("node").alias("class"), within.alias("within"))


def near_duplicate_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, subset: int = SUBSET, block: int = BLOCK, heavy: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(groups, repeated): (doc_id, check, keep, keep_check) for each document of a group that links connect, check being
    xxhash64 of its text and keep the least (doc_id, check) of the group; (doc_id, check) of rows that come more than once."""
    some, classes, found = _join(docs, n, threshold, subset, block, heavy, False)
    groups = _groups(classes, found, threshold).select("class", "root")
    rows = X.written(some.select("doc_id", "check", "node").join(groups, F.col("node") == F.col("class")).select("doc_id", "check", "root"), "grouped")
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "check")).alias("least"))
    return rows.join(least, "root").select("doc_id", "check", F.col("least.doc_id").alias("keep"), F.col("least.check").alias("keep_check")), some.where("copies > 1").select("doc_id", "check")


def without_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, subset: int = SUBSET, block: int = BLOCK, heavy: int = 4096) -> DataFrame:
    """The documents, all columns, but of each group of near duplicates only the one with the least doc_id.

    Rows that share a doc_id are told apart by their text; a repeated row (the same doc_id and text) stays once at most if it has
    a similar document or another n-gram that others share. Rows without an id or text stay.
    """
    groups, repeated = near_duplicate_groups(docs, n, threshold, subset, block, heavy)
    key = lambda df: [df["doc_id"].cast("bigint"), F.xxhash64(df["text"])]
    kept = X.without(docs, key(docs), groups.where("doc_id <> keep or check <> keep_check").select("doc_id", "check"))
    again = X.written(repeated, "repeated")
    if again.limit(1).count():
        a, b = X.free(docs, "__a"), X.free(docs, "__b")
        twice = kept.join(again.toDF(a, b), (key(kept)[0] == F.col(a)) & (key(kept)[1] == F.col(b)), "left_semi")
        kept = X.without(kept, key(kept), again).unionByName(twice.dropDuplicates(["doc_id", "text"]))
    return kept
