"""Substring deduplication by recompression: every passage of at least `length` words that occurs before, in whatever document,
is found, and all but its first occurrence can be cut.

1. Rounds of recompression name runs of two equal symbols, then pairs: in each round a hash bit of its name puts every symbol
   left or right, and a left symbol followed by a right one becomes one symbol, if the two hold at most round + 2 words
   together. A name is a 64-bit hash of the names below it, so the naming is global without a dictionary: equal passages get
   equal symbols in every task, and rounds need no exchange. What lies beside a passage changes at most 16 words' worth of
   its symbols at either end (2 by runs, 2 + 3 + 4 + 5 by four rounds): of 50 words at least 18 hold the same symbols, which
   have up to 6 words, hence at least 3 of them. So every three consecutive symbols get a high-level name, and each repeat of
   50 words has at least one in common with its earlier occurrence.
2. Names that occur once are dropped in one packed exchange; the shared ones go back to their documents. Heavy names, which a
   large part of the documents has, are counted before and known to every task by a table of bounded size; they aren't exchanged.
3. Verification: in a copy of a window of `length` words, every name that lies 16 words or more from both of its ends occurs
   too. So a window is a candidate if all of these are shared and it holds a shared name at all; candidates are hashed
   (64 + 32 bits) and exchanged, and a window is a repeat if it occurs before, by (doc_id, hash of the row, position). Of heavy
   windows, only the first occurrences in each task are exchanged. Repeats that overlap or touch and have the same first
   document make one span.

Naming departs from the textbook's recompression in that names are hashes instead of numbers from a dictionary, so that rounds
need no exchange, and in that only runs of two are named. Texts are compared by hashes of 96 bits.

A word is a run of bytes other than ASCII white space. Defined results: null, empty and short texts have no spans; a row with
a null doc_id takes no part; rows that share a doc_id are told apart by their text, and a repeated row counts once (cutting
treats both alike); a passage repeated within one document is cut there too. Other columns are kept and ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from ._text import U64, combine, groups, mix, rolling, span_hash, strings, words

LENGTH, ROUNDS, PHRASE = 50, 4, 3
_FLUSH = 800_000


def parse(names: np.ndarray, row: np.ndarray, rounds: int = ROUNDS, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, word after the last) of every `phrase` consecutive top symbols of a row; symbols don't cross rows."""
    symbol, start, size = names, np.arange(len(names)), np.ones(len(names), np.int64)
    if len(symbol) > 1:  # runs: exactly two equal words, longer runs stay as they are
        same = (symbol[1:] == symbol[:-1]) & (row[1:] == row[:-1])
        before = np.concatenate(([False], same[:-1]))
        after = np.append(same[1:], False)
        at = np.flatnonzero(same & ~before & ~after)
        symbol, start, size, row = _merge(symbol, start, size, row, at, U64(0x52554E))
    for r in range(rounds):
        if len(symbol) < 2:
            break
        left = (mix(symbol + U64(r + 1)) & U64(1)).astype(bool)
        at = np.flatnonzero(left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= r + 3) & (row[1:] == row[:-1]))
        symbol, start, size, row = _merge(symbol, start, size, row, at, U64(r))
    m = len(symbol) - phrase + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    ok = np.flatnonzero(row[:m] == row[phrase - 1 :])
    return combine([symbol[ok + k] for k in range(phrase)]), start[ok], start[ok + phrase - 1] + size[ok + phrase - 1]


def _merge(symbol, start, size, row, at, seed):
    """Replace the symbols at `at` and after them by a name for both."""
    symbol, size = symbol.copy(), size.copy()
    symbol[at] = combine([symbol[at], symbol[at + 1], np.full(len(at), seed)])
    size[at] += size[at + 1]
    keep = np.ones(len(symbol), bool)
    keep[at + 1] = False
    return symbol[keep], start[keep], size[keep], row[keep]


#: A document: its doc_id and a hash of its row.
_DOC = np.dtype([("id", "<i8"), ("uid", "<i8")])
_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary()), ("docs", pa.binary())])
_SENT_SQL = "bucket int, keys binary, refs binary, docs binary"
_EDGE = 16  # words of a passage, from either end, whose symbols depend on what lies beside it


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in rows:
        held.append(x)
        size += sum(len(v) for v in x if isinstance(v, bytes))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _ranked(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct documents in order, the place of each document in them)."""
    order = np.lexsort((docs["uid"], docs["id"]))
    x = docs[order]
    new = np.ones(len(x), bool)
    new[1:] = (x["id"][1:] != x["id"][:-1]) | (x["uid"][1:] != x["uid"][:-1])
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], at


def _docs_of(table: pa.Table, *refs: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct documents in order, for each column of references to a row's documents their places in them)."""
    lists = [np.frombuffer(x.as_py(), _DOC) for x in table["docs"]]
    docs, at = _ranked(np.concatenate(lists))
    begin = np.cumsum([0] + [len(x) for x in lists])
    return docs, [np.concatenate([at[b:][_large(r.as_py())] for b, r in zip(begin.tolist(), table[n])]) for n in refs]


def _canonical(names: np.ndarray, buckets: int) -> np.ndarray:
    """Names cut to what is left of them after an exchange, 56 bits at most."""
    return names >> U64(64 - min(56, X.BITS + buckets.bit_length() - 1))


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        data, offsets, _ = strings(batch.column(0))
        for i, j in groups(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, end, row = words(d, o)
            yield parse(span_hash(d, start, end), row)[0]


def _scatter(buckets: int, heavy: np.ndarray):
    flush_at = max(_FLUSH, min(8 * _FLUSH, 16 * buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, refs, docs, size, rows = [], [], [], 0, 0

        def packed():
            k, r, d = np.concatenate(keys), np.concatenate(refs), np.concatenate(docs)
            known = X.places(k, heavy) >= 0
            if known.any():  # straight to the documents, by way of any bucket
                own, at = _canonical(k[known], buckets), r[known]
                order = np.argsort(at, kind="stable")
                own, at = own[order], at[order]
                for v, i, j in X.slices(at):
                    names = np.unique(own[i:j])
                    yield v % buckets, names.tobytes(), b"D", d[v : v + 1].tobytes()
                k, r = k[~known], r[~known]
            order = np.argsort(k, kind="stable")
            k, r = k[order], r[order]
            for b, i, j in X.slices(X.bucket_of(k, buckets)):
                used, ref = np.unique(r[i:j], return_inverse=True)
                wide = np.uint16 if len(used) <= 1 << 16 else np.uint32
                yield b, X.pack_keys(k[i:j], buckets), np.dtype(wide).char.encode() + ref.astype(wide).tobytes(), d[used].tobytes()

        for batch in batches:
            uids = batch.column(0).to_numpy()
            data, offsets, _ = strings(batch.column(1))
            for i, j in groups(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, row = words(d, o)
                name, first, _ = parse(span_hash(d, start, end), row)
                keys.append(name)
                refs.append(row[first] + rows)
                docs.append(uids[i:j])
                size += len(name)
                rows += j - i
                if size > flush_at or rows > 50_000:
                    yield from _batches(packed(), _SENT)
                    keys, refs, docs, size, rows = [], [], [], 0, 0
        if rows:
            yield from _batches(packed(), _SENT)
        keys, refs, docs = [], [], []
        X.trim()

    return run


_BACK = pa.schema([("doc", pa.int64()), ("names", pa.binary())])
_BACK_SQL = "doc bigint, names binary"


def _shared(buckets: int):
    """Names that occur at least twice, in their canonical form, for each row that has them."""
    bits = U64(buckets.bit_length() - 1)

    def run(table: pa.Table) -> pa.Table:
        keys, refs, docs, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        rows = []
        for k, r, d in zip(table["keys"], table["refs"], table["docs"]):
            r, d = r.as_py(), np.frombuffer(d.as_py(), np.int64)
            if r == b"D":
                rows.append((int(d[0]), k.as_py()))
                continue
            keys.append(X.unpack_keys(k.as_py()))
            refs.append(np.frombuffer(r[1:], np.dtype(r[:1].decode())).astype(np.int64) + at)
            docs.append(d)
            at += len(d)
        keys, refs, docs = np.concatenate(keys), np.concatenate(refs), np.concatenate(docs)
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, refs = keys[order], refs[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.diff(np.append(first, len(keys)))
            keep = np.repeat(n >= 2, n)
            keys, refs = keys[keep], refs[keep]
            order = np.argsort(refs, kind="stable")
            keys, refs = keys[order], refs[order]
            full = _canonical((U64(table["bucket"][0].as_py()) << (U64(64) - bits)) | ((keys << U64(64 - X.BITS)) >> bits), buckets)
            rows += [(int(docs[r]), np.unique(full[i:j]).tobytes()) for r, i, j in X.slices(refs)]
        return pa.table({"doc": [r[0] for r in rows], "names": [r[1] for r in rows]}, schema=_BACK)

    return run


_WINDOWS = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("check", pa.binary()), ("docs", pa.binary()), ("refs", pa.binary()), ("words", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary())])
_WINDOWS_SQL = "bucket int, hash binary, check binary, docs binary, refs binary, words binary, starts binary, sizes binary"
_AT = np.dtype([("word", "<i4"), ("start", "<i4"), ("end", "<i4")])


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 in 2 bytes each if they fit, else 4."""
    return b"H" + x.astype(np.uint16).tobytes() if not len(x) or x.max() < 1 << 16 else b"I" + x.astype(np.uint32).tobytes()


def _large(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], np.dtype(blob[:1].decode()))


def _windows(buckets: int, length: int):
    """Windows of documents that hold a shared name: packed by their hash. Offsets are in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = [], [], 0

        def packed():
            h, c, d, a = (np.concatenate(x) for x in zip(*held))
            known = np.array(found, _DOC)
            order = np.argsort(h, kind="stable")
            h, c, d, a = h[order], c[order], d[order], a[order]
            for b, i, j in X.slices(X.bucket_of(h, buckets)):
                o = np.lexsort((a["word"][i:j], d[i:j]))
                docs, refs = np.unique(d[i:j][o], return_inverse=True)
                x = a[i:j][o]
                yield b, h[i:j][o].tobytes(), c[i:j][o].tobytes(), known[docs].tobytes(), _small(refs), _small(x["word"]), x["start"].tobytes(), _small(x["end"] - x["start"])

        for batch in batches:
            ids, uids = batch.column("doc_id").to_numpy(), batch.column("uid").to_numpy()
            data, offsets, _ = strings(batch.column("text"))
            names = batch.column("names")
            for i, j in groups(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, row = words(d, o)
                word = span_hash(d, start, end)
                name, first, after = parse(word, row)
                at = np.searchsorted(row, np.arange(j - i + 1))
                bounds = np.searchsorted(row[first], np.arange(j - i + 1))
                full = _canonical(name, buckets)
                for r in range(j - i):
                    lo, hi = int(at[r]), int(at[r + 1])
                    if hi - lo < length:
                        continue
                    known = np.frombuffer(b"".join(names[i + r].as_py()), np.uint64)
                    f, e = first[bounds[r] : bounds[r + 1]] - lo, after[bounds[r] : bounds[r + 1]] - lo
                    is_shared = np.isin(full[bounds[r] : bounds[r + 1]], known)
                    m = hi - lo - length + 1
                    s = np.flatnonzero(_covered(e[is_shared] - length, f[is_shared] + 1, m) & ~_covered(e[~is_shared] - length + _EDGE, f[~is_shared] - _EDGE + 1, m))
                    if not len(s):
                        continue
                    x = np.zeros(len(s), _AT)
                    x["word"], x["start"], x["end"] = s, start[lo + s] - o[r], end[lo + s + length - 1] - o[r]
                    w = word[lo:hi]
                    held.append((rolling(w, length)[s], rolling(w, length, 77)[s].astype(np.uint32), np.full(len(s), len(found), np.int32), x))
                    found.append((ids[i + r], uids[i + r]))
                    size += len(s)
                    if size > _FLUSH:
                        yield from _batches(packed(), _WINDOWS)
                        held, found, size = [], [], 0
        if size:
            yield from _batches(packed(), _WINDOWS)
        held, found = [], []
        X.trim()

    return run


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of the places 0..n lie in any begin..end."""
    a, b = np.maximum(begin, 0), np.minimum(end, n)
    fits = a < b
    steps = np.bincount(a[fits], minlength=n + 1) - np.bincount(b[fits], minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, checks, documents in order, places in them, windows) of packed windows."""
    h, c = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table[n]]) for n, t in (("hash", np.uint64), ("check", np.uint32)))
    docs, (d,) = _docs_of(table, "refs")
    a = np.zeros(len(h), _AT)
    a["word"], a["end"] = (np.concatenate([_large(x.as_py()) for x in table[n]]) for n in ("words", "sizes"))
    a["start"] = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["starts"]])
    a["end"] += a["start"]
    return h, c, docs, d, a


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(0):
            yield np.frombuffer(x.as_py(), np.uint64)


def _heavy_firsts(heavy: np.ndarray):
    """(place, check, id, uid, word): the first occurrence, in a batch of rows, of each heavy window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, docs, d, a = _entries(pa.Table.from_batches([batch]))
            at = X.places(h, heavy)
            some = np.flatnonzero(at >= 0)
            at, c, d, w = at[some], c[some], d[some], a["word"][some]
            order = np.lexsort((w, d, c, at))
            at, c, d, w = at[order], c[order], d[order], w[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (c[1:] != c[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[new], c[new].astype(np.int64), docs["id"][d[new]], docs["uid"][d[new]], w[new].astype(np.int64))], ["place", "check", "id", "uid", "word"])

    return run


#: The first occurrence of a heavy window.
_FIRST = np.dtype([("key", "<u8"), ("check", "<u4"), ("id", "<i8"), ("uid", "<i8"), ("word", "<i4")])


def _light(firsts: np.ndarray):
    """The packed windows without the heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                h, c = np.frombuffer(x["hash"], np.uint64), np.frombuffer(x["check"], np.uint32)
                at = X.places(h, firsts)
                keep = (at < 0) | (firsts["check"][at] != c)
                if keep.any():
                    rows.append((x["bucket"], h[keep].tobytes(), c[keep].tobytes(), x["docs"], *(_small(_large(x[k])[keep]) for k in ("refs", "words")), np.frombuffer(x["starts"], np.int32)[keep].tobytes(), _small(_large(x["sizes"])[keep])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _WINDOWS)], schema=_WINDOWS)

    return run


def _heavy_hits(firsts: np.ndarray, doc_buckets: int):
    """Heavy windows that occur before, packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, docs, d, a = _entries(pa.Table.from_batches([batch]))
            at = X.places(h, firsts)
            own = docs[d]
            hit = np.flatnonzero((at >= 0) & (firsts["check"][at] == c) & ((own["id"] != firsts["id"][at]) | (own["uid"] != firsts["uid"][at]) | (a["word"] != firsts["word"][at])))
            if len(hit):
                f = np.zeros(len(hit), _DOC)
                f["id"], f["uid"] = firsts["id"][at[hit]], firsts["uid"][at[hit]]
                yield from _packed_hits(own[hit], f, a[hit], doc_buckets).to_batches()

    return run


def _packed_hits(docs: np.ndarray, firsts: np.ndarray, a: np.ndarray, doc_buckets: int) -> pa.Table:
    """_HITS of windows, with the documents that they are in and those of their first occurrences."""
    known, at = _ranked(np.concatenate([docs, firsts]))
    d, f = at[: len(docs)], at[len(docs) :]
    to = X.bucket_of(mix(known["uid"].view(np.uint64) if known["uid"].flags.c_contiguous else known["uid"].astype(np.uint64)), doc_buckets)[d]
    order = np.lexsort((a["word"], d, to))
    d, a, f, to = d[order], a[order], f[order], to[order]
    rows = []
    for b, i, j in X.slices(to):
        used, refs = np.unique(np.concatenate([d[i:j], f[i:j]]), return_inverse=True)
        rows.append((b, known[used].tobytes(), _small(refs[: j - i]), _small(refs[j - i :]), a[i:j].tobytes()))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_HITS)], schema=_HITS)


_HITS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("refs", pa.binary()), ("firsts", pa.binary()), ("at", pa.binary())])
_HITS_SQL = "bucket int, docs binary, refs binary, firsts binary, at binary"


def _repeats(doc_buckets: int):
    """Windows that occur before, with the document of their first occurrence, packed by document."""

    def run(table: pa.Table) -> pa.Table:
        h, c, docs, d, a = _entries(table)
        order = np.lexsort((a["word"], d, c, h))
        h, c, d, a = h[order], c[order], d[order], a[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        group = np.cumsum(new) - 1
        first_doc, first_word = d[new][group], a["word"][new][group]
        hit = (d != first_doc) | (a["word"] != first_word)
        return _packed_hits(docs[d[hit]], docs[first_doc[hit]], a[hit], doc_buckets)

    return run


_SPANS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("n_words", pa.int32()), ("first_doc_id", pa.int64())])
_SPANS_SQL = "doc_id bigint, uid bigint, start_byte int, end_byte int, n_words int, first_doc_id bigint"


def _join_windows(length: int):
    def run(table: pa.Table) -> pa.Table:
        docs, (d, f) = _docs_of(table, "refs", "firsts")
        a = np.concatenate([np.frombuffer(x.as_py(), _AT) for x in table["at"]])
        order = np.lexsort((f, a["word"], d))
        d, a, f = d[order], a[order], f[order]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (a["word"][1:] > a["word"][:-1] + length))))
        last = np.append(new[1:], len(d)) - 1
        return pa.table({"doc_id": docs["id"][d[new]], "uid": docs["uid"][d[new]], "start_byte": a["start"][new], "end_byte": a["end"][last], "n_words": a["word"][last] - a["word"][new] + length, "first_doc_id": docs["id"][f[new]]}, schema=_SPANS)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, heavy: int = 4096) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_words, first_doc_id) of each repeat; docs has doc_id and text.

    A span holds whole windows of `length` words (45 at least), each of which occurs before; first_doc_id has the first
    occurrence. heavy: how often a name or window must occur, at least, to be a heavy one.
    """
    return _spans(docs, length, heavy).drop("uid")


def _uid(doc_id, text):
    return F.xxhash64(doc_id.cast("bigint"), text)


def _spans(docs: DataFrame, length: int, heavy: int) -> DataFrame:
    """repeated_spans, with a hash of the row that the span is in."""
    if length < 45:
        raise ValueError("a shorter passage need not hold a shared name")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _uid(F.col("doc_id"), F.col("text")).alias("uid")).where("doc_id is not null and text is not null")
    docs = X.rereadable(docs)
    b, often = X.buckets(docs), min(8, heavy)
    known = X.heavy_keys(docs.select("text").mapInArrow(X.count_frequent(_symbols, b, often=often), X.COUNTED), b, heavy)
    sent = docs.select("uid", "text").mapInArrow(_scatter(b, known), _SENT_SQL)
    names = X.by_bucket(sent, b, _shared(b), _BACK_SQL)
    names = names.groupBy("doc").agg(F.collect_set("names").alias("names"))
    held = docs.join(names, F.col("uid") == F.col("doc")).select("doc_id", "uid", "text", "names")
    windows = X.written(held.mapInArrow(_windows(b, length), _WINDOWS_SQL), "windows")
    X.release(docs.sparkSession)
    known = X.heavy_keys(windows.select("hash").mapInArrow(X.count_frequent(_hashes, b, often=often), X.COUNTED), b, heavy)
    if not len(known):
        hits = X.by_bucket(windows, b, _repeats(b), _HITS_SQL)
    else:
        first = windows.mapInArrow(_heavy_firsts(known), "place bigint, check bigint, id bigint, uid bigint, word bigint").groupBy("place", "check").agg(F.min(F.struct("id", "uid", "word")).alias("f"))
        rows = [(known["key"][r["place"]], r["check"], *r["f"]) for r in first.orderBy("place", "check").toLocalIterator()]
        firsts = np.array(rows, _FIRST)
        firsts = firsts[np.concatenate(([True], firsts["key"][1:] != firsts["key"][:-1]))]
        hits = X.by_bucket(windows.mapInArrow(_light(firsts), _WINDOWS_SQL), b, _repeats(b), _HITS_SQL)
        hits = hits.unionByName(windows.mapInArrow(_heavy_hits(firsts, b), _HITS_SQL))
    return X.by_bucket(hits, b, _join_windows(length), _SPANS_SQL)


def _cutter(columns: list[str], cuts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column("text"), batch.column(cuts)
            out = []
            for t, s in zip(text, spans):
                t, s = t.as_py(), s.as_py()
                if s and t is not None:
                    raw = t.encode()
                    kept, at = [], 0
                    for x in sorted(s, key=lambda x: (x["start_byte"], x["end_byte"])):
                        if x["start_byte"] > at:
                            kept.append(raw[at : x["start_byte"]])
                        at = max(at, x["end_byte"])
                    kept.append(raw[at:])
                    t = b"".join(kept).decode()
                out.append(t)
            arrays = {c: batch.column(c) for c in columns} | {"text": pa.array(out, text.type)}
            yield pa.RecordBatch.from_arrays([arrays[c] for c in columns], columns)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, heavy: int = 4096) -> DataFrame:
    """The documents, all columns, with every repeat but its first occurrence cut from text; n_chars, if there, is set anew."""
    found = X.written(_spans(docs, length, heavy), "repeats")
    X.release(docs.sparkSession)  # what the search shuffled isn't needed for the cut
    row, cuts = X.free(docs, "__row"), X.free(docs, "__spans")
    spans = found.groupBy(F.col("uid").alias(row)).agg(F.collect_list(F.struct("start_byte", "end_byte")).alias(cuts))
    of = F.when(docs["doc_id"].isNotNull() & docs["text"].isNotNull(), _uid(docs["doc_id"], docs["text"]))
    joined = docs.join(spans, of == F.col(row), "left").select(*[docs[c] for c in docs.columns], cuts)
    out = joined.mapInArrow(_cutter(docs.columns, cuts), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
