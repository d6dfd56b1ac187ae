"""BPE encoding and decoding over a distinct-word table.

Encoding: each task splits its texts into words (the vocabulary's own split) with byte kernels and sends its distinct words, once
each, to buckets of their hash; a bucket encodes each distinct word once, whatever the number of tasks that sent it, and
answers in the order in which it was asked; documents travel as positions in their task's word list, 2 bytes a word, and
meet the answers, so ids are joined back by position and no text is shuffled. Decoding joins ids to pieces: the id-to-piece
table (50,256 rows, of fixed size, below 1 MB) is held by each worker and the join is by position in it, a batch at a time.

The tokenizer's rank file is a parameter; it is read where it lies and never copied. Encoding agrees with the public library for
the same ranks; special tokens' strings are ordinary text.

Defined results: a null text has null ids, an empty one none; null or repeated doc_ids and repeated rows are encoded row by row;
white space, any script and any control character make a round trip. Other columns are ignored by `encode`.

The split runs twice over its input (once for the words, once for the positions), which must therefore give the same rows in
the same tasks when it is read again, as scans of files do; anything else is written first. A task is cut into parts row by row, by bytes of text, so
that the cuts don't depend on Arrow's batches, which differ with the columns that are read. A checksum of each part's words in
their order travels with the answers; where it differs from that of the positions, this is an error rather than a wrong result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import _exchange as X
from ._text import U64, groups, mix, pieces, span_hash, strings

#: The vocabulary's file, a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Its split, that of byte-level BPE vocabularies of 50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text, and 8 for each row, after which a part of a task ends.
_PART = 24_000_000
#: Words or ids that are looked up at a time.
_BLOCK = 1 << 18


def ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def tokenizer(path: str = RANKS):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(1)
def split_pattern():
    import regex

    return regex.compile(PATTERN)


class Words:
    """Distinct words of the texts added so far, in the order of their first occurrence by hash; and texts as positions."""

    def __init__(self, placed: bool = True) -> None:
        self.placed = placed  # whether positions are kept
        self.hash = np.zeros(0, np.uint64)
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []  # (bytes, lengths) of new words
        self.order = np.zeros(0, np.int64)
        self.n = self.seen = 0
        self.positions: list[np.ndarray] = []

    def add(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions are kept; returns the number of words of each text."""
        start, row = pieces(data, offsets, split_pattern())
        if not len(start):
            return np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        h = span_hash(data, start, end)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, unique)
        known = np.zeros(len(unique), bool)
        if len(self.hash):
            known = self.hash[np.minimum(at, len(self.hash) - 1)] == unique
        place = np.empty(len(unique), np.int64)
        place[known] = self.order[at[known]]
        fresh = np.flatnonzero(~known)
        fresh = fresh[np.argsort(first[fresh], kind="stable")]
        place[fresh] = self.n + np.arange(len(fresh))
        s, size = start[first[fresh]], (end - start)[first[fresh]]
        index = np.repeat(s - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(s) else np.zeros(0, np.int64)
        self.texts.append((data[index], size))
        self.n += len(fresh)
        hashes = np.concatenate([self.hash, unique[~known]])
        order = np.concatenate([self.order, place[~known]])
        rank = np.argsort(hashes, kind="stable")
        self.hash, self.order = hashes[rank], order[rank]
        if self.placed:
            self.positions.append(place[inverse].astype(np.int32))
        self.seen += len(h)
        return np.bincount(row, minlength=len(offsets) - 1)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, lengths, hashes), by position."""
        h = np.empty(self.n, np.uint64)
        h[self.order] = self.hash
        return np.concatenate([t for t, _ in self.texts]), np.concatenate([s for _, s in self.texts]), h

    def check(self) -> int:
        """Of the words in their order."""
        return int(mix(self.hash + mix(self.order.astype(np.uint64) + U64(1))).sum(dtype=np.uint64) >> U64(1))


def _parts(batches: Iterator[pa.RecordBatch], placed: bool = True) -> Iterator[tuple[int, Words, list[tuple[pa.Array, np.ndarray, np.ndarray]]]]:
    """(part, words, [(other columns, is null, words of each text)]) for every few million words of a task; text comes last.

    A part ends with the row that fills it, wherever batches end.
    """
    part, held, got, size = TaskContext.get().partitionId() << 20, Words(placed), [], 0
    for batch in batches:
        data, offsets, null = strings(batch.column(batch.num_columns - 1))
        ends = offsets + 8 * np.arange(len(offsets))
        a = 0
        while a < len(offsets) - 1:
            b = min(len(offsets) - 1, int(np.searchsorted(ends, ends[a] + _PART - size)))
            o = offsets[a : b + 1]
            counts = np.concatenate([held.add(data[o[i] : o[j]], o[i : j + 1] - o[i]) for i, j in groups(o, 1 << 21)])
            got.append((batch.column(0).slice(a, b - a) if batch.num_columns > 1 else None, null[a:b], counts))
            size += int(ends[b] - ends[a])
            a = b
            if size >= _PART:
                yield part, held, got
                part, held, got, size = part + 1, Words(placed), [], 0
    if got:
        yield part, held, got


_ASKED = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("check", pa.int64()), ("texts", pa.binary()), ("sizes", pa.binary())])
_ASKED_SQL = "bucket int, part bigint, check bigint, texts binary, sizes binary"


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] if len(begin) else data[:0]


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held, _ in _parts(batches, False):
            if not held.n:
                continue
            data, size, h = held.words()
            begin = np.cumsum(size) - size
            to = X.bucket_of(h, buckets)
            order, check = np.argsort(to, kind="stable"), held.check()
            rows = [(b, part, check, _gather(data, begin[order[i:j]], size[order[i:j]]).tobytes(), _sizes(size[order[i:j]])) for b, i, j in X.slices(to[order])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)
            del rows, data, size, begin, h, held
            X.trim()

    return run


def _sizes(x: np.ndarray) -> bytes:
    """Small numbers in a byte each; a larger one as 255 and 4 bytes at the end."""
    big = x >= 255
    small = np.where(big, 255, x).astype(np.uint8)
    return np.uint32(len(x)).tobytes() + small.tobytes() + x[big].astype(np.uint32).tobytes()


def _unsizes(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    x = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    x[x == 255] = np.frombuffer(blob, np.uint32, offset=4 + n)
    return x


_ANSWER = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("check", pa.int64()), ("sizes", pa.binary()), ("ids", pa.binary())])
_ANSWER_SQL = "part bigint, bucket int, check bigint, sizes binary, ids binary"


def _encode_words(path: str, most: int = 16 << 20):
    """Encode each distinct word of a bucket once; answer every part. Rows come by bucket; the words of some MB of them are held
    at a time, and the distinct words of the bucket with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)._core_bpe.encode_single_piece
        known: dict[bytes, int] = {}
        sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        size, flat, parts, held, now = [], [], [], 0, None

        def answers() -> pa.RecordBatch:
            nonlocal sizes, ids, size, flat, parts, held
            sizes, ids = np.concatenate([sizes, np.array(size, np.int64)]), np.concatenate([ids, np.array(flat, np.uint32)])
            begin = np.cumsum(sizes) - sizes
            rows = [(part, now, check, _sizes(sizes[w]), _narrow(_gather(ids, begin[w], sizes[w]))) for part, check, w in parts]
            size, flat, parts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)

        for batch in batches:
            for bucket, part, check, texts, packed in zip(*(batch.column(k) for k in range(5))):
                if bucket.as_py() != now:
                    if parts:
                        yield answers()
                    now, sizes, ids = bucket.as_py(), np.zeros(0, np.int64), np.zeros(0, np.uint32)
                    known.clear()
                texts, ends = texts.as_py(), np.cumsum(_unsizes(packed.as_py())).tolist()
                at, where = 0, []
                for end in ends:
                    word = texts[at:end]
                    at = end
                    k = known.get(word)
                    if k is None:
                        k = known[word] = len(known)
                        own = encode(word)
                        size.append(len(own))
                        flat += own
                    where.append(k)
                parts.append((part.as_py(), check.as_py(), np.array(where, np.int64)))
                held += len(texts) + 8 * len(where)
                if held > most:
                    yield answers()
        if parts:
            yield answers()
        known.clear()
        X.trim()

    return run


def _narrow(ids: np.ndarray) -> bytes:
    return b"H" + ids.astype(np.uint16).tobytes() if not len(ids) or ids.max() < 1 << 16 else b"I" + ids.astype(np.uint32).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], np.dtype(blob[:1].decode()))


_MET = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("check", pa.int64()), *((c, pa.binary()) for c in ("sizes", "ids", "buckets", "rows", "nulls", "counts", "positions"))])
_MET_SQL = "part bigint, bucket int, check bigint, sizes binary, ids binary, buckets binary, rows binary, nulls binary, counts binary, positions binary"


def _place(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held, got in _parts(batches):
            ids = pa.concat_arrays([g[0] for g in got])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
            null, counts = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
            at = np.concatenate(held.positions) if held.positions else np.zeros(0, np.int64)
            to = X.bucket_of(held.words()[2], buckets) if held.n else np.zeros(0, np.int64)
            big = at >= 0xFFFF
            blob = np.where(big, 0xFFFF, at).astype(np.uint16).tobytes() + at[big].astype(np.uint32).tobytes()
            row = (part, -1, held.check(), None, None, to.astype(np.uint16).tobytes(), sink.getvalue().to_pybytes(), null.tobytes(), counts.astype(np.uint32).tobytes(), blob)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MET)], schema=_MET)
            del row, blob, at, big, held, got
            X.trim()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """The ids of a part's documents, from its positions (the first row) and the answers, in the order of buckets."""
    bucket, checks = table["bucket"].to_pylist(), table["check"].to_pylist()
    if bucket[0] != -1 or -1 in bucket[1:] or len(set(checks)) > 1:
        raise RuntimeError("the input gave other rows when it was read again; write it first")
    x = {c: table[c][0].as_py() for c in ("buckets", "rows", "nulls", "counts", "positions")}
    with pa.ipc.open_stream(x["rows"]) as r:
        doc = r.read_all()["id"].combine_chunks()
    counts = np.frombuffer(x["counts"], np.uint32).astype(np.int64)
    n = int(counts.sum())
    at = np.frombuffer(x["positions"], np.uint16, n).astype(np.int32)
    at[at == 0xFFFF] = np.frombuffer(x["positions"], np.uint32, offset=2 * n)
    to = np.frombuffer(x["buckets"], np.uint16)
    order = np.argsort(to, kind="stable")  # the words in the order of the answers
    sizes = np.concatenate([np.zeros(0, np.int64), *(_unsizes(v.as_py()) for v in table["sizes"][1:])])
    ids = np.concatenate([np.zeros(0, np.uint16), *(_wide(v.as_py()) for v in table["ids"][1:])])
    if len(sizes) != len(to):
        raise RuntimeError("the input gave other rows when it was read again; write it first")
    size, begin = np.empty(len(to), np.int64), np.empty(len(to), np.int64)
    size[order], begin[order] = sizes, np.cumsum(sizes) - sizes
    del sizes, order, table
    null = np.frombuffer(x["nulls"], bool)
    word_ends = np.concatenate(([0], np.cumsum(counts)))
    kind = pa.list_(pa.int32())
    tables, i, a = [], 0, None
    while i < len(counts):  # some documents at a time: memory follows the ids and not the indices
        j = min(len(counts), max(i + 1, int(np.searchsorted(word_ends, word_ends[i] + _BLOCK, "right")) - 1))
        a = at[word_ends[i] : word_ends[j]]
        ends = np.concatenate(([0], np.cumsum(size[a])))[word_ends[i : j + 1] - word_ends[i]].astype(np.int32)
        offsets = pa.array(ends, mask=np.append(null[i:j], False)) if null[i:j].any() else pa.array(ends)
        lists = pa.ListArray.from_arrays(offsets, pa.array(_gather(ids, begin[a], size[a]).astype(np.int32), pa.int32()))
        tables.append(pa.table({"doc_id": doc.slice(i, j - i), "ids": lists}))
        i = j
    del at, a, ids, size, begin
    X.trim()
    return pa.concat_tables(tables) if tables else pa.table({"doc_id": doc, "ids": pa.array([], kind)})


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids) of every row; docs has doc_id and text."""
    result = StructType([docs.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))])
    rows = X.rereadable(docs.select("doc_id", "text"))
    b = min(X.buckets(rows), 1 << 16)  # a bucket's memory follows its distinct words, not the number of parts
    asked = X.placed(rows.select("text").mapInArrow(_ask(b), _ASKED_SQL), b)
    answers = asked.mapInArrow(_encode_words(path), _ANSWER_SQL)
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("buckets", "rows", "nulls", "counts", "positions")]
    answers = answers.select("part", "bucket", "check", "sizes", "ids", *nothing)
    both = rows.mapInArrow(_place(b), _MET_SQL).unionByName(answers)
    tasks = 1 << (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    return X.by_bucket(both, tasks, _meet, result, "part", F.shiftright("part", 20).cast("int"), ("bucket",))


@functools.lru_cache(2)
def piece_table(path: str = RANKS) -> pa.Array:
    """The pieces by id; an id without a piece has an empty one, as has the last place, which is for any other number."""
    table = {i: p for p, i in ranks(path).items()}
    return pa.array([table.get(i, b"") for i in range(max(table) + 2)], pa.binary())


def _decoder(path: str, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            ends = np.concatenate(([0], np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy())))
            i = 0
            while i < len(batch):  # some rows at a time: memory follows them and not the batch
                j = min(len(batch), max(i + 1, int(np.searchsorted(ends, ends[i] + 4 * _BLOCK, "right")) - 1))
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, _texts(rows.column(at), table)], names)
                i = j
            X.trim()

    return run


def _texts(ids: pa.Array, table: pa.Array) -> pa.Array:
    null = ids.is_null().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
    flat = ids.flatten().fill_null(-1).to_numpy()
    flat = np.where((flat < 0) | (flat >= len(table) - 1), len(table) - 1, flat)
    joined = table.take(pa.array(flat))  # the join: an id is the place of its piece
    ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
    offsets = pa.array(ends[start].astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(ends[start].astype(np.int32))
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, offsets.buffers()[1], joined.buffers()[2]])
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), text) if null.any() else text


def decode(encoded: DataFrame, path: str = RANKS, ids: str = "ids", to: str = "text") -> DataFrame:
    """The rows, with the text of their ids in a further column: ids join the id-to-piece table by position, a batch at a time.

    Null ids give a null text; an id without a piece adds nothing; bytes that aren't UTF-8 give the replacement character.
    """
    if to in encoded.columns:
        raise ValueError(f"there is a column {to} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoder(path, encoded.columns.index(ids), [*encoded.columns, to]), f"{schema}, `{to}` string")


def encoded_documents(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids)."""
    return encode(docs, path).select("doc_id", F.size("ids").alias("n_tokens"), "ids")
