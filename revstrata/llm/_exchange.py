"""Exchange of packed arrays: one Spark row carries thousands of numpy entries, so that a shuffle of hashes costs their
bytes and little else. Also the shared folder, table sizes and the number of buckets."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bits of a key below its bucket. With those of the bucket, 52 and more tell keys apart; less than one pair of different
#: keys a GB of text is taken for equal.
BITS = 48


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset in local mode, as in tests, one of our own is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a table in the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the input's size; for files, their bytes."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(n, 1 << 60)


def buckets(df: DataFrame, mb: float = 8, most_mb: float = 32) -> int:
    """A power of two: a bucket for each `mb` MB of input, a scan of files, up to 2**16 buckets, then for each `most_mb` MB, without an end."""
    size = plan_bytes(df) / 1e6
    n = max(16, min(size / mb, 1 << 16), size / most_mb)
    return 1 << (int(n) - 1).bit_length()


def partitions(spark: SparkSession, n: int) -> int:
    """Tasks for n buckets: a power of two, about as many as Spark's setting for shuffles, a task for every 64 buckets at least."""
    asked = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 64)
    return min(n, 1 << (asked - 1).bit_length())


def by_bucket(df: DataFrame, n: int, f: Callable[[pa.Table], pa.Table], schema: str, key: str = "bucket", by: Column | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """f of the rows of each bucket, in the given order. One exchange in which every task gets as many buckets as any other.

    by: what places a bucket if its key, for which a number from 0 to n is expected, doesn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            for v, i, j in slices(batch.column(key).to_numpy()):
                if held and v != now:
                    yield from f(pa.Table.from_batches(held)).to_batches(1 << 16)
                    held = []
                now = v
                held.append(batch.slice(i, j - i))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches(1 << 16)
        held = []
        trim()

    return placed(df, n, key, by, order).mapInArrow(run, schema)


def placed(df: DataFrame, n: int, key: str = "bucket", by: Column | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of n buckets, evenly over tasks, a bucket's rows together in one."""
    return df.repartitionById(partitions(df.sparkSession, n), F.col(key) if by is None else by).sortWithinPartitions(key, *order)


def rereadable(df: DataFrame) -> DataFrame:
    """The rows, such that reading them again gives the same ones in the same tasks: a scan of files as it is, else written."""

    def nodes(plan) -> list[str]:
        return [plan.nodeName(), *(x for k in range(plan.children().size()) for x in nodes(plan.children().apply(k)))]

    plan = df._jdf.queryExecution().optimizedPlan()
    names = nodes(plan)
    if plan.deterministic() and set(names[:-1]) <= {"Project", "Filter"} and names[-1].startswith(("Relation", "LogicalRelation", "LocalRelation")):
        return df
    return written(df, "input")


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit key: its leading bits; ascends with the key."""
    return (keys >> U64(64 - (n.bit_length() - 1))).astype(np.int64)


def pack_keys(keys: np.ndarray, n: int, bits: int = BITS) -> bytes:
    """Sorted keys of one of n buckets, cut to `bits` bits below the bucket's: gaps of as many bytes as the largest needs."""
    cut = cut_keys(keys, n, bits)
    gaps = np.diff(cut, prepend=U64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, :width] = raw
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def cut_keys(keys: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """What unpack_keys gives for these keys."""
    return (keys << U64(n.bit_length() - 1)) >> U64(64 - bits)


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each doc id, spread evenly."""
    x = ids.astype(np.int64).view(np.uint64) * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return (x >> U64(64 - max(1, n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(ids), np.int64)


def slices(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run."""
    if not len(sorted_values):
        return []
    cut = np.flatnonzero(np.diff(sorted_values)) + 1
    begin = np.concatenate(([0], cut))
    end = np.append(cut, len(sorted_values))
    return list(zip(sorted_values[begin].tolist(), begin.tolist(), end.tolist()))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any longer."""
    import gc
    import time

    for _ in range(2):  # a plan's objects go one after another
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges between nodes 0..n."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        live = a != b
        u, v, a, b = u[live], v[live], a[live], b[live]
        if not len(u):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, contracted: (node, least node connected to it by them)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = forest(at[: len(u)], at[len(u) :], len(node))
        own = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["u", "v"])


def components(edges: DataFrame, per_task: int = 2_000_000) -> DataFrame:
    """(node, root) of each node of an undirected graph with columns (u, v), root being the least node connected to it.

    Every task contracts its edges, `per_task` of them; while there is more than one such task, alternating large-star and
    small-star rounds follow, in which least neighbours are partial minima and joined back, so that no task holds a hub's
    neighbours. Every round is written to the shared folder, so lost executors cost no more than a round. An empty table gives
    an empty one.
    """
    edges = written(edges.select("u", "v").where("u <> v"), "edges")
    state = None
    while True:
        n = edges.count()
        tasks = max(1, -(-n // per_task))
        edges = written(edges.repartition(tasks).mapInArrow(_forests, "u bigint, v bigint"), "forests")
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = written(large.where("u <> v").distinct(), "stars")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def without(df: DataFrame, keys: list, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of df whose keys (bigint columns) aren't in ids (as many, distinct): ids, of fixed width, are broadcast up to
    `most` rows, 16 MB for two columns; beyond, both sides shuffle."""
    gone = [free(df, f"__gone{i}") for i in range(len(keys))]
    ids = ids.toDF(*gone)
    if ids.limit(most + 1).count() <= most:
        ids = F.broadcast(ids)
    same = F.lit(True)
    for k, g in zip(keys, gone):
        same = same & (k == F.col(g))
    return df.join(ids, same, "left_anti")


def heavy_keys(packed: DataFrame, n: int, least: int = 4096, most: int = 1 << 20) -> np.ndarray:
    """Keys that would make a bucket much larger than others, with their counts, as a sorted structured array.

    packed: what `count_frequent` gives over n buckets. A key is heavy if it was counted `least` times and makes up 1 / `most` of
    all entries or more (half of that, for a flush in which it is rare doesn't count it): so at most 2 * `most` keys are, 32 MB.
    """
    rows = written(by_bucket(packed, n, _sum_counts(least), "keys binary, counts binary, total bigint"), "frequent")
    total = rows.agg(F.sum("total")).first()[0] or 0
    found = rows.select("keys", "counts").mapInArrow(_at_least(total / most / 2), "entries binary").collect()
    return np.sort(np.concatenate([np.zeros(0, HEAVY), *(np.frombuffer(r["entries"], HEAVY) for r in found)]), order="key")


HEAVY = np.dtype([("key", "<u8"), ("count", "<i8")])
COUNTED = "bucket int, keys binary, counts binary, total bigint"
_COUNTED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])


def count_frequent(keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], n: int, flush: int = 3_000_000, often: int = 8):
    """For mapInArrow, with the schema COUNTED: of the keys of a task, in flushes, those that a flush has `often` or more times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            k = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            count = np.diff(np.append(first, len(k)))
            some = count >= often
            k, count = k[first][some], count[some]
            rows = [(b, k[i:j].tobytes(), count[i:j].astype(np.int64).tobytes(), 0) for b, i, j in slices(bucket_of(k, n))] + [(0, b"", b"", size)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTED)], schema=_COUNTED)

        for keys in keys_of(batches):
            held.append(keys)
            size += len(keys)
            if size >= flush:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()
        held = []
        trim()

    return run


def _sum_counts(least: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]])
        unique, inverse = np.unique(keys, return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)
        some = sums >= least
        return pa.table({"keys": pa.array([unique[some].tobytes()], pa.binary()), "counts": pa.array([sums[some].tobytes()], pa.binary()), "total": pa.array([sum(table["total"].to_pylist())], pa.int64())})

    return run


def _at_least(count: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0), batch.column(1)):
                counts = np.frombuffer(c.as_py(), np.int64)
                some = counts >= count
                x = np.zeros(int(some.sum()), HEAVY)
                x["key"], x["count"] = np.frombuffer(k.as_py(), np.uint64)[some], counts[some]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["entries"])

    return run


def places(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The place of each key among the heavy ones, -1 of any other."""
    if not len(heavy):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(heavy["key"], keys), len(heavy) - 1)
    return np.where(heavy["key"][at] == keys, at, -1)


def free(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def trim() -> None:
    """Give memory that was freed back to the system: a worker that waits for its next task should hold little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
