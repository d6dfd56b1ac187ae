"""Delimited records, logs, page-view lines, file names and classic web archives."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revstrata import schemas
from revstrata.functions.dates import log_time
from revstrata.functions.strings import request_parts


def read_tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def read_anchors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_tsv(spark, path, schemas.ANCHOR)


def read_id_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_tsv(spark, path, schemas.ID_MAP)


def read_redirects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_tsv(spark, path, schemas.REDIRECTS)


def read_link_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_tsv(spark, path, schemas.LINK_EVENT)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value); plain or compressed."""
    return spark.read.text(path)


def read_series(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(title, month, total, series) of `title month total n n n ...`."""
    p = F.split("value", " ")
    numbers = F.transform(F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))), lambda x: x.try_cast("bigint"))
    return read_lines(spark, path).select(F.get(p, F.lit(0)).alias("title"), F.get(p, F.lit(1)).alias("month"), F.get(p, F.lit(2)).try_cast("bigint").alias("total"), F.filter(numbers, lambda x: x.isNotNull()).alias("series"))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """schemas.LOG_ENTRY of lines in the common log format; lines without its fields are dropped."""
    pattern = r'^(\S+)[ \t]+(\S+)[ \t]+(\S+)[ \t]+\[([^\]]*)\][ \t]+"([^"]*)"[ \t]+(\d{3})[ \t]+(\d+|-)\s*$'
    part = lambda i: F.regexp_extract(column, pattern, i)
    dash = lambda c: F.nullif(c, F.lit("-"))
    rows = lines.where(F.col(column).rlike(pattern)).select(
        part(1).alias("remote"), dash(part(2)).alias("logname"), dash(part(3)).alias("user_id"), part(4).alias("time"), log_time(part(4)).alias("epoch_ms"), part(5).alias("request"), request_parts(part(5)).alias("r"), part(6).cast("int").alias("status"), part(7).try_cast("bigint").alias("size"),
    )
    return rows.select("remote", "logname", "user_id", "time", "epoch_ms", "request", "r.method", "r.resource", "r.protocol", "status", "size")


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_log(read_lines(spark, path))


def file_names(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path), a row for each file; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")


def archive_headers(source: BinaryIO) -> Iterator[tuple[str | None, dict[str, str]]]:
    """(document id, headers) of each record of a web archive, a stream; a record's block is passed over by its length."""
    while line := source.readline(1 << 20):
        if not line.startswith(b"WARC/"):
            continue
        found = {}
        while (line := source.readline(1 << 20)).strip():
            key, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                found[key.strip()] = value.strip()
        length = found.get("Content-Length", "")
        yield found.get("WARC-TREC-ID"), found
        left = int(length) if length.isdigit() else 0
        while left and (passed := len(source.read(min(left, 1 << 20)))):
            left -= passed


def read_archive_headers(spark: SparkSession, path: str, glob: str = "*.warc*") -> DataFrame:
    """schemas.WARC of the records that have a document id; files are plain or gzip, each one task's work, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        import pyarrow.fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                uri = "file:///" + name[5:].lstrip("/") if name.startswith("file:") else name
                fs, at = pyarrow.fs.FileSystem.from_uri(uri)
                with fs.open_input_stream(at, compression=None) as raw:
                    plain = io.BufferedReader(raw, 1 << 20)
                    source = gzip.GzipFile(fileobj=plain) if plain.peek(2)[:2] == b"\x1f\x8b" else plain
                    rows = []
                    for x in archive_headers(source):
                        if x[0] is not None:
                            rows.append((x[0], list(x[1].items())))
                        if len(rows) == 10_000:
                            yield packed(rows)
                            rows = []
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.map_(pa.string(), pa.string()))], ["doc_id", "headers"])

    files = file_names(spark, path, glob)
    return files.repartition(max(1, min(files.count(), 1 << 15))).mapInArrow(run, schemas.WARC)
