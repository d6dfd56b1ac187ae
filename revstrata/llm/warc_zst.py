"""WARC archives compressed with Zstandard and a dictionary: one frame per record, the dictionary in a leading skippable frame.

Layout: a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself plain or Zstandard-compressed, or no such frame
for an archive without one; then a frame per record. A record is `WARC/1.0` or `WARC/1.1`, header lines, an empty line, a block of
Content-Length bytes and two line ends.

Reading: files are spread over tasks by name and streamed, a frame at a time, so memory follows the largest record and not the
file; any file system that pyarrow knows will do. Each record is validated: version line, header syntax, the headers that the
standard requires, a Content-Length equal to the block's length, the closing line ends, and that the frame holds one record
and no more. A record that fails is returned with what is wrong in `error`, and the reader goes on with the next frame; where
a frame itself, or the dictionary, can't be decoded the rest of that file can't be found, so one row says so and ends the file.
A frame whose record is larger than `most_record` bytes is passed over, without being held, and reported.

Defined results: an empty file gives no rows; headers are matched without regard to case, the last of a repeated one wins; an
empty block is an empty payload. Writing: null payloads are empty blocks, null URLs leave WARC-Target-URI out, repeated rows are
records of their own, null ids give a record without a number in its id; line ends in a URL are percent-encoded; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D
_ZSTD = 0xFD2FB528
MOST_RECORD = 1 << 30
REQUIRED = ("warc-record-id", "content-length", "warc-date", "warc-type")


def record(kind: str, date: str, block: bytes, record_id: str, uri: str | None = None, mime: str = "text/html") -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """(headers, block, what is wrong with it or None)."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return {}, b"", "no end of headers"
    lines = raw[:end].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return {}, b"", "bad version line"
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on with the header
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        name = key.strip().decode("utf-8", "replace").lower()
        if not colon or not name or key != key.strip():
            return headers, b"", "bad header line"
        headers[name] = value.strip().decode("utf-8", "replace")
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        return headers, b"", f"no {missing[0]}"
    size = headers["content-length"]
    if not (size.isascii() and size.isdigit()):
        return headers, b"", "bad content-length"
    body = raw[end + 4 :]
    block, tail = body[: int(size)], body[int(size) :]
    if len(block) < int(size):
        return headers, block, "block shorter than content-length"
    if tail != b"\r\n\r\n":
        return headers, block, "block longer than content-length" if not tail.startswith(b"\r\n\r\n") else "more than one record in the frame"
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        return headers, block, "block digest differs"
    return headers, block, None


class Frames:
    """The dictionary and the decoded frames of a stream; None for a frame of more than `most` bytes."""

    def __init__(self, source, most: int = MOST_RECORD) -> None:
        self._in, self._left, self._most = source, b"", most
        self.dictionary: bytes | None = None

    def _fill(self, n: int) -> bool:
        while len(self._left) < n:
            more = self._in.read(1 << 20)
            if not more:
                return False
            self._left += bytes(more)
        return True

    def __iter__(self) -> Iterator[bytes | None]:
        import zstandard

        decoder, first = zstandard.ZstdDecompressor(), True
        while self._fill(1):
            if not self._fill(8):
                raise ValueError("truncated frame")
            magic, size = struct.unpack("<II", self._left[:8])
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if not self._fill(8 + size):
                    raise ValueError("truncated skippable frame")
                if first and magic == DICTIONARY_MAGIC:
                    raw = self._left[8 : 8 + size]
                    try:
                        if raw[:4] == struct.pack("<I", _ZSTD):
                            one = zstandard.ZstdDecompressor().decompressobj()
                            raw = one.decompress(raw)
                            if not one.eof:
                                raise ValueError("truncated")
                        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                    except (zstandard.ZstdError, ValueError, MemoryError) as e:
                        raise ValueError(f"bad dictionary: {e}") from None
                    self.dictionary = raw
                self._left = self._left[8 + size :]
                first = False
                continue
            first = False
            if magic != _ZSTD:
                raise ValueError("not a frame")
            one, parts, n = decoder.decompressobj(), [], 0
            try:
                while not one.eof:
                    if not self._left and not self._fill(1):
                        raise ValueError("truncated frame")
                    chunk, self._left = self._left, b""
                    parts.append(one.decompress(chunk))
                    n += len(parts[-1])
                    if n > self._most:
                        parts = []
                self._left = one.unused_data
            except zstandard.ZstdError as e:
                raise ValueError(f"bad frame: {e}") from None
            yield b"".join(parts) if n <= self._most else None


_ROWS = pa.schema([("file", pa.string()), ("record", pa.int64()), ("record_id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())])
_ROWS_SQL = "file string, record bigint, record_id string, kind string, uri string, date string, headers map<string,string>, payload binary, error string"


def _open(path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)
    return fs, at


def _uri(path: str) -> str:
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def _rows(path: str, most_record: int) -> Iterator[tuple]:
    fs, at = _open(_uri(path))
    with fs.open_input_stream(at, compression=None) as source:
        n = 0
        frames = iter(Frames(source, most_record))
        while True:
            try:
                raw = next(frames)
            except StopIteration:
                return
            except ValueError as e:
                yield path, n, None, None, None, None, [], b"", str(e)
                return
            h, block, error = parse_record(raw) if raw is not None else ({}, b"", "larger than the limit for a record")
            yield path, n, h.get("warc-record-id", "").strip("<>") or None, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), list(h.items()), block, error
            n += 1


def _read(most_record: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in _rows(path, most_record):
                    held.append(row)
                    size += len(row[7]) + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROWS)], schema=_ROWS)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROWS)], schema=_ROWS)

    return run


def read(spark: SparkSession, path: str, glob: str = "*.warc.zst", most_record: int = MOST_RECORD) -> DataFrame:
    """A row for each record of the archives under a folder: (file, record, record_id, kind, uri, date, headers, payload, error)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    # only names are read here; a task takes few of them, for archives are large
    n = max(1, min(files.count(), 1 << 15))
    return files.repartition(n).mapInArrow(_read(most_record), _ROWS_SQL)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it to be in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def train_dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary of sample records, at most an eighth of their bytes; none of less than 8 samples or too little text."""
    import zstandard

    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, samples)) // 8)), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _write(folder: str, date: str, dictionary_from: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _open(_uri(folder))
        files, sink, size, packer = [], None, 0, None

        def start(samples):
            nonlocal sink, size, packer
            name = f"part-{TaskContext.get().partitionId():06d}-{len(files):04d}-{uuid.uuid4().hex}.warc.zst"
            sink = fs.open_output_stream(f"{root}/{name}", compression=None)
            files.append([name, 0])
            dictionary = train_dictionary(samples)
            packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
            if dictionary:
                packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
                body = zstandard.ZstdCompressor(level=9).compress(dictionary)
                sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
            size = 0

        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            blocks = (b.encode() if isinstance(b, str) else b or b"" for b in batch.column(2).to_pylist())
            raws = [record("response", date, b, f"urn:page:{'' if i is None else i}", u) for i, u, b in zip(ids, urls, blocks)]
            for raw in raws:
                if sink is None:
                    start([r[:8192] for r in raws[:dictionary_from]])
                frame = packer.compress(raw)
                sink.write(frame)
                size += len(frame)
                files[-1][1] += 1
                if size > most:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.int64())], ["file", "records"])

    return run


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", dictionary_from: int = 200, most: int = 256 << 20) -> int:
    """Write (id, url, payload) as archives of about `most` bytes; returns the number of records.

    A file's dictionary is trained on its first `dictionary_from` records. Only the files of tasks that succeeded are kept:
    a task that is run again writes files of other names, and those of lost attempts are deleted at the end.
    """
    folder = _qualified(rows.sparkSession, folder)
    fs, root = _open(_uri(folder))
    fs.create_dir(root)
    done = rows.mapInArrow(_write(folder, date, dictionary_from, most), "file string, records bigint").collect()
    kept = {r["file"] for r in done}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if info.base_name not in kept and info.base_name.endswith(".warc.zst"):
            fs.delete_file(info.path)
    return sum(r["records"] for r in done)


def pages_of(archive: DataFrame) -> DataFrame:
    """(page_id, url, n_bytes, payload_md5, error) of response records written by `write`."""
    return archive.select(
        F.expr("try_cast(substring_index(record_id, ':', -1) as bigint)").alias("page_id"),
        F.col("uri").alias("url"),
        F.length("payload").cast("bigint").alias("n_bytes"),
        F.md5("payload").alias("payload_md5"),
        "error",
    )
