"""Byte-level text kernels: whole Arrow batches are split and hashed with numpy, without a Python loop over words.

Hashes are prefix-sum polynomials over random byte values modulo 2**64, finished with a mixer. A span's hash depends only
on its bytes, so equal spans have equal names in every task without any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_R = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words in the n-gram join: ASCII letters and digits, and everything that isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of words that are delimited by ASCII white space only.
VISIBLE = np.ones(256, bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept, and grown when needed."""
    if len(_powers[0]) < n:
        m = 1 << max(18, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit; works in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of a string or binary column; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    null = np.zeros(len(column), bool)
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0], null


def groups(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each data[start:end]; starts must ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _R[LOWER] if lower else _R
    out = np.empty(len(starts), np.uint64)
    i, piece = 0, 1 << 19
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + piece)))
        hi = int(ends[i:j].max())
        power, inverse = powers(hi - lo + 1)
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * power[:-1], out=prefix[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (prefix[e] - prefix[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = VISIBLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes of `kind`; runs don't cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One name for each tuple of names, order kept."""
    h = np.full(len(parts[0]), 0x8445D61A4E774912, np.uint64)
    for p in parts:
        h = (h ^ p) * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(29)
    return mix(h)


def rolling(names: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n consecutive names (len - n + 1 of them), in time that doesn't depend on n."""
    m = len(names) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(names) + 1)
    prefix = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(mix(names + U64(seed)) * power[:-1], out=prefix[1:])
    return mix((prefix[n:] - prefix[:m]) * inverse[:m])


def sets(names: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, name), sorted by both: (names, offsets by row). Rows must ascend."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    out, sizes = [], np.zeros(n_rows, np.int64)
    for i in range(n_rows):
        if bounds[i] < bounds[i + 1]:
            u = np.sort(names[bounds[i] : bounds[i + 1]])
            u = u[np.concatenate(([True], u[1:] != u[:-1]))]
            out.append(u)
            sizes[i] = len(u)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


# The split that byte-level BPE vocabularies use before merging.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[[39, *range(28, 32)]] = True


def pieces(data: np.ndarray, offsets: np.ndarray, pattern) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces into which the pattern splits each text, and the row of each.

    Texts of ASCII and Latin-1 letters without apostrophes are split by byte classes; the pattern itself is run on any
    other text, with the same result.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high = data >= 128
    odd = _ODD[data]
    lead = high & (data >= 0xC0)
    odd |= lead & (data != 0xC3)
    nxt = np.zeros(n, np.uint8)
    nxt[:-1] = data[1:]
    odd |= (data == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))
    counts = np.concatenate(([0], np.cumsum(odd)))
    hard = counts[offsets[1:]] > counts[offsets[:-1]]
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    runs = np.flatnonzero(edge[:n])
    after = np.append(runs[1:], n)
    doc_end = np.zeros(n + 1, bool)
    doc_end[offsets] = True
    white = (kind[runs] == 0) & ~doc_end[after]
    begin, end = runs[white], after[white]
    edge[end - 1] = True
    edge[end[data[end - 1] == 32]] = False
    edge[begin] = True
    if hard.any():
        for i in np.flatnonzero(hard):
            a, b = int(offsets[i]), int(offsets[i + 1])
            edge[a:b] = False
            at = a
            for piece in pattern.findall(data[a:b].tobytes().decode("utf-8", "surrogatepass")):
                edge[at] = True
                at += len(piece.encode("utf-8", "surrogatepass"))
    starts = np.flatnonzero(edge[:n])
    return starts, np.searchsorted(offsets, starts, "right") - 1
