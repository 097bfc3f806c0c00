"""Vectorised helpers on Arrow text: words, rolling hashes and sliding minima, many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The lowest 0 to 8 bytes of a number.
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((BASE, BACK)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` reads the hash of any span."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the symbols from ``starts`` up to ``ends``; it does not depend on the place."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def rolling(prefix: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` symbols, not mixed: good enough to put them in an order."""
    n = max(0, len(prefix) - size)
    return (prefix[size:] - prefix[:n]) * powers(len(prefix))[1][:n]


def content_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, eight at a time. Each eight are mixed with their place before they are added, so no pattern in a text cancels out, as it may in a polynomial."""
    size = ends - starts
    count = (size + 7) >> 3
    stop = np.cumsum(count)
    if not len(stop) or not stop[-1]:
        return mix(size.astype(np.uint64) + MIX_A)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    place = np.arange(stop[-1]) - np.repeat(stop - count, count)
    left = np.repeat(size, count) - 8 * place
    x = eight[np.repeat(starts, count) + 8 * place]
    x &= LOW_BYTES[np.minimum(left, 8)]
    x = mix(x + (place + 1).astype(np.uint64) * BASE)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return mix((sums[stop] - sums[stop - count]) ^ mix(size.astype(np.uint64) + MIX_A))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column and where each row begins, with the end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(table: pa.Table | pa.RecordBatch, text: str, limit: int = 1 << 18) -> Iterator[pa.Table | pa.RecordBatch]:
    """Row ranges of about ``limit`` bytes of text, so that work arrays stay small; one longer row is a range by itself."""
    total = np.cumsum(np.diff(utf8(table.column(text))[1]))
    begin = 0
    while begin < len(total):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, "right")))
        yield table.slice(begin, end - begin)
        begin = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each row, with the end. ``between``: which bytes part words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Binary array of (possibly overlapping) slices of ``data``."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    index = np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[index]))]).cast(kind or pa.binary())


def rows_of(first: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The row that each numbered item lies in, by the first item of each row."""
    return np.searchsorted(first, items, "right") - 1
