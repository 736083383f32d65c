"""Vectorised byte-level helpers shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  ``slices`` cuts a batch into pieces of a bounded
number of bytes (a piece always holds at least one whole document) and exposes the bytes
without copying, so peak memory follows the longest document, not the batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Lower-cases A-Z only; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a white-space-separated word: everything but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII letters and digits and every byte of a multi-byte character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def text_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; offsets start at 0, nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows of about ``max_bytes`` of text each."""
    data, offs = text_view(batch.column(batch.schema.get_field_index(column)))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _BASE_INV):
        p = np.full(n, b & ((1 << 64) - 1), dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n; tables for long texts aren't kept."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(size) if size <= 1 << 22 else _powers.__wrapped__(int(n))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (avalanche of every input bit)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] the polynomial sum of bytes i..j-1 (modulo 2**64)."""
    s = np.zeros(len(data) + 1, dtype=U64)
    if len(data):
        p, _ = powers(len(data) + 1)
        x = s[1:]
        x[:] = data
        x += U64(1)
        x *= p[: len(data)]
        np.cumsum(x, out=x)
    return s


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, independent of where the span lies."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U64))


def spans(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of kept bytes; runs never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = keep[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    row = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, row


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
