"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Texts are never decoded or copied row by row: a column's value buffer is one
byte array, with the bounds of its documents beside it. Word hashes come from
prefix sums of a polynomial modulo 2**64, so a word costs the same at any length.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from lodestone.llm import tokens

# Arrays of a megabyte and more go back to the system when they are freed. By default the C library
# raises that limit as a worker runs, and a worker that serves many stages keeps what its largest one took.
with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
    ctypes.CDLL(None).mallopt(-3, 1 << 20)


def settle() -> None:
    """For the start of a task: what a worker still holds of earlier stages, tokenizers and freed memory, goes back to the system."""
    tokens.release()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
#: One random 64-bit number for each byte.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

_b = np.arange(256)
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
#: ASCII white space: a space and the bytes 9 to 13.
NOT_SPACE = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))
#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit number over all its bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to the n-th."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, _INVERSE)):
            p = np.full(max(n + 1, 1 << 20), U(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 bounds of its rows (null: empty)."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    bounds = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return buf, bounds - bounds[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; rows stay whole."""
    _, bounds = column_bytes(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def prefix(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of the polynomial hash; element i sums the bytes before i."""
    n = len(buf)
    h = np.zeros(n + 1, U)
    v = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
    np.cumsum(v[buf] * powers(n)[0][:n], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the spans [s, e), whatever their place."""
    return mix((h[e] - h[s]) * powers(len(h))[1][s] + (e - s).astype(U))


def words(buf: np.ndarray, bounds: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes of a kind."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[buf]
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | head[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | head[1:n]
    s = np.flatnonzero(begins)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(bounds, s, "right") - 1


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + len)."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lens)


def pack(x: np.ndarray) -> bytes:
    """Small numbers as byte planes, compressed."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not raw[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(raw[:used].tobytes())


def unpack(b: bytes) -> np.ndarray:
    """The numbers that :func:`pack` packed."""
    used = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8")[:, 0]
