"""Vectorised text primitives shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes.  A *chunk* is a list of byte strings laid out
in one buffer with a separator after each, so that tokenising, hashing and
windowing run as a few NumPy passes over many documents at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

#: words of spaces: maximal runs without \x20 and \x09-\x0D
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words of letters: 0-9, a-z and everything beyond ASCII, after A-Z are lower-cased
LETTER_WORDS = np.zeros(256, bool)
LETTER_WORDS[0x30:0x3A] = True
LETTER_WORDS[0x61:0x7B] = True
LETTER_WORDS[0x80:] = True
#: bytes.translate table that lower-cases A-Z only
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    while len(_POW) < n:
        m = len(_POW)
        step, back = np.uint64(pow(_BASE, m, 1 << 64)), np.uint64(pow(_BASE_INV, m, 1 << 64))
        with np.errstate(over="ignore"):
            _POW, _INV = np.concatenate([_POW, _POW * step]), np.concatenate([_INV, _INV * back])
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and inverse powers to normalise a slice's hash by its start."""
    power, inverse = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        values = buf.astype(np.uint64)
        values += np.uint64(1)
        values *= power[:-1]
        np.cumsum(values, out=sums[1:])
    return sums, inverse


def lanes_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; beyond the end they are zeros."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[s:e] for each pair of bounds: eight bytes after eight, mixed after each, the length first.

    Not a polynomial, for which different texts with equal hashes are easy to give.
    """
    lanes = lanes_of(buf)
    left = np.asarray(ends - starts, np.int64)
    out = mix(left.astype(np.uint64) ^ np.uint64(_BASE))
    at, row = np.asarray(starts, np.int64), None
    while True:
        live = np.flatnonzero(left > 0)
        if not len(live):
            return out
        if len(live) < len(left):
            row = live if row is None else row[live]
            at, left = at[live], left[live]
        lane = lanes[at]
        short = left < 8
        if short.any():
            lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        if row is None:
            out = mix((out ^ lane) + np.uint64(_BASE_INV))
        else:
            out[row] = mix((out[row] ^ lane) + np.uint64(_BASE_INV))
        at, left = at + 8, left - 8


def equal_slices(buf: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether buf[s : s + n] and buf[o : o + n] are the same bytes, for each s, o and n."""
    lanes = lanes_of(buf)
    same = np.ones(len(starts), bool)
    row = np.arange(len(starts))
    at, to, left = (np.asarray(x, np.int64) for x in (starts, others, sizes))
    while len(row):
        keep = (left > 0) & same[row]
        row, at, to, left = row[keep], at[keep], to[keep], left[keep]
        differ = lanes[at] ^ lanes[to]
        short = left < 8
        differ[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        same[row[differ != 0]] = False
        at, to, left = at + 8, to + 8, left - 8
    return same


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of k neighbouring values, for each start that has k of them."""
    n = max(0, len(values) - k + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += values[j : j + n] * np.uint64(pow(_BASE, 2 * j + 1, 1 << 64))
    return mix(total)


def join_texts(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with a separator after each text; starts and ends of the texts in it."""
    buf = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + 1) - 1
    return buf, ends - size, ends


def words_of(buf: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words up to its end."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.take(table, buf, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[0::2], edge[1::2]
    return starts, stops, np.searchsorted(starts, ends)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as byte strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a string column with about `limit` bytes together, and their texts; a longer text is alone.

    One range's texts are there at a time, and what one is done with goes back to the system: a batch may
    hold many megabytes, and a worker lives longer than its task.
    """
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > limit:
            yield start, i, byte_texts(column.slice(start, i - start))
            start, total = i, 0
        total += n + 1
    if start < len(column):
        yield start, len(column), byte_texts(column.slice(start))
    give_back()


def give_back() -> None:
    """Hands free memory back to the system, where there is a way to."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `limit` bytes together; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
