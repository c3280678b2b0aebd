"""Whole columns of text as one flat byte array, and the vectorised scans that the operators share.

Texts are handled as UTF-8. A null is an empty text. ``pieces`` cuts Arrow batches so that the
NumPy temporaries of one step stay near ``PIECE`` bytes times a small factor, however many rows a
batch has; a single longer text is a piece of its own and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte.
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, dtype=np.uint64, out=have)
        if n <= 2 * PIECE:
            _powers[kind] = have
    return have[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the n + 1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int64)
    off = off.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def release() -> None:
    """Gives free memory back to the system: a worker lives on after its task, and what one stage freed is no use to the next one's JVM."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: about ``limit`` bytes of ``column`` in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut where a text ends."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    cuts = off[1:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = cuts[cuts > 0] - 1
    after[ends] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def owner(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The index of the text that each position lies in."""
    return np.searchsorted(off, starts, "right") - 1


class Hasher:
    """64-bit hashes of any spans of a flat buffer, from one running sum; equal bytes, equal hash."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[buf] * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words that stay in one text, with the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), at


def sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of ``values`` by text."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def table(names: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(names)
