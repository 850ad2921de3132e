"""Vectorised words of Arrow text columns: boundaries and 64-bit hashes, without Python objects per word.

A word is a run of bytes outside space and 0x09-0x0D. Work goes through slices of bounded bytes, so
memory follows the slice (or the longest single text), not the batch.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside ASCII letters, digits and UTF-8 sequences.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; behind the end are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, head: int | None = None) -> np.ndarray:
    """A uint64 for each span of bytes (its first ``head``), eight bytes at a time."""
    eight = eights(data)
    left, at = ends - starts, starts.copy()
    if head:
        left = np.minimum(left, head)
    h = np.full(len(at), (seed * 0x632BE59BD9B4E019 + 0x243F6A8885A308D3) & (2**64 - 1), np.uint64) ^ left.astype(np.uint64)
    live = np.arange(len(at))
    while len(live):
        block = eight[at[live]] & _MASK[np.minimum(left[live], 8)]
        h[live] = mix(h[live] * _K ^ block)
        live = live[left[live] > 8]
        at[live] += 8
        left[live] -= 8
    return h


def same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes from ``a`` and from ``b`` on are equal."""
    eight, out = eights(data), np.ones(len(a), bool)
    live, left, at = np.arange(len(a)), size.copy(), 0
    while len(live):
        mask = _MASK[np.minimum(left[live], 8)]
        out[live] &= (eight[a[live] + at] & mask) == (eight[b[live] + at] & mask)
        live = live[out[live] & (left[live] > 8)]
        left[live] -= 8
        at += 8
    return out


class Words:
    """Words of one slice: ``starts``, ``ends`` (bytes) and ``ptr``, the word range of each row.

    ``between`` marks the bytes that part words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        n = len(data)
        space = between[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before |= edge[:n]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after |= edge[1:]
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.ptr = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 0, head: int | None = None) -> np.ndarray:
        """A uint64 for each word, from its bytes (the first ``head``)."""
        return hashes(self.data, self.starts, self.ends, seed, head)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` consecutive words and whether the words are of one row, by first word."""
        count = len(hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        g = np.zeros(count, np.uint64)
        for k in range(n):
            g = g * _K + hashes[k : k + count]
        row_end = np.repeat(self.ptr[1:], np.diff(self.ptr))[:count]
        return mix(g), np.arange(count) + n <= row_end
