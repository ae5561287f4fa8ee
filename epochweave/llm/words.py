"""Words and shingles of whole Arrow batches, hashed with NumPy.

A word's hash is a polynomial over its bytes, read off a running sum, so that no Python object is made for a word. Memory is
bounded by CHUNK bytes (or the longest word) beyond the batch itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15
_cache: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if _cache.get("n", 0) < n:
        n = max(n, CHUNK)
        inverse = pow(BASE, -1, 1 << 64)
        powers = [np.full(n + 1, b, np.uint64) for b in (BASE, inverse)]
        for p in powers:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        _cache.update(n=n, powers=powers, byte=mix(np.arange(1, 257, dtype=np.uint64)))
    return _cache["byte"], *_cache["powers"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and where each row begins (and the last ends)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(batches, column: int = 1, most: int = 1 << 21):
    """The batches in pieces of about `most` bytes of a text column, or one row, so that what is made of them stays small."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def classes(separators: str) -> np.ndarray:
    """For each byte whether it belongs to a word. separators: "space" (space, tab to return) or "punctuation" (all ASCII but letters and digits)."""
    byte = np.arange(256)
    if separators == "space":
        return ~((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)))
    return (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))


def lower_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


class Words:
    """starts, ends: byte ranges of the words; first: for each row, and one more, its first word; hashes: 64 bits a word, A-Z as a-z."""

    def __init__(self, column: pa.Array, separators: str = "space") -> None:
        self.raw, self.offsets = buffers(column)
        inside = classes(separators)[self.raw]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = self.offsets[:-1] < self.offsets[1:]
        before[self.offsets[:-1][filled]] = False
        after[self.offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        low, at = lower_table(), 0
        while at < len(self.starts):
            begin = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, begin + CHUNK, "right")))
            stop = self.ends[upto - 1]
            byte, power, inverse = _tables(int(stop - begin))
            total = np.zeros(stop - begin + 1, np.uint64)
            np.cumsum(byte[low[self.raw[begin:stop]]] * power[: stop - begin], out=total[1:])
            s, e = self.starts[at:upto] - begin, self.ends[at:upto] - begin
            out[at:upto] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = upto
        return out


def combined(hashes: np.ndarray) -> int:
    """One hash for a whole sequence of word hashes, other than that of any shingle."""
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * 0xA0761D6478BD642F + h + 0x5851F42D4C957F2D) & ((1 << 64) - 1)
    return total


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words."""
    n = len(hashes) - k + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        total *= np.uint64(0xA0761D6478BD642F)
        total += hashes[j : j + n]
    return mix(total)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence as one; without words, empty."""
    words = Words(column)
    every = shingle_hashes(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([combined(words.hashes[a:b])], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
