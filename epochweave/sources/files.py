"""Compression and hashes of whole files, by name."""

from __future__ import annotations

import bz2
import gzip
import hashlib
from collections.abc import Callable

# Extension, default level, and the range of levels.
LEVELS = {"br": (11, 0, 11), "bz2": (9, 1, 9), "gz": (9, 0, 9), "snappy": (None, None, None), "zstd": (3, 1, 22)}


def _parsed(name: str) -> tuple[str, int | None]:
    kind, _, level = name.partition(":")
    if kind not in LEVELS:
        raise ValueError(f"no compression {name!r}")
    default, low, high = LEVELS[kind]
    if level and (low is None or not low <= int(level) <= high):
        raise ValueError(f"no level {level} of {kind}")
    return kind, int(level) if level else default


def compress(name: str, data: bytes) -> bytes:
    kind, level = _parsed(name)
    if kind == "gz":
        return gzip.compress(data, level, mtime=0)
    if kind == "bz2":
        return bz2.compress(data, level)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    if kind == "br":
        import brotli

        return brotli.compress(bytes(data), quality=level)
    import snappy

    return snappy.compress(bytes(data))


def decompress(name: str, data: bytes) -> bytes:
    kind, _ = _parsed(name)
    if kind == "gz":
        return gzip.decompress(data)
    if kind == "bz2":
        return bz2.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == "br":
        import brotli

        return brotli.decompress(data)
    import snappy

    return snappy.decompress(data)


def extension(name: str) -> str:
    return _parsed(name)[0]


def hashes() -> dict[str, Callable[[bytes], str]]:
    """Every hash by name: those of hashlib with a fixed length, and xxhash's if there."""
    out = {n: (lambda b, n=n: hashlib.new(n, b).hexdigest()) for n in hashlib.algorithms_available if not n.startswith("shake") and n.islower()}
    try:
        import xxhash
    except ImportError:
        return out
    return out | {n: (lambda b, f=getattr(xxhash, n): f(b).hexdigest()) for n in ("xxh32", "xxh64", "xxh128", "xxh3_64", "xxh3_128") if hasattr(xxhash, n)}


def digest(name: str, data: bytes) -> str:
    if name not in hashes():
        raise ValueError(f"no hash {name!r}")
    return hashes()[name](data)
