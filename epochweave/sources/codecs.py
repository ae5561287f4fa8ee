"""Columns of rows as bytes: the encodings of the sharded row format, by name.

A null has no bytes in this format, so encoding one is an error. Images stay encoded bytes, as Spark has no image values; raw ones are a
(width, height, mode, data) tuple. Pickles are never read or written.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np

# Fixed values of the format: the byte that stands for each array type, in its order.
ARRAY_TYPES = {"uint8": 8, "int8": 9, "uint16": 16, "int16": 17, "float16": 18, "uint32": 32, "int32": 33, "float32": 34, "uint64": 64, "int64": 65, "float64": 66}
SCALARS = ("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float16", "float32", "float64")
UNSAFE = ("pkl",)


@dataclass(frozen=True)
class Codec:
    """size: the bytes of every value, if they are always as many."""

    encode: Callable
    decode: Callable
    size: int | None = None


def _typed(kind: type | tuple, encode: Callable) -> Callable:
    def run(x):
        if not isinstance(x, kind) or (isinstance(x, bool) and kind is int):
            raise TypeError(f"{type(x).__name__} can't be encoded here")
        return encode(x)

    return run


def _scalar(dtype: str) -> Codec:
    kind = np.dtype(dtype).newbyteorder("<")

    def encode(x) -> bytes:
        if x is None:
            raise TypeError("a null can't be encoded")
        if kind.kind in "iu" and not np.iinfo(kind).min <= int(x) <= np.iinfo(kind).max:
            raise ValueError(f"{x} is no {dtype}")
        return np.array(int(x) if kind.kind in "iu" else x, kind).tobytes()

    return Codec(encode, lambda b: np.frombuffer(b, kind)[0].item(), kind.itemsize)


def _array(dtype: str | None, shape: tuple[int, ...] | None) -> Codec:
    if dtype is not None and dtype not in ARRAY_TYPES:
        raise ValueError(f"no array of {dtype}")
    by_number = {v: k for k, v in ARRAY_TYPES.items()}

    def encode(x) -> bytes:
        x = x if isinstance(x, np.ndarray) else np.array(x, dtype)
        if x.dtype.name not in ARRAY_TYPES or (dtype and x.dtype.name != dtype):
            raise ValueError(f"an array of {x.dtype.name} where {dtype or 'numbers'} were due")
        if not x.ndim or not x.size or x.ndim > 63:
            raise ValueError("an array needs 1 to 63 axes, and elements")
        if shape and x.shape != shape:
            raise ValueError(f"shape {x.shape} where {shape} was due")
        head = b"" if dtype else bytes([ARRAY_TYPES[x.dtype.name]])
        if not shape:
            width = next(k for k in range(4) if max(x.shape) < 1 << (8 << k))
            head += bytes([x.ndim << 2 | width]) + np.array(x.shape, f"<u{1 << width}").tobytes()
        return head + np.ascontiguousarray(x).tobytes()

    def decode(b: bytes) -> np.ndarray:
        at, kind, dims = 0, dtype, shape
        if not kind:
            kind, at = by_number[b[0]], 1
        if not dims:
            axes, width = b[at] >> 2, 1 << (b[at] & 3)
            dims = tuple(np.frombuffer(b[at + 1 : at + 1 + axes * width], f"<u{width}").tolist())
            at += 1 + axes * width
        return np.frombuffer(b[at:], kind).reshape(dims)

    return Codec(encode, decode, int(np.prod(shape)) * np.dtype(dtype).itemsize if dtype and shape else None)


def _listed(lead: bytes) -> Codec:
    """Byte strings behind their number and sizes."""

    def encode(parts: list[bytes]) -> bytes:
        return lead + struct.pack(f"<{1 + len(parts)}I", len(parts), *map(len, parts)) + b"".join(map(bytes, parts))

    def decode(b: bytes) -> list[bytes]:
        at = len(lead)
        if len(b) < at + 4:
            raise ValueError("too short for a list")
        (n,) = struct.unpack_from("<I", b, at)
        if len(b) < at + 4 + 4 * n:
            raise ValueError("too short for its list")
        sizes, out = struct.unpack_from(f"<{n}I", b, at + 4), []
        at += 4 + 4 * n
        for size in sizes:
            out.append(b[at : at + size])
            at += size
        return out

    return Codec(encode, decode)


def _raw_image(x) -> bytes:
    width, height, mode, data = x
    return struct.pack("<3I", width, height, len(mode.encode())) + mode.encode() + bytes(data)


def _raw_image_of(b: bytes) -> tuple:
    width, height, n = struct.unpack_from("<3I", b)
    return width, height, b[12 : 12 + n].decode(), b[12 + n :]


_BYTES = Codec(_typed((bytes, bytearray), bytes), bytes)
_FIXED = {
    "bytes": _BYTES,
    "str": Codec(_typed(str, str.encode), bytes.decode),
    "int": Codec(_typed(int, lambda x: struct.pack("<q", x)), lambda b: struct.unpack("<q", b)[0], 8),
    "str_int": Codec(_typed(int, lambda x: str(x).encode()), lambda b: int(b)),
    "str_float": Codec(_typed(float, lambda x: repr(x).encode()), lambda b: float(b)),
    "str_decimal": Codec(_typed(Decimal, lambda x: str(x).encode()), lambda b: Decimal(b.decode())),
    "json": Codec(lambda x: json.dumps(x.tolist() if isinstance(x, np.ndarray) else x).encode(), json.loads),
    "pil": Codec(_raw_image, _raw_image_of),
    "jpeg": _BYTES, "png": _BYTES, "list[pil]": _listed(bytes(4)), "list[jpeg]": _listed(bytes(4)), "list[png]": _listed(bytes(4)), "jpeg_array": _listed(b""), "jpegarray": _listed(b""),
} | {d: _scalar(d) for d in SCALARS}


def codec(name: str) -> Codec:
    """The codec of a name such as int32, str or ndarray:float32:2,3."""
    if name in UNSAFE:
        raise ValueError(f"{name} can run code when it is read, and is refused")
    kind, _, rest = name.partition(":")
    if kind == "ndarray":
        dtype, _, shape = rest.partition(":")
        dims = tuple(map(int, shape.split(","))) if shape else None
        if dims and min(dims) < 1:
            raise ValueError("an axis must have elements")
        return _array(dtype or None, dims)
    if name not in _FIXED:
        raise ValueError(f"no encoding {name!r}")
    return _FIXED[name]


def encode(name: str, value) -> bytes:
    """Bytes pass as they are, whatever the encoding: they count as encoded."""
    return bytes(value) if isinstance(value, (bytes, bytearray)) and name not in ("json",) else codec(name).encode(value)
