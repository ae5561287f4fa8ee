"""Whole columns of rows as the bytes of the sharded row format, and back.

A row has the sizes of its columns of variable size (u32), then its columns. Both ways work column by column over a block of rows:
bytes are scattered to, or gathered from, places that running sums of the sizes give, so that no row is handled by itself.
"""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from epochweave.sources.codecs import ARRAY_TYPES, SCALARS, codec, encode

RAW = ("bytes", "jpeg", "png")
#: The fields of a raw image.
IMAGE = ("width", "height", "mode", "data")


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Of the Spark types that columns of shards are read as."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    return {T.BinaryType: pa.binary(), T.StringType: pa.string(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}[type(kind)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and how many each value has."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], np.diff(offsets)


def _plain(value, encoding: str):
    """A value of Spark's as its codec takes it."""
    if isinstance(value, datetime.datetime):
        return round((value if value.tzinfo else value.astimezone()).timestamp() * 1_000_000)
    if isinstance(value, datetime.date):
        return (value - datetime.date(1970, 1, 1)).days
    if isinstance(value, list) and value and isinstance(value[0], tuple) and encoding == "json":
        return dict(value)
    if isinstance(value, dict) and encoding == "pil":
        return tuple(value[n] for n in IMAGE)
    return value


def _array_kind(encoding: str) -> np.dtype | None:
    """The numbers of arrays of stated type and any shape, which are handled as whole columns; none for other encodings."""
    kind, _, rest = encoding.partition(":")
    return np.dtype(rest).newbyteorder("<") if kind == "ndarray" and rest in ARRAY_TYPES else None


def _array_column(column: pa.Array, to: np.dtype) -> tuple[np.ndarray, np.ndarray] | None:
    """column_bytes() of lists, or lists of lists of one length, of numbers; none if something in them needs a look of its own (a null, an empty array, a number that may not fit)."""
    shapes, flat, n = [], column, np.ones(len(column), np.int64)
    while pa.types.is_list(flat.type) and len(shapes) < 2:
        sizes = np.diff(flat.offsets.to_numpy().astype(np.int64))
        if flat.null_count or not len(sizes) or sizes.min() < 1:
            return None
        first = sizes[_starts(n)]
        if (np.repeat(first, n) != sizes).any():
            return None
        shapes.append(first)
        flat, n = flat.flatten(), n * first
    if not shapes or flat.null_count or not (pa.types.is_floating(flat.type) or pa.types.is_integer(flat.type)):
        return None
    numbers = flat.to_numpy(zero_copy_only=False)
    if to.kind in "iu" and (numbers.dtype.kind == "f" or numbers.min() < np.iinfo(to).min or numbers.max() > np.iinfo(to).max):
        return None
    shapes = np.stack(shapes, axis=1)
    width = np.searchsorted([1 << 8, 1 << 16], shapes.max(axis=1), "right")
    head, held = 1 + (shapes.shape[1] << width), n * to.itemsize
    at, out = _starts(head + held), np.empty(int((head + held).sum()), np.uint8)
    out[at] = shapes.shape[1] << 2 | width
    for k in np.unique(width).tolist():
        rows = np.flatnonzero(width == k)
        out[(at[rows] + 1)[:, None] + np.arange(shapes.shape[1] << k)] = shapes[rows].astype(f"<u{1 << k}").view(np.uint8).reshape(len(rows), -1)
    out[_ranges(at + head, held)] = numbers.astype(to).view(np.uint8)
    return out, head + held


def _arrays_of(own: np.ndarray, lengths: np.ndarray, of: np.dtype, kind: pa.DataType) -> pa.Array:
    """Flat lists of arrays' bytes that follow each other. Heads say how many elements there must be."""
    at = _starts(lengths)
    lead = own[at].astype(np.int64) if len(at) else at
    axes, width = lead >> 2, 1 << (lead & 3)
    held = lengths - 1 - axes * width
    n = held // of.itemsize
    for a, w in {*zip(axes.tolist(), width.tolist(), strict=True)}:
        rows = np.flatnonzero((axes == a) & (width == w))
        if held[rows].min() < 0 or (own[(at[rows] + 1)[:, None] + np.arange(a * w)].view(f"<u{w}").astype(np.int64).prod(axis=1) * of.itemsize != held[rows]).any():
            raise ValueError("an array's bytes aren't as many as its shape says")
    values = own[_ranges(at + lengths - held, held)].view(of).astype(kind.value_type.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, kind.value_type))


def column_bytes(column: pa.Array, encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values one after the other, and how many each has. A null is an error."""
    if column.null_count:
        raise ValueError("the format has no nulls: give a default before writing")
    kind = column.type
    binary = pa.types.is_binary(kind) or pa.types.is_large_binary(kind)
    if (binary and encoding != "json") or (encoding == "str" and (pa.types.is_string(kind) or pa.types.is_large_string(kind))):
        data, lengths = _flat(column)  # bytes pass as they are: they count as encoded
        if (size := codec(encoding).size) and (lengths != size).any():
            raise ValueError(f"values of {encoding} have {size} bytes each")
        return data, lengths
    if (encoding in SCALARS or encoding == "int") and not pa.types.is_decimal(kind):
        numbers = column.cast(pa.int32()).to_numpy() if pa.types.is_date(kind) else column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()).to_numpy() if pa.types.is_timestamp(kind) else column.to_numpy(zero_copy_only=False)
        to = np.dtype("int64" if encoding == "int" else encoding).newbyteorder("<")
        if to.kind in "iu" and len(numbers):
            least, most = np.iinfo(to).min, np.iinfo(to).max
            if numbers.dtype.kind == "f" and not np.isfinite(numbers).all() or numbers.min() < least or numbers.max() > most:
                raise ValueError(f"a value is no {encoding}")
        return numbers.astype(to).view(np.uint8), np.full(len(column), to.itemsize)
    if (to := _array_kind(encoding)) is not None and (found := _array_column(column, to)) is not None:
        return found
    parts = [encode(encoding, _plain(x, encoding)) for x in column.to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs that begin at starts."""
    return np.repeat(starts - _starts(lengths), lengths) + np.arange(int(lengths.sum()))


#: Mean bytes of values from which each is copied by itself: the places of single bytes would take eight times the bytes, twice.
LONG = 64


def _put(out: np.ndarray, at: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Values that follow each other in data to places of their own."""
    if len(data) <= LONG * len(lengths):
        out[_ranges(at, lengths)] = data
        return
    to, of = memoryview(out), memoryview(np.ascontiguousarray(data))
    for a, b, n in zip(at.tolist(), _starts(lengths).tolist(), lengths.tolist(), strict=True):
        to[a : a + n] = of[b : b + n]


def _got(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Values from places of their own, one after the other."""
    if (total := int(lengths.sum())) <= LONG * len(lengths):
        return data[_ranges(at, lengths)]
    of = memoryview(data)
    return np.frombuffer(b"".join([of[a : a + n] for a, n in zip(at.tolist(), lengths.tolist(), strict=True)]), np.uint8, total)


def encode_rows(columns: list[pa.Array], encodings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows one after the other, and how many each has; columns in order of name."""
    n = len(columns[0])
    known = [column_bytes(c, e) for c, e in zip(columns, encodings, strict=True)]
    loose = [lengths for (_, lengths), e in zip(known, encodings, strict=True) if codec(e).size is None]
    head = np.stack(loose, axis=1).astype("<u4").view(np.uint8).reshape(n, -1) if loose else np.zeros((n, 0), np.uint8)
    total = head.shape[1] + sum(lengths for _, lengths in known)
    at, out = _starts(total), np.empty(int(total.sum()), np.uint8)
    out[at[:, None] + np.arange(head.shape[1])] = head
    at = at + head.shape[1]
    for data, lengths in known:
        _put(out, at, lengths, data)
        at = at + lengths
    return out, total


def _texts(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a block of rows has over 2 GiB in a column")
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _read_as(value, encoding: str):
    if isinstance(value, np.ndarray):
        return value.ravel().tolist()
    if encoding == "json":
        return json.dumps(value)
    if encoding in ("str_decimal", "str_int"):
        return str(value)
    if encoding == "pil":
        return dict(zip(IMAGE, value, strict=True))
    return Decimal(value) if encoding == "uint64" else value


def decode_rows(data: np.ndarray, starts: np.ndarray, encodings: dict[str, str], kinds: dict[str, T.DataType]) -> dict[str, pa.Array]:
    """The columns in kinds (of encodings, all columns in order of name) of the rows that begin at starts."""
    loose = [n for n, e in encodings.items() if codec(e).size is None]
    sizes = data[starts[:, None] + np.arange(4 * len(loose))].view("<u4").astype(np.int64).reshape(len(starts), -1)
    at, out = starts + 4 * len(loose), {}
    for name, encoding in encodings.items():
        lengths = sizes[:, loose.index(name)] if name in loose else np.full(len(starts), codec(encoding).size)
        if name in kinds:
            own = _got(data, at, lengths)
            kind = arrow_type(kinds[name])
            if encoding in RAW or encoding == "str":
                out[name] = _texts(own, lengths, kind)
            elif encoding in SCALARS and encoding != "uint64" or encoding == "int":
                out[name] = pa.array(own.view(np.dtype("int64" if encoding == "int" else encoding).newbyteorder("<")).astype(kind.to_pandas_dtype()), kind)
            elif (of := _array_kind(encoding)) is not None and of != np.dtype("uint64"):  # those may not fit
                out[name] = _arrays_of(own, lengths, of, kind)
            else:
                raw, ends = own.tobytes(), np.cumsum(lengths).tolist()
                decode = codec(encoding).decode
                out[name] = pa.array([_read_as(decode(raw[b - n : b]), encoding) for b, n in zip(ends, lengths.tolist(), strict=True)], kind)
        at = at + lengths
    return out
