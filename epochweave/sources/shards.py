"""Sharded rows: files of rows with an index, as a Spark data source.

A shard of encoded rows ("mds") is the number of rows (u32), one more offsets (u32), a JSON head, then the rows; see columns.py. Rows as
lines (JSON or separated values) have the same numbers and head in a file of their own, behind the name of that of the lines. index.json
lists all shards (see index.py). Tasks write to folders of their own, and only those of tasks that Spark has accepted get into the index.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from threading import Lock
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from epochweave.functions.units import bytes_to_int
from epochweave.places import filesystem, qualified
from epochweave.sources.codecs import UNSAFE, codec, encode
from epochweave.sources.columns import arrow_type, decode_rows, encode_rows
from epochweave.sources.files import compress, decompress, digest, extension
from epochweave.sources.index import FILES, VERSION, commit, delete_files, has_index, moved, read_index
from epochweave.sources.pruning import Condition, checked, may_match, summary

FORMAT = "mds"
BLOCK = 4 << 20
#: Bytes of shards, as they are when decompressed, that a task reads at most (or one shard).
TASK_BYTES = 64 << 20
_registering = Lock()
#: The encoding of each Spark type.
BY_TYPE = {
    T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.DecimalType: "str_decimal", T.StringType: "str", T.BinaryType: "bytes",
    T.BooleanType: "uint8", T.TimestampType: "int64", T.DateType: "int32",
}
#: Encodings whose values a summary can hold.
SUMMED = ("str", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "float32", "float64")
ARRAYS = {T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64"}


def encodings_of(schema: T.StructType, unsigned: bool = False) -> dict[str, str]:
    """An encoding for each column. unsigned: bytes and shorts as uint8 and uint16, as older writers had them. Timestamps are microseconds."""
    out = {}
    for f in schema.fields:
        kind = f.dataType
        if isinstance(kind, T.ArrayType) and type(kind.elementType) in ARRAYS:
            out[f.name] = f"ndarray:{ARRAYS[type(kind.elementType)]}"
        elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            out[f.name] = "json"
        elif type(kind) in BY_TYPE:
            out[f.name] = {"int8": "uint8", "int16": "uint16"}.get(BY_TYPE[type(kind)], BY_TYPE[type(kind)]) if unsigned else BY_TYPE[type(kind)]
        else:
            raise ValueError(f"no encoding for {kind.simpleString()} in column {f.name}")
    return out


def type_of(encoding: str) -> T.DataType:
    """The Spark type that a column of this encoding is read as."""
    kind, _, rest = encoding.partition(":")
    if kind == "ndarray":
        dtype = rest.partition(":")[0]
        return T.ArrayType({"float32": T.FloatType(), "float64": T.DoubleType(), "float16": T.FloatType()}.get(dtype, T.LongType()) if dtype else T.DoubleType())
    if kind.startswith("list[") or kind in ("jpeg_array", "jpegarray"):
        return T.ArrayType(T.BinaryType())
    if kind == "pil":
        return T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("mode", T.StringType()), T.StructField("data", T.BinaryType())])
    simple = {"bytes": T.BinaryType(), "jpeg": T.BinaryType(), "png": T.BinaryType(), "str": T.StringType(), "json": T.StringType(), "str_decimal": T.StringType(), "str_int": T.StringType(), "str_float": T.DoubleType(), "uint64": T.DecimalType(20, 0), "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType()}
    return simple.get(kind, T.LongType())


def joined(first: list[bytes], blocks: list[np.ndarray]) -> memoryview:
    """All bytes, one after the other, in a single copy; the blocks are let go as they are put into it."""
    out = np.empty(sum(map(len, first)) + sum(b.nbytes for b in blocks), np.uint8)
    at, blocks[:] = 0, [np.frombuffer(b"".join(first), np.uint8), *blocks][::-1]
    while blocks:
        block = blocks.pop()
        out[at : at + block.nbytes] = block
        at += block.nbytes
    return memoryview(out)


class ShardWriter:
    """Rows into shards of at most size_limit bytes, one at a time in memory; a row that alone is larger is a shard of its own.

    A shard is closed when a row would make it larger than the limit, so one that is exactly full is kept open until the next row.
    """

    def __init__(self, columns: dict[str, str], folder: str, size_limit: int | str | None = 1 << 26, compression: str | None = None, hashes: list[str] | None = None, summaries: list[str] | None = None) -> None:
        limit = bytes_to_int(size_limit) if size_limit is not None else None
        if limit is not None and limit >= 1 << 32:
            raise ValueError("offsets have 32 bits: a shard must be smaller than 4 GiB")
        if hashes and sorted(set(hashes)) != list(hashes):
            raise ValueError("hashes must be sorted, each once")
        self.limit, self.compression, self.hashes = limit, compression, hashes or []
        self.config = {"version": VERSION, "compression": compression, "hashes": self.hashes, "size_limit": limit} | self.layout(columns)
        self.head = json.dumps(self.config, sort_keys=True).encode()
        self.files, self.where = filesystem(folder)
        self.files.create_dir(self.where, recursive=True)
        self.blocks: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.summaries, self.values = summaries or [], []
        self.now = self.empty
        self.shards: list[dict] = []
        self.shards_before = 0  # of the same folder, in names only

    def layout(self, columns: dict[str, str]) -> dict:
        names = sorted(columns)
        self.encodings = {n: columns[n] for n in names}
        return {"format": FORMAT, "column_names": names, "column_encodings": list(self.encodings.values()), "column_sizes": [codec(e).size for e in self.encodings.values()]}

    @property
    def empty(self) -> int:
        """What a shard without rows takes."""
        return 8 + len(self.head)

    def write(self, values: dict) -> None:
        """A single row."""
        parts = [pa.array([values[n] if isinstance(values[n], bytes) else encode(e, values[n])], pa.binary()) for n, e in self.encodings.items()]
        self.add(*encode_rows(parts, list(self.encodings.values())))

    def write_rows(self, batch: pa.RecordBatch) -> None:
        """Rows of columns by name, in blocks of about BLOCK bytes."""
        step = max(1, int(batch.num_rows * BLOCK // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            self.add(*encode_rows([part.column(n) for n in self.encodings], list(self.encodings.values())), part)

    def add(self, data: np.ndarray, lengths: np.ndarray, rows: pa.RecordBatch | None = None) -> None:
        """Encoded rows one after the other, and how many bytes each has; rows: the same, for their summaries."""
        ends, used, first = np.cumsum(lengths), np.cumsum(lengths + 4), 0
        while first < len(lengths):
            before = used[first - 1] if first else 0
            upto = len(lengths) if self.limit is None else int(np.searchsorted(used, before + self.limit - self.now, "right"))
            if upto == first and not self.lengths:
                upto = first + 1
            if upto > first:
                begin = ends[first - 1] if first else 0
                self.blocks.append(data[begin : ends[upto - 1]])
                self.lengths.append(lengths[first:upto])
                if rows is not None and self.summaries:
                    self.values.append(rows.select(self.summaries).slice(first, upto - first))
                self.now += int(used[upto - 1] - before)
            if upto < len(lengths):
                self.flush()
            first = upto

    def flush(self) -> None:
        if not self.lengths:
            return
        lengths, rows = np.concatenate(self.lengths), self.blocks
        self.blocks = []  # parts() empties them, so that a shard's bytes are held once
        info = self.config | {"samples": len(lengths)} | dict.fromkeys(FILES)
        for kind, name, data in self.parts(lengths, rows):
            info[f"raw_{kind}"] = self._stored(name, data)
            if self.compression:
                name, data = f"{name}.{extension(self.compression)}", compress(self.compression, data)
                info[f"zip_{kind}"] = self._stored(name, data)
            with self.files.open_output_stream(posixpath.join(self.where, name), compression=None) as out:
                out.write(data)
        if self.values:
            columns = pa.Table.from_batches(self.values)
            info["values"] = {n: summary(columns.column(n).combine_chunks()) for n in self.summaries}
        self.shards.append(info)
        self.blocks, self.lengths, self.values, self.now = [], [], [], self.empty

    def numbers(self, lengths: np.ndarray, begin: int) -> bytes:
        offsets = begin + np.concatenate([[0], np.cumsum(lengths)])
        return np.array([len(lengths)], "<u4").tobytes() + offsets.astype("<u4").tobytes()

    def parts(self, lengths: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[str, str, bytes]]:
        """The files of a shard: kind, name and bytes."""
        begin = 4 + 4 * (len(lengths) + 1) + len(self.head)
        yield "data", f"shard.{self.shards_before + len(self.shards):05}.{FORMAT}", joined([self.numbers(lengths, begin), self.head], rows)

    def _stored(self, name: str, data: bytes) -> dict:
        return {"basename": name, "bytes": len(data), "hashes": {h: digest(h, data) for h in self.hashes}}


class LineWriter(ShardWriter):
    """Rows that are lines: JSON objects, or values with a separator under a line of names. Where they begin is in a file beside them."""

    def __init__(self, columns: dict[str, str], folder: str, kind: str = "json", separator: str | None = None, **more) -> None:
        self.kind, self.separator = kind, {"csv": ",", "tsv": "\t"}.get(kind, separator)
        super().__init__(columns, folder, **more)

    def layout(self, columns: dict[str, str]) -> dict:
        self.names = sorted(columns)
        if self.kind == "json":
            return {"format": "json", "columns": columns, "newline": "\n"}
        own = {} if self.kind in ("csv", "tsv") else {"separator": self.separator}
        return {"format": self.kind, "column_names": self.names, "column_encodings": [columns[n] for n in self.names], "newline": "\n"} | own

    def write_rows(self, batch: pa.RecordBatch) -> None:
        lines = [line.encode() + b"\n" for line in batch.column(0).to_pylist()]
        self.add(np.frombuffer(b"".join(lines), np.uint8), np.fromiter(map(len, lines), np.int64, len(lines)))

    def parts(self, lengths: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[str, str, bytes]]:
        first = b"" if self.kind == "json" else (self.separator.join(self.names) + "\n").encode()
        name = f"shard.{self.shards_before + len(self.shards):05}.{self.kind}"
        yield "data", name, joined([first], rows)
        yield "meta", f"{name}.meta", self.numbers(lengths, len(first)) + self.head


def load_shard(folder: str, shard: dict, validate: str | None = None) -> bytes:
    """A shard's bytes, decompressed; validate names the hash to check the stored file by."""
    stored = shard.get("zip_data") or shard["raw_data"]
    files, where = filesystem(folder)
    with files.open_input_stream(posixpath.join(where, stored["basename"]), compression=None) as stream:
        data = stream.read()
    if validate and digest(validate, data) != stored["hashes"].get(validate):
        raise ValueError(f"{stored['basename']} doesn't have its {validate}")
    return decompress(shard["compression"], data) if shard.get("zip_data") else data


def shard_columns(shard: dict, data: bytes, kinds: dict[str, T.DataType], first: int = 0, stop: int | None = None) -> dict[str, pa.Array]:
    """The columns in kinds of rows first to stop of a shard's bytes."""
    n = shard["samples"]
    stop = n if stop is None else stop
    if not 0 <= first <= stop <= n:
        raise IndexError(f"rows {first} to {stop} of {n}")
    starts = np.frombuffer(data, "<u4", n + 1, 4).astype(np.int64)[first:stop]
    return decode_rows(np.frombuffer(data, np.uint8), starts, dict(zip(shard["column_names"], shard["column_encodings"], strict=True)), kinds)


@dataclass
class ShardPartition(InputPartition):
    """parts: number, first sample, shard and the rows asked for (pairs of first and stop), of each shard."""

    parts: str


class ShardReader(DataSourceReader):
    """Partitions of some shards each, up to a number of bytes, in order of the index; only rows and columns that are asked for are decoded.

    What is asked for are options of the source, not filters that Spark pushes down: it would keep those of one query on a frame for the
    next. samples are ranges [first, stop), in order and apart; conditions skip the shards that can't have a row for them.
    """

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.validate = options["path"], options.get("validate")
        self.schema = schema
        self.asked = json.loads(options.get("samples", "[[0, null]]"))
        self.conditions = json.loads(options.get("conditions", "[]"))
        self.at_once, self.tasks = int(options.get("task_bytes", str(TASK_BYTES))), int(options.get("tasks", "1"))

    def chosen(self) -> list[tuple[int, int, dict, list[tuple[int, int]]]]:
        """Number, first sample, entry and the rows asked for of each shard that is opened."""
        out, first, at = [], 0, 0
        for i, shard in enumerate(read_index(self.folder)):
            stop, spans = first + shard["samples"], []
            while at < len(self.asked) and self.asked[at][1] is not None and self.asked[at][1] <= first:
                at += 1
            for low, high in self.asked[at:]:
                if low >= stop:
                    break
                spans.append((max(low, first) - first, (stop if high is None else min(high, stop)) - first))
            if spans and may_match(shard, self.conditions):
                out.append((i, first, shard, spans))
            first = stop
        return out

    def partitions(self) -> list[ShardPartition]:
        chosen = self.chosen()
        size = lambda c: c[2]["raw_data"]["bytes"]
        goal = min(self.at_once, -(-sum(map(size, chosen)) // self.tasks))
        out, part, held = [], [], 0
        for c in chosen:
            if part and held + size(c) > goal:
                out, part, held = [*out, part], [], 0
            part.append((c[0], c[1], {k: v for k, v in c[2].items() if k != "values"}, c[3]))
            held += size(c)
        return [ShardPartition(json.dumps(p)) for p in [*out, part]]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for number, first, shard, spans in json.loads(partition.parts):
            data = load_shard(self.folder, shard, self.validate)
            own = {n: t for n, t in kinds.items() if n in shard["column_names"]}
            step = max(1, shard["samples"] * BLOCK // max(len(data), 1))
            for low, high in spans:
                for at in range(low, high, step):
                    upto = min(at + step, high)
                    columns = shard_columns(shard, data, own, at, upto)
                    place = {"sample_id": pa.array(np.arange(first + at, first + upto)), "shard_id": pa.array(np.full(upto - at, number))}
                    none = lambda n: place[n] if n in place else pa.nulls(upto - at, arrow_type(kinds[n]))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([columns[n] if n in columns else none(n) for n in kinds], list(kinds))


@dataclass
class Written(WriterCommitMessage):
    part: str
    shards: str


class ShardTask:
    """What a task writes: shards in a folder of its own, and for the commit their entries with stream and number.

    Columns named by `stream` and `number` aren't stored: rows of another stream go to another folder, and each number is a shard of
    its own, of whatever size; both need rows that come sorted by them.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.columns = options["path"], json.loads(options["columns"])
        self.limit, self.compression = options.get("size_limit", str(1 << 26)), options.get("compression") or None
        self.hashes = [h for h in options.get("hashes", "").split(",") if h]
        self.summaries = [c for c in json.loads(options.get("summaries", "[]")) if c in self.columns]
        self.kind, self.separator = options.get("rows", FORMAT), options.get("separator")
        self.by = [options.get("stream"), options.get("number")]

    def _writer(self, folder: str) -> ShardWriter:
        limit = None if self.limit == "none" or self.by[1] else self.limit
        more = {"size_limit": limit, "compression": self.compression, "hashes": self.hashes, "summaries": self.summaries}
        return ShardWriter(self.columns, folder, **more) if self.kind == FORMAT else LineWriter(self.columns, folder, self.kind, self.separator, **more)

    def _runs(self, batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        keys = [batch.column(c).to_pylist() if c else [None] * batch.num_rows for c in self.by]
        begins = [i for i in range(batch.num_rows) if not i or any(k[i] != k[i - 1] for k in keys)] if any(self.by) else [0]
        for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            yield (keys[0][a], keys[1][a]), batch.slice(a, b - a)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        part, out, now, found = uuid.uuid4().hex, None, None, []

        def close() -> None:
            if out is not None:
                out.flush()
                found.extend((now[0], now[1], moved(s, lambda name: f"{part}/{name}")) for s in out.shards)
                out.shards_before += len(out.shards)
                out.shards = []

        for batch in batches:
            for key, rows in self._runs(batch) if batch.num_rows else ():
                if key != now:
                    close()
                    out = self._writer(f"{self.folder}/{_folder_of(key[0])}{part}") if out is None or key[0] != now[0] else out
                    now = key
                out.write_rows(rows)
        close()
        return Written(part, json.dumps(found))


def _folder_of(stream: object) -> str:
    """A stream's folder below that of all, with a slash; none without streams."""
    return "" if stream is None else f"{quote(str(stream), safe='')}/"


def _entries(messages: list[Written | None]) -> dict[object, list[dict]]:
    """Entries by stream, in order of tasks, or of their numbers."""
    out: dict[object, list] = {}
    for m in messages:
        for stream, number, shard in json.loads(m.shards) if m else ():
            out.setdefault(stream, []).append((number, shard))
    return {k: [s for _, s in (sorted(v, key=lambda x: x[0]) if v[0][0] is not None else v)] for k, v in out.items()}


def _aborted(folder: str, messages: list[Written | None]) -> None:
    files, where = filesystem(folder)
    for m in messages:
        for stream in {_folder_of(s) for s, _, _ in json.loads(m.shards)} if m else ():
            if files.get_file_info(path := posixpath.join(where, f"{stream}{m.part}")).type.name == "Directory":
                files.delete_dir(path)


class ShardSink(DataSourceArrowWriter):
    """The index that is there is extended, or with overwrite replaced and its shards removed."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.task, self.folder, self.overwrite = ShardTask(options), options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return self.task.write(batches)

    def commit(self, messages: list[Written | None]) -> None:
        streams = _entries(messages)
        if not streams:
            raise ValueError("there are no rows to write")
        for stream, shards in streams.items():
            folder = f"{self.folder}/{_folder_of(stream)}".rstrip("/")
            delete_files(folder, commit(folder, shards, self.overwrite))

    def abort(self, messages: list[Written | None]) -> None:
        _aborted(self.folder, messages)


class ShardStreamSink(DataSourceStreamArrowWriter):
    """Each batch of a stream is one commit, named by the query and the batch's number: a batch that comes again replaces itself."""

    def __init__(self, options: dict) -> None:
        if not options.get("query"):
            raise ValueError("a stream needs the option query: a name that stays when it is started again")
        if options.get("stream") or options.get("number"):
            raise ValueError("a stream of rows is written to one folder, in shards by size")
        self.task, self.folder, self.query = ShardTask(options), options["path"], options["query"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return self.task.write(batches)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        delete_files(self.folder, commit(self.folder, _entries(messages).get(None, []), batch=f"{self.query}/{batchId}"))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        _aborted(self.folder, messages)


class ShardSource(DataSource):
    """Format "mds". Read: options path, validate, columns (names, JSON), samples (ranges, JSON), conditions (JSON), task_bytes, tasks. Write: path,
    columns (encodings, JSON), size_limit, compression, hashes, summaries (names, JSON), rows (mds, json, csv, tsv or xsv), separator, stream,
    number; as a stream also query."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        fields: dict[str, T.DataType] = {}
        for shard in read_index(self.options["path"]):
            for name, encoding in zip(shard["column_names"], shard["column_encodings"], strict=True):
                if encoding in UNSAFE:
                    raise ValueError(f"column {name} has the unsafe encoding {encoding}")
                fields.setdefault(name, type_of(encoding))
        if asked := self.options.get("columns"):
            fields = {n: fields[n] for n in json.loads(asked)}
        place = [T.StructField(n, T.LongType()) for n in ("sample_id", "shard_id") if n not in fields]
        return T.StructType([*place, *(T.StructField(n, t) for n, t in fields.items())])

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardSink:
        return ShardSink(self.options, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> ShardStreamSink:
        return ShardStreamSink(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, once: while it is made known anew, other threads wouldn't find it."""
    with _registering:
        if not getattr(spark, "_knows_shards", False):
            spark.dataSource.register(ShardSource)
            spark._knows_shards = True


def ranges(samples: int | range | list[int | range]) -> list[list[int]]:
    """Ids and ranges of step 1 as ranges in order and apart."""
    spans = []
    for x in samples if isinstance(samples, (list, tuple)) else [samples]:
        x = range(x, x + 1) if isinstance(x, int) else x
        if x.step != 1 or x.start < 0:
            raise IndexError("samples are read one by one or as ranges of step 1, from 0 on")
        spans += [(x.start, x.stop)] if len(x) else []
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def meets(conditions: list[Condition]) -> Column:
    """The conditions on rows."""
    out = F.lit(True)
    for name, op, value in conditions:
        c = F.col(name)
        out &= c.isin(list(value)) if op == "in" else {"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
    return out


def read_shards(spark: SparkSession, folder: str, validate: str | None = None, columns: list[str] | None = None, samples: int | range | list[int | range] | None = None, where: list[Condition] | None = None) -> DataFrame:
    """The rows of a folder with an index, with sample_id and shard_id.

    columns: only these are decoded. samples: only these, by number or range (of step 1), are read, each once, from the shards that have
    them. where: conditions (column, operator, value) that rows must meet all of; shards whose summaries rule them out aren't opened.
    """
    register(spark)
    reader = spark.read.format(FORMAT).option("tasks", spark.sparkContext.defaultParallelism)
    reader = reader.option("validate", validate) if validate else reader
    where = checked(where or [])
    if columns:
        reader = reader.option("columns", json.dumps([*columns, *sorted({c for c, _, _ in where} - {*columns})]))
    if samples is not None:
        reader = reader.option("samples", json.dumps(ranges(samples)))
    out = reader.option("conditions", json.dumps(where)).load(qualified(spark, folder))
    out = out.where(meets(where)) if where else out
    return out.select("sample_id", "shard_id", *[c for c in columns if c not in ("sample_id", "shard_id")]) if columns and where else out


def write_shards(df: DataFrame, folder: str, columns: dict[str, str] | None = None, mode: str = "append", summaries: list[str] | None = None, stream: str | None = None, number: str | None = None, order: list[str] | None = None, **options: str) -> str:
    """df as shards under a folder, which is returned in full. Which columns and how: columns, or what their types say.

    mode: "append" adds to the shards there, "overwrite" replaces them, "error" refuses a folder that has an index. Shards are
    compressed by zstd unless compression says otherwise ("" for none). A frame without rows is an error. summaries: columns (numbers or
    texts) of whose values the index has bounds and a Bloom filter. stream, number: columns that aren't stored unless
    columns names them. A folder below this one for each stream, all written by one job; a shard for each number of a stream, whatever
    size_limit says, with its rows in the order of the columns in `order`.
    """
    columns = columns or encodings_of(df.drop(*[c for c in (stream, number) if c]).schema)
    if not columns:
        raise ValueError("there are no columns to write")
    if bad := [c for c in summaries or [] if columns.get(c, "").partition(":")[0] not in SUMMED]:
        raise ValueError(f"no summaries of columns other than numbers and texts: {bad}")
    options = {"compression": "zstd"} | options | {"columns": json.dumps(columns), "summaries": json.dumps(summaries or [])}
    keys = {k: v for k, v in (("stream", stream), ("number", number)) if v}
    if not keys:
        return save_rows(df.select(*columns), folder, mode, options)
    rows = df.select(*[F.col(v).cast("string" if k == "stream" else "long").alias(f"_{k}") for k, v in keys.items()], *columns, *[F.col(c).alias(f"_{i}") for i, c in enumerate(order or [])])
    if number:
        rows = rows.repartition(*[f"_{k}" for k in keys])
    rows = rows.sortWithinPartitions(*[f"_{k}" for k in keys], *[f"_{i}" for i in range(len(order or []))]).select(*[f"_{k}" for k in keys], *columns)
    return save_rows(rows, folder, mode, options | {k: f"_{k}" for k in keys})


def stream_to_shards(df: DataFrame, folder: str, query: str, checkpoint: str, columns: dict[str, str] | None = None, **options: str):
    """A writeStream of df as shards under a folder, to be started: each batch's rows are in the index once, also if the batch comes again.

    query names the stream in the index, and must stay as long as the checkpoint does.
    """
    register(df.sparkSession)
    columns = columns or encodings_of(df.schema)
    options = {"compression": "zstd"} | options | {"columns": json.dumps(columns), "query": query, "path": qualified(df.sparkSession, folder), "checkpointLocation": checkpoint}
    return df.select(*columns).writeStream.format(FORMAT).outputMode("append").options(**options)


def save_rows(df: DataFrame, folder: str, mode: str, options: dict[str, str]) -> str:
    """df through the sink, with the options of ShardSource."""
    register(df.sparkSession)
    folder = qualified(df.sparkSession, folder)
    if mode not in ("append", "overwrite", "error"):
        raise ValueError(f"no mode {mode!r}")
    if mode == "error" and has_index(folder):
        raise FileExistsError(f"{folder} has an index")
    df.write.format(FORMAT).mode("overwrite" if mode == "overwrite" else "append").options(**options).save(folder)
    return folder
