"""Rows as lines: JSON and separated values in shards with an index, read whole with Spark's own readers, or by position from the bytes that hold them."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from epochweave.places import filesystem, qualified
from epochweave.sources.files import decompress
from epochweave.sources.index import read_index
from epochweave.sources.shards import BLOCK, FORMAT, ShardPartition, ShardReader, ranges, read_shards, save_rows

KINDS = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType()}
#: What Spark's readers of lines open by its ending.
READABLE = ("gz", "bz2")


def _columns(df: DataFrame, columns: dict[str, str] | None) -> dict[str, str]:
    by_type = {"string": "str", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float"}
    columns = columns or {n: by_type.get(t, t) for n, t in df.dtypes}
    if bad := [n for n, t in columns.items() if t not in KINDS]:
        raise ValueError(f"only str, int and float can be lines: {bad}")
    return columns


def _present(name: str, kind: str) -> Column:
    c = F.col(name).cast(KINDS[kind])
    return F.when(c.isNull(), F.raise_error(f"column {name} has a null, which lines can't hold").cast(KINDS[kind])).otherwise(c)


def _written(lines: Column, df: DataFrame, folder: str, columns: dict[str, str], mode: str = "append", **options: str) -> str:
    compression = options.get("compression", "")
    if compression and compression.partition(":")[0] not in READABLE:
        raise ValueError(f"lines can be compressed by {' or '.join(READABLE)}, not by {compression}")
    return save_rows(df.select(lines.alias("line")), folder, mode, {"compression": ""} | options | {"columns": json.dumps(columns)})


def write_json_lines(df: DataFrame, folder: str, columns: dict[str, str] | None = None, **options: str) -> str:
    """One JSON object a line, keys in order. options: as of write_shards()."""
    columns = _columns(df, columns)
    return _written(F.to_json(F.struct(*[_present(n, columns[n]).alias(n) for n in sorted(columns)])), df, folder, columns, rows="json", **options)


def write_separated(df: DataFrame, folder: str, separator: str = ",", columns: dict[str, str] | None = None, **options: str) -> str:
    """A line of names, in order, in each shard, then values as they are, unquoted; a separator or line end within a value or name is an error."""
    columns = _columns(df, columns)
    if bad := [n for n in columns if separator in n or "\n" in n]:
        raise ValueError(f"a name holds a separator: {bad}")

    def value(n: str) -> Column:
        c = _present(n, columns[n]).cast("string")
        return F.when(c.rlike("[\n\r]") | F.contains(c, F.lit(separator)), F.raise_error(f"column {n} holds a separator").cast("string")).otherwise(c) if columns[n] == "str" else c

    kind = {",": "csv", "\t": "tsv"}.get(separator, "xsv")
    return _written(F.concat_ws(separator, *[value(n) for n in sorted(columns)]), df, folder, columns, rows=kind, separator=separator, **options)


def lines_at(folder: str, shard: dict, low: int, high: int) -> list[str]:
    """Lines low to high of a shard. Of a shard that isn't compressed only the offsets and these lines' bytes are read."""
    files, where = filesystem(folder)
    n = shard["samples"]
    if not 0 <= low <= high <= n:
        raise IndexError(f"lines {low} to {high} of {n}")

    def part(kind: str, begin: int, size: int) -> bytes:
        if stored := shard.get(f"zip_{kind}"):
            with files.open_input_stream(posixpath.join(where, stored["basename"]), compression=None) as stream:
                return decompress(shard["compression"], stream.read())[begin : begin + size]
        with files.open_input_file(posixpath.join(where, shard[f"raw_{kind}"]["basename"])) as file:
            return file.read_at(size, begin)

    offsets = np.frombuffer(part("meta", 4 + 4 * low, 4 * (high - low + 1)), "<u4").astype(np.int64)
    data = part("data", int(offsets[0]), int(offsets[-1] - offsets[0])).decode()
    return data.removesuffix("\n").split("\n") if high > low else []


class LineReader(ShardReader):
    """Lines of the samples asked for, in blocks of BLOCK bytes."""

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        for number, first, shard, spans in json.loads(partition.parts):
            step = max(1, shard["samples"] * BLOCK // max(shard["raw_data"]["bytes"], 1))
            for low, high in spans:
                for at in range(low, high, step):
                    upto = min(at + step, high)
                    lines = lines_at(self.folder, shard, at, upto)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + upto)), pa.array(np.full(upto - at, number)), pa.array(lines, pa.string())], ["sample_id", "shard_id", "line"])


class LineSource(DataSource):
    """Format "shard_lines": options path, samples (ranges, JSON), task_bytes, tasks."""

    @classmethod
    def name(cls) -> str:
        return "shard_lines"

    def schema(self) -> str:
        return "sample_id long, shard_id long, line string"

    def reader(self, schema: T.StructType) -> LineReader:
        return LineReader(self.options, schema)


def _parsed(line: Column, kind: str, separator: str, names: dict[str, str]) -> list[Column]:
    if kind == "json":
        row = F.from_json(line, T.StructType([T.StructField(n, KINDS[t]) for n, t in names.items()]), {"mode": "FAILFAST"})
        return [row.getField(n).alias(n) for n in names]
    values = F.split(line, f"\\Q{separator}\\E", -1)
    return [F.get(values, i).cast(KINDS[t]).alias(n) for i, (n, t) in enumerate(names.items())]


def read_by_index(spark: SparkSession, folder: str, samples: int | range | list[int | range] | None = None) -> DataFrame:
    """A folder with an index of any known format: one of shards of encoded rows, or of JSON or separated lines.

    samples: only these, by number or range, from the bytes that hold them; then with sample_id.
    """
    folder = qualified(spark, folder)
    shards = read_index(folder)
    kinds = {s["format"] for s in shards}
    if len(kinds) != 1:
        raise ValueError(f"an index of one format is due, not {sorted(kinds)}")
    kind = kinds.pop()
    if kind == FORMAT:
        return read_shards(spark, folder, samples=samples)
    if kind not in ("json", "csv", "tsv", "xsv"):
        raise ValueError(f"no format {kind!r}")
    names = shards[0]["columns"] if kind == "json" else dict(zip(shards[0]["column_names"], shards[0]["column_encodings"], strict=True))
    separator = {"csv": ",", "tsv": "\t"}.get(kind) or shards[0].get("separator")
    if samples is not None:
        spark.dataSource.register(LineSource)
        rows = spark.read.format("shard_lines").option("tasks", spark.sparkContext.defaultParallelism).option("samples", json.dumps(ranges(samples))).load(folder)
        return rows.select("sample_id", *_parsed(F.col("line"), kind, separator, names))
    paths = [f"{folder}/{(s.get('zip_data') or s['raw_data'])['basename']}" for s in shards]
    schema = T.StructType([T.StructField(n, KINDS[t]) for n, t in names.items()])
    if kind == "json":
        return spark.read.schema(schema).json(paths)
    rows = spark.read.schema(schema).options(sep=separator, header=True, quote="", escape="").csv(paths)
    return rows.select(*[F.coalesce(n, F.lit("")).alias(n) if t == "str" else F.col(n) for n, t in names.items()])  # Spark reads an empty value as a null
