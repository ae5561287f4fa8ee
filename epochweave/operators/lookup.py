"""Lookups: which shard a sample is in, rows by position, ids for names."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochweave.places import filesystem, qualified, written

SPAN = 1024
#: Files that a task fetches at once, and bytes of contents that it holds.
FETCHES, FETCHED = 8, 16 << 20


def shard_offsets(shards: DataFrame) -> DataFrame:
    """shards (stream_id, shard_id, n) with begin: the samples before each. Summed by blocks of shard ids, then within them."""
    shards = shards.withColumn("_block", F.floor(F.col("shard_id") / 4096))
    sums = shards.groupBy("_block").agg(F.sum("n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(Window.partitionBy("_block").orderBy("shard_id")) - F.col("n")
    return shards.join(sums.withColumn("_first", before).drop("_s"), "_block").withColumn("begin", F.col("_first") + inside).select("stream_id", "shard_id", "n", "begin")


def span_lookup(ids: DataFrame, shards: DataFrame, span: int = SPAN, n: str = "n", begin: str = "begin") -> DataFrame:
    """ids (sample_id, ...) with offset_in_shard and what shards have besides n, begin and stream_id. Ids outside all shards find none.

    A range join made an equal join: a shard is listed under each span of ids that it reaches into, so only shards of an id's own span
    are compared with it.
    """
    listed = shards.where(F.col(n) > 0).withColumn("_span", F.explode(F.sequence(F.floor(F.col(begin) / span), F.floor((F.col(begin) + F.col(n) - 1) / span))))
    found = ids.withColumn("_span", F.floor(F.col("sample_id") / span)).join(listed.drop("stream_id"), "_span").where((F.col("sample_id") >= F.col(begin)) & (F.col("sample_id") < F.col(begin) + F.col(n)))
    return found.withColumn("offset_in_shard", F.col("sample_id") - F.col(begin)).drop("_span", begin, n)


def _wrap(i: int, n: int) -> int:
    if not -n <= i < n:
        raise IndexError(f"{i} is outside of {n} rows")
    return i + n if i < 0 else i


def take_rows(rows: DataFrame, position: str, ids: list[int], n: int) -> DataFrame:
    """The rows at positions, in the order asked for (column pos), repeated as asked; negative ones count from the end."""
    asked = rows.sparkSession.createDataFrame([(i, _wrap(x, n)) for i, x in enumerate(ids)], f"pos long, {position} long")
    return rows.join(asked, position)


def take_nested(rows: DataFrame, position: str, ids: list | range | int, n: int) -> DataFrame:
    """The rows at positions in lists within lists, of any depth: column pos (array) is where in the lists each was asked for. Negative ones count from the end."""

    def flat(x: list | range | int, at: tuple[int, ...]) -> Iterator[tuple[list[int], int]]:
        if isinstance(x, int):
            yield list(at), _wrap(x, n)
        else:
            for i, y in enumerate(x):
                yield from flat(y, (*at, i))

    asked = rows.sparkSession.createDataFrame(list(flat(ids, ())), f"pos array<long>, {position} long")
    return rows.join(asked, position)


def nested(found: list[tuple[list[int], object]], like: list | range | int) -> object:
    """What take_nested() found, as (pos, value), in lists as they were asked for."""
    by = {tuple(p): v for p, v in found}
    build = lambda x, at: by[at] if isinstance(x, int) else [build(y, (*at, i)) for i, y in enumerate(x)]
    return build(like, ())


def slice_rows(rows: DataFrame, position: str, of: slice, n: int) -> DataFrame:
    """The rows of a slice, with their order in it (column pos): a filter, without a join."""
    start, stop, step = of.indices(n)
    p = F.col(position)
    inside = (p >= start) & (p < stop) if step > 0 else (p <= start) & (p > stop)
    return rows.where(inside & (F.pmod(p - start, F.lit(abs(step))) == 0)).withColumn("pos", F.floor((p - start) / step))


def class_ids(rows: DataFrame, name: str) -> DataFrame:
    """Each distinct name with class_id, its rank from 0. Names are classes, few enough for one sort."""
    return rows.select(name).distinct().withColumn("class_id", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(name)) - 1)


def first_rows(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order."""
    return rows.orderBy(*order).limit(n)


def write_contents(rows: DataFrame, path: str, content: str, folder: str) -> int:
    """A file below the folder for each row, by the tasks that have the rows; how many. A repeated task writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = posixpath.join(where, name)
                files.create_dir(posixpath.dirname(at), recursive=True)
                with files.open_output_stream(at, compression=None) as out:
                    out.write(data.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    folder = qualified(rows.sparkSession, folder)
    return rows.select(path, content).mapInArrow(run, "path string").count()


def pack_contents(rows: DataFrame, path: str, content: str, folder: str) -> DataFrame:
    """Contents packed into a file for each task; columns path, packed_in, packed_at, n_bytes say where each is. For small contents, of which a file each would be too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(folder)
        files.create_dir(where, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.pack", 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = out or files.open_output_stream(posixpath.join(where, name), compression=None)
                sizes = []
                for data in batch.column(1):
                    data = data.as_buffer() if data.is_valid else b""
                    out.write(data)
                    sizes.append(len(data))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(sizes)), pa.array(at + ends - sizes, pa.int64()), pa.array(sizes, pa.int64())], ["path", "packed_in", "packed_at", "n_bytes"])
                at += int(ends[-1])
        finally:
            if out is not None:
                out.close()

    folder = qualified(rows.sparkSession, folder)
    # written at once: a task that ran again later would name another file
    return written(rows.select(path, content).mapInArrow(run, "path string, packed_in string, packed_at long, n_bytes long"), "packed")


def _opened(folder: str, column: int, keep: int, packed: bool):
    """Each row with its content: the file at its path, or a part of one. A few files are fetched at once, and about FETCHED bytes held."""

    def one(name: str | None, at: int | None, size: int | None) -> bytes | None:
        if name is None:
            return None
        files, where = filesystem(folder)
        try:
            if not packed:
                with files.open_input_stream(posixpath.join(where, name), compression=None) as stream:
                    return stream.read()
            with files.open_input_file(posixpath.join(where, name)) as file:
                return file.read_at(size, at)
        except FileNotFoundError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(FETCHES) as pool:
            for batch in batches:
                asked = list(zip(*[batch.column(column + i).to_pylist() for i in range(3 if packed else 1)], *([] if packed else [[None] * batch.num_rows] * 2), strict=True))
                begin, held, size = 0, [], 0
                for first in range(0, len(asked), FETCHES):
                    held += pool.map(lambda x: one(*x), asked[first : first + FETCHES])
                    size += sum(len(x or b"") for x in held[-FETCHES:])
                    if size >= FETCHED or first + FETCHES >= len(asked):
                        yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns[:keep], pa.array(held, pa.large_binary()).cast(pa.binary())], [*batch.schema.names[:keep], "content"])
                        begin, held, size = begin + len(held), [], 0

    return run


def external_content(rows: DataFrame, path: str, folder: str, places: DataFrame | None = None) -> DataFrame:
    """rows with content (bytes): what lies below the folder at the path that a row names; null where nothing does.

    Each row's file is opened by the task that has the row: the folder isn't listed, and contents aren't shuffled. places, as of
    pack_contents(): the paths are looked up in these, and rows dealt out so that a task reads on in the files that it opens.
    """
    folder = qualified(rows.sparkSession, folder)
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    if places is None:
        return rows.select("*", F.col(path).alias("_at")).mapInArrow(_opened(folder, len(rows.columns), len(rows.columns), False), schema)
    found = rows.join(places.select(F.col("path").alias("_at"), "packed_in", "packed_at", "n_bytes"), F.col(path) == F.col("_at"), "left").drop("_at")
    found = found.select(*rows.columns, "packed_in", "packed_at", "n_bytes").sortWithinPartitions("packed_in", "packed_at")
    return found.mapInArrow(_opened(folder, len(rows.columns), len(rows.columns), True), schema)
