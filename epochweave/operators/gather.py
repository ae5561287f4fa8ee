"""The rows of a plan, taken from the shards that hold them.

A plan's rows (numbers only) are dealt to tasks by shard, behind the shard's entry in the index. A task opens each shard once and decodes
only the rows that are asked for, as often as they are, so that texts are never shuffled to find their place in a plan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochweave.operators.lookup import span_lookup
from epochweave.places import qualified, written
from epochweave.sources.codecs import UNSAFE
from epochweave.sources.columns import arrow_type, decode_rows
from epochweave.sources.index import read_index
from epochweave.sources.shards import BLOCK, FORMAT, TASK_BYTES, load_shard, type_of

ENTRIES = "stream_id long, place long, n long, before long, size long, folder string, entry string"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stream, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shards = read_index(folder)
            n = np.array([s["samples"] for s in shards], np.int64)
            size = [s["raw_data"]["bytes"] for s in shards]
            columns = [np.full(len(n), stream), np.arange(len(n)), n, np.cumsum(n) - n, size, [folder] * len(n), [json.dumps({k: v for k, v in s.items() if k != "values"}) for s in shards]]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["stream_id", "place", "n", "before", "size", "folder", "entry"])


def indexed_shards(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Columns stream_id, shard_id, n, first_sample, size, folder, entry: the shards of some folders, each a stream, in the order given.

    From the indexes alone, a task each; no shard is opened. Ids of shards and samples are dense: streams, then shards as the index has them.
    """
    rows = [(i, qualified(spark, f)) for i, f in enumerate(folders.values())]
    listed = written(spark.createDataFrame(rows, "stream_id long, folder string").repartition(max(1, len(rows)), "stream_id").mapInArrow(_listed, ENTRIES), "entries")
    begins, shards, samples = [], 0, 0
    for r in listed.groupBy("stream_id").agg(F.count("*").alias("shards"), F.sum("n").alias("n")).orderBy("stream_id").collect():  # a row for each stream
        begins.append((r.stream_id, shards, samples))
        shards, samples = shards + r.shards, samples + r.n
    begins = spark.createDataFrame(begins, "stream_id long, _shards long, _samples long")
    placed = listed.join(F.broadcast(begins), "stream_id")
    return placed.select("stream_id", (F.col("_shards") + F.col("place")).alias("shard_id"), "n", (F.col("_samples") + F.col("before")).alias("first_sample"), "size", "folder", "entry")


def kinds_of(shards: DataFrame, columns: list[str] | None) -> dict[str, T.DataType]:
    """The columns of the shards, each with the type it is read as."""
    found: dict[str, T.DataType] = {}
    layouts = shards.select(*[F.get_json_object("entry", f"$.{k}").alias(k) for k in ("format", "column_names", "column_encodings")]).distinct().collect()  # a row for each way to write a stream
    for r in sorted(layouts, key=str):
        if r.format != FORMAT:
            raise ValueError(f"rows of a plan are taken from shards of format {FORMAT}, not {r.format}")
        for name, encoding in zip(json.loads(r.column_names), json.loads(r.column_encodings), strict=True):
            if encoding in UNSAFE:
                raise ValueError(f"column {name} has the unsafe encoding {encoding}")
            if found.setdefault(name, type_of(encoding)) != type_of(encoding):
                raise ValueError(f"column {name} has several types: {found[name].simpleString()} and {type_of(encoding).simpleString()}")
    if missing := {*(columns or [])} - {*found}:
        raise ValueError(f"no shard has the columns {sorted(missing)}")
    return {n: found[n] for n in columns or found}


def rows_at(shard: dict, data: bytes, kinds: dict[str, T.DataType], places: np.ndarray) -> list[pa.Array]:
    """Columns of a shard's rows at some places, in that order; null where the shard lacks a column."""
    if len(places) and not 0 <= places.min() <= places.max() < shard["samples"]:
        raise IndexError(f"rows {places.min()} to {places.max()} of {shard['samples']}")
    starts = np.frombuffer(data, "<u4", shard["samples"] + 1, 4).astype(np.int64)[places]
    encodings = dict(zip(shard["column_names"], shard["column_encodings"], strict=True))
    found = decode_rows(np.frombuffer(data, np.uint8), starts, encodings, {n: t for n, t in kinds.items() if n in encodings})
    return [found[n] if n in found else pa.nulls(len(places), arrow_type(t)) for n, t in kinds.items()]


def _taken(names: list[str], kinds: dict[str, T.DataType], validate: str | None):
    """Rows _shard, _place, _folder, _entry and a plan's columns, sorted by the first two: the plan's columns and those of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, data = None, None
        for batch in batches:
            ids, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (place[:-1] < 0)])[: len(ids)])
            for a, b in zip(cuts, np.append(cuts, len(ids))[1:], strict=True):
                if place[a] < 0:
                    entry, data = (batch.column(2)[a].as_py(), json.loads(batch.column(3)[a].as_py())), None
                    continue
                if data is None:
                    data = load_shard(*entry, validate)
                step = max(1, entry[1]["samples"] * BLOCK // max(len(data), 1))
                for at in range(a, b, step):
                    part = batch.slice(at, min(step, b - at))
                    yield pa.RecordBatch.from_arrays([*part.columns[4:], *rows_at(entry[1], data, kinds, part.column(1).to_numpy())], [*names, *kinds])

    return run


def gathered(plan: DataFrame, shards: DataFrame, columns: list[str] | None = None, validate: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """plan (sample_id and other columns) with the columns of its samples' rows; samples below 0 (padding) and beyond the last are left out.

    shards: as of indexed_shards(). columns: only these are decoded. A sample that a plan has several times is returned as often. Plan
    and rows must have no column in common. Tasks get about task_bytes of shards each.
    """
    kinds = kinds_of(shards, columns)
    if both := {*plan.columns} & {*kinds}:
        raise ValueError(f"both the plan and the rows have the columns {sorted(both)}")
    total = shards.agg(F.count("*").alias("shards"), F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    if not total.shards:
        raise ValueError("there are no shards")
    spans = shards.select(F.col("shard_id").alias("_shard"), F.col("n").alias("_n"), F.col("first_sample").alias("_begin"))
    located = span_lookup(plan, spans, max(1, total.n // total.shards), n="_n", begin="_begin")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in plan.schema.fields]
    heads = shards.select(F.col("shard_id").alias("_shard"), F.lit(-1).cast("long").alias("_place"), F.col("folder").alias("_folder"), F.col("entry").alias("_entry"), *empty)
    rows = heads.unionByName(located.select("_shard", F.col("offset_in_shard").cast("long").alias("_place"), F.lit(None).cast("string").alias("_folder"), F.lit(None).cast("string").alias("_entry"), *plan.columns))
    tasks = max(-(-total.size // task_bytes), min(total.shards, plan.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartition(tasks, "_shard").sortWithinPartitions("_shard", "_place")
    return dealt.mapInArrow(_taken(plan.columns, kinds, validate), T.StructType([*plan.schema.fields, *(T.StructField(n, t) for n, t in kinds.items())]))
