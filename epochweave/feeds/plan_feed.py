"""An epoch's plan as a stream of rows in the order of the plan, for all devices at once.

The plan is written once, numbers only, in chunks of its order, with the shard and place of each sample. The stream has a partition for
each worker of each device; it reads its own part of the plan and takes the rows from the shards, so that none pass the driver. The
offset is {epoch, sample_in_epoch}, which a checkpoint keeps. At most max_samples are admitted to a batch: how far batches have been
planned is kept beside the plan, under the query's name, since a source isn't told where a query that is started again stands.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from epochweave.operators.gather import kinds_of, rows_at
from epochweave.operators.lookup import span_lookup
from epochweave.places import filesystem, qualified
from epochweave.plans.epoch import Planner, Resume
from epochweave.sources.shards import load_shard

PLACE = ["order", "node", "rank", "worker", "batch", "slot", "stream_id", "sample_id"]
#: Places of a plan in a file.
CHUNK = 1 << 16


def _put(folder: str, name: str, value: object) -> None:
    files, where = filesystem(folder)
    files.create_dir(where, recursive=True)
    fresh, path = posixpath.join(where, f".{name}.new"), posixpath.join(where, name)
    with files.open_output_stream(fresh, compression=None) as out:
        out.write(json.dumps(value, sort_keys=True).encode())
    if files.type_name != "local" and files.get_file_info(path).is_file:
        files.delete_file(path)
    files.move(fresh, path)


def _got(folder: str, name: str) -> object | None:
    files, where = filesystem(folder)
    path = posixpath.join(where, name)
    if not files.get_file_info(path).is_file:
        return None
    with files.open_input_stream(path, compression=None) as stream:
        return json.loads(stream.read())


def write_plan(planner: Planner, folder: str, epochs: list[int], columns: list[str] | None = None, resume: Resume | None = None, chunk: int = CHUNK) -> str:
    """The plans of some epochs of a planner made by Planner.of_folders(), with where their rows are; the folder in full. columns: what is to be read of rows."""
    spark, shards, world = planner.shards.sparkSession, planner.shards, planner.world
    folder, sizes = qualified(spark, folder), []
    kinds = kinds_of(shards, columns)
    if both := {*PLACE, "epoch"} & {*kinds}:
        raise ValueError(f"both the plan and the rows have the columns {sorted(both)}")
    total = shards.agg(F.count("*").alias("shards"), F.sum("n").alias("n")).first()
    spans = shards.select("shard_id", F.col("n").alias("_n"), F.col("first_sample").alias("_begin"))
    for i, epoch in enumerate(epochs):
        plan = planner.epoch(epoch, resume).select(*PLACE)
        own = span_lookup(plan.where("sample_id >= 0"), spans, max(1, total.n // max(total.shards, 1)), n="_n", begin="_begin")
        path = f"{folder}/plan/epoch={i}"
        own.withColumn("chunk", F.floor(F.col("order") / chunk)).repartition("chunk").sortWithinPartitions("chunk", "order").write.partitionBy("chunk").parquet(path)
        sizes.append(plan.agg(F.coalesce(F.max("order") + 1, F.lit(0))).first()[0])
    shards.select("shard_id", "folder", "entry").repartitionByRange("shard_id").sortWithinPartitions("shard_id").write.parquet(f"{folder}/entries")
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    _put(folder, "head.json", {"epochs": epochs, "sizes": sizes, "chunk": chunk, "devices": [world.nodes, world.ranks_per_node, world.workers_per_rank], "schema": schema.json()})
    return folder


@dataclass
class PlanPart(InputPartition):
    epoch: int
    low: int
    high: int
    node: int
    rank: int
    worker: int


class PlanFeedReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.query, self.validate = options["path"], options.get("query"), options.get("validate")
        self.head = _got(self.folder, "head.json")
        self.kinds = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(self.head["schema"])).fields}
        self.begins = np.concatenate([[0], np.cumsum(self.head["sizes"])]).tolist()
        self.most = int(options.get("max_samples", "0")) or self.begins[-1]
        self.planned = (_got(f"{self.folder}/progress", self.query) if self.query else None) or 0

    def _offset(self, at: int) -> dict:
        """Places are counted over all epochs."""
        epoch = min(int(np.searchsorted(self.begins, at, "right")) - 1, len(self.head["sizes"]))
        return {"epoch": epoch, "sample_in_epoch": at - self.begins[epoch]}

    def _at(self, offset: dict) -> int:
        return self.begins[offset["epoch"]] + offset["sample_in_epoch"]

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        """max_samples beyond what has been planned: there a query stands that is started again, once a batch that was under way has been."""
        return self._offset(min(self.planned + self.most, self.begins[-1]))

    def partitions(self, start: dict, end: dict) -> list[PlanPart]:
        low, high = self._at(start), self._at(end)
        if high > self.planned:
            self.planned = high
            if self.query:
                _put(f"{self.folder}/progress", self.query, high)
        nodes, ranks, workers = self.head["devices"]
        out = []
        for epoch, (a, b) in enumerate(zip(self.begins[:-1], self.begins[1:], strict=True)):
            if max(a, low) < min(b, high):
                out += [PlanPart(epoch, max(a, low) - a, min(b, high) - a, n, r, w) for n in range(nodes) for r in range(ranks) for w in range(workers)]
        return out

    def read(self, part: PlanPart) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(self.folder)
        entries = ds.dataset(posixpath.join(where, "entries"), filesystem=files, format="parquet")
        mine = (ds.field("order") >= part.low) & (ds.field("order") < part.high) & (ds.field("node") == part.node) & (ds.field("rank") == part.rank) & (ds.field("worker") == part.worker)
        plans = []
        for chunk in range(part.low // self.head["chunk"], (part.high - 1) // self.head["chunk"] + 1):
            path = posixpath.join(where, f"plan/epoch={part.epoch}", f"chunk={chunk}")
            if files.get_file_info(path).type.name != "Directory":
                continue  # nothing but padding
            plans.append(ds.dataset(path, filesystem=files, format="parquet"))
        if not plans:
            return
        # one look at the entries for all chunks: there are as many of them as shards, so one for each chunk would grow with the square of the rows
        asked = pc.unique(pa.concat_tables([p.to_table(columns=["shard_id"], filter=mine) for p in plans]).column("shard_id"))
        known = {r["shard_id"]: r for r in entries.to_table(filter=ds.field("shard_id").isin(asked)).to_pylist()} if len(asked) else {}
        for plan in plans:
            plan = plan.to_table(filter=mine).sort_by("order")
            shard, place = plan.column("shard_id").to_numpy(), plan.column("offset_in_shard").to_numpy()
            order, pieces = np.argsort(shard, kind="stable"), []
            ids, begins = np.unique(shard[order], return_index=True)
            for i, a, b in zip(ids.tolist(), begins, np.append(begins, len(order))[1:], strict=True):
                entry = json.loads(known[i]["entry"])
                pieces.append(rows_at(entry, load_shard(known[i]["folder"], entry, self.validate), self.kinds, place[order[a:b]]))
            if pieces:
                back = pa.array(np.argsort(order, kind="stable"))
                columns = [pa.concat_arrays(list(c)).take(back) for c in zip(*pieces, strict=True)]
                numbers = [plan.column(n).combine_chunks().cast(pa.int64()) for n in PLACE]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(plan.num_rows, self.head["epochs"][part.epoch])), *numbers, *columns], ["epoch", *PLACE, *self.kinds])


class PlanFeed(DataSource):
    """Format "plan_feed": options path (of write_plan()), max_samples and query (a name that stays when the query is started again), validate."""

    @classmethod
    def name(cls) -> str:
        return "plan_feed"

    def schema(self) -> T.StructType:
        rows = T.StructType.fromJson(json.loads(_got(self.options["path"], "head.json")["schema"]))
        return T.StructType([T.StructField(n, T.LongType()) for n in ("epoch", *PLACE)] + rows.fields)

    def streamReader(self, schema: T.StructType) -> PlanFeedReader:
        if self.options.get("max_samples") and not self.options.get("query"):
            raise ValueError("max_samples needs the option query: a name that stays when the query is started again")
        return PlanFeedReader(self.options)


def plan_feed(spark: SparkSession, folder: str, max_samples: int | None = None, query: str | None = None, validate: str | None = None) -> DataFrame:
    """The rows of a written plan as a stream, in its order within each worker of each device; padding is left out."""
    spark.dataSource.register(PlanFeed)
    reader = spark.readStream.format("plan_feed")
    for name, value in (("max_samples", max_samples), ("query", query), ("validate", validate)):
        reader = reader.option(name, value) if value else reader
    return reader.load(qualified(spark, folder))
