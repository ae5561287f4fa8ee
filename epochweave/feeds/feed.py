"""Feeds: an epoch's rows in order, shards as an unbounded stream, and files taken in once each."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from epochweave.places import qualified
from epochweave.plans.epoch import Planner, Resume
from epochweave.sources.index import read_index
from epochweave.sources.shards import load_shard, shard_columns, type_of


class EpochReader:
    """The rows of a plan, epoch after epoch, in the order of traversal: what a training loop on one device reads.

    Spark fetches the next part of the rows while one is read. state() says how to go on after what has been read, in whole global
    batches of all devices; the epoch's number moves on when an epoch begins, so a state taken between two is of the one that is over.
    """

    def __init__(self, planner: Planner, source: DataFrame, row_key: str, node: int = 0, rank: int = 0, resume: Resume | None = None) -> None:
        self.planner, self.source, self.row_key, self.node, self.rank, self.resume = planner, source, row_key, node, rank, resume
        self.next_epoch, self.read, self.going_on = 0, 0, None

    def __iter__(self) -> Iterator[Row]:
        self.going_on = self.resume if self.resume and self.resume.epoch >= self.next_epoch else None
        epoch = self.going_on.epoch if self.going_on else self.next_epoch
        self.next_epoch, self.read, self.resume = epoch + 1, 0, None
        rows = self.planner.rows(epoch, self.source, self.row_key, self.going_on).where((F.col("node") == self.node) & (F.col("rank") == self.rank))
        for row in rows.orderBy("order").toLocalIterator(prefetchPartitions=True):
            self.read += 1
            yield row

    def state(self) -> Resume:
        """Every device has read as much as this one."""
        before = self.going_on.sample_in_epoch if self.going_on else 0
        return self.planner.state(max(self.next_epoch - 1, 0), before + self.read * self.planner.world.ranks, self.going_on)


@dataclass
class Part(InputPartition):
    epoch: int
    shard: str
    first: int
    low: int
    high: int


class EpochFeedReader(DataSourceStreamReader):
    """Rows of epoch after epoch in the order of their shards, a partition for each shard and epoch.

    The offset is {epoch, sample_in_epoch}. What is there to be read ends with the last of the epochs asked for: a query that is started
    again goes on from its checkpoint, with nothing or with the epochs that are asked for beyond those.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.epochs = options["path"], int(options.get("epochs", "1"))
        self.shards = read_index(self.folder)
        self.total = sum(s["samples"] for s in self.shards)

    def initialOffset(self) -> dict:
        return {"epoch": 0, "sample_in_epoch": 0}

    def latestOffset(self) -> dict:
        return {"epoch": self.epochs, "sample_in_epoch": 0}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for epoch in range(start["epoch"], end["epoch"] + 1):
            low = start["sample_in_epoch"] if epoch == start["epoch"] else 0
            high = end["sample_in_epoch"] if epoch == end["epoch"] else self.total
            first = 0
            for shard in self.shards:
                a, b = max(low, first), min(high, first + shard["samples"])
                if a < b:
                    out.append(Part(epoch, json.dumps(shard), first, a - first, b - first))
                first += shard["samples"]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        shard = json.loads(part.shard)
        kinds = {n: type_of(e) for n, e in zip(shard["column_names"], shard["column_encodings"], strict=True)}
        rows = pa.table(shard_columns(shard, load_shard(self.folder, shard), kinds, part.low, part.high)).to_pylist()
        ids = np.arange(part.first + part.low, part.first + part.high)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part.epoch)), pa.array(ids), pa.array([json.dumps(r, default=_text, sort_keys=True) for r in rows], pa.string())], ["epoch", "sample_id", "row"])


def _text(value) -> str:
    return value.hex() if isinstance(value, bytes) else str(value)


class EpochFeed(DataSource):
    """Format "epoch_feed": options path, epochs. Rows are JSON objects; bytes are hex digits."""

    @classmethod
    def name(cls) -> str:
        return "epoch_feed"

    def schema(self) -> str:
        return "epoch long, sample_id long, row string"

    def streamReader(self, schema: T.StructType) -> EpochFeedReader:
        return EpochFeedReader(self.options)


def epoch_feed(spark: SparkSession, folder: str, epochs: int = 1) -> DataFrame:
    spark.dataSource.register(EpochFeed)
    return spark.readStream.format("epoch_feed").option("epochs", epochs).load(qualified(spark, folder))


def ingest(spark: SparkSession, source: str, schema: T.StructType | str, checkpoint: str, sink: Callable[[DataFrame, int], None], kind: str = "parquet"):
    """Every file of a folder that hasn't been taken in yet, once: sink(rows, batch number). Returns the finished query."""
    stream = spark.readStream.schema(schema).format(kind).load(source)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
