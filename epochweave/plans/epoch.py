"""An epoch from end to end: streams, shards, weights, drawing, dealing, shuffling, batching, and going on after a stop."""

from __future__ import annotations

import json
from copy import copy
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochweave.places import written
from epochweave.plans.batching import PLAN, block_sizes, device_per_stream, ordered, per_stream, stratified, stream_orders
from epochweave.plans.keys import numbered
from epochweave.plans.partition import initial_grid, relaxed_cells
from epochweave.plans.sampling import draw_per_shard, resample, shards_of, shuffle_units, whole_shards
from epochweave.plans.weights import Weight, choices
from epochweave.plans.world import World


@dataclass(frozen=True)
class Resume:
    """What is needed to go on with an epoch on the same or another world."""

    epoch: int = 0
    sample_in_epoch: int = 0
    num_canonical_nodes: int = 1
    shuffle_seed: int = 0
    initial_physical_nodes: int | None = None

    def dump(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def load(text: str) -> Resume:
        return Resume(**json.loads(text))


def _block(canonical: int) -> int:
    return max(4_000_000 // canonical, 1 << 18)


def samples_of(rows: DataFrame, stream: str, row_key: str, shard_rows: int) -> DataFrame:
    """Columns stream_id, shard_id, place, sample_id, row_key: rows of each stream in order of their key, in shards of shard_rows.

    Ids are dense: streams in order of name, then shards, then rows. They come from the order of stream and key, of any type, never from
    how rows happen to be dealt.
    """
    kept = numbered(rows.select(F.col(stream).alias("_name"), F.col(row_key).alias("row_key")), ["_name", "row_key"], "sample_id")
    names, shards = [], 0
    for i, r in enumerate(kept.groupBy("_name").agg(F.count("*").alias("n"), F.min("sample_id").alias("first")).orderBy("first").collect()):  # a row for each stream of a mixture
        names.append((r._name, i, r["first"], shards))
        shards += -(-r.n // shard_rows)
    names = rows.sparkSession.createDataFrame(names, T.StructType([T.StructField("_of", kept.schema["_name"].dataType), *(T.StructField(n, T.LongType()) for n in ("stream_id", "_first", "_shards"))]))
    placed = kept.join(F.broadcast(names), F.col("_name").eqNullSafe(F.col("_of")))
    pos = F.col("sample_id") - F.col("_first")
    return placed.select("stream_id", (F.col("_shards") + F.floor(pos / shard_rows)).cast("long").alias("shard_id"), (pos % shard_rows).cast("long").alias("place"), F.col("sample_id").cast("long").alias("sample_id"), "row_key")


@dataclass
class Planner:
    """samples: as of samples_of(), or none, and shards: as of indexed_shards(). weights: for each stream in order, or none. block_size: how far shuffling moves a row."""

    samples: DataFrame | None
    weights: list[Weight] | None = None
    epoch_size: int | None = None
    world: World = field(default_factory=World)
    batch_size: int = 1
    canonical: int | None = None
    shuffle: str | None = "py1e"
    seed: int = 0
    granularity: int = 1
    block_size: int | None = None
    sampling: str = "balanced"
    batching: str = "random"
    partition: str = "relaxed"
    shards: DataFrame | None = None

    @staticmethod
    def of_folders(spark: SparkSession, folders: dict[str, str], **more) -> Planner:
        """Of folders of shards, each a stream, from their indexes alone: no row is read before gathered() takes it."""
        from epochweave.operators.gather import indexed_shards

        return Planner(None, shards=indexed_shards(spark, folders), **more)

    def __post_init__(self) -> None:
        if self.batching not in ("random", "stratified", "per_stream", "device_per_stream"):
            raise ValueError(f"no batching method {self.batching!r}")
        if self.sampling not in ("balanced", "fixed"):
            raise ValueError(f"no sampling method {self.sampling!r}")
        if self.canonical is None:
            self.canonical = (64 if self.shuffle in ("py1s", "py2s") else 1) * self.world.nodes
        self.given_block = self.block_size is not None
        if self.block_size is None:
            self.block_size = _block(self.canonical)
        if self.shards is None:
            self.shards = written(shards_of(self.samples), "shards")  # a row for each shard, which every plan begins with
        sizes = self.shards.groupBy("stream_id").agg(F.sum("n").alias("n")).orderBy("stream_id").collect()  # a row for each stream
        self.sizes = [r.n for r in sizes]
        self.choose = choices(self.sizes, self.weights or [Weight()] * len(self.sizes), self.epoch_size, self.seed)
        self.n = sum(self.choose)
        self.partial = any(c % n for c, n in zip(self.choose, self.sizes, strict=True) if n)

    def units(self, epoch: int) -> DataFrame:
        """What is drawn, as whole shards and remainders of shards: see shuffle_units()."""
        own = 0 if self.sampling == "fixed" else epoch
        choose = F.element_at(F.array(*[F.lit(c).cast("long") for c in self.choose]), (F.col("stream_id") + 1).cast("int"))
        shards = self.shards.select("stream_id", "shard_id", "n", "first_sample")
        chosen = draw_per_shard(shards, choose, self.granularity, self.seed, own) if self.partial else whole_shards(shards, choose)
        return shuffle_units(chosen)

    def drawn(self, epoch: int) -> DataFrame:
        """Columns big_id, unit_begin, sample_id, stream_id, shard_id."""
        return resample(self.units(epoch), self.seed, 0 if self.sampling == "fixed" else epoch)

    def grid(self, drop: int = 0, **more: int) -> dict:
        return {"n": self.n, "canonical": self.canonical, "nodes": self.world.nodes, "ranks": self.world.ranks_per_node, "workers": self.world.workers_per_rank, "batch_size": self.batch_size, "drop": drop} | more

    def _at(self, resume: Resume) -> Planner:
        """This planner as it was when the state was kept: canonical nodes and seed are the run's, whatever world it goes on in."""
        if (resume.num_canonical_nodes, resume.shuffle_seed) == (self.canonical, self.seed):
            return self
        out = copy(self)
        out.canonical, out.seed = resume.num_canonical_nodes, resume.shuffle_seed
        out.block_size = self.block_size if self.given_block else _block(out.canonical)
        out.choose = choices(out.sizes, out.weights or [Weight()] * len(out.sizes), out.epoch_size, out.seed)
        out.partial = any(c % n for c, n in zip(out.choose, out.sizes, strict=True) if n)
        return out

    def state(self, epoch: int, sample_in_epoch: int, resume: Resume | None = None) -> Resume:
        """What to keep of a run that has read so many samples of an epoch: the nodes it began with stay those of the first run."""
        going_on = resume if resume and resume.epoch >= epoch else None
        first = going_on.initial_physical_nodes if going_on else None
        return Resume(epoch, sample_in_epoch, going_on.num_canonical_nodes if going_on else self.canonical, going_on.shuffle_seed if going_on else self.seed, self.world.nodes if first is None else first)

    def epoch(self, epoch: int = 0, resume: Resume | None = None) -> DataFrame:
        """The plan of an epoch: columns order, node, rank, worker, batch, slot, stream_id, sample_id (-1: padding).

        resume goes on after its samples: in its epoch, with its canonical nodes, seed and initial nodes. Of an epoch that is over it says nothing.
        Methods other than random go on with the global batch that isn't whole yet.
        """
        seen, initial = 0, None
        if resume and resume.epoch >= epoch:
            epoch, seen, initial = resume.epoch, resume.sample_in_epoch, resume.initial_physical_nodes
            self = self._at(resume)  # noqa: PLW0642
        initial = initial if self.partition == "relaxed" else None
        units, spark, own = self.units(epoch), self.shards.sparkSession, 0 if self.sampling == "fixed" else epoch
        if self.batching == "random":
            if self.shuffle and not 1 <= self.canonical <= self.n:
                raise ValueError("each canonical node must have a row")
            cells = relaxed_cells(spark, self.grid(seen), initial)
            units = units.select(F.lit(0).alias("g"), F.lit(self.n).cast("long").alias("n"), "unit_begin", "size", "stream_id", "shard_id", "base", "first_sample", F.col("n").alias("width"))
            samples = ordered(units, self.canonical, self.shuffle, self.seed, epoch, F.lit(self.block_size), self.partial, own).drop("g")
            return cells.join(samples, "pos", "left").withColumn("sample_id", F.coalesce("sample_id", F.lit(-1).cast("long"))).select(*PLAN)
        blocks = block_sizes(self.block_size, self.choose)
        streams = [{"stream_id": i, "n": c, "first": sum(self.choose[:i]), "block": b} for i, (c, b) in enumerate(zip(self.choose, blocks, strict=True)) if c]
        world, batch, seen = self.world, self.batch_size, seen // (self.world.ranks * self.batch_size)
        grid = self.grid(**{"stratified": {"nodes": 1, "batch_size": 1}, "per_stream": {}, "device_per_stream": {"nodes": self.canonical, "batch_size": 1}}[self.batching])
        if self.batching == "device_per_stream":
            if self.canonical % world.nodes:
                raise ValueError("canonical nodes must be a multiple of nodes where each device batch is one stream's")
            if self.shuffle and min(s["block"] for s in streams) < 1:
                raise ValueError("a stream's part of the shuffle's block is no row; a larger block or share is needed")
        orders = stream_orders(spark, units, streams, grid, initial, self.shuffle, self.seed, epoch, self.partial, own)
        grid = initial_grid(grid, initial)
        if self.batching == "stratified":
            return stratified(orders, streams, grid, world, batch, seen)
        method = per_stream if self.batching == "per_stream" else device_per_stream
        return method(orders, streams, grid, world, batch, seen, self.seed, epoch)

    def rows(self, epoch: int, source: DataFrame, row_key: str, resume: Resume | None = None) -> DataFrame:
        """The plan with the rows of the source; padding is left out."""
        plan = self.epoch(epoch, resume).where("sample_id >= 0").join(self.samples.select("sample_id", "row_key"), "sample_id")
        return plan.join(source, plan["row_key"] == source[row_key]).drop("row_key")

    def gathered(self, epoch: int, columns: list[str] | None = None, resume: Resume | None = None, validate: str | None = None) -> DataFrame:
        """The plan with the rows of its shards, of a planner made by of_folders(); padding is left out. Only rows of the plan are shuffled, not those of shards."""
        from epochweave.operators.gather import gathered

        return gathered(self.epoch(epoch, resume).where("sample_id >= 0"), self.shards, columns, validate)
