"""Batches of four compositions, as rows of the grid (order, node, rank, worker, batch, slot) with the sample that stands there.

How many whole batches a stream has follows from its size alone, so what is dropped and padded is known before any row is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.plans.keys import key, ranked
from epochweave.plans.partition import CELLS, SCALARS, Grid, coordinates, grouped_cells, initial_grid
from epochweave.plans.sampling import remainders
from epochweave.plans.shuffle import permutations
from epochweave.plans.world import World

METHODS = ("random", "stratified", "per_stream", "device_per_stream")
PLAN = ["order", *CELLS, "stream_id", "sample_id"]


def shares(choose: list[int], global_batch: int) -> list[int]:
    """Rows of a global batch for each stream: whole parts, then the largest remainders (the later stream first on ties)."""
    total = sum(choose)
    out = [c * global_batch // total for c in choose]
    by_rest = sorted(range(len(choose)), key=lambda i: (choose[i] * global_batch % total, i), reverse=True)
    for i in by_rest[: global_batch - sum(out)]:
        out[i] += 1
    if min(out) < 1:
        raise ValueError("a stream's part of a global batch is no row; a larger batch or share is needed")
    return out


def block_sizes(block_size: int, choose: list[int]) -> list[int]:
    """Each stream's part of the shuffle's block, so that all together move rows as far as one block would."""
    return [block_size * c // sum(choose) for c in choose]


def ordered(units: DataFrame, canonical: int, shuffle: str | None, seed: int, epoch: int, block: Column, partial: bool, drawn_in: int) -> DataFrame:
    """Columns g, pos, stream_id, sample_id: which sample a position of each group leads to.

    units: g, n, unit_begin, size, and stream_id, shard_id, base, first_sample, width (the shard's n) of shuffle_units(). A unit with
    a base is a whole shard, so its samples follow from their place; partial says that there are others, whose draw (of the epoch
    drawn_in) is looked up.
    """
    rows = units.drop("first_sample", "width")
    if shuffle:
        rows = permutations(rows, canonical, shuffle, seed, epoch, block)
    else:
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1))).withColumn("big_id", F.col("unit_begin") + F.col("_i")).withColumn("pos", F.col("big_id"))
    sample = F.col("base") + F.col("big_id") - F.col("unit_begin")
    if not partial:
        return rows.select("g", "pos", "stream_id", sample.alias("sample_id"))
    drawn = remainders(units.select("g", "stream_id", "shard_id", F.col("width").alias("n"), "size", "unit_begin", "base", "first_sample"), seed, drawn_in)
    drawn = drawn.select("stream_id", "big_id", F.col("sample_id").alias("_drawn"))
    return rows.join(drawn, ["stream_id", "big_id"], "left").select("g", "pos", "stream_id", F.coalesce("_drawn", sample).alias("sample_id"))


def stream_orders(spark: SparkSession, units: DataFrame, streams: list[dict], grid: dict, initial_nodes: int | None, shuffle: str | None, seed: int, epoch: int, partial: bool, drawn_in: int) -> DataFrame:
    """Columns stream_id, order, node, pos, sample_id: the traversal of each stream by itself.

    streams: stream_id, n (drawn rows), first (where they begin among all), block. A row for each stream of a mixture; they go to all
    tasks as a table, so that a plan doesn't grow with them.
    """
    first = initial_grid(grid, initial_nodes)
    rows = [(s["stream_id"], s["first"], s["block"], *(Grid(**(first | {"n": s["n"]})).scalars[k] for k in SCALARS)) for s in streams]
    table = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("g", "first", "block", *SCALARS)))
    cells = grouped_cells(table.drop("first", "block"), first)
    own = units.withColumnRenamed("n", "width").join(F.broadcast(table.select("g", "n", "first", "block")), F.col("stream_id") == F.col("g"))
    own = own.withColumn("unit_begin", F.col("unit_begin") - F.col("first")).select("g", "n", "unit_begin", "size", "block", "stream_id", "shard_id", "base", "first_sample", "width")
    samples = ordered(own, grid["canonical"], shuffle, seed, epoch, F.col("block"), partial, drawn_in)
    return cells.join(samples.drop("stream_id"), ["g", "pos"], "left").select(F.col("g").alias("stream_id"), "order", "node", "pos", "sample_id")


def dealt(rows: DataFrame, n: int, seen: int, world: World, batch_size: int) -> DataFrame:
    """A plan (columns PLAN) of the rows of n global batches (columns global, at: the place in it, stream_id, sample_id), from batch `seen` on.

    Batches without samples are added until each worker has as many.
    """
    whole, left = world.ranks * batch_size, max(0, n - seen)
    filled = -(-left // world.workers_per_rank) * world.workers_per_rank
    rows = rows.where((F.col("global") >= seen) & (F.col("global") < n)).select(((F.col("global") - seen) * whole + F.col("at")).alias("order"), "stream_id", "sample_id")
    none = F.lit(None).cast("long")
    rows = rows.unionByName(rows.sparkSession.range(left * whole, filled * whole).select(F.col("id").alias("order"), none.alias("stream_id"), F.lit(-1).cast("long").alias("sample_id")))
    return rows.select("order", *[c.cast("long").alias(k) for k, c in coordinates(F.col("order"), world.nodes, world.ranks_per_node, world.workers_per_rank, batch_size).items()], "stream_id", "sample_id").select(*PLAN)


def _turns(spark: SparkSession, whole: list[tuple[int, int, int]], purpose: str, seed: int, epoch: int, chunk: int = 1 << 16) -> DataFrame:
    """Columns node, stream_id, own, turn: the whole batches (node, stream_id, how many) of a node take turns by hash, a stream's in its own order."""
    rows = spark.createDataFrame(whole, "node long, stream_id long, _n long").where("_n > 0")
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk)))).repartition("node", "stream_id", "_chunk")
    rows = rows.select("node", "stream_id", F.explode(F.sequence(F.col("_chunk") * chunk, F.least(F.col("_n"), (F.col("_chunk") + 1) * chunk) - 1)).alias("_b"))
    rows = ranked(rows.withColumn("_key", key(purpose, "stream_id", "node", "_b", seed=seed, epoch=epoch)), ["node"], "_key", "turn")
    return ranked(rows, ["node", "stream_id"], "_key", "own").select("node", "stream_id", "own", "turn")


def stratified(orders: DataFrame, streams: list[dict], grid: dict, world: World, batch_size: int, seen: int) -> DataFrame:
    """Every global batch has the same part of each stream, as many batches as the scarcest allows."""
    parts = shares([s["n"] for s in streams], world.ranks * batch_size)
    least = min(Grid(**(grid | {"n": s["n"]})).filled * grid["ranks"] * grid["nodes"] // p for s, p in zip(streams, parts, strict=True))
    table = orders.sparkSession.createDataFrame([(s["stream_id"], p, sum(parts[:i])) for i, (s, p) in enumerate(zip(streams, parts, strict=True))], "stream_id long, part long, begin long")
    rows = orders.join(F.broadcast(table), "stream_id")  # a row for each stream of a mixture
    rows = rows.select(F.floor(F.col("order") / F.col("part")).alias("global"), (F.col("begin") + F.col("order") % F.col("part")).alias("at"), "stream_id", "sample_id")
    return dealt(rows, least, seen, world, batch_size)


def per_stream(orders: DataFrame, streams: list[dict], grid: dict, world: World, batch_size: int, seen: int, seed: int, epoch: int) -> DataFrame:
    """Each global batch is one stream's; incomplete ones are dropped; streams take turns by hash."""
    size = world.ranks * batch_size
    whole = [(0, s["stream_id"], Grid(**(grid | {"n": s["n"]})).filled // grid["batch_size"]) for s in streams]
    if short := [i for _, i, n in whole if not n]:
        raise ValueError(f"stream {short[0]} has too few samples for a global batch of {size}")
    turns = _turns(orders.sparkSession, whole, "turn", seed, epoch).select("stream_id", "own", F.col("turn").alias("global"))
    rows = orders.withColumn("own", F.floor(F.col("order") / size)).withColumn("at", F.col("order") % size).join(turns, ["stream_id", "own"])
    return dealt(rows.select("global", "at", "stream_id", "sample_id"), sum(n for _, _, n in whole), seen, world, batch_size)


def device_per_stream(orders: DataFrame, streams: list[dict], grid: dict, world: World, batch_size: int, seen: int, seed: int, epoch: int) -> DataFrame:
    """Each device batch is one stream's, from its own canonical nodes.

    A node's device batches of all streams take turns by hash, each stream's in its own order, and go to the node's ranks one after
    another. orders are those of a grid of one canonical node to a node, so that they don't depend on the number of nodes.
    """
    canonical, ranks = grid["canonical"], world.ranks_per_node
    share = canonical // world.nodes
    whole = [(p, s["stream_id"], Grid(**(grid | {"n": s["n"]})).filled * share * ranks // batch_size) for s in streams for p in range(world.nodes)]
    if short := [i for _, i, n in whole if not n]:
        raise ValueError(f"stream {short[0]} has too few samples for a device batch of {batch_size}")
    turns = _turns(orders.sparkSession, whole, "device", seed, epoch)
    # order is by step (batch and worker), canonical node, rank; within a node's share of canonical nodes the same without the others
    step, inside = F.floor(F.col("order") / (canonical * ranks)), F.col("order") % (share * ranks)
    rows = orders.withColumn("_at", step * (share * ranks) + inside).withColumn("node", F.floor(F.col("node") / share))
    rows = rows.withColumn("own", F.floor(F.col("_at") / batch_size)).withColumn("_slot", F.col("_at") % batch_size).join(turns, ["node", "stream_id", "own"])
    each = sum(n for p, _, n in whole if p == 0)
    at = (F.col("node") * ranks + F.col("turn") % ranks) * batch_size + F.col("_slot")
    rows = rows.select(F.floor(F.col("turn") / ranks).alias("global"), at.alias("at"), "stream_id", "sample_id")
    missing = orders.sparkSession.range(each % ranks and ranks - each % ranks).select((F.col("id") + each).alias("turn"))  # of the last round
    missing = missing.select("turn", F.explode(F.sequence(F.lit(0), F.lit(world.nodes - 1))).alias("node")).select("turn", "node", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("_slot"))
    missing = missing.select(F.floor(F.col("turn") / ranks).alias("global"), at.alias("at"), F.lit(None).cast("long").alias("stream_id"), F.lit(-1).cast("long").alias("sample_id"))
    return dealt(rows.unionByName(missing), -(-each // ranks), seen, world, batch_size)
