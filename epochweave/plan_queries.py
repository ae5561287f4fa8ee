"""Queries over the planner: documents as four streams by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.plan_sql import ALL, SAMPLES, SHARD_ROWS, draw, grid, hexkey, shuffled
from epochweave.plans.batching import block_sizes, dealt
from epochweave.plans.epoch import Planner, Resume, samples_of
from epochweave.plans.keys import numbered, running
from epochweave.plans.partition import Grid, relaxed_cells
from epochweave.plans.sampling import draw_per_shard, resample, shards_of, shuffle_units
from epochweave.plans.shuffle import permutation, spans
from epochweave.plans.weights import Weight, absolute, relative
from epochweave.plans.world import World, replicated
from epochweave.registry import query, table

#: The sampling queries draw so many of each stream; all others plan every row of the table, and those of two streams more than once.
CHOOSE = [180, 400, 90, 330]
REPEAT = [1, 2, 1, 1.5]
WEIGHTS = [Weight(repeat=r) for r in REPEAT]
EVERY = "floor(n * case stream_id when 1 then 2 when 3 then 1.5 else 1 end)"
WORLD = World(2, 2, 1)


def _samples(spark, sf_dir: str) -> DataFrame:
    return samples_of(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", SHARD_ROWS)


def _planner(spark, sf_dir: str, **more) -> Planner:
    return Planner(_samples(spark, sf_dir), **({"weights": WEIGHTS, "world": WORLD, "batch_size": 4, "canonical": 2, "shuffle": "py1e", "seed": 7, "block_size": 200} | more))


def _shards(spark, sf_dir: str) -> DataFrame:
    return shards_of(_samples(spark, sf_dir))


def _choose(c: list[int] = CHOOSE):
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in c]), (F.col("stream_id") + 1).cast("int"))


def _drawing(spark, sf_dir: str, **more) -> Planner:
    return _planner(spark, sf_dir, weights=[Weight(choose=c) for c in CHOOSE], **more)


@query(
    "epoch_plan_random",
    f"with {SAMPLES}, {draw(EVERY, 1, 7, 1)}, {shuffled('py1e', ALL, 2, 7, 1)}, {grid(ALL, 2, 2, 2, 1, 4)} "
    "select c.node, c.rank, c.worker, c.batch, c.slot, s.sample_id, s.stream_id, d.doc_id, d.n_chars from cells c join perm using (pos) join drawn using (big_id) "
    "join samples s on s.sample_id = drawn.sample_id join documents d on d.doc_id = s.row_key",
)
def epoch_plan_random(spark, sf_dir):
    rows = _planner(spark, sf_dir).rows(1, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("node", "rank", "worker", "batch", "slot", "sample_id", "stream_id", "doc_id", "n_chars")


# Mixing and sampling

_STREAMS = "streams as (select stream_id, n from names)"


def _streams(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("n"))


def _relative_sql(weight: str, total: int) -> str:
    return (
        f"with {SAMPLES}, w as (select stream_id, n, {weight} as weight from names), f as (select *, cast(floor({total} * (weight / sum(weight) over ())) as bigint) as part from w) "
        f"select stream_id, n, part + (case when row_number() over (order by {hexkey('shortfall', 'stream_id')}) <= {total} - sum(part) over () then 1 else 0 end) as choose from f"
    )


@query("x2_relative_weights", _relative_sql("(stream_id + 1.0) / 8", 1003))
def x2(spark, sf_dir):
    return relative(_streams(spark, sf_dir).withColumn("weight", (F.col("stream_id") + 1.0) / 8), "weight", 1003).select("stream_id", "n", "choose")


@query("x3_epoch_size_by_stream_size", _relative_sql("cast(n as double)", 777))
def x3(spark, sf_dir):
    return relative(_streams(spark, sf_dir).withColumn("weight", F.col("n").cast("double")), "weight", 777).select("stream_id", "n", "choose")


@query("x4_absolute_weights", f"with {SAMPLES} select stream_id, n, case stream_id when 0 then 500 when 1 then cast(floor(1.5 * n) as bigint) when 2 then cast(floor(0.25 * n) as bigint) else n end as choose from names")
def x4(spark, sf_dir):
    given = F.when(F.col("stream_id") == 0, 500)
    repeat = F.when(F.col("stream_id") == 1, 1.5).when(F.col("stream_id") == 2, 0.25)
    return absolute(_streams(spark, sf_dir).withColumn("given", given).withColumn("repeat", repeat)).select("stream_id", "n", "choose")


@query("x5_sampling_granularity", f"with {SAMPLES}, {draw(CHOOSE, 16, 3, 2)} select stream_id, shard_id, n, chosen from chosen")
def x5(spark, sf_dir):
    return draw_per_shard(_shards(spark, sf_dir), _choose(), 16, 3, 2).select("stream_id", "shard_id", "n", "chosen")


@query("x6_resample_streams", f"with {SAMPLES}, {draw(CHOOSE, 8, 5, 1)} select big_id, unit_begin, sample_id, stream_id, shard_id from drawn")
def x6(spark, sf_dir):
    return resample(shuffle_units(draw_per_shard(_shards(spark, sf_dir), _choose(), 8, 5, 1)), 5, 1)


@query("x6_shuffle_units", f"with {SAMPLES}, {draw(CHOOSE, 8, 5, 1)} select unit_begin, size from units")
def x6_units(spark, sf_dir):
    return _drawing(spark, sf_dir, granularity=8, seed=5).units(1).select("unit_begin", "size")


@query("x7_fixed_sampling", f"with {SAMPLES}, {draw(CHOOSE, 1, 7, 0)} select sample_id, count(*) as times from drawn group by sample_id")
def x7(spark, sf_dir):
    return _drawing(spark, sf_dir, sampling="fixed").drawn(3).groupBy("sample_id").agg(F.count("*").alias("times"))


@query("x8_epoch_size", f"with {SAMPLES}, {draw(EVERY)} select n_all as epoch_size, cast(ceil(n_all / 4.0) as bigint) as samples_per_rank, cast(ceil(n_all / 16.0) as bigint) as global_batches from everything")
def x8(spark, sf_dir):
    p = _planner(spark, sf_dir)
    n = F.count("*")
    whole = p.world.ranks * p.batch_size
    return p.drawn(0).agg(n.alias("epoch_size"), F.ceil(n / p.world.ranks).alias("samples_per_rank"), F.ceil(n / whole).alias("global_batches"))


@query("x9_count_per_subset", "select lang, source, count(*) as n from documents group by all")
def x9(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("x10_even_pick", "with o as (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents) select i, doc_id from (select unnest(range(37)) as i) join o on r = cast(floor(i * (n / 37)) as bigint)")
def x10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    picks = spark.range(37).select(F.col("id").alias("i"), F.floor(F.col("id") * F.lit(n / 37)).alias("r"))
    return numbered(docs, "doc_id", "r").join(F.broadcast(picks), "r").select("i", "doc_id")


# Partitioning

_CELLS = "node, rank, worker, batch, slot, pos"


def _rows_of(name: str) -> str:
    return f"(select count(*) from {name})"


def _grid_query(name: str, rows: str, *args, **more) -> None:
    """As many positions as a table has rows."""

    @query(name, f"with {grid(_rows_of(rows), *args, **more)} select {_CELLS} from cells")
    def run(spark, sf_dir):
        return Grid(table(spark, sf_dir, rows).count(), *args, **more).cells(spark).select(*_CELLS.split(", "))


_grid_query("d2_partition_orig", "orders", 4, 2, 3, 2, 5)
_grid_query("d2_partition_more_nodes", "customer", 2, 6, 2, 2, 4)
_grid_query("d2_partition_drop_first", "orders", 4, 2, 3, 2, 5, drop=101)
_grid_query("d3_partition_few_samples", "nation", 64, 2, 2, 1, 3)


@query("d1_partition_by_table", f"with {grid('(select count(*) from lineitem)', 8, 4, 8, 2, 16)} select node, rank, count(*) as cells, count(*) filter (pos >= 0) as filled, sum(pos) as total from cells group by all")
def d1(spark, sf_dir):
    cells = Grid(table(spark, sf_dir, "lineitem").count(), 8, 4, 8, 2, 16).cells(spark)
    return cells.groupBy("node", "rank").agg(F.count("*").alias("cells"), F.sum((F.col("pos") >= 0).cast("long")).alias("filled"), F.sum("pos").alias("total"))


@query(
    "d4_partition_relaxed",
    f"with {grid(_rows_of('customer'), 4, 4, 2, 1, 6, 96)} select (traversal // 16) % 3 as node, (traversal // 8) % 2 as rank, 0 as worker, traversal // 48 as batch, traversal % 8 as slot, pos from cells",
)
def d4(spark, sf_dir):
    return relaxed_cells(spark, {"n": table(spark, sf_dir, "customer").count(), "canonical": 4, "nodes": 3, "ranks": 2, "workers": 1, "batch_size": 8, "drop": 96}, 4).select(*_CELLS.split(", "))


@query("d5_replication", f"with {grid(_rows_of('part'), 2, 2, 2, 1, 4)} select (node * 2 + rank) * 3 + copy as rank, batch, slot, pos from cells, (select unnest(range(3)) as copy)")
def d5(spark, sf_dir):
    world = World(2, 6, 1).replicate(3)
    cells = Grid(table(spark, sf_dir, "part").count(), 2, world.nodes, world.ranks_per_node, 1, 4).cells(spark)
    return replicated(cells.withColumn("rank", F.col("node") * world.ranks_per_node + F.col("rank")), 3).select("rank", "batch", "slot", "pos")


@query("d6_world", "select w as worker, w // 24 as node, w // 4 as rank, (w // 4) % 6 as rank_of_node, w % 4 as worker_of_rank, w % 24 = 0 as is_local_leader from (select unnest(range(72)) as w)")
def d6(spark, sf_dir):
    world = World(3, 6, 4)
    return spark.range(world.workers).select(F.col("id").alias("worker"), *[c.alias(k) for k, c in world.coordinates(F.col("id")).items()])


# Shuffles

for _name, _algorithm in (("h1_naive", "naive"), ("h3_py1s", "py1s"), ("h4_py2s", "py2s"), ("h5_py1br", "py1br"), ("h6_py1e", "py1e")):

    @query(f"{_name}_shuffle", f"with {SAMPLES}, {draw(EVERY, 1, 7, 2)}, {shuffled(_algorithm, ALL, 4, 7, 2)} select pos, node, big_id from perm")
    def _shuffle(spark, sf_dir, algorithm=_algorithm):
        p = _planner(spark, sf_dir)
        return permutation(p.units(2).select("unit_begin", "size"), p.n, 4, algorithm, 7, 2, 200).select("pos", "node", "big_id")


@query("h2_divide_spans", f"with {SAMPLES}, {draw(EVERY, 1, 7, 0)}, {shuffled('py1s', ALL, 8, 7, 0)} select unit_begin, node, begin, size, first from spans where size > 0")
def h2(spark, sf_dir):
    p = _planner(spark, sf_dir)
    return spans(p.units(0), p.n, 8, 7)


# Batching


#: A world with more than one worker, so that there are batches to fill up; global batches of 16, canonical nodes two to a node.
BATCHING = {"world": World(2, 2, 3), "batch_size": 4, "canonical": 4, "shuffle": "py1e"}


def _orders_sql(p: int, b: int) -> str:
    """orders: traversal, stream_id, node, pos, sample_id: each stream dealt (over p nodes in batches of b) and shuffled by itself, with its part of a block of 200."""
    union = []
    for i in range(len(REPEAT)):
        one = lambda what: f"(select {what} from choices where stream_id = {i})"  # noqa: B023, E731
        first = f"(select cast(coalesce(sum(choose), 0) as bigint) from choices where stream_id < {i})"
        inner = (
            f"with units as (select unit_begin - {first} as unit_begin, size from all_u where unit_begin >= {first} and unit_begin < {first} + {one('choose')}), "
            f"{shuffled('py1e', one('choose'), 4, 7, 1, '(200 * ' + one('choose') + ' // ' + ALL + ')')}, {grid(one('choose'), 4, p, 2, 3, b)} "
        )
        union.append(f"select traversal, {i} as stream_id, node, pos, sample_id from ({inner} select cells.traversal, cells.node, cells.pos, drawn.sample_id from cells left join perm using (pos) left join drawn on drawn.big_id = perm.big_id + {first})")
    return f"{SAMPLES}, {draw(EVERY, 1, 7, 1)}, all_u as (select * from units), orders as (" + " union all ".join(union) + ")"


#: From batched (g: global batch, spot: place in it, stream_id, sample_id) and total (n: whole global batches) to a plan, filled up to 3 workers.
_DEALT = """
    placed as (
        select g * 16 + spot as o, stream_id, sample_id from batched, total where g < n
        union all select i, null, -1 from (select unnest(range((select n * 16 from total), (select (n + 2) // 3 * 48 from total))) as i)
    ) select o as "order", (o // 8) % 2 as node, (o // 4) % 2 as rank, (o // 16) % 3 as worker, o // 48 as batch, o % 4 as slot, stream_id, sample_id from placed"""


@query(
    "g2_stratified",
    f"with {_orders_sql(1, 1)}, q as (select stream_id, choose * 16 // n_all as part, choose * 16 % n_all as rest from choices, everything), "
    "parts as (select stream_id, part + (case when row_number() over (order by rest desc, stream_id desc) <= 16 - sum(part) over () then 1 else 0 end) as part from q), "
    "begins as (select *, sum(part) over (order by stream_id) - part as begin from parts), "
    "total as (select cast(min(n // part) as bigint) as n from (select stream_id, count(*) filter (pos >= 0) as n from orders group by stream_id) join parts using (stream_id)), "
    f"batched as (select cast(traversal // part as bigint) as g, cast(begin + traversal % part as bigint) as spot, stream_id, sample_id from orders join begins using (stream_id)), {_DEALT}",
)
def g2(spark, sf_dir):
    return _planner(spark, sf_dir, batching="stratified", **BATCHING).epoch(1)


_TURNS = "turns as (select node, stream_id, row_number() over (partition by node, stream_id order by k) - 1 as own, row_number() over (partition by node order by k) - 1 as turn from (select *, {} as k from whole))"


@query(
    "g3_per_stream",
    f"with {_orders_sql(2, 4)}, x as (select stream_id, traversal // 16 as own, traversal % 16 as spot, pos, sample_id from orders), whole as (select 0 as node, stream_id, own from x group by all having min(pos) >= 0 and count(*) = 16), "
    f"{_TURNS.format(hexkey('turn', 'stream_id', 'node', 'own', seed=7, epoch=1))}, total as (select count(*) as n from whole), batched as (select turn as g, spot, stream_id, sample_id from x join turns using (stream_id, own)), {_DEALT}",
)
def g3(spark, sf_dir):
    return _planner(spark, sf_dir, batching="per_stream", **BATCHING).epoch(1)


@query(
    "g4_device_per_stream",
    f"with {_orders_sql(4, 1)}, i as (select stream_id, node // 2 as node, pos, sample_id, row_number() over (partition by stream_id, node // 2 order by traversal) - 1 as i from orders), x as (select *, i // 4 as own, i % 4 as slot from i), "
    f"whole as (select node, stream_id, own from x group by all having min(pos) >= 0 and count(*) = 4), {_TURNS.format(hexkey('device', 'stream_id', 'node', 'own', seed=7, epoch=1))}, "
    "each as (select max(n) as n from (select node, count(*) as n from whole group by node)), total as (select (n + 1) // 2 as n from each), "
    "batched as (select turn // 2 as g, (node * 2 + turn % 2) * 4 + slot as spot, stream_id, sample_id from x join turns using (node, stream_id, own) "
    f"union all select t // 2, (p * 2 + t % 2) * 4 + s, null, -1 from each, (select unnest(range(2)) as p), (select unnest(range(4)) as s), (select unnest(range((select n from each), (select (n + 1) // 2 * 2 from each))) as t)), {_DEALT}",
)
def g4(spark, sf_dir):
    return _planner(spark, sf_dir, batching="device_per_stream", **BATCHING).epoch(1)


@query("g5_stream_block_size", f"with {SAMPLES}, {draw(EVERY)} select stream_id, 262144 * choose // n_all as block_size from choices, everything")
def g5(spark, sf_dir):
    p = _planner(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(block_sizes(262144, p.choose))), "stream_id long, block_size long")


@query(
    "g6_padding",
    "with b as (select o_orderkey // 4 as k, row_number() over (order by o_orderkey) - 1 as i, o_orderkey from orders), n as (select count(*) // 16 as whole from b), "
    'rows as (select i, o_orderkey as sample_id from b, n where i < whole * 16 union all select unnest(range((select whole * 16 from n), (select (whole + 6) // 7 * 112 from n))), -1) select i as "order", (i // 8) % 2 as node, (i // 4) % 2 as rank, (i // 16) % 7 as worker, i // 112 as batch, i % 4 as slot, sample_id from rows',
)
def g6(spark, sf_dir):
    orders = numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "i")
    rows = orders.select(F.floor(F.col("i") / 16).alias("global"), (F.col("i") % 16).alias("at"), F.lit(None).cast("long").alias("stream_id"), F.col("o_orderkey").alias("sample_id"))
    return dealt(rows, table(spark, sf_dir, "orders").count() // 16, 0, World(2, 2, 7), 4).drop("stream_id")


@query("p8_drop_padding", f"with {grid(_rows_of('customer'), 2, 2, 3, 2, 5)} select batch, count(*) as n from cells where pos >= 0 group by batch")
def p8(spark, sf_dir):
    return Grid(table(spark, sf_dir, "customer").count(), 2, 2, 3, 2, 5).cells(spark).where("pos >= 0").groupBy("batch").agg(F.count("*").alias("n"))


# Going on after a stop

_RESUME = f"with {SAMPLES}, {draw(EVERY, 1, 7, 1)}, {shuffled('py1e', ALL, 2, 7, 1)}, "
_CELL = "{} as node, {} as rank, {} as worker, {} as batch, {} as slot, coalesce(sample_id, -1) as sample_id from cells left join perm using (pos) left join drawn using (big_id)"
_STOPPED = Resume(1, 160, 2, 7, 2)


def _resumed(spark, sf_dir, world: World, canonical: int | None, seed: int):
    """A run that stopped after 160 samples on two nodes, by a planner that knows no better: the state has the canonical nodes and the seed."""
    return _planner(spark, sf_dir, world=world, canonical=canonical, seed=seed).epoch(1, _STOPPED).select("node", "rank", "worker", "batch", "slot", "sample_id")


@query("e5_resume", f"{_RESUME}{grid(ALL, 2, 2, 2, 1, 4, 160)} select {_CELL.format('cells.node', 'cells.rank', 'cells.worker', 'cells.batch', 'cells.slot')}")
def e5(spark, sf_dir):
    return _resumed(spark, sf_dir, WORLD, 2, 7)


@query("e5_resume_on_four_nodes", f"{_RESUME}{grid(ALL, 2, 4, 2, 1, 2, 160)} select {_CELL.format('cells.node', 'cells.rank', 'cells.worker', 'cells.batch', 'cells.slot')}")
def e5_four(spark, sf_dir):
    return _planner(spark, sf_dir, world=World(4, 2, 1), canonical=None, seed=3, batch_size=2).epoch(1, _STOPPED).select("node", "rank", "worker", "batch", "slot", "sample_id")


@query("e5_resume_on_three_nodes", f"{_RESUME}{grid(ALL, 2, 2, 2, 1, 6, 160)} select {_CELL.format('(traversal // 8) % 3', '(traversal // 4) % 2', '0', 'traversal // 24', 'traversal % 4')}")
def e5_three(spark, sf_dir):
    return _resumed(spark, sf_dir, World(3, 2, 1), None, 0)


@query("e7_loader_counts", f"with {SAMPLES}, {draw(EVERY)}, {grid(ALL, 2, 2, 2, 1, 4)} select batch, count(*) filter (pos >= 0) as yielded, sum(count(*) filter (pos >= 0)) over (order by batch) as sample_in_epoch from cells group by batch")
def e7(spark, sf_dir):
    per = Grid(_planner(spark, sf_dir).n, 2, 2, 2, 1, 4).cells(spark).groupBy("batch").agg(F.sum((F.col("pos") >= 0).cast("long")).alias("yielded"))
    return running(per, [], "batch", "yielded", "_before", bucket=F.floor(F.col("batch") / 65536)).select("batch", "yielded", (F.col("_before") + F.col("yielded")).alias("sample_in_epoch"))


# Lookups

_SPANS = "spans as (select stream_id, shard_id, n, sum(n) over (order by shard_id) - n as begin from shards)"


@query("n1_shard_offsets", f"with {SAMPLES}, {_SPANS} select stream_id, shard_id, n, begin from spans")
def n1(spark, sf_dir):
    from epochweave.operators.lookup import shard_offsets

    return shard_offsets(_shards(spark, sf_dir))


@query("j1_span_lookup", f"with {SAMPLES}, {_SPANS}, ids as (select distinct l_partkey % (select sum(n) from shards) as sample_id from lineitem) select sample_id, shard_id, sample_id - begin as offset_in_shard from ids join spans on sample_id >= begin and sample_id < begin + n")
def j1(spark, sf_dir):
    from epochweave.operators.lookup import shard_offsets, span_lookup

    shards = shard_offsets(_shards(spark, sf_dir))
    total = table(spark, sf_dir, "documents").count()
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % total).alias("sample_id")).distinct()
    return span_lookup(ids, shards).select("sample_id", "shard_id", "offset_in_shard")


@query("j2_gather", f"with {SAMPLES}, {draw(EVERY, 1, 7, 0)}, {shuffled('py1s', ALL, 2, 7, 0)} select pos, sample_id from perm join drawn using (big_id)")
def j2(spark, sf_dir):
    p = _planner(spark, sf_dir)
    return permutation(p.units(0).select("unit_begin", "size"), p.n, 2, "py1s", 7, 0).drop("unit_begin").join(p.drawn(0), "big_id").select("pos", "sample_id")


@query("j3_sample_stream", f"with {SAMPLES} select stream_id, min(sample_id) as first, max(sample_id) as last, count(*) as n from samples group by stream_id")
def j3(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("stream_id").agg(F.min("sample_id").alias("first"), F.max("sample_id").alias("last"), F.count("*").alias("n"))


@query("j5_class_ids", "select source, dense_rank() over (order by source) - 1 as class_id, n from (select source, count(*) as n from documents group by source)")
def j5(spark, sf_dir):
    from epochweave.operators.lookup import class_ids

    docs = table(spark, sf_dir, "documents").select("source")
    return docs.join(class_ids(docs, "source"), "source").groupBy("source", "class_id").agg(F.count("*").alias("n"))


@query("r7_point_lookup", f"with {SAMPLES} select sample_id, doc_id, n_chars from samples join documents on doc_id = row_key where sample_id = 123")
def r7(spark, sf_dir):
    return _samples(spark, sf_dir).where("sample_id = 123").join(table(spark, sf_dir, "documents"), F.col("row_key") == F.col("doc_id")).select("sample_id", "doc_id", "n_chars")


_IDS = [5, -1, 17, 5, 0, -20]


@query("r8_array_indexing", f"with {SAMPLES}, ids as (select unnest({_IDS}) as given, unnest(range({len(_IDS)})) as pos), total as (select count(*) as n from samples) select ids.pos, row_key as doc_id from ids, total, samples where sample_id = case when given < 0 then given + n else given end")
def r8(spark, sf_dir):
    from epochweave.operators.lookup import take_rows

    return take_rows(_samples(spark, sf_dir), "sample_id", _IDS, table(spark, sf_dir, "documents").count()).select("pos", F.col("row_key").alias("doc_id"))


_NESTED = [[5, [-1, 17]], [], 5, [[0], [[-20, 3]]]]


@query("r8_nested_indexing", f"with {SAMPLES}, ids as (select unnest([5, -1, 17, 5, 0, -20, 3]) as given, unnest(['0,0', '0,1,0', '0,1,1', '2', '3,0,0', '3,1,0,0', '3,1,0,1']) as pos), total as (select count(*) as n from samples) select ids.pos, row_key as doc_id from ids, total, samples where sample_id = case when given < 0 then given + n else given end")
def r8_nested(spark, sf_dir):
    from epochweave.operators.lookup import take_nested

    found = take_nested(_samples(spark, sf_dir), "sample_id", _NESTED, table(spark, sf_dir, "documents").count())
    return found.select(F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"), F.col("row_key").alias("doc_id"))


@query("r8_array_slice", f"with {SAMPLES} select (sample_id - 10) // 7 as pos, row_key as doc_id from samples where sample_id >= 10 and sample_id < 200 and (sample_id - 10) % 7 = 0")
def r8_slice(spark, sf_dir):
    from epochweave.operators.lookup import slice_rows

    return slice_rows(_samples(spark, sf_dir), "sample_id", slice(10, 200, 7), table(spark, sf_dir, "documents").count()).select("pos", F.col("row_key").alias("doc_id"))


@query("u1_concatenate_streams", f"with {SAMPLES} select sample_id, stream_id, shard_id, place, row_key from samples")
def u1(spark, sf_dir):
    return _samples(spark, sf_dir)


# What a plan costs


@query("n2_rolling_throughput", "with s as (select order_key, n, avg(n) over w as mean, row_number() over (order by order_key) as r from (select l_orderkey as order_key, count(*) as n from lineitem group by 1) window w as (order by order_key rows between 9 preceding and current row)) select order_key, case when r < 10 then 0 else round(1 / mean, 9) end as per_second from s")
def n2(spark, sf_dir):
    from epochweave.operators.analysis import rolling_throughput

    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("n"))
    return rolling_throughput(steps, "order_key", "n", 10).select("order_key", F.round("per_second", 9).alias("per_second"))


@query("n3_adjacent_difference", f"with {SAMPLES}, {draw(EVERY, 1, 7, 0)}, {shuffled('py1s', ALL, 2, 7, 0)}, o as (select pos, sample_id from perm join drawn using (big_id)) select pos, abs(sample_id - lag(sample_id) over (order by pos)) as difference from o qualify difference is not null")
def n3(spark, sf_dir):
    from epochweave.operators.analysis import differences

    return differences(j2(spark, sf_dir), "pos", "sample_id")


_ENTROPY = "select round(-sum(n / total * log2(n / total)), 6) as entropy from (select difference, count(*) as n, sum(count(*)) over () as total from d group by difference)"


@query("f18_difference_entropy", f"with {SAMPLES}, {draw(EVERY, 1, 7, 0)}, {shuffled('py1s', ALL, 2, 7, 0)}, o as (select pos, sample_id from perm join drawn using (big_id)), d as (select abs(sample_id - lag(sample_id) over (order by pos)) as difference from o qualify difference is not null) {_ENTROPY}")
def f18(spark, sf_dir):
    from epochweave.operators.analysis import difference_entropy

    return difference_entropy(j2(spark, sf_dir), "pos", "sample_id").select(F.round("entropy", 6).alias("entropy"))


@query(
    "z9_shuffle_quality",
    f"with {SAMPLES}, {draw(EVERY, 1, 7, 0)}, {shuffled('py1s', ALL, 2, 7, 0)}, o as (select pos, sample_id, shard_id from perm join drawn using (big_id)), "
    f"a as (with d as (select abs(sample_id - lag(sample_id) over (order by pos)) as difference from o qualify difference is not null) {_ENTROPY}), b as (with d as (select abs(shard_id - lag(shard_id) over (order by pos)) as difference from o qualify difference is not null) {_ENTROPY}) "
    "select a.entropy as sample_entropy, b.entropy as shard_entropy, round(2 / (1 / a.entropy + 1 / b.entropy), 5) as quality from a, b",
)
def z9(spark, sf_dir):
    from epochweave.operators.analysis import shuffle_quality

    p = _planner(spark, sf_dir)
    order = permutation(p.units(0).select("unit_begin", "size"), p.n, 2, "py1s", 7, 0).drop("unit_begin").join(p.drawn(0), "big_id").select("pos", "sample_id", "shard_id")
    return shuffle_quality(order, "pos", "sample_id", "shard_id")


@query("z5_uniform_index", "with n as (select count(*) as n from orders) select i as shard_id, least(130, n - i * 130) as n, i * 130 as begin from n, (select unnest(range((select (n + 129) // 130 from n))) as i)")
def z5(spark, sf_dir):
    from epochweave.operators.analysis import uniform_index

    return uniform_index(spark, table(spark, sf_dir, "orders").count(), 130)


@query(
    "z6_cache_limit",
    f"with {SAMPLES}, {draw(EVERY, 1, 7, 1)}, {shuffled('py1s', ALL, 2, 7, 1)}, {grid(ALL, 2, 2, 2, 1, 4)}, uses as (select cells.node, shard_id, min(batch) as a, max(batch) as b, count(*) * 1000 as size from cells join perm using (pos) join drawn using (big_id) group by 1, 2), "
    "e as (select node, a as t, 0 as kind, size from uses union all select node, b, 1, -size from uses) select max(level) as cache_limit from (select sum(size) over (partition by node order by t, kind, size rows unbounded preceding) as level from e)",
)
def z6(spark, sf_dir):
    from epochweave.operators.analysis import cache_limit

    p = _planner(spark, sf_dir, shuffle="py1s")
    plan = p.epoch(1).where("sample_id >= 0").join(p.samples.select("sample_id", "shard_id"), "sample_id")
    uses = plan.groupBy("node", "shard_id").agg(F.min("batch").alias("first_use"), F.max("batch").alias("last_use"), (F.count("*") * 1000).alias("size"))
    return cache_limit(uses)


@query("z7_simulation_stats", "with s as (select l_orderkey as step, sum(l_quantity) as wait, row_number() over (order by l_orderkey) as r, count(*) over () as steps from lineitem group by 1), f as (select *, wait > 200 as slow from s), w as (select coalesce(max(r) filter (slow and r <= 10), 0) as warm from f) select count(*) filter (slow) as slow_steps, any_value(warm) as warmup_steps, sum(wait) filter (r <= warm) as warmup_wait, count(*) filter (slow and r > warm) as later_drops from f, w")
def z7(spark, sf_dir):
    from epochweave.operators.analysis import simulation_stats

    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("step")).agg(F.sum("l_quantity").alias("wait"))
    return simulation_stats(steps, "step", "wait", 200.0, 10)

