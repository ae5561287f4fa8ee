"""The planner's promises: exact orders, permutations, stable node sets, elastic batches."""

import pytest
from pyspark.sql import functions as F

from epochweave.plans.batching import shares
from epochweave.plans.epoch import Planner, Resume, samples_of
from epochweave.plans.partition import Grid, relaxed_cells
from epochweave.plans.shuffle import permutation
from epochweave.plans.weights import Weight, choices, validate
from epochweave.plans.world import World


def planner(spark, weights=None, epoch_size=None, **more):
    rows = spark.createDataFrame([(i, f"s{i // 2}") for i in range(8)], "value long, stream string")
    return Planner(samples_of(rows, "stream", "value", 2), weights, epoch_size, **({"shuffle": None, "canonical": 1} | more))


def order(p, epoch=0, resume=None):
    plan = p.epoch(epoch, resume).where("sample_id >= 0").join(p.samples.select("sample_id", "row_key"), "sample_id")
    return [r.row_key for r in plan.orderBy("order").select("row_key").collect()]


# The orders that these mixtures must have.
@pytest.mark.parametrize(
    ("weights", "size", "want"),
    [
        (None, None, list(range(8))),
        ([Weight(choose=2)] * 4, None, list(range(8))),
        ([Weight(choose=4)] * 4, None, [0, 1, 0, 1, 2, 3, 2, 3, 4, 5, 4, 5, 6, 7, 6, 7]),
        ([Weight(choose=c) for c in (0, 2, 4, 6)], None, [2, 3, 4, 5, 4, 5, 6, 7, 6, 7, 6, 7]),
        ([Weight(repeat=r) for r in (0, 1, 2, 3)], None, [2, 3, 4, 5, 4, 5, 6, 7, 6, 7, 6, 7]),
        ([Weight(proportion=p / 6) for p in (0, 1, 2, 3)], 12, [2, 3, 4, 5, 4, 5, 6, 7, 6, 7, 6, 7]),
    ],
)
def test_orders_of_mixtures(spark, weights, size, want):
    assert order(planner(spark, weights, size)) == want


def test_weights_that_cannot_be():
    with pytest.raises(ValueError):
        validate([Weight(proportion=1, choose=2)])
    with pytest.raises(ValueError):
        validate([Weight(proportion=1), Weight(repeat=1)])
    with pytest.raises(ValueError):
        choices([3, 4], [Weight(repeat=1), Weight()], 10)
    assert sum(choices([3, 4, 9], [Weight()] * 3, 10)) == 10


def test_a_part_of_a_shard_is_drawn_without_repeats(spark):
    for epoch in (0, 1):
        got = order(planner(spark, [Weight(choose=c) for c in (3, 1, 2, 5)]), epoch)
        assert sorted(set(got[:2])) == [0, 1] and len(got) == 11 and got.count(6) + got.count(7) == 5


@pytest.mark.parametrize("algorithm", ["naive", "py1s", "py2s", "py1br", "py1e"])
def test_shuffles_are_permutations_with_stable_nodes(spark, algorithm):
    units = spark.createDataFrame([(sum(range(k)), k) for k in range(1, 25)], "unit_begin long, size long")
    n, sets = 300, []
    for epoch in (0, 1):
        rows = permutation(units, n, 4, algorithm, 3, epoch, 40).collect()
        assert sorted(r.pos for r in rows) == sorted(r.big_id for r in rows) == list(range(n))
        assert all(r.node == ((r.pos + 1) * 4 - 1) // n for r in rows)
        sets.append([{r.big_id for r in rows if r.node == k} for k in range(4)])
        orders = [r.big_id for r in sorted(rows, key=lambda r: r.pos)]
        assert orders != list(range(n))
    assert (sets[0] == sets[1]) == (algorithm != "naive")
    with pytest.raises(KeyError):
        permutation(units, n, 4, "other")


def test_batches_are_the_same_on_any_number_of_nodes(spark):
    seen = set()
    for nodes in (1, 3, 15, 30):
        cells = Grid(9600, 15, nodes, 8, 2, 960 // nodes // 8).cells(spark).where("pos >= 0")
        sets = cells.groupBy(F.col("batch"), "worker").agg(F.sort_array(F.collect_set("pos")).alias("p")).orderBy("batch", "worker").collect()
        seen.add(tuple(tuple(r.p) for r in sets))
        assert cells.select("pos").distinct().count() == 9600
    assert len(seen) == 1


def test_going_on_keeps_what_is_left(spark):
    grid = {"n": 960, "canonical": 4, "nodes": 4, "ranks": 2, "workers": 1, "batch_size": 6}
    full = [r.pos for r in Grid(**grid).cells(spark).orderBy("order").collect()]
    after = [r.pos for r in relaxed_cells(spark, grid | {"nodes": 3, "batch_size": 8, "drop": 96}, 4).orderBy("order").collect()]
    assert after == full[96:]
    p = planner(spark, world=World(2, 1, 1), canonical=2, batch_size=1)
    assert order(p, 0, Resume(0, 4, 2, 0, 2)) == order(p)[4:] and order(p, 1, Resume(0, 4)) == order(p, 1)
    state = Resume(3, 64, 2, 9, 2)
    assert Resume.load(state.dump()) == state


def mixture(spark, **more):
    """Three streams of 96, 144 and 48 rows in shards of 10."""
    rows = spark.range(288).selectExpr("id as k", "case when id < 96 then 'a' when id < 240 then 'b' else 'c' end as s")
    return Planner(samples_of(rows, "s", "k", 10), **({"batch_size": 6, "world": World(2, 2, 1), "canonical": 4, "shuffle": "py1e", "seed": 5, "block_size": 30} | more))


@pytest.mark.parametrize("nodes", [1, 2, 3, 4])
@pytest.mark.parametrize("batching", ["random", "stratified", "per_stream", "device_per_stream"])
def test_what_was_seen_and_the_rest_are_the_epoch(spark, batching, nodes):
    first = mixture(spark, batching=batching)
    epoch = [r.sample_id for r in first.epoch(1).orderBy("order").collect()]
    state = first.state(1, 48)
    assert state == Resume(1, 48, 4, 5, 2)
    # a planner that knows neither the canonical nodes nor the seed, on as many devices as make the same global batch
    world = World(nodes, 2, 1)
    then = mixture(spark, batching=batching, world=world, batch_size=24 // world.ranks, canonical=None, seed=0)
    if batching == "device_per_stream" and nodes == 3:  # four canonical nodes can't be dealt to three
        with pytest.raises(ValueError):
            then.epoch(0, state)
        return
    rest = [r.sample_id for r in then.epoch(0, state).orderBy("order").collect()]
    seen, wanted = epoch[:48], [x for x in epoch if x >= 0]
    assert -1 not in seen and len(wanted) == len(set(wanted))
    if batching == "device_per_stream" and nodes != 2:  # device batches are of another size, and other ones are incomplete
        left = [x for x in rest if x >= 0]
        assert len(left) == len(set(left)) > 200
    else:
        assert sorted(seen + [x for x in rest if x >= 0]) == sorted(wanted)
    assert then.state(1, 72, state) == Resume(1, 72, 4, 5, 2)
    if nodes == 2:
        assert rest == epoch[48:]


def test_a_state_of_an_epoch_that_is_over_says_nothing(spark):
    p = mixture(spark)
    plan = lambda *a: [tuple(r) for r in p.epoch(*a).orderBy("order").collect()]
    assert plan(2, Resume(1, 48, 2, 9, 1)) == plan(2) and plan(0, Resume(2, 0, 4, 5, 2)) == plan(2)


@pytest.mark.parametrize("batching", ["stratified", "per_stream", "device_per_stream"])
def test_batches_by_stream(spark, batching):
    p = mixture(spark, batching=batching, world=World(2, 2, 3))
    rows = p.epoch(0).collect()
    by = lambda f: {k: [r for r in rows if f(r) == k] for k in {f(r) for r in rows}}
    assert sorted(r.order for r in rows) == list(range(len(rows))) and len(rows) % (24 * 3) == 0
    assert all(len(of) == 6 and sorted(r.slot for r in of) == list(range(6)) for of in by(lambda r: (r.node, r.rank, r.worker, r.batch)).values())
    samples = [r.sample_id for r in rows if r.sample_id >= 0]
    assert len(samples) == len(set(samples)) > 240
    assert all((r.stream_id is None) == (r.sample_id < 0) for r in rows)
    for of in by(lambda r: (r.worker, r.batch)).values():
        streams = [r.stream_id for r in of]
        if streams[0] is None and batching != "device_per_stream":
            assert set(streams) == {None}  # padding comes in whole batches
        elif batching == "stratified":
            assert [streams.count(i) for i in range(3)] == [8, 12, 4]
        elif batching == "per_stream":
            assert len(set(streams)) == 1
        else:
            assert all(len({r.stream_id for r in of if r.node == n and r.rank == k}) == 1 for n in range(2) for k in range(2))


def test_batches_that_cannot_be(spark):
    with pytest.raises(ValueError):
        mixture(spark, batching="per_stream", batch_size=20).epoch(0)
    with pytest.raises(ValueError):
        mixture(spark, batching="device_per_stream", block_size=3).epoch(0)
    with pytest.raises(ValueError):
        mixture(spark, world=World(3, 2, 1), batch_size=4, batching="device_per_stream").epoch(1, Resume(1, 48, 4, 5, 2))
    with pytest.raises(ValueError):
        mixture(spark, batching="stratified", batch_size=1, world=World(1, 2, 1)).epoch(0)


def test_blocks_of_streams_move_rows_less(spark):
    from epochweave.plans.batching import block_sizes

    assert block_sizes(300, [10, 20, 0]) == [100, 200, 0]


def test_ids_come_from_keys_of_any_type(spark):
    rows = spark.createDataFrame([(f"s{i % 3}", f"key {i * 7919 % 1000:04}") for i in range(500)] + [(None, "z")], "s string, k string").repartition(7)
    got = {(r.stream_id, r.row_key): r for r in samples_of(rows, "s", "k", 40).collect()}
    keys = sorted((r.s or "", r.k) for r in rows.collect())
    names = sorted({s for s, _ in keys})
    assert len(got) == 501 and all(got[names.index(s), k].sample_id == i for i, (s, k) in enumerate(keys))
    for i in range(4):
        own = sorted((r.sample_id, r.shard_id, r.place) for (s, _), r in got.items() if s == i)
        assert [p for _, _, p in own] == [j % 40 for j in range(len(own))] and [b - own[0][1] for _, b, _ in own] == [j // 40 for j in range(len(own))]


def test_order_without_a_generator(spark):
    from epochweave.plans.keys import key, numbered, ranked, running

    df = spark.range(3000).withColumn("g", F.col("id") % 3).withColumn("k", key("x", "id")).withColumn("size", F.col("id") % 5)
    rows = sorted(running(ranked(df, ["g"], "k", "r"), ["g"], "k", "size", "before").collect(), key=lambda r: (r.g, r.k))
    for g in range(3):
        own = [r for r in rows if r.g == g]
        assert [r.r for r in own] == list(range(1000)) and [r.before for r in own] == [sum(x.size for x in own[:i]) for i in range(1000)]
    assert sorted((r.n, -r.id) for r in numbered(df, [F.desc("id")], "n").collect()) == [(i, i - 2999) for i in range(3000)]


def test_grids_that_cannot_be(spark):
    with pytest.raises(ValueError):
        Grid(100, 4, 3, 1, 1, 1)
    with pytest.raises(ValueError):
        Grid(10, 1, 1, 1, 1, 1, drop=50)
    assert {r.pos for r in Grid(3, 8, 2, 2, 1, 2).cells(spark).collect()} <= {-1, 0, 1, 2}


def test_shares_of_a_batch():
    assert shares([1, 1, 2], 8) == [2, 2, 4] and sum(shares([5, 3, 9], 16)) == 16
    with pytest.raises(ValueError):
        shares([1, 1000], 4)


def test_worlds():
    assert World(2, 6, 3).replicate(3) == World(2, 2, 3) and World(3, 2, 1).replicate(6) == World(1, 1, 1)
    with pytest.raises(ValueError):
        World(2, 3, 1).replicate(4)
