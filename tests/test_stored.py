"""Indexes that several write to, streams of shards, pruning, access by position, and plans of stored streams."""

import json
import random
import time
import unicodedata
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochweave.feeds.plan_feed import plan_feed, write_plan
from epochweave.functions import text as X
from epochweave.operators.gather import gathered, indexed_shards
from epochweave.operators.lookup import external_content, pack_contents, write_contents
from epochweave.places import remove
from epochweave.plans.epoch import Planner, Resume
from epochweave.plans.weights import Weight
from epochweave.plans.world import World
from epochweave.sources.index import commit, merge_index, put_if_absent, read_index, write_index
from epochweave.sources.lines import LineReader, lines_at, read_by_index, write_json_lines, write_separated
from epochweave.sources.pruning import may_match, summary
from epochweave.sources.shards import ShardReader, ranges, read_shards, stream_to_shards, write_shards


def shard(name, n=1):
    return {"samples": n, "raw_data": {"basename": name, "bytes": 10}, "zip_data": None, "raw_meta": None, "zip_meta": None, "format": "mds", "column_names": [], "column_encodings": []}


# The log of an index


def test_writers_at_once_lose_nothing(tmp_path):
    folder = f"file://{tmp_path}/out"
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: commit(folder, [shard(f"{i}a"), shard(f"{i}b")]), range(40)))
    names = [s["raw_data"]["basename"] for s in read_index(folder)]
    assert sorted(names) == sorted(f"{i}{k}" for i in range(40) for k in "ab") and all(a[:-1] == b[:-1] for a, b in zip(names[::2], names[1::2], strict=True))
    alone = json.loads((tmp_path / "out/index.json").read_text())  # as programs that know nothing of the log see it
    assert [s["raw_data"]["basename"] for s in alone["shards"]] == names and alone["commit"] == 39


def test_a_commit_without_its_index_counts(tmp_path):
    folder = f"file://{tmp_path}/out"
    commit(folder, [shard("a")])
    before = (tmp_path / "out/index.json").read_bytes()
    commit(folder, [shard("b")])
    (tmp_path / "out/index.json").write_bytes(before)  # a writer was lost before it renewed it
    assert [s["raw_data"]["basename"] for s in read_index(folder)] == ["a", "b"]
    gone = commit(folder, [shard("c")], overwrite=True)
    assert [s["raw_data"]["basename"] for s in gone] == ["a", "b"] and [s["raw_data"]["basename"] for s in read_index(folder)] == ["c"]
    write_index(folder, [shard("d")])  # stands for all that was there
    commit(folder, [shard("e")])
    assert [s["raw_data"]["basename"] for s in read_index(folder)] == ["d", "e"]
    with pytest.raises(FileNotFoundError):
        read_index(f"file://{tmp_path}/none")


def test_a_batch_that_comes_again_replaces_itself(tmp_path):
    folder = f"file://{tmp_path}/out"
    commit(folder, [shard("a")], batch="q/0")
    commit(folder, [shard("b")], batch="q/1")
    commit(folder, [shard("other")], batch="r/1")
    gone = commit(folder, [shard("b2"), shard("b3")], batch="q/1")
    assert [s["raw_data"]["basename"] for s in gone] == ["b"]
    assert sorted(s["raw_data"]["basename"] for s in read_index(folder)) == ["a", "b2", "b3", "other"]
    commit(folder, [], batch="q/1")
    assert sorted(s["raw_data"]["basename"] for s in read_index(folder)) == ["a", "other"]


def test_put_if_absent(tmp_path):
    from pyarrow import fs

    files = fs.LocalFileSystem()
    assert put_if_absent(files, f"{tmp_path}/x", b"1") and not put_if_absent(files, f"{tmp_path}/x", b"2")
    other = fs.SubTreeFileSystem(str(tmp_path), files)  # one without links
    assert put_if_absent(other, "y", b"1") and not put_if_absent(other, "y", b"2")
    assert (tmp_path / "x").read_bytes() == (tmp_path / "y").read_bytes() == b"1" and sorted(p.name for p in tmp_path.iterdir()) == ["x", "y"]
    with pytest.raises(OSError):
        put_if_absent(files, f"{tmp_path}/none/x", b"1")


def test_a_stream_into_shards(spark, tmp_path):
    source, folder, check = f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/check"

    def run():
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        stream_to_shards(rows, folder, "numbers", check).trigger(availableNow=True).start().awaitTermination()

    spark.range(90).repartition(3).write.parquet(source)
    run()
    assert sorted(r.id for r in read_shards(spark, folder).collect()) == list(range(90))
    known = {s["raw_data"]["basename"] for s in read_index(folder)}
    remove(spark, f"{check}/commits/2")  # the driver was lost after the index knew of the batch
    run()
    again = {s["raw_data"]["basename"] for s in read_index(folder)}
    assert sorted(r.id for r in read_shards(spark, folder).collect()) == list(range(90)) and len(known & again) < len(known)
    assert not any((tmp_path / "out" / n.replace(".mds", ".mds.zstd")).exists() for n in known - again)
    spark.range(90, 95).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in read_shards(spark, folder).collect()) == list(range(95)) and {s["batch"].split("/")[0] for s in read_index(folder)} == {"numbers"}
    with pytest.raises(Exception, match="query"):
        stream_to_shards(spark.readStream.schema("id long").parquet(source), folder, "", f"{check}2").trigger(availableNow=True).start().awaitTermination()


# Streams, numbers and pruning


def test_streams_and_numbers(spark, tmp_path):
    rows = [(f"s/{i % 3}", i // 30, 99 - i, f"t{i}") for i in range(100)]
    folder = write_shards(spark.createDataFrame(rows, "s string, n long, at long, t string").repartition(4), f"file://{tmp_path}/out", {"t": "str"}, stream="s", number="n", order=["at"], size_limit="100b")
    for k in range(3):
        own = f"{folder}/s%2F{k}"
        assert [s["samples"] for s in read_index(own)] == [10, 10, 10, 4 - (k > 0)]
        assert [r.t for r in read_shards(spark, own).orderBy("sample_id").collect()] == [f"t{i}" for n in range(4) for i in range(min(30 * n + 29, 99), 30 * n - 1, -1) if i % 3 == k]
    assert merge_index(folder) == 12 and read_shards(spark, folder).count() == 100


def test_ranges():
    assert ranges(5) == [[5, 6]] and ranges(range(3, 9)) == [[3, 9]] and ranges([7, 1, range(2, 4), 7, range(9, 9), range(3, 6)]) == [[1, 6], [7, 8]] and ranges([]) == []
    for bad in (range(0, 9, 2), -1, [3, range(-2, 4)]):
        with pytest.raises(IndexError):
            ranges(bad)


def test_conditions_open_few_shards(spark, tmp_path):
    rows = [(i, f"k{i % 50:02}", i / 7, i // 100) for i in range(2000)]
    frame = spark.createDataFrame(rows, "i long, s string, d double, b int").repartitionByRange(2, "i").sortWithinPartitions("i")
    folder = write_shards(frame, f"file://{tmp_path}/out", size_limit="3kb", summaries=["i", "s", "d"])
    total = len(read_index(folder))

    def opened(where):
        return len(ShardReader({"path": folder, "conditions": json.dumps(where)}, frame.schema).chosen())

    for where, most in [([("i", "=", 777)], 2), ([("i", "in", [3, 1999])], 3), ([("i", ">=", 100), ("i", "<", 160)], 3), ([("d", ">", 1e9)], 0), ([("i", "=", 5000)], 0), ([("s", "=", "none")], 3), ([("b", "=", 3)], total)]:
        got = sorted(r.i for r in read_shards(spark, folder, where=where).collect())
        meets = {"=": lambda x, v: x == v, "in": lambda x, v: x in v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, ">": lambda x, v: x > v}
        assert got == [r[0] for r in rows if all(meets[op](dict(zip("isdb", r, strict=True))[c], v) for c, op, v in where)] and opened(where) <= most, where
    got = read_shards(spark, folder, columns=["d"], samples=[5, range(100, 103), 1999], where=[("i", ">", 50)])
    assert got.columns == ["sample_id", "shard_id", "d"] and got.count() == 4
    with pytest.raises(ValueError):
        read_shards(spark, folder, where=[("i", "like", 1)])
    with pytest.raises(ValueError):
        write_shards(frame.withColumn("a", F.array("i")), folder, summaries=["a"])


def test_summaries_never_rule_out_what_is_there():
    rng = random.Random(3)
    for values in ([rng.randrange(-50, 50) for _ in range(40)], [rng.random() for _ in range(40)], ["x" * rng.randrange(200) + str(rng.randrange(9)) for _ in range(40)], [float("nan"), 1.5, -2.0], [None, "a"], [2**60, -(2**60)], [True]):
        of = {"values": {"c": summary(pa.array(values))}}
        for v in (x for x in values if x is not None):
            assert all(may_match(of, [("c", op, v)]) for op in ("=", "<=", ">=")) and may_match(of, [("c", "in", ["zz" if isinstance(v, str) else -7, v])])
    assert not may_match({"values": {"c": summary(pa.array([None], pa.int64()))}}, [("c", "=", 1)]) and may_match({}, [("c", "=", 1)]) and may_match({"values": {"c": summary(pa.array([1]))}}, [("c", "=", "1")]) in (True, False)


def test_small_shards_share_tasks(spark, tmp_path):
    folder = write_shards(spark.range(3000).repartition(2), f"file://{tmp_path}/out", size_limit="1kb")
    n = len(read_index(folder))
    parts = lambda **more: ShardReader({"path": folder, **more}, spark.range(1).schema).partitions()
    assert n > 20 and len(parts()) == 1 and len(parts(tasks="4")) in (4, 5) and len(parts(task_bytes="1")) == n
    assert read_shards(spark, folder).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert [r.sample_id for r in read_shards(spark, folder).orderBy("sample_id").collect()] == list(range(3000))


# Lines by position


@pytest.mark.parametrize("compression", ["", "gz"])
@pytest.mark.parametrize("kind", ["json", ",", "|"])
def test_lines_by_position(spark, tmp_path, kind, compression):
    rows = [(i, f"é{i}", i / 4) for i in range(400)]
    frame = spark.createDataFrame(rows, "i long, s string, d double").coalesce(1)
    write = lambda f, **o: write_json_lines(frame, f, **o) if kind == "json" else write_separated(frame, f, kind, **o)
    folder = write(f"file://{tmp_path}/out", size_limit="1kb", compression=compression)
    assert len(read_index(folder)) > 5
    got = read_by_index(spark, folder, samples=[3, range(50, 120), 399, 5000]).select("sample_id", "i", "s", "d").collect()
    assert sorted(map(tuple, got)) == [(i, *rows[i]) for i in [3, *range(50, 120), 399]]
    assert sorted(map(tuple, read_by_index(spark, folder).select("i", "s", "d").collect())) == rows
    with pytest.raises(IndexError):
        lines_at(folder, read_index(folder)[0], 0, 10**6)


def test_only_the_bytes_of_lines_are_read(spark, tmp_path, monkeypatch):
    from epochweave.sources import lines as L

    folder = write_json_lines(spark.range(5000).coalesce(1), f"file://{tmp_path}/out")
    read, real = [], L.filesystem

    class Counted:
        def __init__(self, files):
            self.files = files

        def open_input_file(self, path):
            file = self.files.open_input_file(path)
            return type("F", (), {"read_at": lambda _, n, at: read.append(n) or file.read_at(n, at), "__enter__": lambda s: s, "__exit__": lambda *a: file.close()})()

    monkeypatch.setattr(L, "filesystem", lambda f: (Counted(real(f)[0]), real(f)[1]))
    reader = LineReader({"path": folder, "samples": "[[4000, 4003]]"}, None)
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert [r["line"] for b in rows for r in b.to_pylist()] == [f'{{"id":{i}}}' for i in range(4000, 4003)] and sum(read) < 100


# Plans of stored streams


def stored(spark, tmp_path, **more):
    """Three streams of 40, 64 and 24 rows in shards of 7; the last has a column more."""
    rows = [(k, i // 7, i, f"{k}{i}") for k, n in (("a", 40), ("b", 64), ("c", 24)) for i in range(n)]
    frame = spark.createDataFrame(rows, "s string, n long, i long, t string")
    root = f"file://{tmp_path}/streams"
    write_shards(frame.where("s <> 'c'"), root, {"i": "int64", "t": "str"}, stream="s", number="n", order=["i"])
    write_shards(frame.where("s = 'c'").withColumn("x", F.col("i") * 2), root, {"i": "int64", "t": "str", "x": "int64"}, stream="s", number="n", order=["i"])
    planner = Planner.of_folders(spark, {k: f"{root}/{k}" for k in "abc"}, **({"batch_size": 4, "world": World(2, 2, 1), "canonical": 2, "seed": 3, "block_size": 20} | more))
    return planner, [r[3] for r in rows]


def test_shards_of_indexes(spark, tmp_path):
    planner, texts = stored(spark, tmp_path)
    for p in Path(tmp_path).rglob("*.mds*"):
        p.unlink()  # a plan needs no rows
    rows = planner.shards.orderBy("shard_id").collect()
    assert [r.shard_id for r in rows] == list(range(20)) and [r.first_sample for r in rows] == [sum(r.n for r in rows[:i]) for i in range(20)] and [r.stream_id for r in rows] == [0] * 6 + [1] * 10 + [2] * 4
    plan = planner.epoch(0).collect()
    assert sorted(r.sample_id for r in plan if r.sample_id >= 0) == list(range(128)) and len(texts) == 128


@pytest.mark.parametrize("batching", ["random", "stratified", "per_stream", "device_per_stream"])
def test_gathered_rows_are_those_of_the_plan(spark, tmp_path, batching):
    planner, texts = stored(spark, tmp_path, batching=batching, weights=[Weight(repeat=2), Weight(repeat=0.5), Weight(repeat=1)])
    plan = {r.order: r for r in planner.epoch(1).where("sample_id >= 0").collect()}
    rows = planner.gathered(1, validate=None).collect()
    assert len(rows) == len(plan) == len({r.order for r in rows})
    for r in rows:
        assert all(r[c] == plan[r.order][c] for c in planner.epoch(1).columns) and r.t == texts[r.sample_id] and (r.x is None) == (r.stream_id < 2) and (r.x is None or r.x == 2 * r.i)
    assert planner.gathered(1, ["t"]).columns == [*planner.epoch(1).columns, "t"]
    rest = {r.order for r in planner.gathered(0, ["t"], Resume(1, 32, 2, 3, 2)).collect()}
    assert len(rest) <= len(plan) - 24


def test_gather_shuffles_numbers_only(spark, tmp_path):
    planner, texts = stored(spark, tmp_path)
    plan = spark.createDataFrame([(k, s) for k, s in enumerate([5, 5, 127, 0, 64, -1, 500])], "k long, sample_id long")
    rows = gathered(plan, planner.shards, ["t"])
    assert sorted((r.k, r.t) for r in rows.collect()) == [(k, texts[s]) for k, s in enumerate([5, 5, 127, 0, 64])]
    tree = rows._jdf.queryExecution().executedPlan().toString()
    above = tree.split("MapInArrow")[0]
    assert "Exchange" not in above  # what is shuffled is below: places, and entries of the index
    for wrong in (["nothing"], ["k"]):
        with pytest.raises(ValueError):
            gathered(plan.withColumn("t", F.lit(1)) if wrong == ["k"] else plan, planner.shards, None if wrong == ["k"] else wrong)
    with pytest.raises(ValueError):
        gathered(plan, planner.shards.limit(0))


@pytest.mark.parametrize("world", [World(2, 2, 1), World(1, 3, 2)])
def test_a_feed_in_plan_order_goes_on_after_a_stop(spark, tmp_path, world):
    planner, texts = stored(spark, tmp_path, world=world, weights=[Weight(repeat=1.5), Weight(repeat=1), Weight(repeat=1)])
    folder = write_plan(planner, f"file://{tmp_path}/plan", [1, 2], chunk=32)
    batches = {}

    def take(df, number):
        batches[number] = df.collect()  # a batch that is under way at the stop comes again

    def start():
        return plan_feed(spark, folder, max_samples=50, query="train").writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/check").start()

    query, began = start(), time.time()
    while len(batches) < 2 and query.isActive and time.time() - began < 60:
        time.sleep(0.1)
    query.stop()
    query = start()
    query.processAllAvailable()
    query.stop()
    seen = [(r.epoch, r.order, r.node, r.rank, r.worker, r.sample_id, r.t) for b in batches.values() for r in b]
    want = [(e, r.order, r.node, r.rank, r.worker, r.sample_id, texts[r.sample_id]) for e in (1, 2) for r in planner.epoch(e).where("sample_id >= 0").orderBy("order").collect()]
    assert sorted(seen) == sorted(want) and len(seen) == len(set(x[:2] for x in seen))
    assert all(len(b) <= 50 for b in batches.values()) and len(batches) > 4
    for b in batches.values():  # within a worker in order
        own: dict = {}
        for r in b:
            own.setdefault((r.node, r.rank, r.worker), []).append((r.epoch, r.order))
        assert all(v == sorted(v) for v in own.values())


# Contents, accents and pieces of words


def test_contents_by_path(spark, tmp_path):
    rows = [(i, f"d{i % 5}/{i}.bin", bytes([i % 256]) * (i * 7)) for i in range(300)]
    frame = spark.createDataFrame(rows, "i long, path string, content binary").repartition(3)
    folder = f"file://{tmp_path}/files"
    assert write_contents(frame, "path", "content", folder) == 300
    asked = spark.createDataFrame([(i, p) for i, p, _ in rows[::3]] + [(900, "none/x.bin"), (901, None)], "i long, path string").repartition(2)
    for p in Path(tmp_path, "files").rglob("1.bin"):
        p.chmod(0)  # no row asks for it
    want = [(i, c) for i, _, c in rows[::3]] + [(900, None), (901, None)]
    got = external_content(asked, "path", folder)
    assert sorted((r.i, None if r.content is None else bytes(r.content)) for r in got.collect()) == want
    assert "binaryFile" not in got._jdf.queryExecution().toString() and "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    places = pack_contents(frame, "path", "content", f"file://{tmp_path}/packed")
    got = external_content(asked, "path", f"file://{tmp_path}/packed", places)
    assert sorted((r.i, None if r.content is None else bytes(r.content)) for r in got.collect()) == want and len(list(Path(tmp_path, "packed").iterdir())) <= 3


def test_accents_go_natively(spark):
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x900, 0xE00), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC40), 0xD7A3, 0xF900, 0x1D15E, 0x2F800, 0x1F600]]
    texts = ["", None, "plain", "각한글", "ệ", "ệ", *["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(300)]]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.without_accents(F.col("t")).alias("x"))
    got = {r.i: r.x for r in frame.collect()}
    bad = [(t, w, got[i]) for i, (t, w) in enumerate(zip(texts, want, strict=True)) if got[i] != w]
    assert not bad, bad[:3]
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def longest_first(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return None
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def test_pieces_are_those_of_longest_first():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab#") for _ in range(rng.randrange(1, n)))
    for _ in range(300):
        vocabulary = {("##" if rng.random() < 0.6 else "") + some(5) for _ in range(rng.randrange(1, 25))}
        pieces = X.Pieces(vocabulary)
        for _ in range(60):
            word = some(14)
            assert pieces.split(word) == longest_first(word, vocabulary), (word, vocabulary)


def test_registered_wordpieces_against_longest_first(spark):
    from epochweave.queries import QUERIES
    from epochweave.text_queries import _vocabulary

    sf, vocabulary = "/root/testdata/sf0.001", set(_vocabulary())
    got = {r.doc_id: r for r in QUERIES["f12_wordpieces"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.basic_tokens(F.col("text"), accents=False, keep=["[MASK]"]).alias("t")).collect()
    known: dict = {}
    for d in docs:
        cut = [known.setdefault(w, (longest_first(w, vocabulary) if len(w) <= 200 else None) or ["[UNK]"]) for w in d.t or []]
        flat = [p for c in cut for p in c]
        if d.t is not None:
            assert (got[d.doc_id].pieces, got[d.doc_id].unknown) == (len(flat), flat.count("[UNK]"))
    assert len(got) == len(docs) > 100


def test_shards_as_rows_of_an_index(spark, tmp_path):
    a = write_shards(spark.range(10).coalesce(1), f"file://{tmp_path}/a", size_limit="600b")
    rows = indexed_shards(spark, {"one": a, "same": a}).orderBy("shard_id").collect()
    assert sum(r.n for r in rows) == 20 and [r.stream_id for r in rows] == sorted(r.stream_id for r in rows) and rows[-1].first_sample + rows[-1].n == 20


@pytest.mark.parametrize("name", ["r7_shard_pruning", "r3_json_access", "r4_separated_access"])
def test_rows_by_position_are_written_by_many_tasks(spark, monkeypatch, tmp_path, name):
    """Ranges of keys in the index's order, none of which holds all rows."""
    from epochweave import storage_queries
    from epochweave.queries import QUERIES

    folder = f"file://{tmp_path}/rows"
    monkeypatch.setattr(storage_queries, "shared_folder", lambda *_: folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES[name](spark, "/root/testdata/sf0.01").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = Counter()
    for shard in read_index(folder):
        tasks[shard["raw_data"]["basename"].split("/")[0]] += shard["samples"]
    assert len(tasks) == 3 and max(tasks.values()) < sum(tasks.values()) / 2


def test_a_feed_looks_at_the_entries_once(spark, tmp_path, monkeypatch):
    """However many chunks of the plan a partition goes through."""
    from epochweave.feeds import plan_feed as P

    planner, texts = stored(spark, tmp_path, world=World(2, 2, 1))
    folder = write_plan(planner, f"file://{tmp_path}/plan", [1], chunk=16)
    looks, dataset = [], P.ds.dataset

    class Seen:
        def __init__(self, of):
            self.of = of

        def to_table(self, **more):
            looks.append(1)
            return self.of.to_table(**more)

    monkeypatch.setattr(P.ds, "dataset", lambda path, **more: Seen(dataset(path, **more)) if path.endswith("entries") else dataset(path, **more))
    reader = P.PlanFeedReader({"path": folder})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(rows) >= 128 and all(r["t"] == texts[r["sample_id"]] for r in rows)
    assert len(looks) == len(parts) == 4
