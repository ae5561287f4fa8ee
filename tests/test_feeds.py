"""Feeds, ingestion and windows of event time, and the other extension points."""

import pytest

from epochweave.operators.convert import as_layout, images_with_boxes, write_converted
from epochweave.sources.registry import build, retry, source
from epochweave.sources.shards import read_shards, write_shards
from epochweave.feeds.events import sessions, windowed_counts, without_repeats
from epochweave.feeds.feed import EpochReader, epoch_feed, ingest

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_feed_gives_each_sample_once_an_epoch(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    write_shards(spark.range(25).withColumnRenamed("id", "n").coalesce(1), folder, size_limit="1kb")
    seen = []
    take = lambda df, _: seen.append(sorted((r.epoch, r.sample_id, r.row) for r in df.collect()))

    def run(epochs):
        epoch_feed(spark, folder, epochs).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    run(2)
    run(2)  # again, with nothing new
    run(3)
    rows = [r for batch in seen for r in batch]
    assert [r[:2] for r in rows] == [(e, i) for e in range(3) for i in range(25)] and rows[3][2] == '{"n": 3}'


def test_an_epoch_is_read_in_order_and_gone_on_with(spark):
    from epochweave.plans.epoch import Planner, samples_of
    from epochweave.plans.world import World

    rows = spark.range(40).selectExpr("id as k", "id * 10 as v", "'s' as stream")
    planner = Planner(samples_of(rows, "stream", "k", 7), world=World(1, 2, 1), batch_size=2, seed=3, block_size=9)
    readers = [EpochReader(planner, rows.select("k", "v"), "k", rank=rank) for rank in range(2)]
    first = [[r.v for r in reader] for reader in readers]
    assert sorted(v for of in first for v in of) == [10 * i for i in range(40)] and readers[0].state().epoch == 0
    second, seen = readers[0], []
    for row in second:
        seen.append(row.v)
        if len(seen) == 4:
            break
    state = second.state()
    assert (state.epoch, state.sample_in_epoch) == (1, 8) and seen != first[0][:4]
    rest = [r.v for r in EpochReader(planner, rows.select("k", "v"), "k", resume=state)]
    assert len(seen + rest) == len({*seen, *rest}) == 20


def test_ingest_takes_each_file_once(spark, tmp_path):
    source_dir, out, seen = f"{tmp_path}/in", f"{tmp_path}/out", []
    take = lambda: ingest(spark, source_dir, "id long", f"{tmp_path}/c", lambda df, n: seen.append(df.count()) or df.write.mode("append").parquet(out))
    spark.range(10).write.parquet(source_dir)
    take()
    spark.range(10, 14).write.mode("append").parquet(source_dir)
    take()
    take()
    assert spark.read.parquet(out).count() == 14 and sum(seen) == 14


def test_event_windows(spark):
    events = spark.read.parquet(EVENTS)
    n = events.count()
    assert sum(r.n for r in windowed_counts(events).collect()) == n == sum(r.n for r in sessions(events).collect())
    assert sum(r.n for r in windowed_counts(events, slide="30 minutes").collect()) == 2 * n
    stream = spark.readStream.schema(events.schema).parquet(EVENTS.rsplit("/", 1)[0] + "/event*.parquet")
    query = without_repeats(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == events.dropDuplicates(["event_id"]).count()


def test_extension_points(spark, tmp_path):
    @source("numbers")
    def numbers(spark, n):
        return spark.range(n)

    assert build("numbers", spark, n=3).count() == 3
    with pytest.raises(KeyError):
        build("none", spark)
    calls = []

    @retry((ValueError,), 3, 0, 0)
    def late():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return 7

    assert late() == 7
    docs = spark.createDataFrame([("a", "x"), (None, "y")], "body string, url string")
    assert [tuple(r) for r in as_layout(docs, "plain_text", text="body").collect()] == [("a",), ("",)]
    folder = f"file://{tmp_path}/converted"
    write_converted(spark.range(4), folder, {"n": "int", "s": "str"}, lambda pdf: [{"n": int(i), "s": "x" * i} for i in pdf["id"] if i], "n long, s string")
    assert sorted((r.n, r.s) for r in read_shards(spark, folder).collect()) == [(1, "x"), (2, "xx"), (3, "xxx")]
    images = spark.createDataFrame([(1, b"a", 10, 20), (2, b"b", 10, 20)], "img_id long, img binary, htot int, wtot int")
    boxes = spark.createDataFrame([(1, "cat", 2.0, 1.0, 4.0, 5.0)], "img_id long, class_name string, left double, top double, width double, height double")
    out = images_with_boxes(images, boxes, spark.createDataFrame([("cat", 3)], "class_name string, class_id int")).collect()
    assert len(out) == 1 and out[0].bbox_sizes == [[0.1, 0.1, 0.3, 0.6]] and out[0].bbox_labels == [3]


def test_layouts_and_transforms(spark):
    from epochweave.operators.convert import LAYOUTS, transformed

    assert len(LAYOUTS["captioned_image"]) == 14 and len(LAYOUTS["video"]) == len(LAYOUTS["segment_pair"]) == 7
    rows = spark.createDataFrame([(None, float("nan"), None, b"x")], "nsfw string, width double, similarity double, jpg binary")
    for n, kind in LAYOUTS["captioned_image"].items():
        if n not in rows.columns:
            rows = rows.selectExpr("*", f"cast(null as {'string' if kind == 'str' else 'int'}) as {n}")
    out = as_layout(rows, "captioned_image").first()
    assert out.nsfw == "" and out.width == 0 and out.height == 0 and out.similarity is None and bytes(out.jpg) == b"x"
    assert [r.x for r in transformed(spark.range(3).selectExpr("id as x"), "x long", x=lambda s: s * 2).collect()] == [0, 2, 4]


def test_table_functions_are_bert_chunks(spark):
    import random

    from epochweave.functions.tables import register
    from epochweave.operators.bert import chunks

    docs = [(i, [[f"w{i}"] * (k % 5 + 1) for k in range(i * 3)]) for i in range(12)] + [(90, []), (91, None)]
    register(spark)
    frame = spark.createDataFrame(docs, "doc_id long, sentences array<array<string>>").repartition(3)
    rows = spark.sql("select * from segment_chunks(table({docs}) partition by (doc_id), 20, 7)", docs=frame).collect()
    want = [(i, n, len(a), None if b is None else len(b), t) for i, s in docs for n, (a, b, t) in enumerate(chunks([x for x in s or [] if x], 20, 0.1, random.Random(f"7:{i}")))]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr) and len(want) > 12


def test_nested_ids(spark):
    from epochweave.operators.lookup import nested, take_nested

    rows = spark.range(10).selectExpr("id as at", "id * 10 as v")
    for ids in ([[3, -1], [], [[0]], 3], [], range(2, 5), [range(3), [9]], 7):
        found = [(r.pos, r.v) for r in take_nested(rows, "at", ids, 10).collect()]
        plain = lambda x: (x + 10 if x < 0 else x) * 10 if isinstance(x, int) else [plain(y) for y in x]  # noqa: B023, E731
        assert nested(found, ids) == plain(ids)
    with pytest.raises(IndexError):
        take_nested(rows, "at", [[10]], 10)
