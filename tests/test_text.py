"""Words, segment pairs, training times, settings and simulations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochweave.functions import text as X
from epochweave.functions.units import TrainingTime
from epochweave.operators.analysis import rolling_throughput, simulation_stats
from epochweave.operators.bert import as_bytes, chunks, cut_pair, frequent_words, instances, mask
from epochweave.operators.settings import settings_of
from epochweave.operators.simulate import Fetching, batches_of, downloads, simulate
from epochweave.queries import QUERIES


def test_wordpieces(spark):
    vocabulary = {"sea", "##shore", "##line", "##s", "line", "s"}
    df = spark.createDataFrame([(["seashoreline", "line", "zebra", "s" * 201, "seax", "ss"],), ([],), (None,)], "t array<string>").coalesce(1)
    assert [r.p for r in df.select(X.wordpieces(F.col("t"), vocabulary).alias("p")).collect()] == [["sea", "##shore", "##line", "line", "[UNK]", "[UNK]", "[UNK]", "s", "##s"], [], None]
    words = spark.createDataFrame([("Seashoreline, Líne!",)], "s string").select(X.basic_tokens(F.col("s"), accents=False).alias("t"))
    assert words.first().t == ["seashoreline", ",", "line", "!"] and words.select(X.wordpieces(F.col("t"), vocabulary | {",", "!"}).alias("p")).first().p == ["sea", "##shore", "##line", ",", "line", "!"]
    both = spark.createDataFrame([("Gö [MASK] Nöw",)], "s string").select(X.basic_tokens(F.col("s"), accents=False, keep=["[MASK]"]).alias("t"))
    assert both.first().t == ["go", "[MASK]", "now"]
    kept = spark.createDataFrame([("Go [MASK] Now",)], "s string").select(X.basic_tokens(F.col("s"), keep=["[MASK]"]).alias("t"))
    assert kept.first().t == ["go", "[MASK]", "now"]


def test_cut_pairs():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([f"{k}{i}" for i in range(rng.randrange(30))] for k in "ab")
        most = rng.randrange(0, 50)
        x, y = cut_pair(a, b, most, rng)
        assert len(x) + len(y) == min(most, len(a) + len(b)) and "".join(x) in "".join(a) and "".join(y) in "".join(b)
        if len(a) + len(b) > most:
            assert abs(len(x) - len(y)) <= 1 or min(len(x), len(y)) == min(len(a), len(b))


def test_masks_and_chunks():
    rng = random.Random(2)
    changed = []
    for _ in range(300):
        tokens = ["[CLS]", *[f"t{i}" for i in range(rng.randrange(1, 60))], "[SEP]"]
        out, places, labels = mask(tokens, 0.15, 5, ["w"], rng)
        assert len(places) == min(5, max(1, round(len(tokens) * 0.15))) and [tokens[p] for p in places] == labels and places == sorted(places)
        assert all(o == t for i, (o, t) in enumerate(zip(out, tokens, strict=True)) if i not in places)
        changed += [out[p] for p in places]
    assert 0.7 < changed.count("[MASK]") / len(changed) < 0.9 and changed.count("w") > 0
    sentences = [[f"s{i}"] * 4 for i in range(40)]
    made = list(chunks(sentences, 20, 0.2, rng))
    seen = [t for a, b, _ in made for t in dict.fromkeys(a + (b or []))]
    assert seen == [f"s{i}" for i in range(40)]  # every sentence once: what an outside segment displaces comes again
    assert {b is None for _, b, _ in made} == {True, False}


def test_random_segments_come_from_other_documents(spark):
    docs = spark.createDataFrame([(i, [[f"d{i}", f"x{i}"]] * 30) for i in range(20)] + [(90, []), (91, None)], "doc_id long, sentences array<array<string>>")
    words = frequent_words(docs, 15)
    assert len(words) == 15
    rows = instances(docs, words, length=32).collect()
    assert {r.doc_id for r in rows} == set(range(20)) and 0.3 < sum(r.next_is_random for r in rows) / len(rows) < 0.8
    for r in rows:
        at = r.tokens.index("[SEP]")
        full = dict(zip(r.positions, r.labels, strict=True))
        told = [full.get(i, t) for i, t in enumerate(r.tokens)]
        first, second = {t[1:] for t in told[1:at]}, {t[1:] for t in told[at + 1 : -1]}
        assert first == {str(r.doc_id)} and len(second) == 1 and (second != first) == r.next_is_random and len(told) <= 32 and len(r.segment) == len(told)
    assert sorted(map(tuple, instances(docs.repartition(5), words, length=32).select("doc_id", "copy", "number").collect())) == sorted((r.doc_id, r.copy, r.number) for r in rows)
    packed = as_bytes(instances(docs, words, length=32), ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *words], 32, 20).first()
    assert [len(packed[c]) for c in packed.__fields__] == [128, 128, 128, 80, 80, 80, 4]
    alone = instances(docs.where("doc_id = 3"), words, length=32).collect()
    assert alone and all(t[1:] == "3" for r in alone for t in r.labels)


def test_pairs_as_bytes_hold_their_rows(spark):
    """Each row's bytes, read by NumPy, beside a plain loop over the row that they come from. Rare words have no id of their own."""
    docs = spark.createDataFrame([(i, [[f"w{(i * j) % 23}" for j in range(k % 6 + 1)] for k in range(25)]) for i in range(12)], "doc_id long, sentences array<array<string>>")
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *frequent_words(docs, 12)]
    pairs = instances(docs, words[5:], length=24, most=4).coalesce(1)
    number = {w: i for i, w in enumerate(words)}
    want = []
    for r in pairs.collect():
        row = {n: [0] * 24 for n in ("input_ids", "input_mask", "segment_ids")} | {n: [0] * 4 for n in ("masked_lm_positions", "masked_lm_ids", "masked_lm_weights")}
        for i, t in enumerate(r.tokens):
            row["input_ids"][i], row["input_mask"][i], row["segment_ids"][i] = number.get(t, 1), 1, r.segment[i]
        for i, (p, t) in enumerate(zip(r.positions, r.labels, strict=True)):
            row["masked_lm_positions"][i], row["masked_lm_ids"][i], row["masked_lm_weights"][i] = p, number.get(t, 1), 1
        want.append(row | {"next_sentence_labels": [int(r.next_is_random)]})
    got = [{n: np.frombuffer(b, "<f4" if n == "masked_lm_weights" else "<i4").tolist() for n, b in r.asDict().items()} for r in as_bytes(pairs, words, 24, 4).collect()]
    assert sorted(got, key=str) == sorted(want, key=lambda r: str({n: list(map(float, v)) if n == "masked_lm_weights" else v for n, v in r.items()})) and len(got) > 50
    assert any(1 in r["input_ids"] for r in got) and any(0 in r["input_mask"] for r in got)


def test_wordpieces_in_parts(spark, monkeypatch):
    """Rows handled a few tokens at a time, with nulls, empty ones and ones of several parts among them, are as all at once."""
    rows = [(i, None if i % 7 == 3 else [("seashore", "line", "shs", "")[(i + j) % 4] for j in range(i % 7 * (i % 3))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, t array<string>").coalesce(1)
    made = []
    for at_once in (X.AT_ONCE, 5):
        monkeypatch.setattr(X, "AT_ONCE", at_once)
        made.append([r.p for r in df.orderBy("i").select(X.wordpieces(F.col("t"), {"sea", "##shore", "line", "s"}).alias("p")).collect()])
    assert made[0] == made[1] and made[0][3] is None and ["sea", "##shore"] == made[0][4][:2]


def test_sentences_as_lines(spark):
    """Beside basic_tokens() of each sentence; pairs from lines are those from arrays, and the queries' plans tokenize nothing a second time."""
    texts = ["A.  b.\x00 c.\x0bd.\ne", "", None, ". \u4e2d\u6587. x\u00ad\ufffd\u00a0y!", "\x00.", "ΑΣ. ΑΣ.\x00Β \U00020001z", "one two. " * 40 + "three " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    arrays = docs.select("doc_id", F.transform(F.split("text", r"(?<=\.)\s"), lambda s: X.basic_tokens(s)).alias("sentences"))
    lines = docs.select("doc_id", X.sentence_lines(F.col("text")).alias("sentences"))
    split = F.transform("sentences", lambda s: F.filter(F.split(s, " "), lambda t: t != ""))
    assert sorted(lines.select("doc_id", split).collect()) == sorted(arrays.collect())
    words = frequent_words(arrays)
    assert frequent_words(lines) == words
    made = [sorted(map(str, instances(d, words, length=32).collect())) for d in (arrays, lines)]
    assert made[0] == made[1] and len(made[0]) > 10
    for name in ("t2_segment_pairs", "c3_segment_pairs_as_bytes"):
        assert "regexp_replace" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_training_times():
    t = TrainingTime.of
    assert t("3ep") < t("4ep") and t("2ba") + 3 == t("5ba") and t("10ba") / t("4ba") == 2.5 and t("7ba") % 4 == t("3ba") and t("2ep") * 3 == t("6ep") and str(t("0.5dur")) == "0.5dur"
    for bad in ("3", "x", "1.5ep", "-1ba"):
        with pytest.raises(ValueError):
            t(bad)
    with pytest.raises(ValueError):
        assert t("3ep") < t("3ba")
    assert batches_of(3, "ep", 10) == (10, 3, 30) and batches_of(25, "ba", 10) == (10, 3, 25) and batches_of(4, "ba", 10) == (4, 1, 4)
    with pytest.raises(ValueError):
        batches_of(1, "tok", 10)


def test_settings():
    got = settings_of('{"compute": {"gpus": 16}, "parameters": {"global_train_batch_size": 64, "max_duration": "20ba", "train_loader": {"num_workers": 8, "dataset": {"shuffle": true, "own_kwargs": {"seed": 3}}}}}')
    assert (got.devices, got.workers, str(got.duration), got.global_batch, got.data) == (16, 8, "20ba", 64, {"shuffle": True, "seed": 3})
    got = settings_of({"batch_size": 8, "max_duration": 2, "train_dataset": {"x": 1}})
    assert (got.devices, got.workers, str(got.duration)) == (None, 1, "2ep")
    pytest.importorskip("yaml")
    assert settings_of("batch_size: 8\ntrainer:\n  max_duration: 3ep\ndataset:\n  train_dataset:\n    x: 1\n    dataloader_kwargs:\n      num_workers: 4").workers == 4
    for bad in ({"batch_size": 8, "max_duration": 2}, {"batch_size": 8, "train_dataset": {}}, {"batch_size": 8, "max_duration": "5tok", "train_dataset": {}}, {"max_duration": 2, "train_dataset": {}}):
        with pytest.raises(ValueError):
            settings_of(bad)


def test_downloads():
    f = Fetching(100.0, None)
    assert f.needed([(1, 50), (2, 150)]) == (2.0, 200) and f.needed([(1, 50)]) == (0.0, 0)
    assert f.ahead([(1, 50), (3, 80), (4, 100)], 1.0) == 80 and f.partial == 20.0
    assert f.needed([(4, 100)]) == (0.8, 100)  # what was there already doesn't count again


def test_the_slowest_node_sets_the_step(spark):
    uses = [(n, b, 10 * n + b, 100 * (n + 1), b) for n in range(2) for b in range(6)]
    df = spark.createDataFrame(uses, "node long, batch long, shard_id long, size long, order long").repartition(3)
    rows = {(r.node, r.batch): r for r in simulate(df, 0.5, 100.0).collect()}
    assert all(rows[n, b].step_seconds == rows[1 - n, b].step_seconds for n in range(2) for b in range(6))
    assert rows[0, 0].step_seconds == 2.5 and rows[1, 0].waits and not rows[0, 0].waits
    ahead = downloads(df, 2.0, 100.0, None, 2).collect()
    assert sum(r.fetched_bytes + r.ahead_bytes for r in ahead) == 6 * 300
    waits = {(r.node, r.batch): r.wait_seconds for r in ahead}
    assert all(waits[0, b] == 0 for b in range(1, 6)) and all(waits[1, b] == 0 for b in range(1, 6))
    small = downloads(df.withColumn("shard_id", F.col("batch") % 2), 0.5, 100.0, 150, 0).where("node = 0").collect()
    assert sum(r.fetched_bytes for r in small) == 600  # a cache of one shard keeps none of two


def test_throughput_in_blocks_is_that_of_the_series(spark, monkeypatch):
    from epochweave.operators import analysis

    monkeypatch.setattr(analysis, "BLOCK", 16)
    values = [random.Random(i).random() + 0.1 for i in range(100)]
    df = spark.createDataFrame([(3 * i, v) for i, v in enumerate(values)], "k long, s double").repartition(4)
    got = [r.per_second for r in rolling_throughput(df, "k", "s", 10).orderBy("k").collect()]
    assert len(got) == 100 and all(g == 0 for g in got[:9]) and all(abs(got[i] - 10 / sum(values[i - 9 : i + 1])) < 1e-9 for i in range(9, 100))
    stats = simulation_stats(df, "k", "s", 0.6, 5).first()
    slow = [i for i, v in enumerate(values) if v > 0.6]
    warm = max([i + 1 for i in slow if i < 5], default=0)
    assert (stats.slow_steps, stats.warmup_steps, stats.later_drops) == (len(slow), warm, sum(i >= warm for i in slow))
