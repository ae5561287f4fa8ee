"""Joins and components against plain versions, and on odd inputs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochweave.llm import components
from epochweave.llm.components import Forest, connected_components
from epochweave.llm.cover_tree import embedding_near_dedup
from epochweave.llm.ngram_join import bands, ngram_jaccard_join
from epochweave.llm.words import Words, shingle_sets


def plain_join(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    inverse, forest = defaultdict(list), Forest()
    for x, s in enumerate(sets):
        overlap = defaultdict(int)
        for g in s:
            for y in inverse[g]:
                overlap[y] += 1
            inverse[g].append(x)
        for y, n in overlap.items():
            if 100 * n >= percent * (len(s) + len(sets[y]) - n):
                forest.join(rows[x][0], rows[y][0])
    return {i: (len(s), forest.root(i)) for (i, _), s in zip(rows, sets, strict=True)}


def families(seed=1):
    rng, texts = random.Random(seed), []
    for n in (2, 3, 6, 9, 10, 20, 40, 150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) for _ in range(40)]
    return list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, "A b"), (9003, "a\tB"), (9004, " \n ")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1 << 19), (5, 80, 1500)])
def test_ngram_join_finds_what_all_pairs_find(spark, k, percent, block):
    rows = families()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent, block).collect()}
    assert got == plain_join(rows, k, percent)


def test_ngram_join_of_odd_tables(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 6), (2, "a b c d", 7), (None, "a b c d", 8)]
    out = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in out if r.doc_id) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(2, None)]
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_hold_all_partners():
    for percent in (80, 90, 99):
        edges = bands(percent, 10_000)
        for low, next_, after in zip(edges, edges[1:], edges[2:], strict=False):
            assert (next_ - 1) * 100 // percent < after and low < next_


def test_words_and_shingles():
    words = Words(pa.array(["The cat  sat\non", None, "aé THE", ""]))
    assert [bytes(words.raw[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)] == ["The", "cat", "sat", "on", "aé", "THE"]
    assert words.first.tolist() == [0, 4, 4, 6, 6] and words.hashes[0] == words.hashes[5] and len(set(words.hashes.tolist())) == 5
    assert [len(s) for s in shingle_sets(pa.array(["a b a b a b", "a", "x" * 3_000_000 + " y z", None]), 3)] == [2, 1, 1, 0]
    many = pa.array([" ".join(f"w{i}" for i in range(200_000))])
    assert len(shingle_sets(many, 3)[0]) == 199_998


@pytest.mark.parametrize("at_once", [400_000, 16])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(90), 1000 + rng.randrange(90)) for _ in range(70)] + [(5000, 5000 + i) for i in range(40)]
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (7, None), (99999, 99999)], "a long, b long").repartition(3)).collect()}
    assert got == {x: forest.root(x) for e in edges if e[0] != e[1] for x in e}


def test_cover_tree_finds_what_all_pairs_find(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16))
    x = np.concatenate([x, rng.normal(size=16) + 0.12 * rng.normal(size=(300, 16)), x[:150] + 0.35 * rng.normal(size=(150, 16)), x[:20]]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    odd = [(90001, None), (90002, []), (90003, [0.0] * 16), (90004, [float("nan")] + [1.0] * 15), (90005, [1.0] * 3), (90006, [2.0] * 3), (90007, [1.0] * 3 + [0.0] * 13), (None, [1.0] * 3), (90008, [None] + [1.0] * 15), (90009, [float("inf")] + [1.0] * 15)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    forest = Forest()
    for a, b in np.argwhere(links).tolist():
        forest.join(a, b)
    for block in (8192, 150):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9, block).collect()}
        assert all(got[i] == (links[i].sum(), forest.root(i), forest.root(i) == i) for i in range(len(x)))
        assert got[90005] == (1, 90005, True) and got[90006] == (1, 90005, False) and got[None] == (0, None, False)
        assert all(got[i] == (0, i, True) for i in (90001, 90002, 90003, 90004, 90007, 90008, 90009))
    assert embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_counts_links_once_where_one_cell_alone_opens_a_task(spark):
    rng = np.random.default_rng(0)
    angle = np.radians(np.concatenate([[0, 46], rng.uniform(-1, 6, 199), rng.uniform(40, 80, 199)]))
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    ids = [r.id for r in spark.range(400).orderBy(F.xxhash64("id"), "id").collect()]  # the first two are the centres
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_near_dedup(frame, 0.9, 200, sample=2).collect()}
    assert got == dict(zip(ids, links.sum(1).tolist(), strict=True))


def test_cover_tree_writes_each_vector_once_however_many_blocks_it_meets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))  # none near another, so that no block can be left out
    x = np.concatenate([x, x[:300] + 0.2 * rng.normal(size=(300, 64)), np.repeat(x[:1], 90, axis=0)]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    forest = Forest()
    for a, b in np.argwhere(links).tolist():
        forest.join(a, b)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4).localCheckpoint()

    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle")}

    before = shuffles()
    out = embedding_near_dedup(frame, 0.9, 40)
    shuffled = sum(n for name, n in shuffles().items() if name not in before)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert got == {i: (links[i].sum(), forest.root(i)) for i in range(len(x))}
    assert shuffled < 3 * x.nbytes
