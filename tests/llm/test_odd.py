"""Operators on odd tables: columns with clashing names, very long texts and vectors, conversations of many turns, repeated rows."""

import base64
import hashlib
import random

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from epochweave.llm.chat import format_chats, read_chats
from epochweave.llm.cover_tree import embedding_near_dedup
from epochweave.llm.decontaminate import contaminated_passages, without_contaminated
from epochweave.llm.packing import best_fit_packing
from epochweave.llm.quality import classify_quality, fit
from epochweave.llm.queries import END_OF_DOCUMENT, VOCABULARY
from epochweave.llm.token_counts import document_token_counts
from epochweave.llm.vocabulary import PATTERN

#: Names that the operators themselves give to columns on the way.
CLASHING = ("n_links", "component_id", "kept", "part", "unit", "score", "held_out", "predicted", "n_tokens", "file", "place", "hit", "item_id", "distance", "bin_id", "piece", "cluster", "site", "window", "tokens", "loss", "n_repeated")


def clashing(df):
    return df.select("*", *[F.lit("odd").alias(n) for n in CLASHING if n not in df.columns])


def rows(df):
    return sorted(map(repr, df.collect()))


def test_vectors_of_many_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3000))
    x = np.concatenate([x, x[:20] + 0.3 * rng.normal(size=(20, 3000)), x[:10] + 0.9 * rng.normal(size=(10, 3000)), x[:5]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_near_dedup(frame).collect()}
    assert got == dict(enumerate(links.sum(1).tolist())) and links.sum() >= 40
    assert rows(embedding_near_dedup(clashing(frame))) == rows(embedding_near_dedup(frame))


def ascended(d, ridge):
    """Weights of the logistic loss on differences by plain gradient ascent."""
    w = np.zeros(d.shape[1])
    rate = 1 / (0.25 * np.linalg.eigvalsh(d.T @ d)[-1] + ridge)
    for _ in range(4000):
        w += rate * (d.T @ (1 / (1 + np.exp(d @ w))) - ridge * w)
    return w


def test_fit_is_what_plain_ascent_finds():
    """With one row of each label, every pair is the same difference, so that the pairs drawn are known."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2, 4))
    model = fit(x, np.array([1, 0]), pairs=50, ridge=3.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose(model.weights, ascended(np.repeat(z[:1] - z[1:], 50, axis=0), 3.0), atol=1e-4)
    # with many rows the order that pairs are drawn in hardly matters
    x = rng.normal(size=(400, 3))
    good = (x @ [2.0, -1.0, 0.0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    model = fit(x, good)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    d = z[rng.choice(np.flatnonzero(good == 1), 30_000)] - z[rng.choice(np.flatnonzero(good == 0), 30_000)]
    plain = ascended(d, 3.0)
    assert model.weights @ plain / np.linalg.norm(model.weights) / np.linalg.norm(plain) > 0.999


def test_quality_whatever_columns_are_called(spark):
    docs = spark.createDataFrame([(i, ("good words in a row. " if i % 2 else "#### $$$ 111 ") * (i % 7 + 1)) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    plain = classify_quality(docs, labels)
    assert rows(classify_quality(clashing(docs).withColumn("quality", F.lit(1) - F.col("doc_id") % 2), clashing(labels).withColumn("text", F.lit("x")))) == rows(plain)
    assert all(r.predicted == r.doc_id % 2 for r in plain.collect())


def test_tokens_of_a_very_long_text(spark):
    texts = ["word " * 400_000, "x" * 100_000, "a b", "a b"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = document_token_counts(clashing(frame), VOCABULARY, END_OF_DOCUMENT, block_tokens=5000)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(encode(t)) for i, t in enumerate(texts)}


def test_passages_in_a_very_long_text(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)]
    filler = [word() for _ in range(250_000)]
    text = " ".join([*filler[:120_000], items[3][1], *filler[120_000:], items[5][1]])
    frame = spark.createDataFrame([(1, text), (2, " ".join(filler[:90_000])), (3, items[3][1]), (3, items[3][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.begin_word) for r in contaminated_passages(clashing(frame), clashing(bench)).collect())
    assert got == [(1, 3, 0, 120_000), (1, 5, 0, 250_030), (3, 3, 0, 0), (3, 3, 0, 0)]
    left = without_contaminated(clashing(frame), clashing(bench))
    assert [r.doc_id for r in left.collect()] == [2] and left.columns == clashing(frame).columns


def test_packing_whatever_columns_are_called(spark):
    frame = spark.createDataFrame([(i, "w " * (i % 50 + 1), f"s{i % 9}") for i in range(200)], "doc_id long, text string, source string")
    assert rows(best_fit_packing(clashing(frame), 64)) == rows(best_fit_packing(frame, 64))


def test_a_conversation_of_many_turns(spark):
    turns = [(7, t, ("user", "assistant")[t % 2], f"turn {t} <|im_end|> " + "é" * (t % 5)) for t in range(20_000)]
    frame = spark.createDataFrame([*turns, (8, 0, "assistant", "short")], "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in read_chats(format_chats(clashing(frame), VOCABULARY, budget=200, history=50)).collect()}
    said = "".join(t for _, _, role, t in turns if role == "assistant")
    assert got[7].n_turns == 20_000 and got[7].loss_chars == len(said) and got[7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest() and got[8].n_turns == 1
