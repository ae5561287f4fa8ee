"""Quality classifier: a Bradley-Terry ranking of documents.

A document's strength is linear in what its text looks like (shapes of characters, words, repetition). The weights come from
preference pairs, each a labelled good document before a labelled bad one, by the logistic loss on the difference of their
features. A score is the strength through a logistic curve placed so that CUT is the quantile of the training documents'
strengths that leaves below it as many as are labelled bad.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochweave.llm.shared import id_and_text
from epochweave.llm.words import Words, shingle_hashes, slices

CUT = 0.3
SIDE = 8
SPECIAL = "\n .,;:!?'\"-_|/\\()[]{}<>=+*#$%&@~^`"


def _byte_classes() -> tuple[np.ndarray, int]:
    """Lower case, upper case, digit, beyond ASCII, other control, then each special character for itself."""
    of = np.full(256, 4)
    of[97:123], of[65:91], of[48:58], of[128:] = 0, 1, 2, 3
    for i, c in enumerate(SPECIAL):
        of[ord(c)] = 5 + i
    return of, 5 + len(SPECIAL)


def _coarse() -> np.ndarray:
    """For pairs of neighbours: lower, upper, digit, beyond ASCII, blank, stop or comma, other sign."""
    of, _ = _byte_classes()
    out = np.minimum(of, 4)
    out[np.arange(256) >= 128] = 3
    for c in SPECIAL:
        out[ord(c)] = 4 if c in " \n" else 5 if c in ".,;:'-" else 6
    return out


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text, null as empty."""
    words = Words(column)
    raw, offsets, n = words.raw, words.offsets, len(column)
    single, n_single = _byte_classes()
    coarse, rows = _coarse(), []
    every = shingle_hashes(words.hashes, 3)
    lengths = words.ends - words.starts
    for i in range(n):
        text = raw[offsets[i] : offsets[i + 1]]
        a, b = int(words.first[i]), int(words.first[i + 1])
        size, count = max(len(text), 1), max(b - a, 1)
        share = np.bincount(single[text], minlength=n_single) / size
        c = coarse[text]
        pair = np.bincount(c[:-1] * 7 + c[1:], minlength=49) / size
        own, tri = words.hashes[a:b], every[a : max(a, b - 2)]
        length = lengths[a:b] if b > a else np.zeros(1)
        last = raw[words.ends[a:b] - 1] if b > a else np.zeros(1, np.uint8)
        head = raw[words.starts[a:b]] if b > a else np.zeros(1, np.uint8)
        extra = [
            np.log1p(len(text)) / 10, np.log1p(b - a) / 10, length.mean() / 10, length.std() / 10, np.sqrt(length.max()) / 10,
            len(np.unique(own)) / count, len(np.unique(tri)) / max(len(tri), 1), (own[1:] == own[:-1]).sum() / count,
            (coarse[last] == 6).mean(), (coarse[last] == 5).mean(), (coarse[head] == 1).mean(), (length == 1).mean(), (length > 15).mean(),
        ]
        rows.append(np.concatenate([share, pair, extra]))
    x = np.array(rows).reshape(n, n_single + 49 + 13)
    return np.concatenate([x, np.sqrt(x[:, :-13]), np.minimum(x[:, :-13], 0.02) * 50], axis=1)


def pieces(column: pa.Array) -> list[pa.Array]:
    """The column in parts of bounded size."""
    return [b.column(0) for b in slices([pa.RecordBatch.from_arrays([column], ["text"])], 0)] or [column]


@dataclass
class Ranking:
    """centre and scale of the features, their weights, and the logistic curve's slope and the strength at CUT."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    at: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        """Features further than SIDE deviations from the centre count as SIDE, as in training: so odd a text is outside of what was learnt."""
        return np.clip((x - self.centre) / self.scale, -SIDE, SIDE) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.at) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 30_000, ridge: float = 3.0, steps: int = 25) -> Ranking:
    """From labelled rows. Without both labels nothing is preferred, and all score 0.5."""
    x = np.asarray(x, float)
    centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(axis=0), 1e-4) if len(x) else np.ones(x.shape[1])
    flat = Ranking(centre, scale, np.zeros(x.shape[1]), at=float(np.log(CUT / (1 - CUT))))
    high, low = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(high) or not len(low):
        return flat
    rng = np.random.default_rng(4)
    z = np.clip((x - centre) / scale, -SIDE, SIDE)
    each = lambda of: np.concatenate([rng.permutation(of) for _ in range(-(-pairs // len(of)))])[:pairs]
    d = z[each(high)] - z[each(low)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d.T * (p * (1 - p))) @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    out = Ranking(centre, scale, w)
    s = out.strength(x)
    out.at = float(np.quantile(s, len(low) / len(s)))
    out.slope = float(4 / max(np.median(s[high]) - np.median(s[low]), 1e-6))
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Ranking:
    """From documents with a label that aren't held out: all, or the `most` whose ids hash lowest. Only their features reach the driver."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).where("quality = least").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "quality")
    known = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        return pa.array([x.astype(np.float32).tobytes() for part in pieces(text) for x in features(part)], pa.binary())

    rows = known.select("quality", packed("text").alias("x")).toArrow()
    width = features(pa.array([""])).shape[1]
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, width)
    return fit(x, rows.column("quality").to_numpy())


def quality_score(model: Ranking, text: Column) -> Column:
    """A column with the score, 0 to 1, of each text; null counts as empty."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(model.score(features(part)), pa.float64()) for part in pieces(text)])

    return score(text)


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> DataFrame:
    """Columns doc_id, held_out, score, predicted: one row for each row of docs.

    predicted is 1 for a score of at least CUT. Null and empty texts score like any other, as texts without characters; a null doc_id
    counts as not held out. Labels that are null, not 0 or 1, or contradict each other for one document are left out. Only the text
    is an input of the score.
    """
    model = train(docs, labels, most)
    scored = id_and_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
