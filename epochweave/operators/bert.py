"""Pairs of segments with masked tokens, from documents of tokenized sentences.

A sentence is an array of tokens, or a text with blanks between them, where no token has blanks: Spark then handles a value for each sentence or
segment instead of one for each token.

A document is cut into chunks, half of which get their second segment from another document. Which one, and from where in it, a hash of
the chunk decides, so that the other document comes by an equal join on its rank; what it takes to fill the pair is cut there. A
chunk's randomness is its own, so a lost task makes the same rows again.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochweave.places import written
from epochweave.plans.keys import key, numbered

CHUNK = "doc_id long, copy int, number int, _own long, room int, is_random boolean, a array<string>, b array<string>"
ROW = "doc_id long, copy int, number int, tokens array<string>, segment array<int>, next_is_random boolean, positions array<int>, labels array<string>"


def _of(*what) -> random.Random:
    return random.Random(hashlib.md5(":".join(map(str, what)).encode()).hexdigest())


def cut_pair(a: list[str], b: list[str], most: int, rng: random.Random) -> tuple[list[str], list[str]]:
    """Both no longer than `most` together: the longer loses what it has more, then both alike, each at random ends."""
    over = max(0, len(a) + len(b) - most)
    more = min(over, abs(len(a) - len(b)))
    from_b = more * (len(b) > len(a)) + (over - more + 1) // 2
    from_a = over - from_b

    def cut(tokens: list[str], n: int) -> list[str]:
        front = bin(rng.getrandbits(n)).count("1") if n else 0
        return tokens[front : len(tokens) - (n - front)]

    return cut(a, from_a), cut(b, from_b)


def _picked(places: list[int], n: int, words: int, rng: random.Random) -> list[tuple[int, int]]:
    """n of the places at random, in order, each with what comes there: -1 for [MASK], -2 for what is there, or a word's number.

    As rng.shuffle() would deal them; the loop over its bits is written out, since every token of every chunk goes through it.
    """
    bits = rng.getrandbits
    for i in range(len(places) - 1, 0, -1):
        k = (i + 1).bit_length()
        while (j := bits(k)) > i:
            pass
        places[i], places[j] = places[j], places[i]
    out = []
    for p in sorted(places[:n]):
        u = rng.random()
        out.append((p, -1 if u < 0.8 else -2 if u < 0.9 else rng.choice(range(words))))
    return out


def _masked_count(n: int, share: float, most: int) -> int:
    return min(most, max(1, round(n * share)))


def mask(tokens: list[str], share: float, most: int, words: list[str], rng: random.Random) -> tuple[list[str], list[int], list[str]]:
    """Of the tokens to predict 8 in 10 become [MASK], 1 in 10 any word, 1 in 10 stay."""
    places = [i for i, t in enumerate(tokens) if t not in ("[CLS]", "[SEP]")]
    picked = _picked(places, _masked_count(len(tokens), share, most), len(words), rng)
    out = list(tokens)
    for i, to in picked:
        out[i] = "[MASK]" if to == -1 else tokens[i] if to == -2 else words[to]
    return out, [i for i, _ in picked], [tokens[i] for i, _ in picked]


def _cuts(sizes: list[int], room: int, shorter: float, rng: random.Random) -> Iterator[tuple[int, int, int, bool, int]]:
    """chunks() by the sizes of sentences alone: where a chunk's sentences begin, are split and end, whether the second segment comes from elsewhere, and tokens in all."""
    at = 0
    while at < len(sizes):
        target = rng.randint(2, room) if rng.random() < shorter else room
        stop, size = at, 0
        while stop < len(sizes) and size < target:
            size += sizes[stop]
            stop += 1
        split = at + rng.randint(1, stop - at - 1) if stop - at > 1 else stop
        elsewhere = not any(sizes[split:stop]) or rng.random() < 0.5
        yield at, split, stop, elsewhere, target
        at = split if elsewhere else stop


def chunks(sentences: list[list[str]], room: int, shorter: float, rng: random.Random) -> Iterator[tuple[list[str], list[str] | None, int]]:
    """(first segment, second or none, tokens in all): whole sentences up to the target, which is less than room for a share `shorter` of chunks.

    Where the second is to come from elsewhere, what was meant for it comes again in the next chunk.
    """
    for at, split, stop, elsewhere, target in _cuts([len(s) for s in sentences], room, shorter, rng):
        yield [t for s in sentences[at:split] for t in s], None if elsewhere else [t for s in sentences[split:stop] for t in s], target


def _as_lines(documents: DataFrame) -> bool:
    """Whether sentences are texts."""
    return isinstance(documents.schema["sentences"].dataType.elementType, T.StringType)


def frequent_words(documents: DataFrame, n: int = 30_000) -> list[str]:
    """The n most frequent tokens of the documents' sentences: a vocabulary of bounded size."""
    tokens = F.split(F.array_join("sentences", " "), " ") if _as_lines(documents) else F.flatten("sentences")
    words = documents.select(F.explode(tokens).alias("w"))
    words = (words.where("w <> ''") if _as_lines(documents) else words).groupBy("w").agg(F.count("*").alias("n"))
    return [r.w for r in words.orderBy(F.desc("n"), "w").limit(n).collect()]


def _runs(values: pa.Array, begins: np.ndarray, ends: np.ndarray, none: np.ndarray | None = None) -> pa.ListArray:
    """Lists of the values from begins to ends, null where `none` says so."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(at)), mask=None if none is None else pa.array(none))


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Where lists begin and end in what flatten() gives of them; none is null."""
    return lists.offsets.to_numpy().astype(np.int64) - (lists.offsets[0].as_py() if len(lists.offsets) else 0)


def _tokens(lists: pa.Array, most: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lists, or of texts with blanks between them, one after the other, and where each list begins and ends; most: of no list more than so many."""
    if not pa.types.is_string(lists.type):
        return lists.flatten(), _ends(lists)
    parts = pc.split_pattern(lists, " ")
    values, ends = parts.flatten(), _ends(parts)
    full = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    if most is not None:
        before = np.concatenate([[0], np.cumsum(full)])
        full &= before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends)) < np.repeat(most, np.diff(ends))
    return values.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


def _chunked(room: int, shorter: float, copies: int, seed: int):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    names = ["doc_id", "copy", "number", "_own", "room", "is_random", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 50):
                ids, ranks, sentences = batch.slice(first, 50).columns
                of, rows, cuts = _ends(sentences).tolist(), [], []
                tokens, at = _tokens(sentences.flatten())
                sizes = np.diff(at).tolist()
                for d, (doc_id, rank) in enumerate(zip(ids.to_pylist(), ranks.to_pylist(), strict=True)):
                    own = sizes[of[d] : of[d + 1]]
                    for copy in range(copies):
                        for i, (x, y, z, elsewhere, target) in enumerate(_cuts(own, room, shorter, _of(seed, doc_id, copy))):
                            rows.append((doc_id, copy, i, rank, target - sum(own[x:y]), elsewhere))
                            cuts.append((of[d] + x, of[d] + y, of[d] + z))
                if rows:
                    x, y, z = (at[np.array(c)] for c in zip(*cuts, strict=True))
                    elsewhere = np.array([r[5] for r in rows])
                    numbers = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    segments = [_runs(tokens, x, y), _runs(tokens, y, np.where(elsewhere, y, z), elsewhere)]
                    yield pa.RecordBatch.from_arrays([*numbers, *(pc.binary_join(c, " ") if pa.types.is_string(sentences.type.value_type) else c for c in segments)], names)

    return run


def _finished(room: int, share: float, most: int, words: list[str], seed: int):
    """Chunks with both segments to rows of ROW. Tokens are numbers of places (in the first segments, the second ones, the words) until a block of rows is done."""
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(["[CLS]", "[SEP]", "[MASK]", *words], pa.string())
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                ids, copies, numbers, a, b, is_random, left = batch.slice(first, 1000).columns
                (a, of_a), (b, of_b) = _tokens(a), _tokens(b, left.to_numpy())
                pool, second = pa.concat_arrays([a, b, known]), len(a)
                fixed = set(pc.indices_nonzero(pc.is_in(pool, pa.array(["[CLS]", "[SEP]"]))).to_pylist())  # such tokens of a text are never predicted either
                a, b = of_a.tolist(), of_b.tolist()
                special = len(pool) - len(known)
                tokens, segments, places, labels, kept = [], [], [], [], []
                for r, (doc_id, copy, number) in enumerate(zip(ids.to_pylist(), copies.to_pylist(), numbers.to_pylist(), strict=True)):
                    rng = _of(seed, doc_id, copy, number)
                    one, two = cut_pair(range(a[r], a[r + 1]), range(second + b[r], second + b[r + 1]), room, rng)
                    if not (one and two):
                        continue
                    row = [special, *one, special + 1, *two, special + 1]
                    at = [*range(1, len(one) + 1), *range(len(one) + 2, len(row) - 1)]
                    if len(fixed) > 2:
                        at = [i for i in at if row[i] not in fixed]
                    picked = _picked(at, _masked_count(len(row), share, most), len(words), rng)
                    labels.append([row[i] for i, _ in picked])
                    for i, to in picked:
                        if to != -2:
                            row[i] = special + 3 + to  # -1: [MASK]
                    tokens.append(row)
                    segments.append((len(one) + 2, len(two) + 1))
                    places.append([i for i, _ in picked])
                    kept.append(r)
                if not kept:
                    continue
                kept = pa.array(kept)
                offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int32())
                flat = lambda x: np.fromiter((v for y in x for v in y), np.int64)
                listed = lambda x: pa.ListArray.from_arrays(offsets(x), pool.take(pa.array(flat(x))))  # noqa: B023, E731
                segment = np.repeat(np.tile(np.array([0, 1], np.int32), len(segments)), np.array(segments).ravel())
                columns = [listed(tokens), pa.ListArray.from_arrays(offsets(tokens), pa.array(segment)), is_random.take(kept), pa.ListArray.from_arrays(offsets(places), pa.array(flat(places), pa.int32())), listed(labels)]
                yield pa.RecordBatch.from_arrays([ids.take(kept), copies.take(kept), numbers.take(kept), *columns], names)

    return run


def instances(documents: DataFrame, words: list[str], length: int = 128, copies: int = 2, shorter: float = 0.1, share: float = 0.15, most: int = 20, seed: int = 0) -> DataFrame:
    """Rows as in ROW. documents: doc_id, sentences (array of arrays of tokens). words: what a masked token may become, see frequent_words().

    shorter: the share of chunks with a random, shorter target. Documents without tokens give no rows, and no segments to others; where
    there is a single document, its own sentences follow.
    """
    lines = _as_lines(documents)
    documents = documents.select("doc_id", F.filter("sentences", lambda s: F.trim(s) != "" if lines else F.size(s) > 0).alias("sentences")).where("size(sentences) > 0")
    known = numbered(documents, "doc_id", "_rank")
    n = max(1, known.count())
    room = length - 3
    # written, since chunks go two ways from here
    chunk = CHUNK.replace("array<string>", "string") if lines else CHUNK
    parts = written(known.select("doc_id", "_rank", "sentences").mapInArrow(_chunked(room, shorter, copies, seed), chunk), "chunks")
    hashed = lambda what, below: F.conv(F.substring(key(what, "doc_id", "copy", "number", seed=seed), 1, 13), 16, 10).cast("long") % below
    own = parts.where("not is_random").select("doc_id", "copy", "number", "a", "b", "is_random", F.lit((1 << 31) - 1).alias("room"))
    # any document but one's own
    asked = parts.where("is_random").withColumn("_rank", (F.col("_own") + 1 + hashed("other", F.lit(max(1, n - 1)))) % F.lit(n))
    found = asked.join(known.select("_rank", "sentences"), "_rank").withColumn("room", F.greatest(F.col("room"), F.lit(1)))
    following = F.slice("sentences", hashed("sentence", F.size("sentences")).cast("int") + 1, F.col("room"))  # a sentence has a token at least
    taken = F.array_join(following, " ") if lines else F.slice(F.flatten(following), F.lit(1), F.col("room"))  # a text is cut to its room later
    rows = own.unionByName(found.select("doc_id", "copy", "number", "a", taken.alias("b"), "is_random", "room"))
    return rows.mapInArrow(_finished(room, share, most, words, seed), ROW)


def as_bytes(rows: DataFrame, words: list[str], length: int = 128, most: int = 20) -> DataFrame:
    """instances() as the seven columns of bytes that loaders expect: int32 (weights float32), filled with zeros. words: token ids by place, [UNK] among them for all others."""
    names = ["input_ids", "input_mask", "segment_ids", "masked_lm_positions", "masked_lm_ids", "masked_lm_weights", "next_sentence_labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(words)}
        known, numbers, unknown = pa.array(ids, pa.string()), np.array([*ids.values()], "<i4"), ids["[UNK]"]

        def of(tokens: pa.Array) -> np.ndarray:
            found = pc.index_in(tokens, known)
            return np.where(found.is_null().to_numpy(zero_copy_only=False), unknown, numbers[found.fill_null(0).to_numpy()])

        def full(values: np.ndarray, sizes: np.ndarray, size: int, kind: str = "<i4") -> pa.Array:
            if len(sizes) and sizes.max() > size:
                raise ValueError(f"{sizes.max()} values where there is room for {size}")
            out = np.zeros((len(sizes), size), kind)
            out[np.arange(size) < sizes[:, None]] = values
            return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.arange(len(sizes) + 1, dtype=np.int32) * (4 * size)), pa.py_buffer(out.tobytes())])

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                tokens, segment, is_random, places, labels = batch.slice(first, 1000).columns
                n, k = (np.diff(_ends(x)) for x in (tokens, places))
                one = np.ones(len(n), np.int64)
                columns = [full(of(tokens.flatten()), n, length), full(1, n, length), full(segment.flatten().to_numpy(), n, length), full(places.flatten().to_numpy(), k, most), full(of(labels.flatten()), k, most), full(1, k, most, "<f4")]
                yield pa.RecordBatch.from_arrays([*columns, full(is_random.to_numpy(zero_copy_only=False), one, 1)], names)

    return rows.select("tokens", "segment", "next_is_random", "positions", "labels").mapInArrow(run, ", ".join(f"{n} binary" for n in names))
