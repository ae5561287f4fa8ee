"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

A word of n characters has n + Q - 1 q-grams, with ends marked. One edit touches Q of them at most, so that two words one edit apart share
at least max(n, m) - 1, each at places that differ by one at most. Ranked from the rarest q-gram of the vocabulary to the commonest,
such words share at least k of their first Q + k: words meet by each choice of k = 2 of these. Where many words meet at one key, these
words meet again by k = 3, 4, 5, so that no task holds a group that grows with the vocabulary; what still is too many then is cut into
parts, and each two parts meet. A block of words that meet gets an inverted index of all its q-grams; postings within the limits of
length and place are merged and counted (by sorting whole blocks of them in NumPy, which is what a heap does one by one). Pairs that
reach the bound are verified character by character.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochweave.llm.shared import grouped, written
from epochweave.llm.words import mix, signed

Q = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Codes of characters: the marked end, a to z, À to ÿ. This bounds the number of q-grams.
ALPHABET = 1 + 26 + 64
#: Words that meet at one key in one block, and the choices of q-grams by which they meet.
MOST, LEVELS = 256, (2, 3, 4, 5)
#: Rows of blocks that are merged at once, and characters compared at once.
TOGETHER, CELLS = 2048, 1 << 20
PAIR = "a string, b string"


def misspelt(doc_id: Column, run: Column, one_in: int) -> Column:
    """The lower-cased run; if one_in divides the crc32 of <doc_id>:<run>, without the character at crc32 % length."""
    low = F.translate(run, UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low))
    at = F.pmod(h, F.length(low)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))).otherwise(low)


def vocabulary(docs: DataFrame, one_in: int = 199, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """Columns word, n: words of at least min_chars characters, on at least min_count places of all texts."""
    # shorter runs only get shorter; of a text only its maximal runs of that length are taken
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(misspelt(F.col("doc_id"), F.col("run"), one_in).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


@dataclass
class Grams:
    """Of some words: chars (codes, words one after the other, with Q - 1 ends before and after each), first (where each begins), size (characters), and of every q-gram its word, place and number."""

    chars: np.ndarray
    first: np.ndarray
    size: np.ndarray
    word: np.ndarray
    place: np.ndarray
    code: np.ndarray


def grams(words: pa.Array) -> Grams:
    x = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).astype(np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size + 2 * (Q - 1)) - size - 2 * (Q - 1)
    chars = np.zeros(int((size + 2 * (Q - 1)).sum()), np.int64)
    own = np.repeat(first + Q - 1 - np.cumsum(size) + size, size) + np.arange(len(x))
    chars[own] = np.where(x < 128, x - 96, x - 0xC0 + 27)
    n = size + Q - 1
    word = np.repeat(np.arange(len(size)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at, code = first[word] + place, np.zeros(len(word), np.int64)
    for i in range(Q):
        code = code * ALPHABET + chars[at + i]
    return Grams(chars, first, size, word, place, code)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's words have each q-gram: ALPHABET ** Q numbers at most."""
    n = np.zeros(ALPHABET**Q, np.int64)
    for batch in batches:
        of = grams(batch.column(0))
        n += np.bincount(np.unique(of.word * ALPHABET**Q + of.code) % ALPHABET**Q, minlength=ALPHABET**Q)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["gram", "n"])


def _keyed(rank, k: int):
    """A row (key, word) for each choice of k among the first Q + k q-grams of a word, by rank. Words have that many, being of six characters at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = grams(batch.column(0))
            order = np.lexsort([of.code, rank.value[of.code], of.word])
            begins = np.cumsum(of.size + Q - 1) - of.size - Q + 1
            first = of.code[order][begins[:, None] + np.arange(Q + k)].astype(np.uint64)
            keys = np.zeros((len(begins), math.comb(Q + k, k)), np.uint64)
            for column in np.array(list(combinations(range(Q + k), k))).T:
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + first[:, column] + np.uint64(1))
            keys.sort(axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[new])), batch.column(0).take(pa.array(np.nonzero(new)[0]))], ["key", "word"])

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether b comes from a by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _verified(of: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of words, a no longer than b, which are one edit apart: what follows the first difference must agree."""
    out = np.zeros(len(a), bool)
    scale = np.ceil(np.log2(of.size[b])).astype(np.int64)  # words of about one length together, so that few long ones don't widen all
    for k in np.unique(scale).tolist():
        every, step = np.flatnonzero(scale == k), max(1, CELLS >> k)
        for at in range(0, len(every), step):
            some = every[at : at + step]
            x, y = a[some], b[some]
            width = int(of.size[y].max()) + 1  # an end mark behind each
            low = of.chars.take(of.first[x][:, None] + Q - 1 + np.arange(width), mode="clip")
            high = of.chars.take(of.first[y][:, None] + Q - 1 + np.arange(width), mode="clip")
            place, inside = np.arange(width), np.arange(width) < of.size[x][:, None]
            unequal = (low != high) & inside
            before = np.where(unequal.any(axis=1), unequal.argmax(axis=1), of.size[x])
            moved = (low[:, :-1] != high[:, 1:]) & inside[:, :-1] & (place[:-1] >= before[:, None])
            out[some] = np.where(of.size[x] == of.size[y], unequal.sum(axis=1) == 1, ~moved.any(axis=1))
    return out


def near_pairs(words: pa.Array, block: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words (their places) of one block that are one edit apart. part: in a block of several, only pairs of different parts.

    The blocks' inverted index is the q-grams in order of block, number and place: a posting meets those behind it up to the next place,
    as far as lengths allow. All that meet are merged in order of their pair, and counted.
    """
    of = grams(words)
    span = int(of.size.max(initial=0)) + Q + 2
    number = np.cumsum(np.diff(block, prepend=block[:1]) != 0)
    sort = (number[of.word] * ALPHABET**Q + of.code) * span + of.place
    order = np.argsort(sort, kind="stable")
    sort, word = sort[order], of.word[order]
    behind = np.searchsorted(sort, sort + 1, "right") - np.arange(len(sort)) - 1
    low, high = np.repeat(word, behind), word[np.repeat(np.arange(len(sort)) + 1 - np.cumsum(behind) + behind, behind) + np.arange(int(behind.sum()))]
    keep = (np.abs(of.size[low] - of.size[high]) <= 1) & (low != high)
    if part is not None and len(part):
        begins = np.flatnonzero(np.diff(number, prepend=-1))
        mixed = np.minimum.reduceat(part, begins) < np.maximum.reduceat(part, begins)
        keep &= ~mixed[number[low]] | (part[low] != part[high])
    low, high = low[keep], high[keep]
    pair, count = np.unique(np.minimum(low, high) * len(words) + np.maximum(low, high), return_counts=True)
    low, high = pair // max(len(words), 1), pair % max(len(words), 1)
    enough = count >= np.maximum(of.size[low], of.size[high]) - 1
    low, high = low[enough], high[enough]
    swap = of.size[low] > of.size[high]
    low, high = np.where(swap, high, low), np.where(swap, low, high)
    near = _verified(of, low, high)
    return low[near], high[near]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, word, part, by key: the pairs of each key's words, about TOGETHER rows at once."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        words, part = rows.column("word").combine_chunks(), rows.column("part").to_numpy()
        low, high = (words.take(pa.array(x)) for x in near_pairs(words, rows.column("key").to_numpy(), part if part.any() else None))
        first = pc.less(low, high)
        return pa.RecordBatch.from_arrays([pc.if_else(first, low, high), pc.if_else(first, high, low)], ["a", "b"])

    held, n = [], 0
    for _, rows in grouped(batches):
        if n + rows.num_rows > TOGETHER and held:
            yield pairs(pa.concat_tables(held))
            held, n = [], 0
        held.append(rows)
        n += rows.num_rows
    if held:
        yield pairs(pa.concat_tables(held))


def _blocks(keyed: DataFrame) -> DataFrame:
    """Rows key, word, part in blocks, with pairs within found in each: one for each key."""
    return keyed.repartition("key").sortWithinPartitions("key", "part", "word").mapInArrow(_met, PAIR)


def pairs_one_edit_apart(words: DataFrame, most: int = MOST) -> DataFrame:
    """Columns a, b (a before b): all pairs of words one edit apart. words: a column word, distinct, of letters a to z and À to ÿ, six at least."""
    spark = words.sparkSession
    n = words.select("word").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # a number a q-gram, ALPHABET ** Q at most
    rank = np.zeros(ALPHABET**Q, np.int64)
    rank[[r.gram for r in n]] = [r.n for r in n]
    rank, now, out = spark.sparkContext.broadcast(rank), words.select("word"), None
    for k in LEVELS:
        keyed = written(now.mapInArrow(_keyed(rank, k), "key long, word string"), "q-grams")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        hot = written(sizes.where(F.col("n") > most).select("key", "n"), "hot-keys")
        shared = keyed.join(sizes.where(F.col("n") <= most).select("key"), "key", "left_semi").withColumn("part", F.lit(0))
        found = _blocks(shared)
        out = found if out is None else out.unionAll(found)
        if not hot.take(1):
            break
        many = keyed.join(hot, "key")
        now = written(many.select("word").distinct(), "words")
    else:
        # parts of a key that is still shared by too many: each two parts meet, and each with itself
        parts = F.ceil(F.col("n") * 2 / most).cast("int")
        dealt = many.withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        met = dealt.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "word", "part")
        out = out.unionAll(_blocks(met))
    return written(out.distinct(), "pairs")


def _last(forms: DataFrame, rounds: int) -> DataFrame:
    """Columns word, root, from columns word, form: by following twice as many forms in each round."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def spelling_variants(docs: DataFrame, one_in: int = 199, min_chars: int = 6, min_count: int = 5, times: int = 5, most: int = MOST) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n: words of the texts with those one edit apart.

    docs: columns doc_id, text. Words are maximal runs of Latin letters (A to Z, À to ÿ), with A-Z lower-cased, of at least min_chars
    characters and min_count places; for one in one_in, chosen by hash, a character is left out. form: of the words one edit apart
    that with the largest n (of equals the first in order of code points), if it is at least times the word's n; root: the last
    of a word's forms' forms, or the word. Null texts have no words, a null doc_id counts as empty; repeated rows count each.
    """
    words = written(vocabulary(docs, one_in, min_chars, min_count), "words")
    pairs = pairs_one_edit_apart(words, most)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionAll(pairs.select("b", "a"))
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("is", F.col("best").isNotNull() & (-F.col("best.n") >= times * F.col("n")))
    rows = written(rows.select("word", F.when(F.col("is"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is"), -F.col("best.n")).alias("form_n")), "forms")
    largest = rows.agg(F.max("n")).first()[0] or 1
    # each form has at least `times` the places of the one before, so that there are few, and half as many after each round
    longest = max(1, math.ceil(math.log(max(largest, 2)) / math.log(times)))
    roots = _last(rows.where("form is not null"), math.ceil(math.log2(longest)))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
