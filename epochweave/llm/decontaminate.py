"""Benchmark decontamination: passages of benchmark items in documents, by edit distance.

Every filter is exact, so that no passage within the distance is lost. An item that may differ in k characters is cut into k // 2 + 1
pieces: in any such passage one piece at least has one edit or none. All strings at most one edit from a piece are listed (an index of
keys and a bit table), and every place of a document is looked up in it, by characters of normalised text. What is found is checked
upwards: g pieces side by side may have 2g - 1 edits, and if an item is within k, then so are some piece, a pair and a group of pieces
that each hold the one before (bit-parallel, for all places at once). Places that are left are verified: the smallest edit distance,
in characters, between the item and any part of the window around that place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochweave.llm.shared import id_and_text, written
from epochweave.llm.words import Words, classes, lower_table, slices

HITS = "array<struct<item_id:long,distance:int,item_chars:int,begin_word:long>>"
BITS = 26
LONGEST = 10
BUCKET = 32
LEVELS = (2, 6)
AT_ONCE = 1 << 16
LETTERS = 39
SPACE, OTHER = 1, 38


@dataclass
class Items:
    ids: list[int]
    texts: list[str]


@dataclass
class Groups:
    """Pieces side by side: where each begins in its item, its length and edits, and for each code the bits of where it stands."""

    begin: np.ndarray
    length: np.ndarray
    edits: np.ndarray
    stands: np.ndarray


@dataclass
class Index:
    """Pieces (item, offset, group at each level) and, by length, strings near them: keys, sorted, the piece of each, and the bits of all."""

    item: np.ndarray
    offset: np.ndarray
    group: list[np.ndarray]
    groups: list[Groups]
    keys: dict[int, np.ndarray]
    pieces: dict[int, np.ndarray]
    bits: np.ndarray


def normal(column: pa.Array) -> tuple[str, np.ndarray]:
    """All rows' words, lower case, each with a space behind it, or a line feed behind a row's last; for each row and one more, its first word."""
    words = Words(column, "punctuation")
    out = np.full(int((words.ends - words.starts + 1).sum()), 32, np.uint8)
    behind = np.cumsum(words.ends - words.starts + 1) - 1
    letters = np.ones(len(out), bool)
    letters[behind] = False
    out[letters] = lower_table()[words.raw[classes("punctuation")[words.raw]]]
    last = words.first[1:][words.first[1:] > words.first[:-1]] - 1
    out[behind[last]] = 10
    return out.tobytes().decode("utf-8", "replace"), words.first


def codes(text: str) -> np.ndarray:
    """Six bits a character: 0 between rows, the space, letters, digits, and one code for all characters beyond ASCII."""
    table = np.full(129, OTHER, np.uint8)
    table[10], table[32], table[97:123], table[48:58] = 0, SPACE, np.arange(2, 28), np.arange(28, 38)
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128)]


def grams(code: np.ndarray) -> np.ndarray:
    """The LONGEST characters from each place on that has them, six bits each."""
    out, have = code.astype(np.uint64), 1
    while have < LONGEST:
        step = min(have, LONGEST - have)
        out, have = out[:-step] | (out[step:] << np.uint64(6 * step)), have + step
    return out


def _slot(key: np.ndarray, length: int) -> np.ndarray:
    return ((key + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * length & (1 << 64) - 1) >> np.uint64(64 - BITS)).astype(np.int64)


def prepare(item_ids: list[int], texts: list[str | None]) -> Items:
    """The items with words, and their normalised texts."""
    text, first = normal(pa.array(texts, pa.string()))
    rows = iter(text.split("\n"))
    found = [(i, next(rows)) for i, a, b in zip(item_ids, first[:-1], first[1:], strict=True) if b > a]
    return Items([i for i, _ in found], [t for _, t in found])


def _near(piece: np.ndarray, n: int, edits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, keys of that length, one for each piece): one at least is in every string with at most so many edits (0 or 1) to a piece of n."""
    low = lambda j: piece & np.uint64((1 << 6 * j) - 1)
    high = lambda j: piece >> np.uint64(6 * j) << np.uint64(6 * j)
    if not edits:
        yield n, piece
        return
    for j in range(n):  # edits of the first or last character are in these
        yield n - 1, low(j) | (high(j + 1) >> np.uint64(6))
    for c in range(1, LETTERS):
        for j in range(1, n - 1):
            yield n, low(j) | np.uint64(c << 6 * j) | high(j + 1)
        for j in range(1, n):
            yield min(n + 1, LONGEST), (low(j) | np.uint64(c << 6 * j) | (high(j) << np.uint64(6))) & np.uint64((1 << 6 * LONGEST) - 1)


@lru_cache(maxsize=1)
def index(texts: tuple[str, ...], share: float) -> Index:
    item, offset, group, whole, kinds = [], [], [[] for _ in LEVELS], [[] for _ in LEVELS], {}
    for i, text in enumerate(texts):
        code, k = codes(text), int(share * len(text))
        n = k // 2 + 1
        bounds = [len(text) * j // n for j in range(n + 1)]
        for level, size in enumerate(LEVELS):
            for j in range(n):
                if j % size == 0:
                    upto = min(j + size, n)
                    whole[level].append((bounds[j], code[bounds[j] : bounds[upto]], min(2 * (upto - j) - 1, k)))
                group[level].append(len(whole[level]) - 1)
        for a, b in zip(bounds, bounds[1:], strict=False):
            b = min(b, a + LONGEST)  # of a longer piece its beginning
            kinds.setdefault((b - a, min(k, 1)), []).append((len(item), sum(int(c) << 6 * j for j, c in enumerate(code[a:b].tolist()))))
            item.append(i)
            offset.append(a)
    found: dict[int, list] = {}
    for (n, edits), rows in kinds.items():
        which = np.array([r for r, _ in rows], np.int32)
        for length, key in _near(np.array([r for _, r in rows], np.uint64), n, edits):
            found.setdefault(length, []).append((key, which))
    keys, pieces, bits = {}, {}, np.zeros(1 << BITS, bool)
    for length, parts in found.items():
        key, piece = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort([piece, key])
        key, piece = key[order], piece[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        keys[length], pieces[length] = key[new], piece[new]
        bits[_slot(keys[length], length)] = True
    groups = []
    for own in whole:
        stands = np.zeros((len(own), LETTERS), np.uint64)
        for g, (_, code, _) in enumerate(own):
            for j, c in enumerate(code[:64].tolist()):
                stands[g, c] |= np.uint64(1 << j)
        groups.append(Groups(*(np.array(x, np.int64) for x in ([b for b, _, _ in own], [len(c) for _, c, _ in own], [e for _, _, e in own])), stands))
    return Index(np.array(item, np.int64), np.array(offset, np.int64), [np.array(g, np.int64) for g in group], groups, keys, pieces, np.packbits(bits))


def _within(code: np.ndarray, place: np.ndarray, group: np.ndarray, groups: Groups) -> np.ndarray:
    """Whether the text has the group within its edits, if it begins at the place, give or take these; groups of over 64 characters pass."""
    length, edits, one = groups.length[group], groups.edits[group], np.uint64(1)
    top = np.minimum(length - 1, 63).astype(np.uint64)
    up, down, score, best = np.full(len(place), 2**64 - 1, np.uint64), np.zeros(len(place), np.uint64), length.astype(np.int32), length.astype(np.int32)
    stands, row, where = groups.stands.ravel(), group * LETTERS, place - edits
    for t in range(int((length + 2 * edits).max(initial=0))):
        x = stands[row + code.take(where + t, mode="clip")] | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | ~(d0 | up), up & d0
        score += ((hp >> top) & one).astype(np.int32)
        score -= ((hn >> top) & one).astype(np.int32)
        hp, hn = hp << one, hn << one
        up, down = hn | ~(d0 | hp), hp & d0
        np.minimum(best, score, out=best)
    return (best <= edits) | (length > 64)


def _looked_up(code: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, where in the text their items might begin)."""
    code = np.concatenate([code, np.zeros(LONGEST - 1, np.uint8)])
    for at in range(0, len(code), AT_ONCE):
        full = grams(code[at : at + AT_ONCE + LONGEST - 1])
        for length, keys in index.keys.items():
            key = full & np.uint64((1 << 6 * length) - 1)
            slot = _slot(key, length)
            place = np.flatnonzero((index.bits[slot >> 3] << (slot & 7).astype(np.uint8)) & 128)
            key = key[place]
            low = np.searchsorted(keys, key)
            real = keys.take(low, mode="clip") == key
            place, low, key = place[real], low[real], key[real]
            n = np.searchsorted(keys, key, "right") - low
            piece = index.pieces[length][np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield piece, np.repeat(place + at, n) - index.offset[piece]


def candidates(code: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(items, places): where in the text each item might begin, give or take its edits."""
    found = [(piece.astype(np.int64) << 40) + place + (1 << 38) for piece, place in _looked_up(code, index)]
    found = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    piece, place = found >> 40, (found & ((1 << 40) - 1)) - (1 << 38)
    for group, groups in zip(index.group, index.groups, strict=True):
        some = [slice(a, a + (1 << 14)) for a in range(0, len(piece), 1 << 14)]
        left = np.concatenate([np.zeros(0, bool), *(_within(code, place[c] + groups.begin[group[piece[c]]], group[piece[c]], groups) for c in some)])
        piece, place = piece[left], place[left]
    return index.item[piece], place


def _search(pattern: str, text: str) -> tuple[int, int]:
    """The smallest edit distance between the pattern and any part of the text, and where such a part ends (bit-parallel, column by column)."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up, down = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, at
    return best, end


def edit_distance_within(pattern: str, text: str) -> int:
    """The smallest edit distance between the pattern and any part of the text."""
    return _search(pattern, text)[0]


def _likely(code: np.ndarray, index: Index) -> Iterator[tuple[int, int]]:
    """(item, place): each item with where it might begin, in steps of BUCKET."""
    item, place = candidates(code, index)
    found = np.unique(item << 40 | (place + (1 << 38)) // BUCKET)
    yield from zip((found >> 40).tolist(), ((found & ((1 << 40) - 1)) * BUCKET - (1 << 38)).tolist(), strict=True)


def find(column: pa.Array, items: Items, share: float) -> list[list[dict]]:
    """For each text the items of which it has a passage, with the smallest distance and where that passage begins."""
    out: list[list[dict]] = [[] for _ in range(len(column))]
    text, first_word = normal(column)
    if not text or not items.ids:
        return out
    code = codes(text)
    behind = np.flatnonzero(code <= SPACE)  # behind each word
    last = first_word[1:][first_word[1:] > first_word[:-1]] - 1
    rows, ends = np.flatnonzero(first_word[1:] > first_word[:-1]), behind[last]
    starts = np.concatenate([[0], ends[:-1] + 1])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for item, place in _likely(code, index(tuple(items.texts), share)):
        pattern = items.texts[item]
        k = int(share * len(pattern))
        low, high = place - k, place + len(pattern) + k + BUCKET
        for n in range(int(np.searchsorted(ends, low)), int(np.searchsorted(starts, high))):
            old = best.get((int(rows[n]), item))
            if old and not old[0]:
                continue
            a = max(int(starts[n]), low)
            window = text[a : min(int(ends[n]), high)]
            d, end = _search(pattern, window)
            if d <= k and (old is None or d < old[0]):
                begin = a + end - _search(pattern[::-1], window[:end][::-1])[1]
                best[int(rows[n]), item] = d, int(np.searchsorted(behind, begin)) - int(first_word[rows[n]])
    for (row, item), (d, begin) in sorted(best.items()):
        out[row].append({"item_id": items.ids[item], "distance": d, "item_chars": len(items.texts[item]), "begin_word": begin})
    return out


def passages(text: Column, items: Items, share: float = 0.2) -> Column:
    """A column of type HITS: the items of which a text has a passage within an edit distance of share times the item's length."""

    @F.arrow_udf(HITS)
    def hits(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_chars", pa.int32()), ("begin_word", pa.int64())]))
        parts = [pa.array(find(b.column(0), items, share), kind) for b in slices([pa.RecordBatch.from_arrays([text], ["text"])], 0)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return hits(text)


def item_blocks(benchmark: DataFrame, block_chars: int = 1 << 17) -> Iterator[Items]:
    """The benchmark in blocks of about block_chars characters, each small enough to go to every task."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # a stated set of queries, a bounded block at a time
        yield prepare([r.item_id for r in part], [r.text for r in part])


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, block_chars: int = 1 << 17) -> DataFrame:
    """Columns doc_id, item_id, distance, item_chars, begin_word: one row for each document row and item found in it.

    Texts are compared as words of letters and digits (bytes beyond ASCII count as letters), A-Z as a-z, joined by single spaces. Items
    without such words, and null ids or texts of items, match nothing; null and empty documents have no passages. A null doc_id is
    kept as null. Repeated items are reported each; repeated document rows are, too.
    """
    docs, out = id_and_text(docs), None
    for items in item_blocks(benchmark, block_chars):
        found = docs.select("doc_id", F.explode(passages(F.col("text"), items, share)).alias("hit")).select("doc_id", "hit.*")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, block_chars: int = 1 << 17) -> DataFrame:
    """The rows of docs that have no passage of any item. What each block of items but the last leaves is written, so that a task holds one block's index at a time."""
    for k, items in enumerate(item_blocks(benchmark, block_chars)):
        docs = written(docs, "clean") if k else docs
        docs = docs.where(F.size(passages(F.col("text").cast("string"), items, share)) == 0)
    return docs
