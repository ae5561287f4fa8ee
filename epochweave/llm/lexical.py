"""Ranked lexical search: a tiered index of impacts, searched from its highest tier down.

Documents are dealt into shards of a few megabytes of text, a row each. A posting (term, document) carries its impact, what it adds to a
score. Impacts are cut into tiers by thresholds; each tier is a column of its own, so that a search that needs the high ones doesn't
read the rest. With each tier go residual bounds: for every term the largest impact in the tiers below. An item is done at a tier when
the whole scores of its 20 best documents so far are above what a document without any posting so far could reach, and when the
documents that could still reach them are few: these alone are looked up in the tiers below. Items without that proof fall through to
the next tier; the last one holds everything. The index keeps the terms of the stated items, from all documents and all of their text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochweave.llm.shared import small_batches, written
from epochweave.llm.words import Words, signed, slices

#: Text, documents and items at once in a task's memory.
SHARD_BYTES, SHARD_DOCS, SUMS = 1 << 22, 1024, 1 << 20
#: Rows (item, term) for which an index is made at once; more items take another pass.
BLOCK = 1 << 18
#: The share of postings in the tiers above the last.
SHARES = (1 / 8, 1 / 2)
#: Documents an item may leave open at a tier, to be looked up below; with more it falls through.
OPEN = 512
UNIT = 1_000_000_000
FOUND = "item long, shard long, at int, doc_id long, score long"


@dataclass
class Index:
    """shards: a row each; terms: sorted hashes; weight of each; below: for each tier, each term's largest impact in the tiers after it."""

    shards: DataFrame
    terms: np.ndarray
    weight: np.ndarray
    below: np.ndarray


@dataclass
class Queries:
    """Items by number, and for each term (sorted) the items that have it, with how often. at: where a term's items begin."""

    items: np.ndarray
    term: np.ndarray
    item: np.ndarray
    times: np.ndarray
    at: np.ndarray


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column(1), "punctuation")
        row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(signed(words.hashes))], ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """Columns item_id, term (hash), times: of all rows with one id together; rows with a null id or text have none."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return written(rows.mapInArrow(_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times")), "item-terms")


def _shards(terms: np.ndarray):
    """Rows of documents and their postings: doc_id, size (terms with repeats), and term (its number), at (the document's place), tf of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SHARD_BYTES):
            for start in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(start, SHARD_DOCS)
                words = Words(part.column(1), "punctuation")
                size = np.diff(words.first)
                number = np.searchsorted(terms, words.hashes)
                place = np.flatnonzero(terms.take(number, mode="clip") == words.hashes) if len(terms) else np.zeros(0, np.int64)
                key, tf = np.unique(number[place] * SHARD_DOCS + np.repeat(np.arange(part.num_rows), size)[place], return_counts=True)
                one = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))
                docs = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([docs, one(size, pa.int32()), one(key // SHARD_DOCS, pa.int32()), one(key % SHARD_DOCS, pa.int32()), one(tf, pa.int32())], ["doc_id", "size", "term", "at", "tf"])

    return run


def _list(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The values of a batch of one row."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _counted(n_terms: int):
    """For each task, how many of its documents have each term; under the number -1 those with any term at all, under -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for row in _rows(batches):
            df += np.bincount(_list(row, "term"), minlength=n_terms)
            size = _list(row, "size")
            n, total = n + int((size > 0).sum()), total + int(size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some]), pa.int64()), pa.array(np.concatenate([[n, total], df[some]]), pa.int64())], ["term", "n"])

    return run


def _tiered(weight: np.ndarray, n_docs: int, total: int, cuts: list[int]):
    tiers = len(cuts) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            term, at, tf = (_list(row, c).astype(np.int64) for c in ("term", "at", "tf"))
            m = 75 + 25 * _list(row, "size").astype(np.int64) * n_docs // max(total, 1)
            impact = weight[term] * (UNIT * tf // (1000 * tf + 12 * m[at]))
            tier = sum((impact < c).astype(np.int64) for c in cuts) if cuts else np.zeros(len(term), np.int64)
            out, names = [row.column("shard"), row.column("doc_id")], ["shard", "doc_id"]
            one = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))
            for k in range(tiers):
                own = np.flatnonzero((tier == k) & (impact > 0))
                begin = np.flatnonzero(np.diff(term[own], prepend=-1))
                most = np.maximum.reduceat(impact[own], begin) if len(begin) else np.zeros(0, np.int64)
                out += [one(term[own], pa.int32()), one(at[own], pa.int32()), one(impact[own], pa.int64()), one(term[own][begin], pa.int32()), one(most, pa.int64())]
                names += [f"term{k}", f"at{k}", f"impact{k}", f"own{k}", f"most{k}"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _largest(n_terms: int, tiers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros((tiers, n_terms), np.int64)
        for row in _rows(batches):
            for k in range(tiers):
                own = _list(row, f"own{k}")
                most[k, own] = np.maximum(most[k, own], _list(row, f"most{k}"))
        tier, term = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(tier, pa.int64()), pa.array(term, pa.int64()), pa.array(most[tier, term])], ["tier", "term", "most"])

    return run


def build_index(docs: DataFrame, terms: np.ndarray, shares: tuple[float, ...] = SHARES) -> Index:
    """An index of all rows of docs for the given terms (sorted hashes, at most BLOCK or a single item's)."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(terms)  # of the stated items, BLOCK numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark, SHARD_DOCS):
        shards = rows.mapInArrow(lambda b: _shards(known.value)(b), "doc_id array<long>, size array<int>, term array<int>, at array<int>, tf array<int>")
        shards = written(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")
    with small_batches(spark, 1):
        counts = dict(shards.select("term", "size").mapInArrow(_counted(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a number a term
        n, total = counts.pop(-1, 0), counts.pop(-2, 0)
        df = np.zeros(len(terms), np.int64)
        df[list(counts)] = list(counts.values())
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        order = np.argsort(-weight, kind="stable")
        upto = np.cumsum(df[order])
        # an impact at the borders of the shares, where a term comes once in a document of middling length
        cuts = [int(weight[order[int(np.searchsorted(upto, s * upto[-1]))]]) * (UNIT // 2200) for s in shares] if len(upto) and upto[-1] else []
        tiers = len(cuts) + 1
        kind = ", ".join(f"term{k} array<int>, at{k} array<int>, impact{k} array<long>, own{k} array<int>, most{k} array<long>" for k in range(tiers))
        tiered = written(shards.mapInArrow(_tiered(weight, n, total, cuts), f"shard long, doc_id array<long>, {kind}"), "tiers")
        most = np.zeros((tiers + 1, len(terms)), np.int64)
        own = tiered.select(*[f"{c}{k}" for k in range(tiers) for c in ("own", "most")])
        for r in own.mapInArrow(_largest(len(terms), tiers), "tier long, term long, most long").groupBy("tier", "term").agg(F.max("most").alias("most")).collect():  # tiers x terms numbers
            most[r.tier, r.term] = r.most
    below = np.maximum.accumulate(most[::-1], axis=0)[::-1][1:]
    return Index(tiered, terms, weight, below)


def _sums(row: pa.RecordBatch, queries: Queries, upto: int, bounds: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """For blocks of items (the first's number), item by document: sums of impacts down to tier upto, and of the bounds of terms that were met."""
    n = len(_list(row, "doc_id"))
    step = max(1, SUMS // max(n, 1))
    runs = []
    for k in range(upto + 1):
        term, at, impact = _list(row, f"term{k}"), _list(row, f"at{k}"), _list(row, f"impact{k}")
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        runs += [(int(term[a]), at[a:b], impact[a:b]) for a, b in zip(begin, np.append(begin, len(term))[1:], strict=True)]
    for first in range(0, len(queries.items), step):
        size = min(step, len(queries.items) - first)
        sums, met = np.zeros((size, n), np.int64), None if bounds is None else np.zeros((size, n), np.int64)
        for term, at, impact in runs:
            a, b = queries.at[term], queries.at[term + 1]
            a, b = a + np.searchsorted(queries.item[a:b], [first, first + size])
            for i, times in zip((queries.item[a:b] - first).tolist(), queries.times[a:b].tolist(), strict=True):
                sums[i, at] += impact * times
                if met is not None and bounds[term]:
                    met[i, at] += bounds[term] * times
        yield first, sums, met


def _reported(row: pa.RecordBatch, item: list, at: list, score: list) -> pa.RecordBatch:
    place = np.concatenate(at) if at else np.zeros(0, np.int64)
    ids = row.column("doc_id").flatten().take(pa.array(place))
    cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cat(item), pa.array(np.full(len(place), row.column("shard")[0].as_py()), pa.int64()), pa.array(place, pa.int32()), ids, cat(score)], ["item", "shard", "at", "doc_id", "score"])


def _best(queries, upto: int, top: int):
    """The best documents of each shard for each item by their sums so far; of a task's later shards those that reach its earlier best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        held = np.zeros((len(own.items), top), np.int64)  # the best sums of this task
        for row in _rows(batches):
            ids = row.column("doc_id").flatten().fill_null(2**63 - 1).to_numpy()
            item, at, score = [], [], []
            for first, sums, _ in _sums(row, own, upto, None):
                for i in np.flatnonzero(sums.max(axis=1, initial=0) > 0).tolist():
                    some = np.flatnonzero(sums[i] >= max(held[first + i, -1], 1))
                    some = some[np.lexsort([ids[some], -sums[i][some]])][:top]
                    if len(some):
                        held[first + i] = -np.sort(-np.concatenate([held[first + i], sums[i][some]]))[:top]
                        item.append(np.full(len(some), first + i))
                        at.append(some)
                        score.append(sums[i][some])
            yield _reported(row, item, at, score)

    return run


def _possible(queries, upto: int, least: np.ndarray, bounds: np.ndarray, unseen: np.ndarray):
    """Documents that could reach least for their item: what they have, and the bounds of the terms not met so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            item, at, score = [], [], []
            for first, sums, met in _sums(row, queries.value, upto, bounds):
                size = len(sums)
                found, place = np.nonzero((sums > 0) & (sums + unseen[first : first + size, None] - met >= least[first : first + size, None]))
                item.append(found + first)
                at.append(place)
                score.append(sums[found, place])
            yield _reported(row, item, at, score)

    return run


def _completed(queries, tiers: range, wanted):
    """wanted: (shard, item, place, score so far), by shard: with what the documents have in these tiers added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (shard, item, place, score) = queries.value, wanted.value
        order = np.argsort(own.item, kind="stable")  # rows of an item together
        begins, term, times = np.searchsorted(own.item[order], np.arange(len(own.items) + 1)), np.repeat(np.arange(len(own.at) - 1), np.diff(own.at))[order], own.times[order]
        for row in _rows(batches):
            a, b = np.searchsorted(shard, row.column("shard")[0].as_py(), "left"), np.searchsorted(shard, row.column("shard")[0].as_py(), "right")
            out = score[a:b].copy()
            for k in tiers:
                key, impact = _list(row, f"term{k}").astype(np.int64) * SHARD_DOCS + _list(row, f"at{k}"), _list(row, f"impact{k}")
                for j in range(a, b) if len(key) else ():
                    terms = slice(begins[item[j]], begins[item[j] + 1])
                    look = term[terms] * SHARD_DOCS + place[j]
                    low = np.searchsorted(key, look)
                    out[j - a] += int((np.where(key.take(low, mode="clip") == look, impact.take(low, mode="clip"), 0) * times[terms]).sum())
            yield _reported(row, [item[a:b]], [place[a:b].astype(np.int64)], [out])

    return run


def _columns(tiers: range) -> list[str]:
    return ["shard", "doc_id", *[f"{c}{k}" for k in tiers for c in ("term", "at", "impact")]]


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _complete(index: Index, sent, found: DataFrame, lower: range) -> DataFrame:
    """found (a bounded number of documents for each item of a block) with what they have in the lower tiers added; only their shards are read."""
    spark = index.shards.sparkSession
    rows = found.orderBy("shard", "item", "at").toArrow()
    wanted = [rows.column(c).to_numpy() for c in ("shard", "item", "at", "score")]
    shards = spark.createDataFrame([(int(s),) for s in np.unique(wanted[0])], "shard long")
    read = index.shards.select(*_columns(lower)).join(F.broadcast(shards), "shard", "left_semi")  # a shard for each of them at most
    return read.mapInArrow(_completed(sent, lower, spark.sparkContext.broadcast(wanted)), FOUND)


def _proven(index: Index, queries: Queries, t: int, found: DataFrame, top: int, most: int) -> tuple[np.ndarray, DataFrame | None]:
    """Which items tier t is enough for, and the ranks of these. found: their best documents by the sums so far."""
    spark, lower, none = index.shards.sparkSession, range(t + 1, len(index.below)), np.zeros(len(queries.items), bool)
    bounds, unseen, least = index.below[t], np.zeros(len(queries.items), np.int64), np.zeros(len(queries.items), np.int64)
    np.add.at(unseen, queries.item, np.repeat(bounds, np.diff(queries.at)) * queries.times)
    whole = _complete(index, spark.sparkContext.broadcast(queries), found.drop("rank"), lower)
    for r in whole.groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= top).collect():  # a row an item
        least[r["item"]] = r["score"]
    number = np.flatnonzero(least > unseen)  # a document without any posting so far is no match for `top` others
    if not len(number):
        return none, None
    own = spark.sparkContext.broadcast(restricted(queries, least > unseen))
    possible = written(index.shards.select(*_columns(range(t + 1))).mapInArrow(_possible(own, t, least[number], bounds, unseen[number]), FOUND), "possible")
    few = [r["item"] for r in possible.groupBy("item").count().where(F.col("count") <= most).collect()]  # a row an item
    if not few:
        return none, None
    none[number[few]] = True
    ranked = _ranked(_complete(index, own, possible.where(F.col("item").isin(few)), lower), top)
    return none, ranked.withColumn("item", F.get(F.lit(number.tolist()).cast("array<long>"), F.col("item").cast("int")))


def search(index: Index, queries: Queries, top: int = 20, most: int = OPEN) -> tuple[DataFrame, list[int]]:
    """Columns item_id, rank, doc_id, score, and how many items were done at each tier."""
    spark, tiers = index.shards.sparkSession, len(index.below)
    out, done = None, []
    with small_batches(spark, 1):
        for t in range(tiers):
            sent = spark.sparkContext.broadcast(queries)  # BLOCK rows at most
            found = _ranked(index.shards.select(*_columns(range(t + 1))).mapInArrow(_best(sent, t, top), FOUND), top)
            proven = np.ones(len(queries.items), bool)
            if t + 1 < tiers:
                proven, found = _proven(index, queries, t, written(found, "best"), top, most)
            done.append(int(proven.sum()))
            if proven.any():
                names = F.lit(queries.items.tolist()).cast("array<long>")
                part = written(found.select(F.get(names, F.col("item").cast("int")).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranks")
                out = part if out is None else out.unionAll(part)
                queries = restricted(queries, ~proven)
            if not len(queries.items):
                break
    return out, done


def restricted(queries: Queries, which: np.ndarray) -> Queries:
    """Only some of the items, numbered anew."""
    number = np.cumsum(which) - 1
    keep = which[queries.item]
    term = np.repeat(np.arange(len(queries.at) - 1), np.diff(queries.at))[keep]
    return Queries(queries.items[which], queries.term, number[queries.item[keep]], queries.times[keep], np.searchsorted(term, np.arange(len(queries.at))))


def queries_of(rows: pa.Table) -> Queries:
    """From columns item_id, term, times."""
    items, item = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
    term, number = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
    order = np.lexsort([item, number])
    return Queries(items, term, item[order], rows.column("times").to_numpy()[order], np.searchsorted(number[order], np.arange(len(term) + 1)))


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20, block: int = BLOCK, shares: tuple[float, ...] = SHARES, most: int = OPEN) -> DataFrame:
    """Columns item_id, rank, doc_id, score: each item's `top` best documents of those with a score above 0.

    docs: columns doc_id, text; items: item_id, text. Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased,
    told apart by 64-bit hashes. Scores are whole numbers, by saturated counts and the rarity of terms. Null and empty texts have no
    term. Repeated rows of documents rank each, a null doc_id as null and after others of its score. Rows of items with one id are
    one item; those with a null id, or without terms, have no rows. Items are searched in blocks of about `block` terms.
    """
    rows = item_terms(items)
    n, out = max(1, -(-rows.count() // block)), None
    for k in range(n):
        own = queries_of(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow())  # a stated set of queries, a bounded block at a time
        if len(own.items):
            part, _ = search(build_index(docs, own.term, shares), own, top, most)
            out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
