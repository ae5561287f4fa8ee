"""N-gram Jaccard join: which documents share almost all of their word n-grams.

The join is a sparse matrix product of the document by n-gram incidence matrix with its transpose, done in blocks. Equal sets are one
row of the matrix. What could link is narrowed down by bounds that follow from the sizes, none of which loses a link:

1. Columns are put in one order for all, by how common they are, then by hash. Two sets that link share one of the first
   n - ceil(t n) + 1 columns of each, so these are a row's keys; n-grams that many documents share come last. How common an n-gram is,
   is counted over all documents in 2**SLOTS counters by hash; where n-grams share a counter only the order changes, not the links.
2. The smallest row of a key is its hub. Rows that have a key in common are in the block of its hub, so a row is in as many blocks as
   it has hubs, and blocks don't grow by chance meetings from row to row. A counter is at least the number of rows that have its
   keys: keys of up to HOT rows are grouped in one shuffle, others aggregated before it and joined, so that Spark can split them.
3. A row stays in a block if others there are in its band of sizes or a neighbouring one. Each row has a bitmap of about as many bits
   as columns: the parity of the columns that fall on a bit. Two bitmaps differ in no more bits than the sets do in columns, so a pair
   of rows in a block whose bitmaps differ in more than its sizes allow is dropped.
4. Rows that are left, directly or over others, are a block of the product. A block of over `block` n-grams is cut by size and hash,
   and only pairs of parts are multiplied whose sizes can link. Overlap counts accumulate over the rows' first columns, then in full
   for the pairs that are left, and pairs below the bound of their sizes are dropped. Pairs already joined through others aren't
   looked at, so a block of n like documents returns n - 1 links, not all pairs.

Nothing is sampled or capped. Sets are recomputed from text where they're needed, since text is smaller than its hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochweave.llm.components import Forest, connected_components
from epochweave.llm.shared import discard, grouped, id_and_text, small_batches, written
from epochweave.llm.words import mix, shingle_sets, signature, signed, slices

BLOCK = 1 << 19
SLOTS = 22
HOT = 1 << 17
PARTS = 64
NARROW, WIDE = 128, 1 << 15
SETS = "doc_id long, n_shingles long, sign1 long, sign2 long, bits binary, part int, counts binary"


def bands(percent: int, upto: int = 1 << 40) -> list[int]:
    """Where each band of sizes begins: partners are in one band or two neighbours."""
    out = [1]
    while out[-1] < upto:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The columns of a set that meet all its partners: its rarest, as many as its size asks for."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    rarity = counts[(s >> np.uint64(64 - SLOTS)).astype(np.int64)]
    return s[np.lexsort((s, rarity))[:n]]


def parity(s: np.ndarray) -> bytes:
    """The bitmap of a set, of a power of two bits that is at least its size, from NARROW to WIDE."""
    width = min(max(NARROW, 1 << (len(s) - 1).bit_length() if len(s) else 0), WIDE)
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_different(n, m, percent: int):
    """In how many columns sets of these sizes may differ that link."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def near(ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs whose bitmaps allow a link, among rows of sides 0 and 1; all sides 0: all rows with all."""
    order = np.lexsort((ids, sizes))
    ids, sizes, sides, bits = ids[order], sizes[order], sides[order], [bits[i] for i in order.tolist()]
    widths, two = np.array([len(b) for b in bits]), bool(sides.any())
    rows, full, half = {}, {}, {}
    for w in np.unique(widths).tolist():
        rows[w] = np.flatnonzero(widths == w)  # in order of size, like all rows
        full[w] = np.frombuffer(b"".join(bits[i] for i in rows[w].tolist()), np.uint64).reshape(len(rows[w]), -1)
        half[w] = full[w][:, : full[w].shape[1] // 2] ^ full[w][:, full[w].shape[1] // 2 :]
    at = np.concatenate([np.arange(len(r)) for r in rows.values()])[np.argsort(np.concatenate(list(rows.values())))]
    fresh, out = np.ones(len(ids), bool), []
    for first in range(len(ids)):
        if not fresh[first]:
            continue
        fresh[first], waiting = False, [first]
        while waiting:
            i = waiting.pop()
            n, w = int(sizes[i]), int(widths[i])
            low, high = np.searchsorted(sizes, [-(-percent * n // 100), 100 * n // percent + 1])
            if not fresh[low:high].any():
                continue
            for other, mine, theirs in ((w, full[w], full), (2 * w, full[w], half), (w // 2, half[w], full)):
                if other not in rows:
                    continue
                a, b = np.searchsorted(rows[other], [low, high])
                place = np.arange(a, b)[fresh[rows[other][a:b]]]
                if two:
                    place = place[sides[rows[other][place]] != sides[i]]
                if len(place):
                    differ = np.bitwise_count(theirs[other][place] ^ mine[at[i]]).sum(1, dtype=np.int64)
                    found = rows[other][place[differ <= most_different(n, sizes[rows[other][place]], percent)]].tolist()
                    fresh[found] = False
                    out += [(int(ids[i]), int(ids[j])) for j in found]
                    waiting += found
    return out


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, some = [c.split()[0] for c in SETS.split(", ")], np.zeros(1 << SLOTS, np.uint32), False
        for batch in slices(batches, most=1 << 20):
            sets = shingle_sets(batch.column(1), n_words)
            signs = [signature(s) for s in sets]
            np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - SLOTS)).astype(np.int64), 1)
            none, some = [None] * len(sets), True
            numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [x[0] for x in signs], [x[1] for x in signs])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array([parity(s) for s in sets], pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        if some:
            none = pa.array([None] * PARTS, pa.int64())
            planes = [zlib.compress(p.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for p in counts.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([None] * PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(planes, pa.binary())], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, planes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            one = np.frombuffer(zlib.decompress(planes.as_buffer()), np.uint8).reshape(4, -1).T
            sums[part] = sums.get(part, np.zeros(1, np.uint32)) + np.ascontiguousarray(one).view(np.uint32).ravel()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["part", "counts"])


def column_counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a column, by the first bits of its hash: 2**SLOTS numbers, whatever the input."""
    rows = sets.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(_summed, "part int, counts binary").collect()  # 4 bytes for each of 2**SLOTS
    out = np.zeros((PARTS, (1 << SLOTS) // PARTS), np.uint32)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def _entries(n_words: int, percent: int, counts: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            known = {}  # equal sets of a batch once
            for s in shingle_sets(batch.column(1), n_words):
                if len(s):
                    known.setdefault(signature(s)[0], s)
            if known:
                keys = [prefix(s, counts.value, percent) for s in known.values()]
                key, sign1 = np.concatenate(keys), np.repeat(np.array(list(known), np.int64), [len(k) for k in keys])
                hot = counts.value[(key >> np.uint64(64 - SLOTS)).astype(np.int64)] > HOT
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(sign1), pa.array(hot)], ["key", "sign1", "hot"])

    return run


def _blocks(entries: DataFrame) -> DataFrame:
    """Columns cluster (the hub), sign1: each row with the hub of each of its keys that others have too."""
    key = Window.partitionBy("key")
    cold = entries.where("not hot").select("sign1", F.min("sign1").over(key).alias("cluster"), F.max("sign1").over(key).alias("top"))
    hot = entries.where("hot")
    hubs = hot.groupBy("key").agg(F.min("sign1").alias("cluster"), F.max("sign1").alias("top"))
    hot = hot.join(hubs.hint("merge"), "key").select("sign1", "cluster", "top")
    return cold.unionByName(hot).where("cluster <> top").select("cluster", "sign1").distinct()


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            if rows.num_rows > 1:
                found = near(*(rows.column(c).to_numpy() for c in ("doc_id", "n_shingles")), rows.column("bits").to_pylist(), rows.column("side").to_numpy(), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def product(ids: list[int], sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A forest of the links (100 * overlap >= percent * union) among rows of sides 0 and 1; both sides 0: all rows with all."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets, sides = [ids[i] for i in order], [sets[i] for i in order], np.array([sides[i] for i in order])
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values))
    column, row = rank[column], np.repeat(np.arange(len(ids)), sizes)
    begin = np.concatenate([[0], np.cumsum(np.sort(count))])
    by_column = row[np.lexsort((row, column))]
    rows = np.split(column[np.lexsort((column, row))], np.cumsum(sizes)[:-1])
    two, forest, out = bool(sides.any()), Forest(), []

    def partners(columns: np.ndarray, i: int) -> np.ndarray:
        columns = columns[begin[columns + 1] - begin[columns] > 1]
        lengths = begin[columns + 1] - begin[columns]
        at = np.arange(lengths.sum()) + np.repeat(begin[columns] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        found = by_column[at]
        return found[found > i]

    for i in range(len(ids) - 1):
        n = int(sizes[i])
        least = -(-percent * n // 100)  # with any partner at least as large
        found = np.unique(partners(rows[i][: n - least + 1], i))
        found = found[(sizes[found] * percent <= 100 * n)]
        if two:
            found = found[sides[found] != sides[i]]
        if out and len(found):
            mine = forest.root(i)
            found = found[[forest.root(j) != mine for j in found.tolist()]]
        if len(found) > 16:
            overlap = np.bincount(partners(rows[i], i), minlength=len(ids))[found]
            good = found[overlap * (100 + percent) >= percent * (n + sizes[found])]
        else:
            good = [j for j in found.tolist() if len(np.intersect1d(rows[i], rows[j], assume_unique=True)) * (100 + percent) >= percent * (n + sizes[j])]
        for j in map(int, good):
            if forest.join(i, j):
                out.append((ids[i], ids[j]))
    return out


def _products(n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            sets = shingle_sets(rows.column("text").combine_chunks(), n_words)
            some = [i for i, s in enumerate(sets) if len(s)]
            ids, sides = rows.column("doc_id").to_pylist(), rows.column("side").to_pylist()
            if found := product([ids[i] for i in some], [sets[i] for i in some], [sides[i] for i in some], percent) if len(some) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def _tasks(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Columns task, doc_id, side: which documents of a block (cluster, doc_id, n_shingles) are compared with which."""
    edges = F.array(*[F.lit(x) for x in bands(percent)])
    members = members.withColumn("band", F.size(F.filter(edges, lambda x: x <= F.col("n_shingles"))) - 1)
    sums = members.groupBy("cluster", "band").agg(F.sum("n_shingles").alias("n"), F.count("*").alias("docs"))
    each = F.map_from_entries(F.collect_list(F.struct("band", F.struct(F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("parts"), "docs"))))
    sums = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("docs").alias("all"), each.alias("bands")).where("all > 1")
    members = members.join(sums, "cluster")
    docs = lambda x: F.coalesce(F.element_at("bands", F.col("band") + x)["docs"], F.lit(0))
    members = members.where(docs(-1) + docs(0) + docs(1) > 1).withColumn("parts", F.transform_values("bands", lambda k, x: x["parts"]))
    small = members.where(F.col("n") <= block).select(F.xxhash64("cluster").alias("task"), "doc_id", F.lit(0).alias("side"))
    cut = members.where(F.col("n") > block)
    in_band = lambda x: F.coalesce(F.element_at("parts", F.col("band") + x), F.lit(0))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id"), in_band(0).cast("long")).cast("int"))
    name = lambda b, i, c, j: F.xxhash64("cluster", b, i, c, j)
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda x: x < n)
    band, part = F.col("band"), F.col("part")
    row = lambda task, side: F.struct(task.alias("task"), side.cast("int").alias("side"))
    tasks = F.concat(
        F.transform(upto(in_band(0)), lambda j: row(name(band, F.least(part, j), band, F.greatest(part, j)), F.when(j < part, 1).otherwise(0))),
        F.transform(upto(F.when(in_band(0) > 0, in_band(1)).otherwise(0)), lambda j: row(name(band, part, band + 1, j), F.lit(0))),
        F.transform(upto(in_band(-1)), lambda j: row(name(band - 1, j, band, part), F.lit(1))),
    )
    cut = cut.select("doc_id", F.explode(tasks).alias("t")).select("t.task", "doc_id", "t.side")
    return small.unionByName(cut)


def ngram_jaccard_join(docs: DataFrame, n_words: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """Columns doc_id, n_shingles, component_id: one row for each row of docs.

    Documents link whose sets of n_words-word shingles have 100 * intersection >= percent * union (percent: 50 to 99). A text is
    lower-cased (A-Z) and cut into runs without white space; with fewer than n_words words it has one shingle, the whole; a null text
    or one without words has none and links with nothing. A null doc_id gets a row with its count and no component. Rows that repeat an
    id are one document that links by any of their texts. Other columns are left aside.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be at least 50 and below 100")
    with small_batches(docs.sparkSession):  # every pass over texts ends within
        return _joined(id_and_text(docs), n_words, percent, block)


def _joined(docs: DataFrame, n_words: int, percent: int, block: int) -> DataFrame:
    every = written(docs.mapInArrow(_sets(n_words), SETS), "sets")
    sets, known = every.where("part is null").drop("part", "counts"), docs.where("doc_id is not null")
    alike = ["n_shingles", "sign1", "sign2"]
    some = sets.where("n_shingles > 0 and doc_id is not null")
    one = written(some.groupBy(*alike).agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits")), "rows")

    counts = docs.sparkSession.sparkContext.broadcast(column_counts(every))
    entries = written(known.mapInArrow(_entries(n_words, percent, counts), "key long, sign1 long, hot boolean"), "keys")
    members = written(_blocks(entries).join(one.select("sign1", "doc_id", "n_shingles"), "sign1").select("cluster", "doc_id", "n_shingles"), "members")
    meeting = written(_tasks(members, percent, 8 * block), "meetings")
    pairs = meeting.join(one.select("doc_id", "n_shingles", "bits"), "doc_id").repartition("task").sortWithinPartitions("task").select("task", "doc_id", "side", "n_shingles", "bits")
    pairs = pairs.mapInArrow(_near(percent), "a long, b long")
    clusters = written(connected_components(pairs).toDF("doc_id", "cluster"), "clusters")

    tasks = written(_tasks(one.select("doc_id", "n_shingles").join(clusters, "doc_id"), percent, block), "tasks")
    held = known.join(tasks, "doc_id").select("task", "doc_id", "side", "text")
    links = held.repartition("task").sortWithinPartitions("task").mapInArrow(_products(n_words, percent), "a long, b long")

    rows = some.join(one.select(*alike, F.col("doc_id").alias("row")), alike).select("doc_id", "row")
    twice = rows.groupBy("doc_id").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").select("doc_id", "low")
    twice = rows.join(twice, "doc_id").select(F.col("row").alias("a"), F.col("low").alias("b"))
    found = connected_components(links.unionByName(twice)).toDF("row", "component")
    of = rows.join(found, "row", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "row")).alias("component_id"))
    for old in (entries, members, meeting, tasks):
        discard(old)
    return sets.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
