"""Best-fit packing of documents into training sequences, with conflicts.

Bins of `capacity` words are kept in the order of what is left in them. Each carries a bitmap of the sources and one of the duplicate
clusters that it holds. A piece looks from the tightest bin that has room for it upwards, until it finds one that holds neither its
source nor its cluster; if there is none, a bin is opened. Pieces come in falling size. They're dealt by hash to packs of about
pack_rows pieces, whatever their source or cluster, each packed by itself; only numbers are dealt, never texts. Bins that a pack leaves
open are then dealt anew and packed in the same way, as pieces with several sources and clusters, round after round until all that are
open have met in one pack or none could join another.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.llm.shared import grouped, written

PIECES = "doc_id long, piece long, begin_word long, n_words long, site long, cluster long, bin_id long"
#: A bin is open if this part of it is left.
OPEN = 16


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece, in the given order; each has a list of sources and one of clusters that its bin may not have yet."""
    often = {c for c, n in Counter(c for of in clusters for c in of).items() if n > 1}  # alone, a cluster has no conflict
    bit: dict = {}
    left: list[tuple[int, int]] = []
    held: list[list[int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = sum(1 << bit.setdefault(("source", x), len(bit)) for x in set(source))
        c = sum(1 << bit.setdefault(("cluster", x), len(bit)) for x in set(cluster) & often)
        at = bisect_left(left, (size, -1))
        while at < len(left) and (held[left[at][1]][0] & s or held[left[at][1]][1] & c):
            at += 1
        if at < len(left):
            room, number = left.pop(at)
        else:
            room, number = capacity, len(held)
            held.append([0, 0])
        held[number][0] |= s
        held[number][1] |= c
        if room > size:
            insort(left, (room - size, number))
        out.append(number)
    return out


def _packed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, rows in grouped(batches):
            one = lambda c: [[] if x is None else [x] for x in rows.column(c).to_pylist()]  # noqa: B023, E731
            bins = best_fit(rows.column("n_words").to_pylist(), one("site"), one("cluster"), capacity)
            names = ["doc_id", "piece", "begin_word", "n_words", "site", "cluster"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), pa.array([(int(pack) << 32) + b for b in bins], pa.int64())], [*names, "bin_id"])

    return run


def _joined(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            ids, first = rows.column("bin_id").to_pylist(), {}
            bins = best_fit(*(rows.column(c).to_pylist() for c in ("n_words", "sites", "clusters")), capacity)
            into = [first.setdefault(b, i) for b, i in zip(bins, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(into, pa.int64())], ["bin_id", "into"])

    return run


def _packs(rows: int, pack_rows: int) -> int:
    """A power of two, so that a row more seldom changes how all are dealt."""
    return 1 << max(0, (-(-rows // pack_rows) - 1).bit_length())


def _together(packed: DataFrame, capacity: int, pack_rows: int) -> DataFrame:
    """packed with the bins that are open joined over packs."""
    most = capacity - capacity // OPEN
    bins = packed.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), F.collect_set("site").alias("sites"), F.collect_set("cluster").alias("clusters")).where(F.col("n_words") <= most)
    bins, moved, number = written(bins, "bins"), None, 0
    while True:
        packs = _packs(bins.count(), pack_rows)
        dealt = bins.withColumn("pack", F.pmod(F.xxhash64("bin_id", F.lit(number)), F.lit(packs))).select("pack", "bin_id", "n_words", "sites", "clusters")
        joined = dealt.repartition("pack").sortWithinPartitions("pack", F.desc("n_words"), "bin_id").mapInArrow(_joined(capacity), "bin_id long, into long")
        joined = written(joined.where("bin_id <> into"), "moves")
        if not joined.take(1):
            break
        step = joined.select(F.col("bin_id").alias("into"), F.col("into").alias("then"))
        moved = joined if moved is None else moved.join(step, "into", "left").select("bin_id", F.coalesce("then", "into").alias("into")).unionByName(joined)
        if packs == 1:
            break
        now = bins.join(joined, "bin_id", "left").groupBy(F.coalesce("into", "bin_id").alias("bin_id")).agg(F.sum("n_words").alias("n_words"), F.flatten(F.collect_list("sites")).alias("sites"), F.flatten(F.collect_list("clusters")).alias("clusters"))
        bins, number = written(now.where(F.col("n_words") <= most), "bins"), number + 1
    if moved is None:
        return packed
    return packed.join(moved, "bin_id", "left").withColumn("bin_id", F.coalesce("into", "bin_id")).drop("into")


def best_fit_packing(docs: DataFrame, capacity: int = 2048, pack_rows: int = 4096) -> DataFrame:
    """Columns doc_id, piece, begin_word, n_words, bin_id: what of which document is in which bin.

    docs: columns doc_id, text, source. Words are runs without white space. A document of more than capacity words is cut into pieces
    of capacity, each a bin by itself, and a rest. No bin holds two pieces of one source, or of texts that are equal but for case
    and white space; null sources conflict with nothing. A null text or one without words is one piece of no words whose bin_id is
    null. Rows that repeat an id are packed each, null ids too. Ties go by doc_id, then piece.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("total"), F.xxhash64(F.col("source").cast("string")).alias("hash"),
        F.col("source").isNull().alias("nowhere"), F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))).alias("cluster"),
    )
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0).cast("long")))))
    pieces = written(
        pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("begin_word"), F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity).cast("long")).alias("n_words"), F.when(~F.col("nowhere"), F.col("hash")).alias("site"), "cluster"), "pieces"
    )
    packs = _packs(pieces.where("n_words > 0").count(), pack_rows)
    none = pieces.where("n_words = 0").select("doc_id", "piece", "begin_word", "n_words", F.lit(None).cast("long").alias("bin_id"))
    rest = pieces.where("n_words > 0").withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "n_words"), F.lit(packs)))
    rest = rest.select("pack", "doc_id", "piece", "begin_word", "n_words", "site", "cluster").repartition("pack").sortWithinPartitions("pack", F.desc("n_words"), "doc_id", "piece", "cluster")
    packed = written(rest.mapInArrow(_packed(capacity), PIECES), "packed")
    packed = _together(packed, capacity, pack_rows) if packs > 1 else packed
    return packed.select(none.columns).unionByName(none)
