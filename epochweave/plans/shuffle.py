"""Permutations of drawn rows that keep each canonical node's share the same in every epoch.

All take units (unit_begin, size: runs of rows of one shard) and rows 0..n-1, and return rows pos, big_id: which drawn row stands where.
Rows go by hashes, so the permutation is not any generator's, but its properties hold: a permutation, the same in every run with the
same seed and epoch, and, but for "naive", each canonical node's set of rows the same in every epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochweave.plans.keys import key, ranked, uniform

ALGORITHMS = ("naive", "py1s", "py2s", "py1br", "py1e")


def _edge(canonical: int, node: Column | str) -> Column:
    """Where a canonical node's share of its group's n rows begins."""
    return F.floor(F.col("n") * (F.col(node) if isinstance(node, str) else node) / canonical).cast("long")


def _more(units: DataFrame) -> list[str]:
    """What else the caller has put into units goes with their rows."""
    return [c for c in units.columns if c not in ("g", "n", "unit_begin", "size")]


def _grouped_spans(units: DataFrame, canonical: int, seed: int) -> DataFrame:
    order = ranked(units.withColumn("_key", key("unit", "unit_begin", seed=seed)), ["g", "n"], "_key", "_rank")
    run = Window.partitionBy("g").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard drawn, not for each sample
    order = order.withColumn("begin", F.coalesce(F.sum("size").over(run), F.lit(0)))
    node_of = lambda p: F.floor(((p + 1) * canonical - 1) / F.col("n"))
    cut = order.withColumn("node", F.explode(F.sequence(node_of(F.col("begin")), node_of(F.col("begin") + F.col("size") - 1))))
    lo, hi = F.greatest("begin", _edge(canonical, "node")), F.least(F.col("begin") + F.col("size"), _edge(canonical, F.col("node") + 1))
    cut = cut.select("g", "n", "unit_begin", "node", lo.alias("begin"), (hi - lo).alias("_size"), (F.col("unit_begin") + lo - F.col("begin")).alias("first"), *_more(units))
    return cut.withColumnRenamed("_size", "size").where("size > 0")


def spans(units: DataFrame, n: int, canonical: int, seed: int = 0) -> DataFrame:
    """Rows unit_begin, node, begin (in the seed's order of units), size, first (drawn row): units in hashed order, cut where nodes end."""
    return _grouped_spans(_one_group(units, n), canonical, seed).select("unit_begin", "node", "begin", "size", "first")


def _one_group(units: DataFrame, n: int) -> DataFrame:
    return units.select(F.lit(0).alias("g"), F.lit(n).cast("long").alias("n"), *[c for c in units.columns if c not in ("g", "n")])


def permutation(units: DataFrame, n: int, canonical: int, algorithm: str = "py1e", seed: int = 0, epoch: int = 0, block_size: int = 1 << 18) -> DataFrame:
    """Columns pos, node, big_id, unit_begin, and whatever else units have."""
    if not 1 <= canonical <= n:
        raise ValueError("each canonical node must have a row")
    return permutations(_one_group(units, n), canonical, algorithm, seed, epoch, F.lit(block_size)).drop("g")


def permutations(units: DataFrame, canonical: int, algorithm: str, seed: int, epoch: int, block: Column) -> DataFrame:
    """Columns g, pos, node, big_id, unit_begin, and whatever else units have: each group g of units (g, n, unit_begin, size) shuffled by itself, all in one pass.

    block is the block's size, a number or an expression of units' columns.
    """
    if algorithm not in ALGORITHMS:
        raise KeyError(f"no shuffle algorithm {algorithm!r}")
    more, units = ["unit_begin", *_more(units)], units.withColumn("_b", block.cast("long"))
    inner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("_i")
    if algorithm == "naive":
        rows = units.select("g", "n", *more, inner).withColumn("big_id", F.col("unit_begin") + F.col("_i"))
        rows = ranked(rows.withColumn("_key", key("naive", "big_id", seed=seed, epoch=epoch)), ["g"], "_key", "pos")
        return rows.select("g", "pos", F.floor(((F.col("pos") + 1) * canonical - 1) / F.col("n")).alias("node"), "big_id", *more)
    run = Window.partitionBy("g", "node").orderBy(key("span", "begin", seed=seed, epoch=epoch)).rowsBetween(Window.unboundedPreceding, -1)
    parts = _grouped_spans(units, canonical, seed).withColumn("at", _edge(canonical, "node") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    rows = parts.select("*", inner).withColumn("big_id", F.col("first") + F.col("_i"))
    if algorithm == "py2s":  # rows of a unit are mixed before it is cut, the same way in every epoch
        first = units.select("g", "unit_begin", inner).withColumn("big_id", F.col("unit_begin") + F.col("_i"))
        mixed = F.row_number().over(Window.partitionBy("g", "unit_begin").orderBy(key("inner", "big_id", seed=seed))) - 1
        first = first.select(F.col("g").alias("_g"), (F.col("unit_begin") + mixed).alias("_place"), F.col("big_id").alias("_mixed"))
        rows = rows.join(first, (F.col("g") == F.col("_g")) & (F.col("big_id") == F.col("_place"))).withColumn("big_id", F.col("_mixed"))
    by_row = key("row", "big_id", seed=seed, epoch=epoch)
    in_span = F.row_number().over(Window.partitionBy("g", "at").orderBy(by_row)) - 1
    if algorithm in ("py1s", "py2s"):
        return rows.select("g", (F.col("at") + in_span).alias("pos"), "node", "big_id", *more)
    low, high, block = _edge(canonical, "node"), _edge(canonical, F.col("node") + 1), F.greatest(F.col("_b"), F.lit(1))
    if algorithm == "py1br":  # staggered blocks that don't overlap and cover the node
        stagger = F.floor(uniform(key("stagger", "node", seed=seed, epoch=epoch)) * (0.75 * block))
        rows = rows.withColumn("_at", F.col("at") + F.col("_i")).withColumn("_block", F.floor((F.col("_at") - low + stagger) / block))
        within = Window.partitionBy("g", "node", "_block")
        return rows.withColumn("_begin", F.min("_at").over(within)).select("g", (F.col("_begin") + F.row_number().over(within.orderBy(by_row)) - 1).alias("pos"), "node", "big_id", *more)
    # py1e: each row moves by up to half a block within its node, as far as its span leaves room
    half = F.greatest(F.lit(0.0), (F.col("_b").cast("double") - F.col("size")) / 2)
    lo, hi = F.greatest(low - F.col("at"), -half), F.least(high - F.col("at") - F.col("size"), half)
    shifted = rows.withColumn("_at", F.col("at") + in_span).withColumn("_to", F.col("_at") + lo + (hi - lo) * uniform(key("shift", "big_id", seed=seed, epoch=epoch)))
    bucket = F.floor((F.col("_to") - low) / block)
    return ranked(shifted, ["g", "node"], "_to", "_r", ["big_id"], bucket).select("g", (_edge(canonical, "node") + F.col("_r")).alias("pos"), "node", "big_id", *more)
