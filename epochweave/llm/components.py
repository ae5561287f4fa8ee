"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.llm.shared import discard, written

PAIR = "a long, b long"
#: Edges that one task joins in memory.
AT_ONCE = 400_000


class Forest:
    """Union by the smaller id."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, x, y) -> bool:
        """Whether x and y were apart until now."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, AT_ONCE at most at a time, as stars around the smallest id of each component: never more rows than came in."""

    def stars() -> pa.RecordBatch:
        high = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array([forest.root(x) for x in high], pa.int64())], ["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
            if len(forest.up) >= AT_ONCE:
                yield stars()
                forest = Forest()
    yield stars()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Columns node and component (the smallest id reachable), for each id that has an edge to another.

    Alternates large-star and small-star steps, each a grouped minimum and a join by id, so that a hub's edges are combined
    before they are shuffled and Spark can split a hub's share of the join. Each round is written to the shared folder. Tasks join what
    edges they hold beforehand; once all that are left number AT_ONCE or fewer, one task ends the work.
    Edges with a null end or equal ends are left out.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b and a is not null and b is not null")
    now = written(pairs.mapInArrow(_stars, PAIR).distinct(), "edges")
    for _ in range(rounds):
        if now.count() <= AT_ONCE:
            last = written(now.coalesce(1).mapInArrow(_stars, PAIR), "edges")
            discard(now)
            return last.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(last.select("b", "b").distinct())
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionAll(now.select("b", F.lit(0), F.lit(1)))
        open_ends = ends.groupBy("v").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or (above = 1 and below = 1)")
        if not open_ends.take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
        both = now.unionAll(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select("b", "m").where("b <> m").unionAll(least)
        following = written(small.toDF("a", "b").mapInArrow(_stars, PAIR).distinct(), "edges")
        discard(now)
        now = following
    raise RuntimeError(f"components haven't settled after {rounds} rounds")
