"""Order without a generator: what numpy would draw, a hash of (seed, epoch, purpose, id) decides here.

So any permutation or sample is the same however rows are dealt, and SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochweave.places import written


def key(purpose: str, *ids: Column | str, seed: int = 0, epoch: int = 0) -> Column:
    """32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.lit(purpose), *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in ids]))


def uniform(k: Column) -> Column:
    """A key as a number in [0, 1)."""
    return F.conv(F.substring(k, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def running(df: DataFrame, by: list[str], order: str, size: str | None, name: str, ties: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """df with the sum of `size` (1 if None) over the rows of its `by` that come before it, in the order of a hex key (or any column, with a bucket that rises with it).

    Two passes instead of one window over everything: sizes are summed by bucket, the sums' running sums are where each bucket begins,
    and only a bucket's own rows are sorted together. Keys of hashes fill the 4096 buckets evenly, whatever `by` is.
    """
    df = df.withColumn("_bucket", F.substring(order, 1, 3) if bucket is None else bucket)
    counts = df.groupBy(*by, "_bucket").agg((F.count("*") if size is None else F.sum(size)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, "_bucket").orderBy(order, *(ties or []))
    inside = F.row_number().over(within) - 1 if size is None else F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(begins, [*by, "_bucket"]).withColumn(name, F.col("_begin") + inside).drop("_bucket", "_begin")


def ranked(df: DataFrame, by: list[str], order: str, name: str, ties: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """df with each row's place, from 0, among the rows of its `by`."""
    return running(df, by, order, None, name, ties, bucket)


def numbered(rows: DataFrame, order: str | list, name: str) -> DataFrame:
    """rows with each row's place, from 0, in an order of columns of any type: sorted by ranges, each of which begins where the counts of those before it end.

    The sorted rows are written to the shared folder, since counts and places must come from the same ranges.
    """
    order = order if isinstance(order, list) else [order]
    kept = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(kept.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = {r._part: r.n for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    begins, before = [], 0
    for part in sorted(sizes):
        begins.append((part, before))
        before += sizes[part]
    begins = rows.sparkSession.createDataFrame(begins, "_part int, _begin long")
    return kept.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_row")).drop("_part", "_begin", "_row")
