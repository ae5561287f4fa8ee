"""What a plan is like before it's run: how well it shuffles, what it keeps in cache, how steps fare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochweave.plans.keys import numbered

BLOCK = 1 << 16


def differences(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Columns order, difference: how far each value is from the one before, for dense orders, by blocks that overlap by one row."""
    at = F.col(order)
    both = rows.select(order, value).withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(at / BLOCK), F.floor((at + 1) / BLOCK)))))
    before = Window.partitionBy("_block").orderBy(order)
    found = both.withColumn("difference", F.abs(F.col(value) - F.lag(value).over(before)))
    return found.where((F.col("_block") == F.floor(at / BLOCK)) & F.col("difference").isNotNull()).select(order, "difference")


def difference_entropy(rows: DataFrame, order: str, value: str) -> DataFrame:
    """One row: the entropy, in bits, of the differences of neighbours."""
    counts = differences(rows, order, value).groupBy("difference").agg(F.count("*").alias("n"))
    # sum(n) log2(sum(n)) - sum(n log2 n), over sum(n): no second pass for the total
    return counts.agg(((F.sum("n") * F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n"))) / F.sum("n")).alias("entropy"))


def shuffle_quality(rows: DataFrame, order: str, sample: str, shard: str) -> DataFrame:
    """One row: both entropies and their harmonic mean."""
    a = difference_entropy(rows, order, sample).select(F.round("entropy", 6).alias("sample_entropy"))
    b = difference_entropy(rows, order, shard).select(F.round("entropy", 6).alias("shard_entropy"))
    return a.crossJoin(b).withColumn("quality", F.round(2 / (1 / F.col("sample_entropy") + 1 / F.col("shard_entropy")), 5))  # one row each


def rolling_throughput(steps: DataFrame, order: str, seconds: str, window: int) -> DataFrame:
    """steps with per_second: one over the mean of the last `window` steps' seconds, 0 for the first window - 1 steps; by blocks that overlap by a window."""
    rows = numbered(steps, order, "_at")
    at = F.col("_at")
    both = rows.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(at / BLOCK), F.floor((at + window - 1) / BLOCK)))))
    mean = F.avg(seconds).over(Window.partitionBy("_block").orderBy("_at").rowsBetween(1 - window, 0))
    found = both.withColumn("per_second", F.when(at < window - 1, F.lit(0.0)).otherwise(1 / mean))
    return found.where(F.col("_block") == F.floor(at / BLOCK)).drop("_block", "_at")


def uniform_index(spark: SparkSession, samples: int, per_shard: int) -> DataFrame:
    """Shards of a data set that isn't there: per_shard samples each, and a last one with the rest."""
    return spark.range(-(-samples // per_shard)).select(F.col("id").alias("shard_id"), F.least(F.lit(per_shard), F.lit(samples) - F.col("id") * per_shard).cast("long").alias("n"), (F.col("id") * per_shard).alias("begin"))


def cache_limit(uses: DataFrame) -> DataFrame:
    """One row: the most bytes that a node's cache must hold, when a shard (node, first_use, last_use, size) stays from first to last use."""
    events = uses.select("node", F.col("first_use").alias("t"), F.lit(0).alias("kind"), "size").unionAll(uses.select("node", F.col("last_use"), F.lit(1), -F.col("size")))
    level = F.sum("size").over(Window.partitionBy("node").orderBy("t", "kind", "size").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("level", level).agg(F.max("level").alias("cache_limit"))


def simulation_stats(steps: DataFrame, order: str, wait: str, slow_over: float, warm_steps: int) -> DataFrame:
    """One row: slow steps, where the warm-up (slow steps among the first warm_steps) ends, its wait, and slow steps after it. Orders are distinct."""
    first = steps.select(order, wait).orderBy(order).limit(warm_steps).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)))  # warm_steps rows
    warm = first.where(F.col(wait) > slow_over).agg(F.coalesce(F.max("_r"), F.lit(0)).alias("_warm"), F.max(order).alias("_until"))  # one row
    rows = steps.join(F.broadcast(warm))
    slow, after = F.col(wait) > slow_over, F.col("_until").isNull() | (F.col(order) > F.col("_until"))
    return rows.agg(
        F.sum(slow.cast("long")).alias("slow_steps"), F.first("_warm").alias("warmup_steps"), F.sum(F.when(~after, F.col(wait))).alias("warmup_wait"), F.sum((slow & after).cast("long")).alias("later_drops"),
    )
