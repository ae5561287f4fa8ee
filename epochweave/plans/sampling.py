"""Drawing an epoch's samples from shards. Shards are all that is planned with: rows of data are looked at only when a plan is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochweave.plans.keys import key, running


def shards_of(samples: DataFrame) -> DataFrame:
    """Columns stream_id, shard_id, n, first_sample: the shards of samples, whose ids are dense within a shard."""
    return samples.groupBy("stream_id", "shard_id").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_sample"))


def draw_per_shard(shards: DataFrame, choose: Column, granularity: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """shards (stream_id, shard_id, n) with chosen: how many samples each gives so that a stream gives `choose`.

    Whole multiples of a stream's size take every shard as often. What is over is made up of picks of at most `granularity` rows of
    a shard, taken in hashed order until there are enough (the last is cut), so that the remainder touches few shards.
    """
    if granularity < 1:
        raise ValueError("granularity must be at least 1")
    total = F.sum("n").over(Window.partitionBy("stream_id"))  # a row for each shard
    base = shards.withColumn("_total", total).withColumn("_choose", choose).withColumn("_full", F.floor(F.col("_choose") / F.col("_total"))).withColumn("_rest", F.col("_choose") % F.col("_total"))
    picks = base.where("_rest > 0").select("stream_id", "shard_id", "n", "_rest", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / granularity) - 1)).alias("_pick"))
    picks = picks.withColumn("_size", F.least(F.lit(granularity).cast("long"), F.col("n") - F.col("_pick") * granularity)).withColumn("_key", key("pick", "shard_id", "_pick", seed=seed, epoch=epoch))
    picks = running(picks, ["stream_id"], "_key", "_size", "_before")
    taken = picks.withColumn("_got", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before")))).groupBy("shard_id").agg(F.sum("_got").alias("_got"))
    out = base.join(taken, "shard_id", "left").withColumn("chosen", (F.col("_full") * F.col("n") + F.coalesce("_got", F.lit(0))).cast("long"))
    return out.drop("_total", "_choose", "_full", "_rest", "_got")


def whole_shards(shards: DataFrame, choose: Column) -> DataFrame:
    """As draw_per_shard, where every stream gives a multiple of its size, so that nothing has to be picked."""
    total = F.sum("n").over(Window.partitionBy("stream_id"))
    return shards.withColumn("chosen", (F.floor(choose / total) * F.col("n")).cast("long"))


def shuffle_units(shards: DataFrame) -> DataFrame:
    """Rows stream_id, shard_id, n, copy, size, unit_begin, base: each full copy of a shard (n, chosen) and its remainder.

    unit_begin says where they lie among all drawn rows. base is the sample that a full copy begins with; a remainder has none.
    """
    units = shards.where("chosen > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("chosen") / F.col("n")) - 1)))
    units = units.withColumn("size", F.least(F.col("n"), F.col("chosen") - F.col("copy") * F.col("n")))
    sums = units.groupBy("stream_id").agg(F.sum("size").alias("_s"))
    first = sums.withColumn("_first", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("stream_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")  # a row for each stream
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("stream_id").orderBy("shard_id", "copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each copy of a shard
    base = F.when(F.col("size") == F.col("n"), F.col("first_sample"))
    return units.withColumn("_in", inside).join(F.broadcast(first), "stream_id").select("stream_id", "shard_id", "n", "copy", "size", (F.col("_first") + F.col("_in")).cast("long").alias("unit_begin"), base.alias("base"), "first_sample")


def remainders(units: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Rows big_id, unit_begin, sample_id, stream_id, shard_id of the units without a base: drawn from their shards without replacement, in order."""
    rows = units.where("base is null").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_place")).withColumn("sample_id", F.col("first_sample") + F.col("_place"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("shard_id").orderBy(key("draw", "sample_id", seed=seed, epoch=epoch)))).where(F.col("_r") <= F.col("size"))
    at = F.row_number().over(Window.partitionBy("shard_id").orderBy("_place")) - 1
    return rows.select((F.col("unit_begin") + at).alias("big_id"), "unit_begin", "sample_id", "stream_id", "shard_id")


def resample(units: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Rows big_id, unit_begin, sample_id, stream_id, shard_id: all that is drawn, from shuffle_units()."""
    whole = units.where("base is not null").select("unit_begin", "base", "stream_id", "shard_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("_i"))
    whole = whole.select((F.col("unit_begin") + F.col("_i")).alias("big_id"), "unit_begin", (F.col("base") + F.col("_i")).alias("sample_id"), "stream_id", "shard_id")
    return whole.unionByName(remainders(units, seed, epoch))
