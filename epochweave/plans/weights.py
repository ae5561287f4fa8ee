"""How much is drawn of each stream of a mixture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochweave.plans.keys import key


@dataclass(frozen=True)
class Weight:
    """At most one of these, for one stream."""

    proportion: float | None = None
    repeat: float | None = None
    choose: int | None = None


def validate(weights: list[Weight]) -> str:
    """The kind of the mixture: "relative" or "absolute"."""
    for w in weights:
        given = [x for x in (w.proportion, w.repeat, w.choose) if x is not None]
        if len(given) > 1:
            raise ValueError("only one of proportion, repeat and choose can be given for a stream")
        if given and given[0] < 0:
            raise ValueError("a weight can't be negative")
    relative = [w.proportion is not None for w in weights]
    if any(relative) and not all(relative):
        raise ValueError("proportion must be given for all streams or for none")
    return "relative" if any(relative) else "absolute"


def relative(streams: DataFrame, weight: str, total: int, seed: int = 0) -> DataFrame:
    """streams (stream_id, ...) with choose: floor(total * share), and what that leaves over to the streams whose key comes first.

    streams has a row for each stream of a mixture, so its windows are over a short list.
    """
    every = Window.partitionBy()
    share = F.col(weight) / F.sum(weight).over(every)
    out = streams.withColumn("choose", F.floor(F.lit(total) * share).cast("long"))
    first = F.row_number().over(every.orderBy(key("shortfall", "stream_id", seed=seed)))
    return out.withColumn("choose", F.col("choose") + (first <= F.lit(total) - F.sum("choose").over(every)).cast("long"))


def absolute(streams: DataFrame) -> DataFrame:
    """streams (stream_id, n, repeat, given) with choose: what is given, or repeat times n cut to a whole, or n."""
    return streams.withColumn("choose", F.coalesce(F.col("given").cast("long"), F.floor(F.col("repeat") * F.col("n")).cast("long"), F.col("n")))


def choices(sizes: list[int], weights: list[Weight], epoch_size: int | None = None, seed: int = 0, spark=None) -> list[int]:
    """The same for a list of streams, on the driver: how many samples each gives to an epoch."""
    if validate(weights) == "absolute" and epoch_size is None:
        return [w.choose if w.choose is not None else int(w.repeat * n) if w.repeat is not None else n for n, w in zip(sizes, weights, strict=True)]
    if validate(weights) == "absolute":
        if any(w.repeat is not None or w.choose is not None for w in weights):
            raise ValueError("with an epoch size only proportions may be given")
        shares = [float(n) for n in sizes]
    else:
        shares = [w.proportion for w in weights]
    import hashlib

    total = sum(sizes) if epoch_size is None else epoch_size
    out = [int(total * (s / sum(shares)) + 1e-9) for s in shares]
    order = sorted(range(len(out)), key=lambda i: hashlib.md5(f"{seed}:0:shortfall:{i}".encode()).hexdigest())
    for i in order[: total - sum(out)]:
        out[i] += 1
    return out
