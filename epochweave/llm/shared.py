"""Where intermediate tables are kept, and small helpers that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.places import remove, shared_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, jobs hand Python at most so many rows at once: with long texts, Arrow's default would be large on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Remove what written() kept; only when nothing lazy reads it any more."""
    if path := getattr(df, "_kept_at", None):
        remove(df.sparkSession, path)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row: a column of its own might be put into use's lambdas, and be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that count, so that others can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def grouped(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """Runs of rows with equal values in a column, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and value[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = value[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)
