"""Sources of streams by name, and trying again."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from functools import wraps
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

from epochweave.sources.lines import read_by_index

BUILDERS: dict[str, Callable[..., DataFrame]] = {}
GROUP = "epochweave_sources"


def source(name: str) -> Callable:
    """Register a function of (spark, **options) that returns the rows of a stream."""

    def add(f: Callable) -> Callable:
        BUILDERS[name] = f
        return f

    return add


def build(name: str, spark: SparkSession, **options) -> DataFrame:
    if name not in BUILDERS:
        for found in entry_points(group=GROUP):
            BUILDERS.setdefault(found.name, found.load())
    if name not in BUILDERS:
        raise KeyError(f"no source {name!r}; there are {sorted(BUILDERS)}")
    return BUILDERS[name](spark, **options)


@source("stream")
def _indexed(spark: SparkSession, path: str) -> DataFrame:
    return read_by_index(spark, path)


def retry(errors: tuple[type[Exception], ...] = (Exception,), attempts: int = 3, first_wait: float = 1.0, jitter: float = 0.5) -> Callable:
    """A decorator: again after twice as long each time, a little at random."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def run(*args, **kwargs):
            for k in range(attempts):
                try:
                    return f(*args, **kwargs)
                except errors:
                    if k == attempts - 1:
                        raise
                    time.sleep(first_wait * 2**k + random.uniform(0, jitter))

        return run

    return around
