"""Sizes, counts and times written as text: on the driver, and as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES = {"b": 0, "kb": 1, "mb": 2, "gb": 3, "tb": 4, "pb": 5, "eb": 6, "zb": 7, "yb": 8}
COUNTS = {"k": 1, "m": 2, "b": 3, "t": 4}


def bytes_to_int(text: int | str) -> int:
    """64, "64", "64b", "1.5kb" and so on, by 1024, cut to a whole."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?)\s*([kmgtpezy]?b)?\s*", text.lower())
    if not found:
        raise ValueError(f"no size: {text!r}")
    return int(float(found[1]) * 1024 ** BYTES[found[2] or "b"])


def count_to_int(text: int | str) -> int:
    """7, "7", "1.5k", "2b" and so on, by 1000, cut to a whole."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?)\s*([kmbt])?\s*", text.lower())
    if not found:
        raise ValueError(f"no count: {text!r}")
    return int(float(found[1]) * 1000 ** COUNTS.get(found[2], 0))


def _scaled(c: Column, units: dict[str, int], base: int, pattern: str) -> Column:
    low = F.lower(F.trim(c))
    number, unit = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    scale = F.lit(1.0)
    for name, power in units.items():
        scale = F.when(unit == name, F.lit(float(base**power))).otherwise(scale)
    return F.when(number != "", F.floor(number.cast("double") * scale).cast("long"))


def bytes_column(c: Column) -> Column:
    return _scaled(c, {k: v for k, v in BYTES.items() if v <= 5}, 1024, r"^(\d+(?:\.\d*)?)\s*([kmgtp]?b)?$")


def count_column(c: Column) -> Column:
    return _scaled(c, COUNTS, 1000, r"^(\d+(?:\.\d*)?)\s*([kmbt])?$")


def list_column(c: Column) -> Column:
    """Items between commas; an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def duration_column(c: Column) -> Column:
    """PT1H2M3S and the like, in seconds."""
    part = lambda x: F.coalesce(F.regexp_extract(c, rf"(\d+){x}", 1).try_cast("long"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def time_column(c: Column) -> Column:
    """A training time such as 3ep or 100ba as struct<value:double,unit:string>."""
    pattern = r"^([\d.]+)\s*(ep|ba|sp|tok|dur)$"
    return F.struct(F.regexp_extract(c, pattern, 1).try_cast("double").alias("value"), F.regexp_extract(c, pattern, 2).alias("unit"))


@total_ordering
@dataclass(frozen=True)
class TrainingTime:
    """So many epochs (ep), batches (ba), samples (sp), tokens (tok), or a share of a run (dur). Only times of one unit compare and add up."""

    value: float
    unit: str = "ba"

    @staticmethod
    def of(text: str | TrainingTime) -> TrainingTime:
        if isinstance(text, TrainingTime):
            return text
        found = re.fullmatch(r"\s*(\d+(?:\.\d*)?)\s*(ep|ba|sp|tok|dur)\s*", text.lower())
        if not found:
            raise ValueError(f"no training time: {text!r}")
        number = float(found[1])
        if found[2] != "dur" and number != int(number):
            raise ValueError(f"{found[2]} come whole, not as {found[1]}")
        return TrainingTime(number if found[2] == "dur" else int(number), found[2])

    def _value(self, other: TrainingTime | str | float) -> float:
        if isinstance(other, (int, float)):
            return other
        other = TrainingTime.of(other)
        if other.unit != self.unit:
            raise ValueError(f"{self.unit} and {other.unit} don't go together")
        return other.value

    def __eq__(self, other) -> bool:
        return self.value == self._value(other)

    def __lt__(self, other) -> bool:
        return self.value < self._value(other)

    def __hash__(self) -> int:
        return hash((self.value, self.unit))

    def __add__(self, other) -> TrainingTime:
        return TrainingTime(self.value + self._value(other), self.unit)

    def __sub__(self, other) -> TrainingTime:
        return TrainingTime(self.value - self._value(other), self.unit)

    def __mul__(self, other) -> TrainingTime:
        return TrainingTime(type(self.value)(self.value * self._value(other)), self.unit)

    def __truediv__(self, other) -> float:
        """How many times the other; so a share of a run."""
        return self.value / self._value(other)

    def __mod__(self, other) -> TrainingTime:
        return TrainingTime(self.value % self._value(other), self.unit)

    __radd__, __rmul__ = __add__, __mul__

    def __str__(self) -> str:
        return f"{self.value}{self.unit}"
