"""Generators of rows for SQL: table functions that take the rows of a partition one after the other, or the values of a row (lateral)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

PART = "part int, n_lines int, text string"


class _Open:
    """Lines up to a blank one are a document; part: how many blank lines came before."""

    def __init__(self) -> None:
        self.part, self.lines = 0, []

    def add(self, line: str | None) -> tuple | None:
        if line is not None and line.strip(" "):
            self.lines.append(line)
            return None
        done = self.close()
        self.part += 1
        return done

    def close(self) -> tuple | None:
        done, self.lines = (self.part, len(self.lines), "\n".join(self.lines)) if self.lines else None, []
        return done


class DocumentsOfLines:
    """documents_of_lines(TABLE(id, i, line) PARTITION BY id ORDER BY i): the documents of each id, one held in memory at a time."""

    def __init__(self) -> None:
        self.open, self.id = _Open(), None

    def eval(self, row: Row) -> Iterator[tuple]:
        self.id = row[0]
        if done := self.open.add(row[2]):
            yield self.id, *done

    def terminate(self) -> Iterator[tuple]:
        if done := self.open.close():
            yield self.id, *done


class DocumentsOfText:
    """documents_of_text(text, separator): the documents of one text, by a lateral call. Of a null text none."""

    def eval(self, text: str, separator: str) -> Iterator[tuple]:
        now = _Open()
        for line in [] if text is None else text.split(separator):
            if done := now.add(line):
                yield done
        if done := now.close():
            yield done


class SegmentChunks:
    """segment_chunks(TABLE(doc_id, sentences) PARTITION BY (doc_id), room, seed): how a document's sentences are cut for pairs of segments, see bert.chunks()."""

    def __init__(self) -> None:
        self.number = {}

    def eval(self, row: Row, room: int, seed: int) -> Iterator[tuple]:
        import random

        from epochweave.operators.bert import chunks

        rng = random.Random(f"{seed}:{row[0]}")
        for a, b, target in chunks([s for s in row[1] or [] if s], room, 0.1, rng):
            number = self.number[row[0]] = self.number.get(row[0], -1) + 1
            yield row[0], number, len(a), None if b is None else len(b), target


FUNCTIONS = {
    "documents_of_lines": udtf(DocumentsOfLines, returnType=f"id long, {PART}"), "documents_of_text": udtf(DocumentsOfText, returnType=PART),
    "segment_chunks": udtf(SegmentChunks, returnType="doc_id long, number int, first_tokens int, second_tokens int, target int"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
