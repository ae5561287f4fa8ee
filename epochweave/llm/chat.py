"""Chat formatting with budgeted windows.

A turn is written <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. Inside texts "<", backslashes and "|" get
one backslash more, so that no control string is left, and reading takes it away again. Running sums of the turns' tokens cut a
conversation into spans of whole turns within a budget; a later window begins with the system turn and as many of the last turns
as fit the history's share. The loss mask covers the texts of assistant turns where they are new, not where they are repeated.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.llm.vocabulary import encoder, shared_vocabulary

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, window long, n_repeated int, text string, loss array<struct<start:long,stop:long>>, tokens long"
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _role_in(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


class Windows:
    """One conversation, turn by turn; holds no more than a window and its history."""

    def __init__(self, conv_id, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system, self.past, self.new, self.sums, self.number, self.seen = None, [], [], [0], 0, 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        self.new.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        while len(self.new) > 1 and self.sums[-1] > self.room():
            yield self.cut()

    def room(self) -> int:
        return self.budget - sum(t[2] for t in self.head())

    def head(self) -> list[tuple]:
        """What a later window repeats: the system turn, then the last turns within the history's share, as far as the first new turn leaves room."""
        room = self.budget - self.new[0][2] if self.new else 0
        system = [self.system] if self.system and self.number and self.system[2] <= room else []
        room -= sum(t[2] for t in system)
        keep = bisect_right(list(accumulate(t[2] for t in reversed(self.past))), room)
        return system + self.past[len(self.past) - keep :]

    def cut(self) -> tuple:
        """The next window: as many new turns as fit behind its head, but one at least."""
        n = max(1, bisect_right(self.sums, self.room()) - 1)
        head, span = self.head(), self.new[:n]
        text, loss, at = [], [], 0
        for i, (role, said, _) in enumerate(head + span):
            start = f"{OPEN}{_role_out(role)}\n"
            body = escape(said)
            if role == "assistant" and i >= len(head):
                loss.append({"start": at + len(start), "stop": at + len(start) + len(body)})
            text.append(f"{start}{body}{CLOSE}\n")
            at += len(text[-1])
        out = (self.conv_id, self.number, len(head), "".join(text), loss, sum(t[2] for t in head + span))
        if not self.number and span[0][0] == "system":
            self.system = span[0]
        last = [t for t in self.past + span if t is not self.system]
        keep = bisect_right(list(accumulate(t[2] for t in reversed(last))), self.history)
        self.past = last[len(last) - keep :]
        self.new, self.number = self.new[n:], self.number + 1
        self.sums = [0, *accumulate(t[2] for t in self.new)]
        return out

    def end(self) -> Iterator[tuple]:
        while self.new:
            yield self.cut()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64()]
    names = ["conv_id", "window", "n_repeated", "text", "loss", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _flushed(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 100
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _formatted(budget: int, history: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for conv_id, role, text, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        yield from now.end()
                    now = Windows(conv_id, budget, history)
                yield from now.add(role, text, tokens)
        if now:
            yield from now.end()

    return lambda batches: _flushed(rows(batches))


def format_chats(conversations: DataFrame, vocabulary: str, budget: int = 512, history: int = 128) -> DataFrame:
    """Columns conv_id, window, n_repeated (turns at its head that were there before), text, loss (spans of characters), tokens.

    conversations: columns conv_id, turn, role, text. Turns go by turn (null first), then role and text where they tie; repeated
    rows are turns of their own. Null roles and texts are empty; rows with a null conv_id are one conversation. A turn of more
    tokens than the budget is a window by itself, after the system turn and history. Tokens are counted before the rows are
    dealt out; a conversation is then read as a stream in one task, which holds one window at a time, however long it is.
    """
    known = shared_vocabulary(conversations.sparkSession, vocabulary)

    @F.arrow_udf("long")
    def count(role: pa.Array, text: pa.Array) -> pa.Array:
        encode = encoder(known).encode_ordinary
        return pa.array([len(encode(f"{OPEN}{r}\n{t}{CLOSE}\n")) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)], pa.int64())

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    turns = turns.withColumn("tokens", count("role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "role", "text", "tokens").mapInArrow(_formatted(budget, history), WINDOWS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, held = None, []
    fresh = lambda conv_id: [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
    done = lambda x: [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]
    for batch in batches:
        for conv_id, n_repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != conv_id:
                if now:
                    held.append(done(now))
                now = fresh(conv_id)
            for turn in list(_TURN.finditer(text))[n_repeated:]:
                now[1] += 1
                now[2].update(f"{_role_in(turn[1])}\n{unescape(turn[2])}\n".encode())
            for span in loss:
                target = unescape(text[span["start"] : span["stop"]])
                now[3] += len(target)
                now[4].update(target.encode())
            now[5] += len(text)
        if len(held) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held = []
    if now:
        held.append(done(now))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def read_chats(windows: DataFrame) -> DataFrame:
    """Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows of format_chats alone."""
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "n_repeated", "text", "loss")
    return rows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
