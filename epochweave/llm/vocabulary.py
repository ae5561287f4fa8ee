"""Byte-level BPE vocabularies given as files of ranks."""

from __future__ import annotations

import base64

from pyspark import Broadcast
from pyspark.sql import SparkSession

MOST_BYTES = 32 << 20
#: How a text is cut before the merges: the fixed pattern of this kind of vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shared_vocabulary(spark: SparkSession, path: str, apart: int | None = None) -> Broadcast:
    """The file's bytes for all executors; its size is bounded by MOST_BYTES. apart: an id that no token may have."""
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    if apart is not None and any(int(line.split()[1]) == apart for line in data.splitlines()):
        raise ValueError(f"{apart} is a token of {path}, so it can't stand for something else")
    return spark.sparkContext.broadcast((path, data))


def encoder(vocabulary: Broadcast):
    """Built once in each Python worker."""
    import tiktoken
    import tiktoken.registry as known

    path, data = vocabulary.value
    name = f"file:{path}:{len(data)}"
    if name not in known.ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        known.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return known.ENCODINGS[name]
