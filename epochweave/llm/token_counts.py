"""Token counts by separator scan.

Documents become flat files of token ids, each document followed by an end-of-document id, without any index. To count, files are
read in blocks that know nothing of each other: a vectorised search finds the separators of a block. Then a prefix scan over
each file's blocks (how many separators came before, and where the last one was) stitches documents that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochweave.llm.shared import fresh_path, id_and_text, written
from epochweave.llm.vocabulary import encoder, shared_vocabulary
from epochweave.llm.words import slices
from epochweave.places import filesystem


def write_token_files(docs: DataFrame, vocabulary: str, end: int, folder: str, dtype: str = "uint16") -> DataFrame:
    """Columns file, place, doc_id: which document is where. One flat file for each task; a null text has no tokens.

    Files of tasks that were lost or repeated may stay in the folder, but aren't in the table. An `end` that is a token of the
    vocabulary is an error.
    """
    known = shared_vocabulary(docs.sparkSession, vocabulary, apart=end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(folder)
        encode, name, place, out = encoder(known), f"{uuid.uuid4().hex}.tokens", 0, None
        for batch in slices(batches, most=1 << 19):
            if out is None:
                files.create_dir(where, recursive=True)
                out = files.open_output_stream(f"{where}/{name}", compression=None)
            for text in batch.column(1):
                out.write(np.array([*encode.encode_ordinary(text.as_py() or ""), end], dtype).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(place, place + n), pa.int64()), batch.column(0)], ["file", "place", "doc_id"])
            place += n
        if out is not None:
            out.close()

    return written(id_and_text(docs).mapInArrow(run, "file string, place long, doc_id long"), "places")


def _separators(folder: str, end: int, dtype: str, step: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(folder)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for name, block, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = []
                with files.open_input_file(f"{where}/{name}") as file:
                    for at in range(start, stop, step):
                        ids = np.frombuffer(file.read_at((min(at + step, stop) - at) * width, at * width), dtype)
                        found.append(np.flatnonzero(ids == end) + at)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([stop], pa.int64()), pa.array([np.concatenate(found)], pa.list_(pa.int64()))], ["file", "block", "stop", "ends"])

    return run


def count_tokens(spark: SparkSession, folder: str, end: int, dtype: str = "uint16", block_tokens: int = 1 << 20) -> DataFrame:
    """Columns file, place, n_tokens: the tokens of each document of the flat files in a folder, without its separator.

    Tokens after a file's last separator are a document too. A file of no tokens has no document.
    """
    width = np.dtype(dtype).itemsize
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.floor(F.col("length") / width).alias("total"))
    blocks = listed.where("total > 0").select("file", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens))).alias("block"))
    blocks = blocks.select("file", "block", (F.col("block") * block_tokens).alias("start"), F.least((F.col("block") + 1) * block_tokens, F.col("total")).alias("stop"))
    found = blocks.repartition(max(4 * spark.sparkContext.defaultParallelism, 1), "file", "block").mapInArrow(_separators(folder, end, dtype), "file string, block long, stop long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select(
        "*", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"), F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1).cast("long")).alias("carry"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
    )
    open_end = F.col("final") & (F.coalesce(F.array_max("ends"), F.col("carry")) < F.col("stop") - 1)
    ends = F.when(open_end, F.array_append("ends", F.col("stop"))).otherwise(F.col("ends"))
    one = lambda at, i: F.struct((F.col("earlier") + i).alias("place"), (at - F.coalesce(F.get("ends", i - 1), F.col("carry")) - 1).alias("n_tokens"))
    return scan.withColumn("ends", ends).select("file", F.explode(F.transform("ends", one)).alias("d")).select("file", "d.place", "d.n_tokens")


def document_token_counts(docs: DataFrame, vocabulary: str, end: int, dtype: str = "uint16", block_tokens: int = 1 << 20) -> DataFrame:
    """Columns doc_id, n_tokens: one row for each row of docs, by way of flat files in the shared folder."""
    folder = fresh_path(docs.sparkSession, "tokens")
    places = write_token_files(docs, vocabulary, end, folder, dtype)
    if not places.take(1):
        return places.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counts = count_tokens(docs.sparkSession, folder, end, dtype, block_tokens)
    # both grow with the documents; a table of few bytes on disk may be large in memory, so neither is broadcast
    return places.join(counts.hint("merge"), ["file", "place"]).select("doc_id", "n_tokens")
