"""From raw documents to packed training sequences, in stages that each work on what the one before has kept.

Every stage takes rows with doc_id, text and source, whatever other columns they have (under any names), and all but the last return the
same columns. Texts may be null, empty or of any length, ids null or repeated, tables empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.llm.decontaminate import without_contaminated
from epochweave.llm.line_dedup import line_dedup
from epochweave.llm.ngram_join import ngram_jaccard_join
from epochweave.llm.packing import best_fit_packing
from epochweave.llm.quality import CUT, quality_score, train
from epochweave.llm.shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least CUT. Null texts score as empty ones; where labels teach nothing, all score 0.5 and stay."""
    return docs.where(quality_score(train(docs, table(spark, sf_dir, "labels")), F.col("text").cast("string")) >= CUT)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are on many sites (but where they come first). Null texts, and all lines of documents with a null id, stay."""
    return line_dedup(docs).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 on five-word shingles, the one with the smallest id.

    Documents without words or with a null id link with nothing and stay; rows that repeat an id stay or go together.
    """
    classes = ngram_jaccard_join(docs, n_words=5, percent=80)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item within 0.2 of its length in edits. Null and empty texts, and items without words, have none."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, in bins of 2048 words. Documents without words are in no bin (bin_id null)."""
    return best_fit_packing(docs, capacity=2048)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The classifier's scores and the packing can't be expressed in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
