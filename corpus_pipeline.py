"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. `docs` is what the stage before kept,
written as Parquet and read again; all stages but the last return the columns of documents, extra
ones included, whatever their names. Null ids are one id, below all others. Null and empty texts are
equal texts, neither toxic nor near to others nor contaminated. Very long texts are read whole. An empty table gives an empty
table. Rows that repeat an id share its verdict, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlake.llm.common import Scratch, table
from swarmlake.llm.exact_dedup import exact_dedup
from swarmlake.llm.fm_index import decontaminate
from swarmlake.llm.prob_minhash import near_duplicates
from swarmlake.llm.queries import packed
from swarmlake.llm.toxicity import score_toxicity


def _kept(docs: DataFrame, verdict: DataFrame, condition: str) -> DataFrame:
    """Documents whose verdict row meets the condition; rows that repeat an id share its best verdict."""
    keep = verdict.filter(condition).select("doc_id").distinct().alias("keep")
    return docs.alias("docs").join(keep, F.col("docs.doc_id").eqNullSafe(F.col("keep.doc_id")), "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return _kept(docs, score_toxicity(docs, table(spark, sf_dir, "labels")), "predicted = 0")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that repeat it, one."""
    columns = docs.columns
    return _kept(docs, exact_dedup(docs), "kept").dropDuplicates(["doc_id", "text"]).select(*columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the largest id."""
    return _kept(docs, near_duplicates(docs), "kept")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents of `sf_dir`."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
