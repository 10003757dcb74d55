"""A training corpus in five stages: classify, drop repeated lines, drop near copies, mix sources, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of ``documents``. run() writes each stage's rows as Parquet in the shared folder and rereads them.
SQL expresses neither the classifier nor the tokenizer, so there is no ORACLE_SQL; tests/llm hold each stage
against brute force.

Defined results, all stages: null and empty texts are texts without words; texts of any length are whole; rows are
decided one by one: those that share a doc_id each by their own text, those without doc_id like others; equal rows share
a verdict, save where one of a group stays or copies are dealt; an empty table gives an empty one; extra columns of any
name stay. What a stage adds to that is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselab.llm.common import held_out, materialise
from doselab.llm.jaccard_join import deduplicate
from doselab.llm.line_dedup import deduplicate_lines
from doselab.llm.mixing import repeat
from doselab.llm.packing import best_fit_packing, public_encoder
from doselab.llm.quality_classifier import good_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.5 go; a tie at 0.5 stays. It learns from the labels of op8's training rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("quality").alias("label"))
    return good_documents(docs, train)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller doc_id holds go; n_chars follows the text (null for null). All rows stay."""
    return deduplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the smallest doc_id's, by text where rows share it, those without doc_id
    last. Texts without words are in no group."""
    return deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is a source; ties go by hash."""
    return repeat(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows with their sequences and places."""
    return best_fit_packing(docs, public_encoder())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", copies_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
