"""The corpus pipeline: documents through five of the operators, each stage's rows written before the next reads them.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.  Each works on
all that the one before it kept:

quality_rules      documents that the quality rules reject go
line_dedup         lines that an earlier document holds in the same order go; documents left without a word go
near_dedup         one document of each class of near duplicates stays
decontamination    documents that hold a benchmark item go
mixing             how many words of each document the mix takes; documents of which it takes none go
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import WORD, content_key, written
from rankforge.llm.decontam import uncontaminated
from rankforge.llm.line_dedup import dedup_lines
from rankforge.llm.minhash import one_of_each_class
from rankforge.llm.mixing import mixture
from rankforge.llm.quality import judge_documents


def _apart(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator works on, and all of them in _row, so that no name clashes with an operator's own."""
    return docs.select(*columns, F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.col("text").alias("_text"), F.col("source").alias("_source"), F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))
    return judge_documents(rows, text="_text", host="_source", keep=("_source", "_row")).where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(_apart(docs, "doc_id", "text")).where(F.col("text").rlike(WORD))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return left.select(*(new.get(c, F.col("_row")[c].alias(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs, but for those with the names of the added ones, and size, target, shard and taken."""
    added = ("size", "target", "shard", "taken")
    taken = mixture(docs).where("taken > 0").select(F.col("doc_id").alias("_of"), F.col("key_a").alias("_a"), F.col("key_b").alias("_b"), *added)
    a, b = content_key(F.col("text"))
    # a document is its id and text; the stages before leave no two equal ones
    mine = F.col("doc_id").eqNullSafe(F.col("_of")) & (a == F.col("_a")) & (b == F.col("_b"))
    own = [c for c in docs.columns if c not in added]
    return docs.select(*own).join(taken, mine).select(*own, *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Alignment, similarity classes and block selection have no form in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents of the folder.  An empty table gives no rows; null texts go in the first
    stage, as they have too few words; null ids and sources are values of their own; columns beyond those of the table
    documents go through all stages as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
