"""Submissions: the frame, its rules and its file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_of_docs

TOP_K = 5


def submission_frame(ranking: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """qid, rank, doc_id: the first top_k different documents of each query."""
    return first_of_docs(ranking, top_k)


def violations(submission: DataFrame, test: DataFrame, documents: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """rule, qid, doc_id: every breach of the rules for submissions."""
    text = lambda df, *c: df.select(*(F.col(x).cast("string").alias(x) for x in c))
    rows, asked, docs = text(submission, "qid", "doc_id"), text(test, "qid").distinct(), text(documents, "doc_id").distinct()
    found = lambda df, rule, *c: df.select(F.lit(rule).alias("rule"), *(F.col(x) if x in c else F.lit(None).cast("string").alias(x) for x in ("qid", "doc_id")))
    return (
        found(asked.join(rows, "qid", "left_anti"), "missing_qid", "qid")
        .unionByName(found(rows.join(asked, "qid", "left_anti").select("qid").distinct(), "unknown_qid", "qid"))
        .unionByName(found(rows.groupBy("qid").count().where(F.col("count") > top_k), "too_many_rows", "qid"))
        .unionByName(found(rows.groupBy("qid", "doc_id").count().where("count > 1"), "duplicate", "qid", "doc_id"))
        .unionByName(found(rows.join(docs, "doc_id", "left_anti").select("doc_id").distinct(), "unknown_doc", "doc_id"))
        .unionByName(found(rows.where("qid is null or doc_id is null"), "null", "qid", "doc_id"))
    )


def validate_submission(submission: DataFrame, test: DataFrame, documents: DataFrame, top_k: int = TOP_K) -> None:
    """Raises ValueError with examples where a rule is broken."""
    if submission.columns != ["qid", "doc_id"]:
        raise ValueError(f"submission must have the columns qid and doc_id, not {submission.columns}")
    bad = violations(submission, test, documents, top_k).limit(5).collect()
    if bad:
        raise ValueError("invalid submission: " + "; ".join(f"{r['rule']} qid={r['qid']} doc_id={r['doc_id']}" for r in bad))


def write_submission(ranking: DataFrame, path: str, test: DataFrame, documents: DataFrame, top_k: int = TOP_K) -> None:
    """Checks the submission and writes it as one CSV file, in the order of the test table and rank; it has top_k rows a query."""
    frame = submission_frame(ranking, top_k)
    validate_submission(frame.select("qid", "doc_id"), test, documents, top_k)
    order = test.select(F.col("qid").cast("string").alias("q"), F.monotonically_increasing_id().alias("at")).groupBy("q").agg(F.min("at").alias("at"))
    placed = frame.join(order, F.col("qid").cast("string") == F.col("q"))
    placed.orderBy("at", "rank").select("qid", "doc_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
