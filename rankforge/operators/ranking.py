"""Rankings: top k, zero padding, dedupe by document and chunk-to-document aggregation.

Scores are compared after rounding to nine digits, ties by unit, so a ranking is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AGGREGATIONS = ("max", "top2_mean", "max_plus_second", "softmax_top3")
SECOND_SHARE = 0.2


def _by_score(*ties: str) -> list[Column]:
    return [F.round("score", 9).desc(), *(F.col(t).asc() for t in ties)]


def top_k(hits: DataFrame, k: int, source: str = "") -> DataFrame:
    """The best k hits of each query as a ranking.  row_number under a limit prunes before the shuffle."""
    w = W.partitionBy("qid").orderBy(*_by_score("unit_ord"))
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "unit_id", "score", F.lit(source).alias("source"), "unit_ord")


def padded(ranking: DataFrame, units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query filled up to k units with units of score 0, the first by unit_ord that it has not matched.

    Those are among the first k units, so each query meets k candidates, not all units.
    """
    first = units.select("unit_ord", "unit_id", "doc_id").orderBy("unit_ord").limit(k)
    short = queries.select("qid").join(ranking.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    fill = short.join(F.broadcast(first)).join(ranking.select("qid", "unit_ord"), ["qid", "unit_ord"], "left_anti")
    fill = fill.withColumn("rank", (F.row_number().over(W.partitionBy("qid").orderBy("unit_ord")) + F.col("n")).cast("long")).where(F.col("rank") <= k)
    source = ranking.select(F.first("source", ignorenulls=True).alias("source"))
    rows = fill.select("qid", "rank", "doc_id", "unit_id", F.lit(0.0).alias("score"), "unit_ord").join(F.broadcast(source))
    return ranking.unionByName(rows.select(*ranking.columns))


def dedupe_ranked_docs(ranking: DataFrame, k: int) -> DataFrame:
    """The best row of each document by score, ranked anew."""
    best = ranking.withColumn("n", F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(*_by_score("rank")))).where("n = 1")
    again = best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*_by_score("rank"))).cast("long"))
    return again.where(F.col("rank") <= k).drop("n")


def first_of_docs(ranking: DataFrame, k: int | None = None) -> DataFrame:
    """qid, rank, doc_id: documents in the order of their first places, ranked anew, at most k."""
    first = ranking.groupBy("qid", "doc_id").agg(F.min("rank").alias("at"))
    again = first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("at", "doc_id")).cast("long"))
    again = again if k is None else again.where(F.col("rank") <= k)
    return again.select("qid", "rank", "doc_id")


def aggregate_chunks(ranking: DataFrame, method: str = "max", k: int | None = None, source: str | None = None) -> DataFrame:
    """Chunks to documents.  A document's score is of its best chunks, and unit_id names the best.

    max: the best; top2_mean: mean of two; max_plus_second: the best and a fifth of the second; softmax_top3: mean of
    three weighted by the exponent of their scores.
    """
    if method not in AGGREGATIONS:
        raise ValueError(f"unknown chunk aggregation: {method}")
    n = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(*_by_score("rank")))
    top = ranking.withColumn("n", n).where("n <= 3")
    at = lambda i: F.max(F.when(F.col("n") == i, F.col("score")))
    docs = top.groupBy("qid", "doc_id").agg(at(1).alias("s1"), at(2).alias("s2"), at(3).alias("s3"), F.min("rank").alias("at"), F.max(F.when(F.col("n") == 1, F.col("unit_id"))).alias("unit_id"), F.max("source").alias("of"))
    s1, s2, s3 = F.col("s1"), F.col("s2"), F.col("s3")
    score = {
        "max": s1,
        "top2_mean": (s1 + F.coalesce(s2, s1)) / 2,
        "max_plus_second": s1 + SECOND_SHARE * F.coalesce(s2, F.lit(0.0)),
        "softmax_top3": (s1 + F.coalesce(s2 * F.exp(s2 - s1), F.lit(0.0)) + F.coalesce(s3 * F.exp(s3 - s1), F.lit(0.0))) / (1 + F.coalesce(F.exp(s2 - s1), F.lit(0.0)) + F.coalesce(F.exp(s3 - s1), F.lit(0.0))),
    }[method]
    named = docs.select("qid", "doc_id", "unit_id", score.alias("score"), "at", (F.lit(source) if source else F.concat_ws(":", "of", F.lit(method))).alias("source"))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*_by_score("at"))).cast("long"))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "doc_id", "unit_id", "score", "source")
