"""Fusion of several rankings of the same queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _members(rankings: list[DataFrame]) -> DataFrame:
    rows = [r.select("qid", "rank", "doc_id", "unit_id", "score", F.lit(i).alias("member")) for i, r in enumerate(rankings)]
    return reduce(DataFrame.unionByName, rows)


def _exemplar():
    """The unit of the document's best raw score; of equal ones the first member's."""
    return F.max_by("unit_id", F.struct(F.col("score"), -F.col("member"), -F.col("rank"))).alias("unit_id")


def rrf(rankings: list[DataFrame], k: int = 60, top_k: int = 5, source: str = "rrf") -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over the members, by a document's first place in each.

    Places are those of the member's own list, repeats counted.  Ties keep the order of first appearance.
    """
    first = _members(rankings).groupBy("qid", "member", "doc_id").agg(F.min("rank").alias("rank"), F.max_by("unit_id", F.struct(F.col("score"), -F.col("rank"))).alias("unit_id"), F.max("score").alias("score"))
    fused = first.groupBy("qid", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"), F.min(F.struct("member", "rank")).alias("seen"), _exemplar())
    order = W.partitionBy("qid").orderBy(F.round("fused", 9).desc(), "seen")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)
    return ranked.select("qid", "rank", "doc_id", "unit_id", F.col("fused").alias("score"), F.lit(source).alias("source"))


def quota_union(rankings: list[DataFrame], quota: int = 8, per_ranking_quota: list[int] | None = None, k: int = 60, top_k: int = 50, source: str = "quota_rrf") -> DataFrame:
    """Members take turns to add their best document not yet chosen, quota times each; the rest is filled by fused score.

    Here places are counted after repeats are dropped.  A query's lists are arrays of at most the members' depth, and
    the turns are one aggregate over them.
    """
    quotas = per_ranking_quota or [quota] * len(rankings)
    if len(quotas) != len(rankings):
        raise ValueError("per_ranking_quota must match the number of rankings")
    first = _members(rankings).groupBy("qid", "member", "doc_id").agg(F.min("rank").alias("at"), F.max_by("unit_id", F.struct(F.col("score"), -F.col("rank"))).alias("unit_id"), F.max("score").alias("score"))
    placed = first.withColumn("rank", F.row_number().over(W.partitionBy("qid", "member").orderBy("at", "doc_id")).cast("long"))
    fused = placed.groupBy("qid", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"), F.min(F.struct("member", "rank")).alias("seen"), _exemplar())
    lists = placed.groupBy("qid").agg(*(F.array_sort(F.collect_list(F.when(F.col("member") == i, F.struct("rank", "doc_id")))).alias(f"m{i}") for i in range(len(rankings))))
    turns = [(r, i) for r in range(max(quotas, default=0)) for i in range(len(rankings)) if r < quotas[i]]

    def turn(chosen, i):
        return F.when(F.size(chosen) >= top_k, chosen).otherwise(F.concat(chosen, F.slice(F.array_except(F.get("lists", i), chosen), 1, 1)))

    named = lists.select("qid", F.array(*(F.transform(f"m{i}", lambda x: x["doc_id"]) for i in range(len(rankings)))).alias("lists"))
    order = F.array(*(F.lit(i) for _, i in turns)) if turns else F.array().cast("array<int>")
    picked = named.select("qid", F.aggregate(order, F.array().cast("array<string>"), turn).alias("picked")).select("qid", F.posexplode("picked").alias("place", "doc_id"))
    both = fused.join(picked, ["qid", "doc_id"], "left")
    by = W.partitionBy("qid").orderBy(F.col("place").asc_nulls_last(), F.round("fused", 9).desc(), "seen")
    ranked = both.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top_k)
    return ranked.select("qid", "rank", "doc_id", "unit_id", F.col("fused").alias("score"), F.lit(source).alias("source"))


def z_score(column: str, *by: str):
    """Within by: distance from the mean in population standard deviations; 0 where these are next to nothing."""
    w = W.partitionBy(*by)
    deviation = F.stddev_pop(column).over(w)
    return F.when(deviation >= 1e-9, (F.col(column) - F.avg(column).over(w)) / deviation).otherwise(F.lit(0.0))
