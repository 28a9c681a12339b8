"""Splits that keep each group of rows on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_holdout(rows: DataFrame, group: str = "gold_doc_id", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with eval_part: holdout for the share test_size of the groups, by the order of a seeded hash; else train."""
    groups = rows.select(F.col(group).cast("string").alias("g")).distinct()
    order = F.md5(F.concat(F.lit(f"{seed}:").cast("binary"), F.coalesce("g", F.lit("")).cast("binary")))
    n = F.ceil(F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) * F.lit(test_size))
    placed = groups.select("g", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "g")).alias("n"), n.alias("held"))
    sides = placed.select("g", F.when(F.col("n") <= F.col("held"), "holdout").otherwise("train").alias("eval_part"))
    return rows.join(sides, F.col(group).cast("string").eqNullSafe(F.col("g"))).drop("g")


def group_kfold(rows: DataFrame, group: str = "gold_doc_id", n_splits: int = 5) -> DataFrame:
    """rows with split fold_i: groups from the largest, each to the fold with the fewest rows so far.

    The greedy choice is one aggregate over the array of groups; groups are gold documents, not rows.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    sizes = rows.groupBy(F.col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    ordered = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.coalesce("g", F.lit("")).alias("g")))).alias("groups"))
    kind = "struct<load:array<bigint>,out:array<struct<g:string,fold:int>>>"

    def put(acc, x):
        load = acc["load"]
        fold = (F.array_position(load, F.array_min(load)) - 1).cast("int")
        return F.struct(F.transform(load, lambda n, i: F.when(i == fold, n - x["less"]).otherwise(n)).alias("load"), F.concat(acc["out"], F.array(F.struct(x["g"].alias("g"), fold.alias("fold")))).alias("out")).cast(kind)

    begin = F.struct(F.array_repeat(F.lit(0).cast("long"), n_splits).alias("load"), F.array().cast("array<struct<g:string,fold:int>>").alias("out")).cast(kind)
    folds = ordered.select(F.explode(F.aggregate("groups", begin, put)["out"]).alias("f")).select(F.col("f.g").alias("g"), F.concat(F.lit("fold_"), F.col("f.fold").cast("string")).alias("split"))
    return rows.join(folds, F.coalesce(F.col(group).cast("string"), F.lit("")) == F.col("g")).drop("g")


def eval_folds(train: DataFrame, mode: str = "holdout", group: str = "gold_doc_id", seed: int = 42, n_splits: int = 5) -> DataFrame:
    """train rows to be evaluated, with split and eval_part.

    holdout: the held-out groups; cv: k folds of the other groups, never the held-out ones; train: all rows.
    """
    if mode == "train":
        return train.withColumns({"split": F.lit("train"), "eval_part": F.lit("train")})
    held = group_holdout(train, group, seed=seed)
    if mode == "holdout":
        return held.where("eval_part = 'holdout'").withColumn("split", F.lit("holdout"))
    if mode == "cv":
        return group_kfold(held.where("eval_part = 'train'").drop("eval_part"), group, n_splits).withColumn("eval_part", F.lit("valid"))
    raise ValueError(f"unknown mode: {mode}")
