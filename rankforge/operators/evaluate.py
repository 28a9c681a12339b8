"""Evaluation: Recall@k, hits per query, rollups over splits, paired comparison and the union of branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_of_docs

KS = (5, 10, 20, 50)
PARTS = ("holdout", "valid", "train")
BASELINE = "bm25_doc"


def gold_ranks(gold: DataFrame, ranking: DataFrame) -> DataFrame:
    """gold (qid, gold_doc_id, ...) and best: the place of the gold document after repeats are dropped, null if absent."""
    places = first_of_docs(ranking).select(F.col("qid").alias("q"), F.col("doc_id").alias("d"), F.col("rank").alias("best"))
    mine = (F.col("qid").cast("string") == F.col("q").cast("string")) & (F.col("gold_doc_id").cast("string") == F.col("d").cast("string"))
    return gold.join(places, mine, "left").drop("q", "d")


def query_hits(gold: DataFrame, ranking: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """gold with hit@k (0 or 1) for each k."""
    hit = lambda k: F.coalesce((F.col("best") <= k).cast("int"), F.lit(0)).alias(f"hit@{k}")
    return gold_ranks(gold, ranking).select(*gold.columns, *(hit(k) for k in ks))


def recall(hits: DataFrame, *by: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """by, n_eval and recall@k: the mean of the hits, 0 where there are none."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_eval"), *(F.coalesce(F.avg(f"`hit@{k}`"), F.lit(0.0)).alias(f"recall@{k}") for k in ks))


def suite_rollup(records: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Long rollup by experiment and eval_part over successful records: mean, sample deviation and standard error over
    splits (null for one split), and the mean weighted by n_eval."""
    ok = records.where("status = 'ok'")
    out = [F.count_distinct("split").alias("n_splits"), F.avg("n_eval").alias("n_eval_mean"), F.sum("n_eval").alias("n_eval_total")]
    for k in ks:
        m = F.col(f"`recall@{k}`")
        out += [
            F.avg(m).alias(f"recall@{k}_mean"),
            F.stddev_samp(m).alias(f"recall@{k}_std"),
            (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"recall@{k}_se"),
            (F.sum(m * F.col("n_eval")) / F.nullif(F.sum("n_eval"), F.lit(0))).alias(f"recall@{k}_micro"),
        ]
    return ok.groupBy("experiment", "eval_part").agg(*out)


def experiment_status(records: DataFrame) -> DataFrame:
    """experiment, its number of splits, status (failed if any record is not ok) and longest duration."""
    return records.groupBy("experiment").agg(
        F.count_distinct("split").alias("n_splits"), F.when(F.bool_or(F.col("status") != "ok"), "failed").otherwise("ok").alias("status"), F.max("duration_sec").alias("duration_sec")
    )


def wide_summary(records: DataFrame, hits: DataFrame | None = None, baseline: str = BASELINE, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per experiment, columns part_metric for the parts that occur, comparison with the baseline if hits are given."""
    out, rolled = experiment_status(records), suite_rollup(records, ks)
    present = {r[0] for r in rolled.select("eval_part").distinct().collect()}  # three parts at most
    paired = paired_comparison(hits, baseline) if hits is not None else None
    for part in (p for p in PARTS if p in present):
        own = rolled.where(F.col("eval_part") == part)
        named = [F.col(f"`{c}`").alias(f"{part}_{c}") for c in own.columns if c not in ("experiment", "eval_part", "n_splits")]
        out = out.join(own.select("experiment", *named), "experiment", "left")
        if paired is not None:
            own = paired.where(F.col("eval_part") == part)
            named = [F.col(c).alias(f"{part}_recall@5_{c}_vs_baseline") for c in ("delta", "wins", "losses", "ties", "n_compared")]
            out = out.join(own.select("experiment", *named), "experiment", "left")
    return out


def paired_comparison(hits: DataFrame, baseline: str = BASELINE, k: int = 5) -> DataFrame:
    """Each experiment against the baseline on the queries that both have: wins, losses, ties, mean difference."""
    keys = ["split", "eval_part", "qid"]
    one = hits.select(*keys, "experiment", F.col(f"`hit@{k}`").cast("int").alias("hit"))
    base = one.where(F.col("experiment") == baseline).select(*keys, F.col("hit").alias("base"))
    both = one.join(base, keys)
    n = lambda c: F.count_if(c)
    return both.groupBy("experiment", "eval_part").agg(
        F.avg(F.col("hit") - F.col("base")).alias("delta"),
        n((F.col("hit") == 1) & (F.col("base") == 0)).alias("wins"),
        n((F.col("hit") == 0) & (F.col("base") == 1)).alias("losses"),
        n(F.col("hit") == F.col("base")).alias("ties"),
        F.count(F.lit(1)).alias("n_compared"),
    )


def oracle_union(gold: DataFrame, branches: list[DataFrame], fusion: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """qid and, for each k of 20 or more, union@k (any branch hits) and lost@k (some branch hits, the fusion does not)."""
    each = [query_hits(gold, r, ks).select("qid", *(F.col(f"`hit@{k}`") for k in ks)) for r in branches]
    union = reduce(DataFrame.unionByName, each).groupBy("qid").agg(*(F.max(f"`hit@{k}`").alias(f"u{k}") for k in ks))
    both = union.join(query_hits(gold, fusion, ks).select("qid", *(F.col(f"`hit@{k}`").alias(f"f{k}") for k in ks)), "qid")
    out = []
    for k in (k for k in ks if k >= 20):
        out += [F.col(f"u{k}").alias(f"union@{k}"), ((F.col(f"u{k}") == 1) & (F.col(f"f{k}") == 0)).cast("int").alias(f"lost@{k}")]
    return both.select("qid", *out)


def diagnostics_rollup(rows: DataFrame, metrics: tuple[str, ...], losses: tuple[str, ...] = ()) -> DataFrame:
    """By kind and candidate over splits: mean and n_eval-weighted mean of the metrics that are not null, sums of losses."""
    out = [F.count_distinct("split").alias("n_splits"), F.sum("n_eval").alias("n_eval_total")]
    for m in metrics:
        there = F.col(f"`{m}`").isNotNull()
        out += [F.avg(f"`{m}`").alias(f"{m}_mean"), (F.sum(F.col(f"`{m}`") * F.col("n_eval")) / F.nullif(F.sum(F.when(there, F.col("n_eval"))), F.lit(0))).alias(f"{m}_micro")]
    out += [F.sum(f"`{m}`").alias(f"{m}_total") for m in losses]
    return rows.groupBy("kind", "candidate").agg(*out)


def selection_metric(summary: DataFrame) -> str:
    """Mean recall at 5 of the first part that the summary has."""
    return next((f"{p}_recall@5_mean" for p in PARTS if f"{p}_recall@5_mean" in summary.columns), "recall@5_mean")


def ordered_summary(summary: DataFrame, metric: str | None = None) -> DataFrame:
    """By status, then from the best; failed rows come first.  A summary without the metric is ordered by status alone."""
    metric = metric or selection_metric(summary)
    by = [F.col(f"`{metric}`").desc_nulls_last()] if metric in summary.columns else []
    return summary.orderBy("status", *by, "experiment")


def best_experiment(summary: DataFrame, metric: str | None = None, n: int = 1) -> DataFrame:
    """experiment of the n best successful rows."""
    metric = metric or selection_metric(summary)
    ok = summary.where("status = 'ok'")
    by = [F.col(f"`{metric}`").desc_nulls_last()] if metric in summary.columns else []
    return ok.orderBy(*by, "experiment").limit(n).select("experiment")


def top_experiments(summary: DataFrame, n: int, metric: str | None = None) -> list[str]:
    """Names of the n best successful experiments."""
    return [r["experiment"] for r in best_experiment(summary, metric, n).collect()]


def prediction_lists(ranking: DataFrame) -> DataFrame:
    """qid, doc_ids in order of rank."""
    return ranking.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r")).select("qid", F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"))


def reciprocal_rank(gold: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """mrr: an extension, the mean of 1 / place of the gold document within k."""
    return gold_ranks(gold, ranking).agg(F.avg(F.when(F.col("best") <= k, 1.0 / F.col("best")).otherwise(0.0)).alias("mrr"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def length_summary(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.min(n).cast("long").alias("min"), F.max(n).cast("long").alias("max"))


def length_histogram(df: DataFrame, low: int, high: int, bins: int, text: str = "text") -> DataFrame:
    n = F.length(F.coalesce(F.col(text), F.lit(""))).cast("double")
    return df.select(F.width_bucket(n, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


