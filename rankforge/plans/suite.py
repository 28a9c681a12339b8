"""Running experiments: a planner from names to rankings, the suites that evaluate them, and submissions."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import BASELINE, KS, best_experiment, diagnostics_rollup, oracle_union, ordered_summary, query_hits, recall, wide_summary
from ..operators.fusion import quota_union, rrf
from ..operators.ranking import aggregate_chunks, dedupe_ranked_docs, first_of_docs, padded, top_k
from ..operators.retrieval import bm25, dense, hybrid_search, tfidf
from ..operators.splits import eval_folds
from ..operators.submission import write_submission
from ..operators.units import chunk_units, document_units, query_rows
from ..sources.shared import table
from ..sources.tables import Bundle, append_jsonl, params_json, write_csv
from .registry import Experiment, checked, default_experiments, merged, selected

#: An encoder adds the column vector (and, for kind bge_m3_chunk, weights) to rows with the column text.
Encoder = Callable[[DataFrame, dict, bool], DataFrame]


class Planner:
    """Rankings of experiments over one corpus and one set of queries.

    Results are kept by (name, depth): an experiment that another one needs at a greater depth is made anew, so what it
    gives does not depend on what ran before.  Kept rankings and chunk tables are written once.
    """

    def __init__(self, experiments: list[Experiment], documents: DataFrame, queries: DataFrame, pad_zero: bool = True, member_depth: int | None = None, lemma=None, encoder: Encoder | None = None):
        self.by_name, self.documents, self.queries = checked(experiments), documents, queries
        self.pad_zero, self.member_depth, self.lemma, self.encoder = pad_zero, member_depth, lemma, encoder
        self._rankings: dict[tuple[str, int], DataFrame] = {}
        self._units: dict[object, DataFrame] = {}

    def units(self, kind: object) -> DataFrame:
        if kind not in self._units:
            made = document_units(self.documents, field_aware=kind == "field") if kind in ("doc", "field") else chunk_units(self.documents, kind)
            self._units[kind] = made if kind == "doc" else table(made, "units")
        return self._units[kind]

    def ranking(self, name: str, depth: int = 50) -> DataFrame:
        if (name, depth) not in self._rankings:
            self._rankings[name, depth] = table(self._made(self.by_name[name], depth), f"ranking-{name[:40]}")
        return self._rankings[name, depth]

    def _cut(self, hits: DataFrame, units: DataFrame, depth: int, source: str) -> DataFrame:
        ranking = top_k(hits, depth, source)
        return padded(ranking, units, self.queries, depth) if self.pad_zero else ranking

    def _made(self, e: Experiment, depth: int) -> DataFrame:
        p = e.params
        if e.kind in ("rrf", "quota_rrf"):
            inner = self.member_depth or max(depth, int(p.get("member_rank_depth") or p.get("rank_depth") or depth))
            members = [self.ranking(m, inner) for m in e.members]
            if e.kind == "rrf":
                return rrf(members, int(p.get("rrf_k", 60)), depth, e.name)
            return quota_union(members, int(p.get("quota", 8)), p.get("per_member_quota"), int(p.get("rrf_k", 60)), depth, e.name)
        if e.kind in ("bm25_doc", "bm25_field_doc", "tfidf_doc"):
            units = self.units("field" if e.kind == "bm25_field_doc" else "doc")
            score = tfidf if e.kind == "tfidf_doc" else bm25
            return dedupe_ranked_docs(self._cut(score(units, self.queries, p["config"], self.lemma, k=depth), units, depth, e.name), depth).drop("unit_ord")
        units, k = self.units(p["chunk"]), max(depth, e.rank_depth)
        if e.kind == "bm25_chunk":
            hits = bm25(units, self.queries, p["config"], self.lemma, k=k)
        else:
            hits = self._encoded(e, units, k)
        chunks = self._cut(hits, units, k, e.name)
        return aggregate_chunks(chunks.drop("unit_ord"), p.get("aggregation", "max"), depth, e.name)

    def _encoded(self, e: Experiment, units: DataFrame, k: int) -> DataFrame:
        if self.encoder is None:
            raise ImportError(f"{e.name} needs an encoder: a model that turns texts into vectors")
        config = e.params["config"]
        have = table(self.encoder(units, config, False), "vectors")
        asked = table(self.encoder(self.queries.withColumnRenamed("question", "text"), config, True), "vectors")
        if e.kind == "dense_chunk" or not config.get("use_sparse", True):
            return dense(have, asked, k=k)
        return hybrid_search(have, asked, config.get("dense_weight", 0.7), config.get("sparse_weight", 0.3), k=k)


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def gold_rows(data: Bundle, mode: str, seed: int, n_splits: int) -> DataFrame:
    """The questions to evaluate, of all folds, as a table."""
    folds = eval_folds(data.train, mode, seed=seed, n_splits=n_splits)
    return table(folds.select(F.col("qid").cast("string").alias("qid"), "question", F.col("gold_doc_id").cast("string").alias("gold_doc_id"), "split", "eval_part"), "gold")


def run_suite(data: Bundle, names: list[str] | None = None, mode: str = "cv", extra: list[Experiment] | None = None, include_optional: bool = False, seed: int = 42, n_splits: int = 5, ks: tuple[int, ...] = KS, out: str | None = None, baseline: str = BASELINE, **planner) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, hits, summary) of the experiments.  All folds are evaluated in one pass per experiment: the index does not
    depend on the fold.  An experiment that fails leaves a failed record, and the others go on."""
    spark = data.documents.sparkSession
    experiments = merged(default_experiments(include_optional), extra)
    chosen = selected(experiments, names)
    gold = gold_rows(data, mode, seed, n_splits)
    plan = Planner(experiments, data.documents, query_rows(gold).distinct(), **planner)
    run_id, kept = uuid.uuid4().hex[:12], []
    records: list[DataFrame] = []
    for e in chosen:
        began, stamp = time.time(), now()
        same = {"run_id": run_id, "mode": mode, "experiment": e.name, "priority": e.priority, "description": e.description, "params": params_json(e.params), "started_at": stamp}
        try:
            hits = table(query_hits(gold.drop("question"), plan.ranking(e.name, max(max(ks), e.rank_depth if e.kind in ("rrf", "quota_rrf") else max(ks))), ks).withColumn("experiment", F.lit(e.name)), "hits")
            record = recall(hits, "split", "eval_part", ks=ks).withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
            kept.append(hits)
        except Exception as problem:
            none = {f"recall@{k}": F.lit(None).cast("double") for k in ks}
            record = gold.select("split", "eval_part").distinct().withColumn("n_eval", F.lit(0).cast("long")).withColumns({**none, "status": F.lit("failed"), "error": F.lit(f"{type(problem).__name__}: {problem}"[:500])})
        record = record.withColumns({k: F.lit(v) for k, v in same.items()} | {"duration_sec": F.lit(time.time() - began), "finished_at": F.lit(now())})
        record = table(record, "record")
        if out:
            append_jsonl(record, f"{out}/metrics/{run_id}")
        records.append(record)
    every = reduce(DataFrame.unionByName, records)
    hits = reduce(DataFrame.unionByName, kept) if kept else spark.createDataFrame([], "qid string, gold_doc_id string, split string, eval_part string, experiment string, " + ", ".join(f"`hit@{k}` int" for k in ks))
    summary = ordered_summary(table(wide_summary(every, hits if kept else None, baseline, ks), "summary"))
    if out:
        for name, df in (("folds", every), ("query_hits", hits), ("summary", summary), ("summary_latest", summary)):
            write_csv(df, f"{out}/{name}" if name == "summary_latest" else f"{out}/{name}_{run_id}")
    return every, hits, summary


def select_best(summary: DataFrame, metric: str | None = None) -> str | None:
    rows = best_experiment(summary, metric).collect()
    return rows[0]["experiment"] if rows else None


def recall_diagnostics(data: Bundle, branches: list[str] | None = None, fusion: str = "rrf_sparse_legal_lemma_char", mode: str = "cv", extra: list[Experiment] | None = None, depth: int = 50, ks: tuple[int, ...] = KS, seed: int = 42, n_splits: int = 5, **planner) -> DataFrame:
    """Whether the branches or their fusion limit recall: each one's recall, that of the branches' union, and what the
    fusion loses of it."""
    branches = branches or ["bm25_legal_lemma_doc", "bm25_legal_lemma_chunk_line_10_5_max", "tfidf_char_doc_3_5"]
    experiments = merged(default_experiments(), extra)
    selected(experiments, [*branches, fusion])
    gold = gold_rows(data, mode, seed, n_splits)
    plan = Planner(experiments, data.documents, query_rows(gold).distinct(), **planner)
    depth = max(depth, *ks)
    rows: list[DataFrame] = []
    wide = [k for k in ks if k >= 20]
    none = lambda names: {n: F.lit(None).cast("double") for n in names}
    for name in [*branches, fusion]:
        hit = query_hits(gold.drop("question"), plan.ranking(name, depth), ks)
        rows.append(recall(hit, "split", "eval_part", ks=ks).withColumns({"kind": F.lit("branch"), "candidate": F.lit(name), **none(f"lost@{k}" for k in wide)}))
    union = gold.drop("question", "gold_doc_id").join(oracle_union(gold.select("qid", "gold_doc_id").distinct(), [plan.ranking(b, depth) for b in branches], plan.ranking(fusion, depth), ks), "qid")
    for k in wide:
        part = union.groupBy("split", "eval_part").agg(F.count(F.lit(1)).alias("n_eval"), F.avg(f"`union@{k}`").alias(f"recall@{k}"), F.sum(f"`lost@{k}`").cast("double").alias(f"lost@{k}"))
        rows.append(part.withColumns({"kind": F.lit("oracle_union"), "candidate": F.lit(f"oracle_union_top{k}"), **none([f"recall@{j}" for j in ks if j != k] + [f"lost@{j}" for j in wide if j != k])}))
    return diagnostics_rollup(reduce(DataFrame.unionByName, rows), tuple(f"recall@{k}" for k in ks), tuple(f"lost@{k}" for k in wide))


def create_submission(data: Bundle, experiment: str, path: str, extra: list[Experiment] | None = None, include_optional: bool = False, k: int = 5, **planner) -> None:
    experiments = merged(default_experiments(include_optional), extra)
    chosen = selected(experiments, [experiment])[0]
    plan = Planner(experiments, data.documents, query_rows(data.test), **planner)
    write_submission(plan.ranking(experiment, max(k, int(chosen.params.get("rank_depth") or 100))), path, data.test, data.documents, k)


def best_documents(ranking: DataFrame, k: int) -> DataFrame:
    return first_of_docs(ranking, k)
