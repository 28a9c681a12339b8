"""Rerank suites: candidates and every configuration over their pairs are evaluated, recorded and submitted."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.evaluate import ordered_summary, query_hits, recall, top_experiments, wide_summary
from ..operators.ranking import top_k
from ..operators.rerank import RerankConfig, Scorer, pairs, rerank_grid, reranked, scored_pairs, scorer_for
from ..operators.retrieval import BM25, bm25
from ..operators.submission import write_submission
from ..operators.units import query_rows
from ..sources.shared import table
from ..sources.tables import Bundle, append_jsonl, params_json, write_csv
from .registry import LEGAL, LINE_10_5, Experiment, default_experiments, merged, recall_experiments, selected
from .suite import Planner, gold_rows, now, select_best


@dataclass(frozen=True)
class RerankOptions:
    """What a suite runs.  Lists become tuples; candidates are ranked as deep as any depth or k needs."""

    mode: str = "holdout"
    seed: int = 42
    n_splits: int = 5
    ks: tuple[int, ...] = (5, 10, 20)
    candidate_depth: int = 100
    depths: tuple[int, ...] = (20,)
    chunks_per_doc: tuple[int, ...] = (2,)
    chunk_aggs: tuple[str, ...] = ("top2_mean",)
    score_modes: tuple[str, ...] = ("ce_plus_candidate",)
    candidate_weights: tuple[float, ...] = (0.15,)
    models: tuple[str, ...] = ("token_overlap",)
    candidates: tuple[str, ...] | None = None
    chunk_depth: int = 2500
    pair_chars: int = 3500
    batch_size: int = 16
    max_length: int = 1024
    with_e5: bool = False
    with_bge_m3: bool = False
    run_id: str | None = None

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, list):
                object.__setattr__(self, f.name, tuple(value))
        object.__setattr__(self, "candidate_depth", max(self.candidate_depth, *self.depths, *self.ks))

    def candidate_names(self) -> tuple[str, ...]:
        if self.candidates is not None:
            return self.candidates
        out = ["rrf_sparse_deep_legal_lemma_char", "quota_sparse_legal_lemma_char_q10"]
        if self.with_e5:
            out += ["rrf_sparse_e5_line", "quota_sparse_e5_line_q8"]
        if self.with_bge_m3:
            out += ["rrf_sparse_bge_m3_native_line", "quota_sparse_bge_m3_native_line_q8"]
        return tuple(out)

    def grid(self, candidate: str, model: str) -> list[RerankConfig]:
        return rerank_grid(candidate, model, self.depths, self.chunks_per_doc, self.chunk_aggs, self.score_modes, self.candidate_weights)


@dataclass(frozen=True)
class RerankResult:
    records: DataFrame
    hits: DataFrame
    summary: DataFrame
    best_rerank: str | None
    best: str | None
    submissions: tuple[str, ...] = ()


class _Pairs:
    """Scored pairs of one set of queries; its chunk ranking is made once, for the first candidate."""

    def __init__(self, data: Bundle, experiments: list[Experiment], queries: DataFrame, options: RerankOptions, scorers: dict[str, Scorer], planner: dict):
        self.documents, self.queries, self.options, self.scorers = data.documents, queries, options, scorers
        self.plan = Planner(experiments, data.documents, queries, **planner)
        self._selector: DataFrame | None = None

    def ranking(self, candidate: str) -> DataFrame:
        return self.plan.ranking(candidate, self.options.candidate_depth)

    def scored(self, candidate: str, model: str, grid: list[RerankConfig]) -> DataFrame:
        o = self.options
        if model not in self.scorers:
            self.scorers[model] = scorer_for(model, o.batch_size, o.max_length)
        units = self.plan.units(LINE_10_5)
        if self._selector is None:
            self._selector = table(top_k(bm25(units, self.queries, BM25(rules=LEGAL), self.plan.lemma, k=o.chunk_depth), o.chunk_depth, "selector"), "selector")
        made = pairs(self.ranking(candidate), self._selector, units, self.documents, max(c.depth for c in grid), max(c.chunks_per_doc for c in grid), o.pair_chars)
        return table(scored_pairs(made, self.queries, self.scorers[model]), "pairs")


def _experiments(options: RerankOptions, extra: list[Experiment] | None) -> list[Experiment]:
    return merged(default_experiments(options.with_e5), recall_experiments(options.with_e5, options.with_bge_m3), extra)


def run_rerank_suite(data: Bundle, options: RerankOptions | None = None, scorers: dict[str, Scorer] | None = None, extra: list[Experiment] | None = None, out: str | None = None, submissions: str | None = None, top_n: int = 1, **planner) -> RerankResult:
    """Every candidate ranking as it is, and every configuration over its pairs, which each model scores once.

    A candidate or model that fails leaves failed records, and the others go on.  With out, records, hits and summary are
    written there; with submissions, the top_n configurations are applied to the test queries and written to that folder.
    """
    o, scorers = options or RerankOptions(), dict(scorers or {})
    spark = data.documents.sparkSession
    experiments, names = _experiments(o, extra), o.candidate_names()
    selected(experiments, list(names))
    gold = gold_rows(data, o.mode, o.seed, o.n_splits)
    asked = gold.drop("question")
    source = _Pairs(data, experiments, query_rows(gold).distinct(), o, scorers, planner)
    run_id = o.run_id or f"rerank_{uuid.uuid4().hex[:12]}"
    records: list[DataFrame] = []
    kept: list[DataFrame] = []

    def attempt(described: list[tuple[str, str, dict]], make: Callable[[], DataFrame]) -> None:
        """described: experiment, description and params of each ranking that make gives, by the column experiment."""
        began, stamp = time.time(), now()
        try:
            ranked = make()
            each = [query_hits(asked, ranked.where(F.col("experiment") == name).drop("experiment"), o.ks).withColumn("experiment", F.lit(name)) for name, _, _ in described]
            hits = table(reduce(DataFrame.unionByName, each), "hits")
            record = recall(hits, "experiment", "split", "eval_part", ks=o.ks).withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
            kept.append(hits)
        except Exception as problem:
            none = {f"recall@{k}": F.lit(None).cast("double") for k in o.ks}
            rows = gold.select("split", "eval_part").distinct().withColumn("experiment", F.explode(F.array(*(F.lit(name) for name, _, _ in described))))
            record = rows.withColumns({"n_eval": F.lit(0).cast("long"), **none, "status": F.lit("failed"), "error": F.lit(f"{type(problem).__name__}: {problem}"[:500])})
        told = spark.createDataFrame([(name, text, params_json(params)) for name, text, params in described], "experiment string, description string, params string")
        same = {"run_id": run_id, "mode": o.mode, "priority": "P0", "started_at": stamp, "finished_at": now(), "duration_sec": time.time() - began}
        records.append(table(record.join(F.broadcast(told), "experiment").withColumns({k: F.lit(v) for k, v in same.items()}), "record"))
        if out:
            append_jsonl(records[-1], f"{out}/metrics/{run_id}")

    plain = {name: f"candidate_{slug(name, 70)}" for name in names}
    configs: dict[str, RerankConfig] = {}
    for name in names:
        about = (plain[name], f"{name} without reranking", {"candidate": name, "depth": o.candidate_depth})
        attempt([about], lambda name=name: source.ranking(name).withColumn("experiment", F.lit(plain[name])))
        for model in o.models:
            grid = o.grid(name, model)
            configs |= {c.name: c for c in grid}
            about = [(c.name, f"{name} reranked by {model}: depth {c.depth}, {c.chunks_per_doc} chunks a document, {c.chunk_agg}, {c.score_mode}", asdict(c)) for c in grid]
            attempt(about, lambda name=name, model=model, grid=grid: table(reranked(source.scored(name, model, grid), grid), "reranked"))
    every = reduce(DataFrame.unionByName, records)
    nothing = "qid string, gold_doc_id string, split string, eval_part string, " + ", ".join(f"`hit@{k}` int" for k in o.ks) + ", experiment string"
    hits = reduce(DataFrame.unionByName, kept) if kept else spark.createDataFrame([], nothing)
    summary = ordered_summary(table(wide_summary(every, hits if kept else None, plain[names[0]], o.ks), "summary"))
    if out:
        for name, df in ((f"folds_{run_id}", every), (f"query_hits_{run_id}", hits), (f"summary_{run_id}", summary), ("rerank_summary_latest", summary)):
            write_csv(df, f"{out}/{name}")
    only = summary.where(F.col("experiment").startswith("rerank_"))
    paths: tuple[str, ...] = ()
    if submissions:
        chosen = [configs[name] for name in top_experiments(only, max(1, top_n))]
        paths = rerank_submissions(data, chosen, submissions, o, scorers, extra, **planner)
    return RerankResult(every, hits, summary, select_best(only), select_best(summary), paths)


def rerank_submissions(data: Bundle, configs: list[RerankConfig], folder: str, options: RerankOptions | None = None, scorers: dict[str, Scorer] | None = None, extra: list[Experiment] | None = None, k: int = 5, **planner) -> tuple[str, ...]:
    """A submission for each configuration.  Those of one candidate and model share their pairs, scored once."""
    o = options or RerankOptions()
    source = _Pairs(data, _experiments(o, extra), query_rows(data.test), o, dict(scorers or {}), planner)
    together: dict[tuple[str, str], list[RerankConfig]] = {}
    for c in configs:
        together.setdefault((c.candidate, c.model), []).append(c)
    paths = []
    for (candidate, model), grid in together.items():
        ranked = table(reranked(source.scored(candidate, model, grid), grid), "reranked")
        for c in grid:
            paths.append(f"{folder.rstrip('/')}/submission_{c.name}")
            write_submission(ranked.where(F.col("experiment") == c.name).drop("experiment"), paths[-1], data.test, data.documents, k)
    return tuple(paths)
