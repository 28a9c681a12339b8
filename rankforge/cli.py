"""python -m rankforge.cli {suite,rerank,submission,supervision} --data FOLDER ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.supervision import evidence_windows, training_pairs
from .plans.registry import recall_experiments
from .plans.rerank_suite import RerankOptions, run_rerank_suite
from .plans.suite import create_submission, run_suite, select_best
from .sources.tables import Layout, load_bundle, present_columns, write_csv

SHOWN = ["experiment", "status", "n_splits", *(f"{p}_recall@{k}_mean" for p in ("holdout", "valid", "train") for k in (5, 10, 20, 50)), "duration_sec"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rankforge")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("suite", "rerank", "submission", "supervision"):
        c = commands.add_parser(name)
        c.add_argument("--data", required=True)
        c.add_argument("--mode", choices=("holdout", "cv", "train"), default="holdout" if name == "rerank" else "cv")
        c.add_argument("--recall", action="store_true", help="also the experiments for wider recall")
        c.add_argument("--optional", action="store_true", help="also the experiments that need models")
        c.add_argument("--folds", type=int, default=5)
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--experiments", nargs="*")
        c.add_argument("--out")
        if name == "rerank":
            o = RerankOptions()
            c.add_argument("--model", dest="models", nargs="+", default=o.models)
            for option, kind, default in (("ks", int, o.ks), ("depths", int, o.depths), ("chunks-per-doc", int, o.chunks_per_doc), ("chunk-aggs", str, o.chunk_aggs), ("score-modes", str, o.score_modes), ("candidate-weights", float, o.candidate_weights)):
                c.add_argument(f"--{option}", type=kind, nargs="+", default=default)
            for option, default in (("candidate-depth", o.candidate_depth), ("chunk-depth", o.chunk_depth), ("pair-chars", o.pair_chars), ("batch-size", o.batch_size), ("max-length", o.max_length)):
                c.add_argument(f"--{option}", type=int, default=default)
            c.add_argument("--bge-m3", action="store_true", help="also the candidates that need its dense and lexical weights")
            c.add_argument("--submit", action="store_true", help="write submissions of the best configurations")
            c.add_argument("--top-n", type=int, default=1)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("rankforge").getOrCreate()
    data, layout = load_bundle(spark, args.data), Layout(args.data)
    extra = recall_experiments(args.optional) if args.recall else None
    if args.command == "suite":
        _, _, summary = run_suite(data, args.experiments, args.mode, extra, args.optional, args.seed, args.folds, out=args.out or layout.artifact("reports"))
        present_columns(summary, SHOWN).show(200, truncate=False)
        print("best:", select_best(summary))
    elif args.command == "rerank":
        same = {name: getattr(args, name) for name in ("mode", "seed", "ks", "candidate_depth", "depths", "chunks_per_doc", "chunk_aggs", "score_modes", "candidate_weights", "models", "chunk_depth", "pair_chars", "batch_size", "max_length")}
        options = RerankOptions(n_splits=args.folds, candidates=args.experiments, with_e5=args.optional, with_bge_m3=args.bge_m3, **same)
        result = run_rerank_suite(data, options, extra=extra, out=args.out or layout.artifact("reports"), submissions=layout.submissions if args.submit else None, top_n=args.top_n)
        present_columns(result.summary, SHOWN).show(200, truncate=False)
        print("best:", result.best_rerank, "of all:", result.best, *result.submissions)
    elif args.command == "submission":
        for name in args.experiments or ["bm25_doc"]:
            create_submission(data, name, args.out or f"{layout.submissions}/{name}", extra, args.optional)
    else:
        write_csv(training_pairs(evidence_windows(data.train, data.documents)), args.out or layout.artifact("supervision"))


if __name__ == "__main__":
    main()
