import pytest
from pyspark.sql import functions as F

from rankforge.operators import evaluate as E
from rankforge.operators import splits, submission
from rankforge.operators.rerank import pairs, rerank_grid, scorer_for
from rankforge.operators.supervision import evidence_windows, hard_negatives, training_pairs
from rankforge.plans import registry as G
from rankforge.plans.rerank_suite import RerankOptions, run_rerank_suite
from rankforge.plans.suite import Planner, create_submission, recall_diagnostics, run_suite, select_best
from rankforge.sources.tables import Bundle, Layout, duplicate_docs, evidence_errors, load_bundle, missing_columns, params_json, unknown_gold


@pytest.fixture(scope="module")
def data(spark):
    texts = [f"doc{i} word{i} topic{i % 3}\ncommon words here\nline about item{i}" for i in range(12)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    train = spark.createDataFrame([(f"q{i}", f"item{i} word{i}", f"d{i}", "", f"doc{i}", 0, len(f"doc{i}"), "t") for i in range(12)], "qid string, question string, gold_doc_id string, ideal_answer string, gold_evidence_text string, gold_evidence_char_start int, gold_evidence_char_end int, topic string")
    test = spark.createDataFrame([("t1", "word3"), ("t2", "item5")], "qid string, question string")
    return Bundle(docs, train, test).validated()


def test_registry_counts():
    assert len(G.default_experiments()) == 21 and len(G.default_experiments(True)) == 23
    assert len(G.recall_experiments()) == 60
    assert len(G.recall_experiments(True)) == 64 and len(G.recall_experiments(include_bge_m3=True)) == 66
    names = {e.name for e in G.recall_experiments(include_bge_m3=True)}
    assert "bm25_legal_lemma_doc_k11p2_b0p9" in names and "bm25_legal_lemma_chunk_char_1600_800_softmax3_rd600" in names
    G.checked(G.merged(G.default_experiments(True), G.recall_experiments(True, True)))


def test_registry_rejects_circles_and_unknown_names():
    with pytest.raises(ValueError, match="circle"):
        G.checked([G.Experiment("a", "rrf", {"members": ["b"]}), G.Experiment("b", "rrf", {"members": ["a"]})])
    with pytest.raises(ValueError, match="members"):
        G.checked([G.Experiment("a", "rrf", {"members": ["zz"]})])
    with pytest.raises(ValueError, match="kind"):
        G.checked([G.Experiment("a", "magic")])


def test_folds(spark):
    rows = spark.createDataFrame([(f"q{i}", f"doc{i % 10}") for i in range(20)], "qid string, gold_doc_id string")
    held = splits.eval_folds(rows, "holdout")
    cv = splits.eval_folds(rows, "cv", n_splits=4)
    assert {r.gold_doc_id for r in held.collect()}.isdisjoint({r.gold_doc_id for r in cv.collect()})
    assert held.count() + cv.count() == 20 and held.select("gold_doc_id").distinct().count() == 2
    assert {r.eval_part for r in cv.collect()} == {"valid"}
    assert cv.groupBy("gold_doc_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()


RECORDS = "experiment string, split string, eval_part string, n_eval long, status string, duration_sec double, `recall@5` double"


def test_rollup(spark):
    one = spark.createDataFrame([("e", "holdout", "holdout", 4, "ok", 1.0, 0.5)], RECORDS)
    r = E.suite_rollup(one, (5,)).first()
    assert r["recall@5_std"] is None and r["recall@5_se"] is None and r["recall@5_micro"] == r["recall@5_mean"] == 0.5
    two = spark.createDataFrame([("e", "fold_0", "valid", 2, "ok", 1.0, 1.0), ("e", "fold_1", "valid", 4, "ok", 2.0, 0.5), ("f", "fold_0", "valid", 0, "failed", 0.0, None)], RECORDS)
    r = E.suite_rollup(two, (5,)).where("experiment = 'e'").first()
    assert r["recall@5_mean"] == 0.75 and r["recall@5_micro"] == pytest.approx(4 / 6)
    status = {r.experiment: (r.status, r.duration_sec) for r in E.experiment_status(two).collect()}
    assert status == {"e": ("ok", 2.0), "f": ("failed", 0.0)}


def test_paired_comparison(spark):
    hits = [("a", 1), ("b", 0), ("c", 1), ("d", 1)], [("a", 0), ("b", 1), ("c", 1), ("d", 0)]
    rows = [("fold_0", "valid", q, e, h) for e, part in zip(("new", "bm25_doc"), hits, strict=True) for q, h in part]
    r = E.paired_comparison(spark.createDataFrame(rows, "split string, eval_part string, qid string, experiment string, `hit@5` int")).where("experiment = 'new'").first()
    assert (r.wins, r.losses, r.ties, r.n_compared, r.delta) == (2, 1, 1, 4, 0.25)


def test_suite_end_to_end(data, tmp_path):
    names = ["bm25_doc", "tfidf_word_doc", "bm25_chunk_line_10_5_max", "rrf_bm25_doc_chunk", "dense_e5_chunk_line_10_5"]
    records, hits, summary = run_suite(data, names, "cv", include_optional=True, n_splits=3, out=str(tmp_path), ks=(5, 10))
    rows = {r["experiment"]: r for r in summary.collect()}
    assert rows["dense_e5_chunk_line_10_5"]["status"] == "failed" and rows["bm25_doc"]["valid_recall@5_mean"] == 1.0
    assert rows["rrf_bm25_doc_chunk"]["valid_recall@5_ties_vs_baseline"] == rows["bm25_doc"]["valid_n_eval_total"]
    assert select_best(summary) == "bm25_chunk_line_10_5_max"
    assert any((tmp_path / "metrics").iterdir()) and (tmp_path / "summary_latest").exists()


def test_planner_keeps_depths_apart(data, spark):
    q = spark.createDataFrame([("q", "common words")], "qid string, question string")
    plan = Planner(G.default_experiments(), data.documents, q)
    assert plan.ranking("bm25_doc", 3).count() == 3 and plan.ranking("bm25_doc", 7).count() == 7
    assert plan.ranking("bm25_doc", 3) is plan.ranking("bm25_doc", 3)


def test_rerank_suite(data, spark, tmp_path):
    options = RerankOptions(mode="train", ks=[5], depths=[5], chunks_per_doc=[1, 2], chunk_aggs=["max", "top2_mean"], score_modes=["ce", "ce_plus_candidate"], candidates=["bm25_doc"], models=["token_overlap", "some/cross-encoder"])
    assert options.candidate_depth == 100 and RerankOptions(candidate_depth=5).candidate_depth == 20
    r = run_rerank_suite(data, options, out=str(tmp_path / "out"), submissions=str(tmp_path / "s"), top_n=2)
    rows = {x["experiment"]: x for x in r.summary.collect()}
    ok = [x for x in rows.values() if x["status"] == "ok"]
    assert len(rows) == 13 and len(ok) == 7 and rows["candidate_bm25_doc"]["train_recall@5_mean"] == 1.0
    assert all(x["duration_sec"] > 0 for x in rows.values())
    assert [x["status"] for x in r.summary.collect()] == ["failed"] * 6 + ["ok"] * 7
    failed = r.records.where("status = 'failed'").first()
    assert "sentence-transformers" in failed["error"] and '"depth": 5' in failed["params"]
    assert r.best_rerank.startswith("rerank_bm25_doc_token_overlap") and r.best in rows
    for name in (f"folds_{failed['run_id']}", f"query_hits_{failed['run_id']}", f"summary_{failed['run_id']}", "rerank_summary_latest", f"metrics/{failed['run_id']}"):
        assert any((tmp_path / "out" / name).iterdir())
    assert len(r.submissions) == 2 and r.submissions[0].endswith(f"submission_{r.best_rerank}")
    for path in r.submissions:
        sent = spark.read.option("header", True).csv(path)
        assert [x.qid for x in sent.collect()] == ["t1"] * 5 + ["t2"] * 5
    nowhere = spark.createDataFrame([("q1", 1, "zz", 1.0)], "qid string, rank long, doc_id string, score double")
    units = spark.createDataFrame([], "unit_id string, text string")
    with pytest.raises(Exception, match="no such document: zz"):
        pairs(nowhere, nowhere.withColumn("unit_id", F.lit("u")).where("false"), units, data.documents, 5, 1).collect()


def test_rerank_and_diagnostics(data):
    grid = rerank_grid("bm25_doc", "token_overlap", depths=(5,), chunks_per_doc=(1, 2))
    assert [c.name for c in grid][0] == "rerank_bm25_doc_token_overlap_d5_c1_max_ce" and len(grid) == 6
    d = {r["candidate"]: r for r in recall_diagnostics(data, ["bm25_doc", "tfidf_word_doc"], "rrf_bm25_doc_chunk", "train", ks=(5, 20), depth=20).collect()}
    assert d["oracle_union_top20"]["recall@20_mean"] == 1.0 and d["oracle_union_top20"]["lost@20_total"] == 0
    for name, backend in (("some/cross-encoder", None), ("some/model", "flag")):
        with pytest.raises(ImportError):
            scorer_for(name, backend=backend)


def test_submission_follows_the_test_table(data, spark, tmp_path):
    turned = spark.createDataFrame([("t2", "item5"), ("t1", "word3")], "qid string, question string").coalesce(1)
    create_submission(Bundle(data.documents, data.train, turned), "bm25_doc", str(tmp_path / "s"))
    assert [r.qid for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["t2"] * 5 + ["t1"] * 5


def test_submission(data, spark, tmp_path):
    create_submission(data, "bm25_doc", str(tmp_path / "s"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert rows.columns == ["qid", "doc_id"] and rows.count() == 10
    submission.validate_submission(rows, data.test, data.documents)
    for bad in ([("t1", "d1")], [("t1", "d1"), ("t1", "d1"), ("t2", "d2")], [("t1", "nowhere"), ("t2", "d2")]):
        with pytest.raises(ValueError):
            submission.validate_submission(spark.createDataFrame(bad, "qid string, doc_id string"), data.test, data.documents)


def test_supervision(data, spark):
    w = evidence_windows(data.train, data.documents, 20)
    assert training_pairs(w).columns == ["qid", "question", "positive_doc_id", "positive_text"]
    assert all(r.text.startswith("doc") for r in w.collect())
    assert evidence_errors(data.train, data.documents).isEmpty()
    ranking = spark.createDataFrame([("q1", 1, "d1"), ("q1", 2, "d2"), ("q1", 3, "d2")], "qid string, rank long, doc_id string")
    assert [(r.negative_doc_id, r.negative_rank) for r in hard_negatives(data.train, ranking).orderBy("negative_rank").collect()] == [("d2", 1), ("d2", 2)]


def test_inputs(data, spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train.csv"):
        Layout(str(tmp_path)).require_inputs(spark)
    for name in ("documents", "train", "test"):
        getattr(data, name).toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    data.test.selectExpr("qid", "'d1' AS doc_id").toPandas().to_csv(tmp_path / "sample_submission.csv", index=False)
    again = load_bundle(spark, str(tmp_path))
    assert sorted(again.documents.collect()) == sorted(data.documents.collect())
    assert missing_columns(data.test, ["qid", "x"]) == ["x"]
    assert duplicate_docs(data.documents.unionByName(data.documents.limit(1))).count() == 1
    assert unknown_gold(data.train.withColumn("gold_doc_id", F.lit("zz")), data.documents).first()[0] == "zz"
    assert params_json({"b": (1, 2), "a": G.LINE_10_5}) == '{"a": {"overlap": 5, "size": 10, "unit": "line"}, "b": [1, 2]}'
