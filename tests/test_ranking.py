import math

import pytest

from rankforge.operators import evaluate as E
from rankforge.operators import ranking as R
from rankforge.operators import retrieval as S
from rankforge.operators.fusion import quota_union, rrf
from rankforge.operators.units import document_units, query_rows

RANKING = "qid string, rank long, doc_id string, unit_id string, score double, source string"


def ranking(spark, docs, qid="q", scores=None):
    return spark.createDataFrame([(qid, i + 1, d, f"{d}{i}", float(scores[i] if scores else len(docs) - i), "s") for i, d in enumerate(docs)], RANKING)


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_quota_union_takes_turns(spark):
    assert order(quota_union([ranking(spark, "abc"), ranking(spark, "axy")], quota=2, top_k=4)) == ["a", "x", "b", "y"]
    with pytest.raises(ValueError):
        quota_union([ranking(spark, "a")], per_ranking_quota=[1, 2])


def test_rrf_counts_repeats_in_places(spark):
    rows = {r.doc_id: r.score for r in rrf([ranking(spark, "aab"), ranking(spark, "bc")], top_k=5).collect()}
    assert rows["a"] == pytest.approx(1 / 61) and rows["b"] == pytest.approx(1 / 63 + 1 / 61) and rows["c"] == pytest.approx(1 / 62)


@pytest.mark.parametrize("method,want", [("max", 3), ("top2_mean", 2.5), ("max_plus_second", 3.4), ("softmax_top3", (3 + 2 * math.exp(-1) + math.exp(-2)) / (1 + math.exp(-1) + math.exp(-2)))])
def test_chunk_aggregation(spark, method, want):
    got = R.aggregate_chunks(ranking(spark, "xxxx", scores=[3, 2, 1, 0]), method).first()
    assert got.score == pytest.approx(want) and got.unit_id == "x0"


def test_unknown_aggregation(spark):
    with pytest.raises(ValueError):
        R.aggregate_chunks(ranking(spark, "x"), "median")


def test_dedupe(spark):
    assert order(R.first_of_docs(ranking(spark, "abacb"), 2)) == ["a", "b"]
    assert order(R.dedupe_ranked_docs(ranking(spark, "aba", scores=[1, 2, 3]), 5)) == ["a", "b"]


def test_recall_dedupes_and_cuts(spark):
    gold = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "qid string, gold_doc_id string")
    rows = ranking(spark, "xxa", "1").unionByName(ranking(spark, "zyb", "2")).unionByName(ranking(spark, "xyz", "3"))
    hits = E.query_hits(gold, rows, (2, 3))
    got = E.recall(hits, ks=(2, 3)).first()
    assert got["recall@2"] == pytest.approx(1 / 3) and got["recall@3"] == pytest.approx(2 / 3)


def test_padding_fills_with_first_unmatched_units(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha", "beta", None, "alpha beta", ""])], "doc_id long, text string")
    q = query_rows(spark.createDataFrame([("q", "beta"), ("r", "nothing")], "qid string, question string"))
    u = document_units(docs)
    got = R.padded(R.top_k(S.bm25(u, q), 4), u, q, 4).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id) for r in got] == [("q", "1"), ("q", "3"), ("q", "0"), ("q", "2"), ("r", "0"), ("r", "1"), ("r", "2"), ("r", "3")]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "aaa bbb"), (1, "aaa aaa ccc"), (2, "")], "doc_id long, text string")
    q = query_rows(spark.createDataFrame([("q", "aaa aaa")], "qid string, question string"))
    got = {r.doc_id: r.score for r in S.bm25(document_units(docs), q).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 5 / 3
    for d, tf, dl in (("0", 1, 2), ("1", 2, 3)):
        assert got[d] == pytest.approx(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)))


def test_vectors(spark):
    rows = spark.createDataFrame([(0, "0", "d", [3.0, 4.0]), (1, "1", "d", [0.0, 0.0])], "unit_ord long, unit_id string, doc_id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vector array<float>")
    got = {r.unit_id: r.score for r in S.dense(rows, q).collect()}
    assert got["0"] == pytest.approx(0.6) and got["1"] == 0


def test_lexical_weights_ignore_unknown_tokens(spark):
    rows = spark.createDataFrame([(0, "0", "a", {"1": 0.5, "2": 1.0}), (1, "1", "b", {"2": 0.25, "3": 0.75})], "unit_ord long, unit_id string, doc_id string, weights map<string,float>")
    q = spark.createDataFrame([("q", {"2": 2.0, "4": 100.0})], "qid string, weights map<string,float>")
    assert {r.unit_id: r.score for r in S.lexical_weights(rows, q).collect()} == {"0": 2.0, "1": 0.5}


def test_top_k_ties_by_unit(spark):
    hits = spark.createDataFrame([("q", i, str(i), str(i), s) for i, s in enumerate([0.1, 0.7, 0.3, 0.9, 0.7])], "qid string, unit_ord long, unit_id string, doc_id string, score double")
    assert order(R.top_k(hits, 3)) == ["3", "1", "4"]
