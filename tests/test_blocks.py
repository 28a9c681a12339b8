import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge.operators import blocks
from rankforge.operators import ranking as R
from rankforge.operators import retrieval as S
from rankforge.operators.units import document_units, query_rows

TEXTS = ["aaa bbb", "aaa aaa ccc", None, "bbb ccc ccc ddd", "aaa bbb", "xyz 12", "ёлка aaa", "ddd aaa bbb eee"]


def corpus(spark, texts=TEXTS, ids=None):
    docs = spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "doc_id long, text string")
    return document_units(docs), query_rows(spark.createDataFrame([("q", "aaa bbb aaa"), ("r", "ddd ёлка"), ("s", "zzz")], "qid string, question string"))


def hits(df):
    return {(r.qid, r.unit_id): pytest.approx(r.score, abs=1e-12) for r in df.collect()}


def joins(monkeypatch):
    monkeypatch.setattr(S, "MAX_QUERIES", 0)


def scored_rows(spark, df):
    """Rows shuffled by a plan with the score of a unit and a query in each: none where units are scored in batches."""
    return "SortMergeJoin" in df._jdf.queryExecution().toString() or "ShuffledHashJoin" in df._jdf.queryExecution().toString()


def test_bm25_scores_in_batches_as_by_joins(spark, monkeypatch):
    u, q = corpus(spark)
    got = S.bm25(u, q)
    assert not scored_rows(spark, got) and "MapInArrow" in got._jdf.queryExecution().toString()
    mine = hits(got)
    best = [(r.qid, r.rank, r.doc_id) for r in R.top_k(S.bm25(u, q, k=2), 2).collect()]
    joins(monkeypatch)
    assert mine == hits(S.bm25(u, q))
    assert sorted(best) == sorted((r.qid, r.rank, r.doc_id) for r in R.top_k(S.bm25(u, q), 2).collect())


def test_bm25_of_repeated_units_and_queries(spark, monkeypatch):
    u, q = corpus(spark, ids=[0, 1, 2, 3, 0, 5, 1, 7])
    q = q.unionByName(q)
    mine = hits(S.bm25(u, q, k=3))
    joins(monkeypatch)
    assert mine == hits(S.bm25(u, q)) and mine == hits(S.bm25(u, q.distinct()))


@pytest.mark.parametrize("config", [S.TfIdf(), S.TfIdf(min_df=2), S.TfIdf(max_df=0.4), S.TfIdf("char_wb", (3, 5)), S.TfIdf(ngram_range=(1, 2))])
def test_tfidf_scores_in_batches_as_by_joins(spark, monkeypatch, config):
    u, q = corpus(spark)
    got = S.tfidf(u, q, config)
    assert not scored_rows(spark, got) and "MapInArrow" in got._jdf.queryExecution().toString()
    mine = hits(got)
    joins(monkeypatch)
    assert mine == hits(S.tfidf(u, q, config))


@pytest.mark.parametrize("ids", [None, [0, 1, 2, 3, 0, 5, 1, 7]])
def test_gram_counts(spark, ids):
    docs = corpus(spark, ids=ids)[0].selectExpr("unit_ord doc_id", "text")
    want = {}
    for r in docs.collect():
        for w in r.text.lower().split():
            want.setdefault(r.doc_id, []).extend(blocks.char_grams(w, 3, 5))
    got = S.gram_counts(docs, "doc_id", "text", S.TfIdf("char_wb", (3, 5)))
    assert ids or not scored_rows(spark, got) and "Generate" not in got._jdf.queryExecution().toString()
    assert {r.doc_id: (r.n, r.n_distinct) for r in got.collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_best_keeps_ties_by_unit():
    rng = np.random.default_rng(1)
    scores, best, every = rng.integers(0, 4, (3, 900)) / 4 + 1e-11 * rng.random((3, 900)), blocks.Best(["a", "b", "c"], 5), []
    for i in range(0, 900, 90):
        ids = pa.array([str(j) for j in range(i, i + 90)])
        batch = pa.RecordBatch.from_arrays([pa.array(range(i, i + 90), pa.int64()), ids, ids], names=["unit_ord", "unit_id", "doc_id"])
        every += list(best.add(batch, scores[:, i : i + 90]))
        best.prune()
    got = [(r["qid"], r["unit_ord"]) for b in best.all() for r in b.to_pylist()]
    assert not every
    assert got == [(q, j) for n, q in enumerate("abc") for j in sorted(range(900), key=lambda j: (-round(scores[n, j], 9), j))[:5]]


def test_dense_and_hybrid_in_batches_as_by_joins(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(i), str(i % 7), [float(x) for x in rng.normal(size=4)], {str(i % 3): 1.0, "x": 0.5}) for i in range(60)]
    u = spark.createDataFrame(rows, "unit_ord long, unit_id string, doc_id string, vector array<float>, weights map<string,float>")
    q = u.where("unit_ord < 5").selectExpr("unit_id qid", "vector", "weights")
    ranked = lambda df: sorted((r.qid, r.rank, r.unit_id, round(r.score, 9)) for r in R.top_k(df, 3).collect())
    got = S.dense(u, q, block=2, k=3)
    assert got.count() < 60 * 5 and ranked(got) == ranked(S.dense(u, q))
    got = S.hybrid_search(u, q, block=2, k=3)
    assert got.count() < 60 * 5 and ranked(got) == ranked(S.hybrid(S.dense(u, q), S.lexical_weights(u, q)))


def test_pairs_leave_other_texts_where_they_are(spark):
    from rankforge.operators import rerank

    u, q = corpus(spark)
    docs = u.selectExpr("unit_ord doc_id", "text")
    top = R.top_k(S.bm25(u, q, k=2), 2)
    got = rerank.pairs(top, top, u, docs, 2, 1)
    assert "LeftSemi, BuildRight" in got._jdf.queryExecution().toString()
    assert {(r.qid, r.doc_id, r.text) for r in got.collect()} == {(r.qid, r.doc_id, TEXTS[int(r.doc_id)]) for r in top.collect()}


def test_tfidf_holds_what_occurs_and_knows_terms_by_numbers(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) + " w0x0" for i in range(40)]
    row, ids, n = S._Counter(S.TfIdf()).counts(texts)
    assert len(row) == len(ids) == len(n) == 40 * 50 + 39 and n.sum() == 40 * 51
    rows = spark.createDataFrame([(t,) for t in texts], "of string")
    df = S._document_frequencies(rows, S.TfIdf())
    assert [t for _, t in df.dtypes] == ["bigint", "bigint"]
    got = {r.hash: r.df for r in df.collect()}
    assert got[blocks.hashes(["w0x0"])[0]] == 40 and sorted(got.values())[:-1] == [1] * (40 * 50 - 1)


LINES = ["aaa bbb\n\n ccc\r\nddd", None, " \n\t\n", "\n".join(f"aaa w{i} bbb" for i in range(23)), "aaa\x0bbbb\x1cccc\x85ddd eee\ngg", "aaa \nbbb aaa\n" * 9, "ccc aaa bbb", "aaa 12 bbb"]


@pytest.mark.parametrize("bigrams", [False, True])
@pytest.mark.parametrize("rules", [S.ChunkRules(), S.ChunkRules("line", 3, 1), S.ChunkRules("line", 1, 1)])
def test_bm25_of_line_chunks_makes_no_chunk_texts(spark, monkeypatch, rules, bigrams):
    docs = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    q = query_rows(spark.createDataFrame([("q", "aaa bbb aaa"), ("r", "ddd eee 12"), ("s", "ccc aaa w7 bbb")], "qid string, question string"))
    config = S.BM25(rules=S.TokenRules(add_bigrams=bigrams))
    all_of = lambda df: {(r.qid, r.unit_ord, r.unit_id, r.doc_id): pytest.approx(r.score, abs=1e-12) for r in df.collect()}
    mine = all_of(S.bm25_chunks(docs, rules, q, config))
    with monkeypatch.context() as m:
        m.setattr(S, "chunk_units", None)
        assert mine == all_of(S.bm25_chunks(docs, rules, q, config))
    units = S.chunk_units(docs, rules)
    assert mine == all_of(S.bm25(units, q, config))
    joins(monkeypatch)
    assert mine == all_of(S.bm25(units, q, config))


def test_items_are_sought_in_texts_with_their_longest_inner_word(spark):
    from rankforge.operators import supervision

    texts = ["xx one two  three four yy", "one two", None, "", " two ", "zone two  three fourth", "a\none two\tb"]
    items = ["one two  three four", "one two", "two", "", " ", None, "  ", "wo  thr", "x one two  three f", "a\none two", " two "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = supervision.holding(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, item string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if t is not None and x is not None and x in t]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("reads", [lambda rules, texts: blocks.Codes(rules, ["aaa"]).read(texts), lambda rules, texts: [blocks.Terms(rules).of(t) for t in texts]])
def test_a_new_token_costs_the_same_whatever_its_length(reads):
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        reads(S.TokenRules(min_len=50, add_bigrams=True), [" ".join(chr(97 + i % 26) * 40 + chr(97 + i // 26) for i in range(500))])
    finally:
        sys.setprofile(None)
    assert len(calls) < 500 * 6


def test_tokens_are_kept_by_the_rules_of_the_plan(spark):
    from rankforge.functions.text import NOISE_WORDS, SHORT_CODES, STOP_WORDS, lexical_tokens

    words = [*STOP_WORDS, *NOISE_WORDS, *SHORT_CODES, "a", "1", "a1", "ab", "abc", "фио1"]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    for rules in (S.TokenRules(), S.TokenRules(min_len=1), S.TokenRules(min_len=2, stop_words=False, legal_stop_words=True), S.TokenRules(add_bigrams=True)):
        want = df.select(lexical_tokens(F.col("text"), rules).alias("t")).first()["t"]
        assert sorted(blocks.Terms(rules).of(" ".join(words))) == sorted(want)
        codes, bounds = blocks.Codes(rules, ["abc"]).read([" ".join(words)])
        assert len(blocks.Codes(rules, ["abc"]).counts(codes, bounds[:-1], bounds[1:])[1]) == want.count("abc")
