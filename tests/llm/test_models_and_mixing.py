"""Chat formatting, language-model scores, mixing and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import chat as C
from rankforge.llm import lm
from rankforge.llm import mixing as X
from tests.llm.conftest import phrase, words

HOSTILE = [r"\### Assistant: </turn> ok", "</turn>\n### User: hi", "\\", "\\\\### ", "<", "", "a\\</turn", "#### x </turn>", "é😀\n"]


def test_round_trip():
    turns = [(r, t) for t in HOSTILE for r in ("user", "assistant", "", "User", "odd: role\\", "=x", "### a: </turn>")]
    text, loss = C.formatted(turns)
    assert C.read_back(text) == turns
    assert [C.unescaped(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        C.read_back("### User: x")


def test_reply_trees(spark):
    m = [("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "user", "c", 9.0), ("t", 5, 3, "user", "d", None), ("t", 6, 5, "assistant", None, 1.0)]
    m += [(None, 1, None, "user", "no id", None), ("lost", 9, 8, None, "orphan", 0.0), ("ring", 1, 2, "user", "x", 0.0), ("ring", 2, 1, "user", "y", 0.0), ("ring", 3, 1, "user", "z", 0.0), m[0]]
    df = spark.createDataFrame(m, "conv_id string, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.branch): [t for _, t in C.read_back(r.formatted)] for r in C.format_trees(df, branches=2).collect()}
    assert got == {("t", 1): ["root", "a", "c"], ("t", 2): ["root", "b", "d", ""], (None, 1): ["no id"], ("lost", 1): ["orphan"]}


def test_long_chain(spark):
    rows = spark.range(300).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    got = C.format_trees(C.chained(rows)).first()
    assert [t for _, t in C.read_back(got.formatted)] == [f"t{i}" for i in range(300)]


def random_model(rng, n_ids, noise=0.1):
    voc = lm.Vocabulary(rng.integers(0, 100, n_ids), rng.random(n_ids) < 0.5)
    pairs = rng.poisson(0.05, (lm.BUCKETS, lm.BUCKETS))
    pairs[:, voc.mass == 0] = 0
    voc.learn(pairs)
    return voc, lm.unpacked(lm.initial() + noise * rng.normal(size=lm.N_PARAMETERS).astype(np.float32))


def test_gradients():
    rng = np.random.default_rng(0)
    voc, p = random_model(rng, 500, 0.01)
    p = {k: x.astype(np.float64) for k, x in p.items()}
    x, t, c = rng.integers(0, lm.BUCKETS, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW)), rng.random((3, lm.WINDOW)) < 0.8
    g, _ = lm.gradients(p, voc.log_class, x, t, c)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        losses, old = [], p[k][i]
        for step in (1e-4, -1e-4):
            p[k][i] = old + step
            losses.append(lm.gradients(p, voc.log_class, x, t, c)[1])
        p[k][i] = old
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(g[k][i], rel=1e-3, abs=1e-7)


def slow_score(voc, p, ids):
    """The log probability of a text's ids, an id and a head at a time, in plain loops."""
    of = [int(voc.bucket[i]) for i in ids]
    before = [int(voc.bucket[-1]), *of[:-1]]
    total = 0.0
    for t in range(len(ids)):
        n = 0 if t < lm.WINDOW else 1 + (t - lm.WINDOW) // lm.STRIDE
        first = n * lm.STRIDE
        x = [p["e"][before[i]] + p["p"][i - first] for i in range(first, t + 1)]
        q, k, v = np.split(np.array(x) @ p["qkv"], 3, axis=1)
        a = np.array([math.exp(q[-1] @ y / math.sqrt(lm.WIDTH)) for y in k])
        h = x[-1] + (a / a.sum()) @ v
        y = np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"] + voc.log_class[before[t]]
        c = voc.of_class[of[t]]
        total += y[c] - math.log(np.exp(y).sum()) + voc.log_bucket[before[t], of[t]] + voc.log_share[ids[t]]
    return total


def test_every_id_is_scored_once_and_causally():
    rng = np.random.default_rng(1)
    w, s = lm.WINDOW, lm.STRIDE
    sizes = [0, 1, w - 1, w, w + 1, w + s, w + s + 1, 200]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for stride in (s, w):
        place, scored = lm._places(bounds, *lm.windows(bounds, stride))
        assert (np.bincount(place[scored], minlength=bounds[-1]) == 1).all()
    voc, p = random_model(rng, 300)
    ids = rng.integers(0, 300, bounds[-1])
    total = lm.log_probabilities(p, voc, ids, bounds)
    assert total == pytest.approx([slow_score(voc, p, ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)], rel=1e-4, abs=1e-4)
    # probabilities of all continuations of one id sum to one
    for first in (5, 299):
        each = [lm.log_probabilities(p, voc, np.array([first, i]), np.array([0, 2])) for i in range(300)]
        one = lm.log_probabilities(p, voc, np.array([first]), np.array([0, 1]))
        assert np.exp(np.array(each) - one).sum() == pytest.approx(1, abs=1e-4)


def whole_model(rng, n_ids, noise=0.1):
    voc, p = random_model(rng, n_ids, noise)
    return voc, p | {k: (noise * rng.normal(size=x.shape)).astype(np.float32) for k, x in lm.leaves(voc).items()}


def slow_tree_score(voc, p, ids):
    """As slow_score, with the model's part in the choice of a bucket in its class and of an id in its bucket."""
    of, last = [int(voc.bucket[i]) for i in ids], [len(voc.bucket) - 1, *ids[:-1]]
    several = Counter(voc.bucket[:-1].tolist())
    vector = lambda j: p["id"][voc.row[voc.bucket[j]], voc.slot[j]]
    total = 0.0
    for t in range(len(ids)):
        n = 0 if t < lm.WINDOW else 1 + (t - lm.WINDOW) // lm.STRIDE
        first = n * lm.STRIDE
        x = [p["e"][voc.bucket[last[i]]] + p["p"][i - first] + (p["own"][last[i]] if several[int(voc.bucket[last[i]])] > 1 else 0) for i in range(first, t + 1)]
        q, k, v = np.split(np.array(x) @ p["qkv"], 3, axis=1)
        a = np.array([math.exp(q[-1] @ y / math.sqrt(lm.WIDTH)) for y in k])
        z = np.maximum((x[-1] + (a / a.sum()) @ v) @ p["w1"] + p["b1"], 0)
        before, c = voc.bucket[last[t]], voc.of_class[of[t]]
        y = z @ p["w2"] + p["b2"] + voc.log_class[before]
        total += y[c] - math.log(np.exp(y).sum())
        scores = {b: math.exp(z @ p["bucket"][b] + voc.log_bucket[before, b]) for b in np.flatnonzero(voc.of_class == c).tolist() if voc.mass[b]}
        total += math.log(scores[of[t]] / sum(scores.values()))
        if several[of[t]] > 1:
            scores = {j: math.exp(z @ vector(j) + voc.log_share[j]) for j in np.flatnonzero(voc.bucket[:-1] == of[t]).tolist()}
            total += math.log(scores[ids[t]] / sum(scores.values()))
    return total


def test_the_model_scores_single_ids():
    rng = np.random.default_rng(3)
    n = 4 * lm.BUCKETS
    voc, p = whole_model(rng, n, 0.3)
    bounds = np.concatenate([[0], np.cumsum([1, lm.WINDOW, 3 * lm.WINDOW])])
    ids = rng.integers(0, n, bounds[-1])
    assert lm.log_probabilities(p, voc, ids, bounds) == pytest.approx([slow_tree_score(voc, p, ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)], rel=1e-4, abs=1e-4)
    # far scores too: the probabilities of all continuations of one id sum to one
    for scale in (1, 100):
        wide = p | {"bucket": scale * p["bucket"], "id": scale * p["id"]}
        each = lm.log_probabilities(wide, voc, np.stack([np.full(n, 5), np.arange(n)], axis=1).ravel(), np.arange(0, 2 * n + 1, 2))
        assert np.exp(each - lm.log_probabilities(wide, voc, np.array([5]), np.array([0, 1]))).sum() == pytest.approx(1, abs=1e-3)
    flat = lm.flattened(p)
    assert all((x == p[k]).all() for k, x in lm.whole(flat, voc).items())


def test_gradients_of_single_ids():
    rng = np.random.default_rng(4)
    n = 4 * lm.BUCKETS
    voc, p = whole_model(rng, n, 0.1)
    p = {k: x.astype(np.float64) for k, x in p.items()}
    last, ids, counted = rng.integers(0, n, (3, lm.WINDOW)), rng.integers(0, n, (3, lm.WINDOW)), rng.random((3, lm.WINDOW)) < 0.8
    of = voc.bucket[ids]
    args = (voc.log_class, voc.bucket[last], voc.of_class[of], counted, voc, last, of, ids)
    g, loss = lm.gradients(p, *args)
    assert loss > lm.gradients(p, *args[:4])[1]
    for k in p:
        dense = g[k]
        if isinstance(dense, tuple):
            assert len(set(dense[0].tolist())) == len(dense[0])
            dense = np.zeros(p[k].shape)
            dense[g[k][0]] = g[k][1]
        i = np.unravel_index(np.abs(dense).argmax(), dense.shape)
        losses, old = [], p[k][i]
        for step in (1e-4, -1e-4):
            p[k][i] = old + step
            losses.append(lm.gradients(p, *args)[1])
        p[k][i] = old
        assert dense[i] and (losses[0] - losses[1]) / 2e-4 == pytest.approx(dense[i], rel=1e-3, abs=1e-7)


def test_a_window_tells_ids_of_one_class_apart():
    n = 300
    voc = lm.Vocabulary(np.full(n, 100), np.zeros(n, bool))
    a, b, x = 0, 1, 2
    u, v = [i for i in range(3, n) if voc.of_class[voc.bucket[i]] == 16][:2]
    texts, bounds = np.array([a, x, u, b, x, v] * 40), np.arange(0, 241, 3)
    of, before, last = lm._inputs(texts, bounds, voc)
    # after x the counts have u and v alike
    voc.learn(np.bincount(before * lm.BUCKETS + of, minlength=lm.BUCKETS**2).reshape(lm.BUCKETS, lm.BUCKETS))
    adam = lm.Adam(lm.whole(lm.initial(), voc), 0.02)
    at, counted = lm._places(bounds, *lm.windows(bounds, lm.WINDOW))
    for _ in range(300):
        adam.step(lm.gradients(adam.p, voc.log_class, before[at], voc.of_class[of[at]], counted, voc, last[at], of[at], texts[at])[0])
    right = lm.log_probabilities(adam.p, voc, np.array([a, x, u, b, x, v]), np.array([0, 3, 6]))
    wrong = lm.log_probabilities(adam.p, voc, np.array([a, x, v, b, x, u]), np.array([0, 3, 6]))
    assert (right - wrong > 2).all()


def test_sequences_are_cut_by_documents_alone():
    import pyarrow as pa

    docs = [(g, np.arange(n, dtype=np.int32).tobytes()) for g, n in ((0, 5), (0, 7), (0, 30), (2, 1), (2, 4))]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["group", "ids"])
    cuts = [[[int(x) for x in b] for _, _, b in lm._sequences(iter([batch(docs[:k]), batch(docs[k:])]), 10, np.int32)] for k in range(6)]
    assert all(c == [[0, 5, 12], [0, 30], [0, 1, 5]] for c in cuts)


def test_words_of_late_are_not_encoded_again():
    import pyarrow as pa

    from rankforge.llm.common import Words

    with open(lm.TOKENIZER, "rb") as f:
        pieces = lm.Pieces(f.read(), 300)
    model, asked = pieces.model, Counter()

    class Counted:
        def encode(self, words, **more):
            asked.update(w if isinstance(w, str) else w.decode() for w in words)
            return model.encode(words, **more)

    pieces.model = Counted()
    often = [f"w\u00f6rd{i}" for i in range(50)]
    for n in range(20):
        text = " ".join([*often, *(f"rare{n}x{i}" for i in range(60)), often[n]])
        w = Words(pa.array([text, None, "", often[0]]))
        _, which, count, start, size = pieces.of(w)
        ids, bounds = pieces.sequence(w, which, start, size)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[*(i for x in t.split() for i in model.encode(x)), pieces.size] for t in (text, "", "", often[0])]
        assert count.sum() == len(which) == 112
    assert all(asked[x] == 1 for x in often) and len(asked) == 50 + 20 * 60


def test_scores_do_not_depend_on_the_batches(monkeypatch):
    rng = np.random.default_rng(5)
    n = 4 * lm.BUCKETS
    voc, p = whole_model(rng, n, 0.3)
    bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 5 * lm.WINDOW, 40))])
    ids = rng.integers(0, n, bounds[-1])
    once = lm.log_probabilities(p, voc, ids, bounds)
    for name, x in (("_BATCH", 5), ("_POOL", 17), ("_ROWS", 3)):
        monkeypatch.setattr(lm, name, x)
    assert lm.log_probabilities(p, voc, ids, bounds) == pytest.approx(once, rel=1e-5)
    assert lm.log_probabilities(p, voc, ids[:0], np.zeros(3, np.int64)).tolist() == [0, 0]


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_rare_words_are_looked_up_by_slices(monkeypatch, held):
    monkeypatch.setattr(lm, "_HELD", held)
    rng = np.random.default_rng(3)
    names = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)

    def in_order(batches):
        table = pa.Table.from_batches(list(batches))
        return table.sort_by([("slice", "ascending"), ("kind", "ascending")]).to_batches(max_chunksize=7)

    def pieces(x, n):
        used, raw = lm._sliced(x, n)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.zeros(len(used), np.int32)), pa.array(raw, pa.binary())], names=["slice", "kind", "raw"])

    # words of three chunks; the last hundred of them in none
    count, parts = {}, []
    for _ in range(3):
        x, n = np.unique(rng.choice(names[:200], 150), return_counts=True)
        parts.append(pieces(x, n))
        for k, c in zip(x.tolist(), n.tolist(), strict=True):
            count[k] = count.get(k, 0) + c
    words = list(lm._summed_words(iter(in_order(parts))))
    assert sum(w.column("n")[0].as_py() for w in words) == 450 and sum(w.column("different")[0].as_py() for w in words) == len(count)
    often = pa.Table.from_batches(lm._often(4)(iter(words)))
    assert {k % (1 << 64): c for k, c in zip(*often.to_pydict().values(), strict=True)} == {k: c for k, c in count.items() if c >= 4}
    texts = [np.unique(rng.choice(names, size), return_counts=True) for size in (40, 0, 1, 90)]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(5, 9)), pa.array([x.tobytes() for x, _ in texts], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in texts], pa.binary())], names=["row", "rare", "rare_n"]
    )
    known = [pa.RecordBatch.from_arrays([w.column("slice"), pa.array([0], pa.int32()), w.column("raw")], names=["slice", "kind", "raw"]) for w in words]
    found = lm._summed_scores(iter(in_order(lm._rare_scores(iter(in_order([*known, *lm._rare_pairs(iter([rows]))]))))))
    got = {r: (n, score) for b in found for r, n, score in zip(*b.to_pydict().values(), strict=True)}
    for row, (x, n) in enumerate(texts, 5):
        hits = [(m, count[k]) for k, m in zip(x.tolist(), n.tolist(), strict=True) if k in count]
        slow = sum(m for m, _ in hits), sum(m * math.log10(c + 0.5) for m, c in hits)
        assert got.get(row, (0, 0)) == (slow[0], pytest.approx(slow[1]))


def test_counts_of_pairs_may_be_larger_than_four_bytes(spark, monkeypatch):
    from rankforge.llm.common import ARRAY_PARTS, array_parts, summed_array

    monkeypatch.setattr(lm, "BUCKETS", 4)
    voc = type("V", (), {"bucket": np.array([1, 2, 3, 0])})()
    ids = np.array([0, 1, 0, 1, 2], np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([ids.tobytes()], pa.binary())], names=["group", "ids"])
    (one,) = lm._pairs(type("B", (), {"value": voc})(), np.int32)(iter([batch]))
    counts = np.frombuffer(one.column("raw")[0].as_py(), np.int32).reshape(4, 4)
    assert counts[0, 1] == 1 and counts[1, 2] == 2 and counts[2, 1] == 1 and counts[2, 3] == 1 and counts.sum() == 5
    most = array_parts(np.full(3, np.iinfo(np.int32).max, np.int32)).to_pylist()
    parts = spark.createDataFrame([(r["part"], bytearray(r["raw"])) for r in most * 3], ARRAY_PARTS)
    assert summed_array(parts, 3, np.int32).tolist() == [3 * np.iinfo(np.int32).max] * 3


def test_lm_scores(spark, docs, corpus, no_docs):
    got = Counter()
    rows = lm.score_texts(docs).collect()
    for r in rows:
        got[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))] += 1
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [(r[0], words((r[1] or "").translate(low))) for r in corpus]
    seen = Counter(x for i, w in tokens if not held(i) for x in w)
    ends = sum(not held(i) for i, _ in tokens)
    n, z = sum(seen.values()) + ends, math.log10(sum(seen.values()) + ends + 0.5 * (len(seen) + 2))
    want = Counter((i, held(i), len(w) + 1, 1 + sum(seen[x] > 0 for x in w), n, round(sum(math.log10(seen[x] + 0.5) - z for x in w) + math.log10(ends + 0.5) - z, 6)) for i, w in tokens)
    assert got == want
    assert all(r.score < 0 for r in rows)
    assert lm.score_texts(no_docs).isEmpty()


def grammar(rng, n):
    """Texts whose words follow from the words before: an article's number, a verb's subject."""
    out = []
    for _ in range(n):
        parts = []
        for _ in range(int(rng.integers(100, 300))):
            many, noun = rng.random() < 0.5, rng.choice(["cat", "dog", "river", "engine", "teacher", "mountain"])
            parts.append(f"{'these' if many else 'this'} {rng.choice(['old', 'red', 'quiet', 'small'])} {noun}{'s' if many else ''} {'were' if many else 'was'} {rng.choice(['seen', 'found', 'painted'])} near {noun}field .")
        out.append(" ".join(parts))
    return out


def test_model_is_better_than_counts(spark):
    df = spark.createDataFrame(list(enumerate(grammar(np.random.default_rng(2), 400))), "doc_id long, text string").repartition(3)
    mean = lambda d, c="score": d.where("held_out").agg(F.avg(F.col(c) / F.col("n_tokens"))).first()[0]
    done = lm.score_texts(df)
    # than the unigram of words, and than the untrained model, which is a bigram of ids
    assert mean(done) > mean(done, "base_score") + 0.3
    assert mean(done) > mean(lm.score_texts(df, rate=0.0)) + 0.01


def test_scores_do_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(list(enumerate(grammar(np.random.default_rng(3), 60))), "doc_id long, text string")
    scores = lambda d: {r.doc_id: r.score for r in lm.score_texts(d, group_ids=8000).collect()}
    one, many = scores(df.coalesce(1)), scores(df.repartition(7))
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], rel=1e-5) for i in one)


def test_training_reads_all_training_documents(spark):
    crc = lambda i: zlib.crc32(str(i).encode())
    # none of them in a sample of one in sixteen, so that a sample would leave the model untrained
    ids = [i for i in range(400) if crc(i) % 5 != 1 and crc(i) // 5 % 16][:60]
    held = next(i for i in range(400) if crc(i) % 5 == 1)
    df = spark.createDataFrame([(i, "the cat sat on the mat " * 20) for i in [*ids, held]], "doc_id long, text string")
    score = lambda d: {r.doc_id: r.score for r in d.collect()}[held]
    assert score(lm.score_texts(df)) > score(lm.score_texts(df.where(F.col("doc_id").isin(*ids[:3], held)))) + 0.1


def brute_targets(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / max(sum(weight[s] for s in names if s not in full), 1e-12)
        over = {s for s in names if s not in full and weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_mixing(spark, no_docs):
    import random

    rng = random.Random(3)
    rows = [(i, phrase(rng, rng.randrange(1, 90)), rng.choice(["a"] * 6 + ["b", "c", "d", None, "É"])) for i in range(600)] + [(None, None, "a"), (7, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kw = {"block_words": 4, "shard_words": 2000}
    got = X.mixture(df, **kw).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, X.mixture(df.repartition(7), **kw).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 16 for s in want)
    assert X.mixture(no_docs).isEmpty()


def test_apportionment(spark):
    rng = np.random.default_rng(4)
    for blocks, aims in ((1000, rng.random(40) ** 3), (7, np.ones(10)), (50, np.array([1.0, 0.0, 1e-9, 3.0])), (333, np.ones(3))):
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(aims)], "n long, target double")
        got = {r.n: r.seats for r in X.apportioned(df, blocks).collect()}
        quotients = sorted(((-x / (2 * k - 1), i) for i, x in enumerate(aims) for k in range(1, blocks + 1) if x), key=lambda q: (round(q[0], 15), q[1]))[:blocks]
        seats = Counter(i for _, i in quotients)
        assert sum(got.values()) == blocks and all(abs(got[i] - seats[i]) <= (1 if blocks == 7 or blocks == 333 else 0) for i in got)


def test_pipeline(spark, tmp_path, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    leak = next(r[1] for r in corpus if r[0] == 13)
    spark.createDataFrame([(1, " ".join(leak.split(" ")[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # clean documents stay, one of each class stays, rejected and leaking ones go
    assert {10, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21} <= set(done) and 13 not in done
    assert not {None, 0, 1, 2, 3} & set(done) and not set(range(22, 37)) & set(done) and not set(range(37, 52)) & set(done)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(r.taken <= 2 * r["size"] for r in done.values())
