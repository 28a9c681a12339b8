"""Line, substring and near-duplicate dedup against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.conftest import words

from rankforge.llm import line_dedup as L
from rankforge.llm import minhash as M
from rankforge.llm import substring as S


def kept_words(texts, length):
    tokens = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in tokens for i in range(len(w) - length + 1))
    out = []
    for w in tokens:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substring(docs, corpus):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in S.remove_repeats(docs).collect())
    assert got == Counter((r[0], *k) for r, k in zip(corpus, kept_words([r[1] for r in corpus], 35), strict=True))


@pytest.mark.parametrize("length,period,cover", [(5, 3, (0, 1)), (7, 7, (0, 1, 3)), (35, 13, (0, 1, 3, 9))])
def test_substring_other_covers(spark, length, period, cover):
    rng = np.random.default_rng(length)
    texts = [" ".join(map(str, rng.integers(0, 4, n))) for n in rng.integers(0, 120, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.remove_repeats(df, length=length, period=period, cover=cover).collect()}
    assert got == dict(enumerate(kept_words(texts, length)))


def test_substring_needs_a_cover(docs):
    with pytest.raises(ValueError):
        S.repeats_removed(docs, period=7, cover=(0, 1))


def test_empty_tables(no_docs):
    assert S.remove_repeats(no_docs).isEmpty()
    assert L.dedup_lines(no_docs).isEmpty()
    assert M.near_classes(no_docs).isEmpty()
    assert M.one_of_each_class(no_docs).isEmpty()


def test_patience():
    assert L.patience([1, 2, 3, 4], [0, 2, 3, 9, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert L.patience([1, 2, 1, 2], [1, 2]) == [(0, 0), (1, 1)]
    assert L.patience([], [1]) == []
    assert L.common_blocks([1, 2, 3], [9, 1, 2, 8, 3], [1, 5, 6, 1, 30], 11) == [1, 2, 4]
    assert L.common_blocks([1, 2], [1, 2], [5, 5], 11) == []


def test_line_dedup(docs, corpus):
    got = Counter((r.doc_id, r.text, r.n_deleted) for r in L.dedup_lines(docs).collect())
    lines = [[(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate((r[1] or "").split("\n")) if x.strip(" \t\n\v\f\r")] for r in corpus]
    # documents: equal id and text are one; by id, null last
    names = {}
    for n, r in enumerate(corpus):
        names.setdefault((r[0] is None, r[0] or 0, r[1]), n)
    order = sorted(names)
    holders = defaultdict(list)
    for d in order:
        for x in {x for _, x in lines[names[d]]}:
            holders[x].append(d)
    shared = defaultdict(set)
    for x, ds in holders.items():
        for d in ds[1:]:
            shared[ds[0], d].add(x)
    ids = {x: i for i, x in enumerate(holders)}
    gone = defaultdict(set)
    for (f, d), xs in shared.items():
        if min(len(holders[x]) for x in xs) <= L.RARE or sum(len(words(x)) for x in xs) >= L.MIN_WORDS:
            a, b = lines[names[f]], lines[names[d]]
            for k in L.common_blocks([ids[x] for _, x in a], [ids[x] for _, x in b], [len(words(x)) for _, x in b], L.MIN_WORDS):
                gone[d].add(b[k][0])
    want = Counter()
    for r in corpus:
        cut = gone[(r[0] is None, r[0] or 0, r[1])]
        want[(r[0], r[1] if not cut else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in cut), len(cut))] += 1
    assert got == want
    assert sum(r[2] for r in got.elements()) > 20


def test_same_text_in_many_documents_keeps_the_first(spark):
    text = "\n".join(" ".join(f"v{i}x{j}" for j in range(12)) for i in range(4))
    df = spark.createDataFrame([(i, text) for i in range(40)] + [(None, text)], "doc_id long, text string")
    got = {r.doc_id: r.n_deleted for r in L.dedup_lines(df).collect()}
    assert got == {0: 0, None: 4, **{i: 4 for i in range(1, 40)}}


def weighted_classes(corpus):
    tokens = [words(r[1]) for r in corpus]
    shingles = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for w in tokens]
    df = Counter(g for s in shingles for g in s)
    n = len(corpus)
    idf = {g: 1 + math.log1p(n / (c + n / 100)) / (2 * math.log(101)) for g, c in df.items()}
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = sum(min(c, shingles[j][g]) * idf[g] for g, c in shingles[i].items() if g in shingles[j])
            total = sum(c * idf[g] for s in (shingles[i], shingles[j]) for g, c in s.items())
            if (corpus[i][1] or "") == (corpus[j][1] or "") or (total and both / (total - both) >= 0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_near_classes(docs, corpus):
    roots = weighted_classes(corpus)
    groups = defaultdict(list)
    for n, r in enumerate(roots):
        groups[r].append(corpus[n][0])
    want = Counter()
    for g in groups.values():
        least = min((x for x in g if x is not None), default=None)
        # one row of each class is kept, of repeated rows too
        want.update((x, least, len(g), n == 0) for n, x in enumerate(sorted(g, key=lambda x: (x is None, x))))
    assert Counter(tuple(r) for r in M.near_classes(docs).collect()) == want
    one = [r.doc_id for r in M.one_of_each_class(docs).collect()]
    assert Counter(one) == Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert M.one_of_each_class(docs).columns == docs.columns


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.random(300) + 0.5
    a, b = np.r_[h[:250]], np.r_[h[50:]]
    wa, wb = w[:250] * 1.0, w[50:] * 1.3
    doc = np.zeros(250, int)
    same = (M.sampled(doc, a, wa, 2000) == M.sampled(doc, b, wb, 2000)).mean()
    both = np.minimum(wa[50:], wb[:200]).sum()
    assert abs(same - both / (wa.sum() + wb.sum() - both)) < 0.04


def all_pairs_deleted(rows, least):
    """Lines deleted when every document is aligned with every earlier one."""
    lines = [[x for x in t.split("\n") if x] for _, t in rows]
    out = {}
    for d, b in enumerate(lines):
        gone = set()
        for a in lines[:d]:
            gone.update(L.common_blocks(a, b, [len(words(x)) for x in b], least))
        out[rows[d][0]] = len(gone)
    return out


def test_line_dedup_finds_blocks_that_no_line_holder_has(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, two = line("p", 15), line("q", 15)
    rows = [(0, one), (1, two), (2, f"{one}\n{two}"), (3, f"{one}\n{two}")]
    # a run of 24 words in twenty documents, whose first line an earlier one holds alone
    one, two = line("r", 12), line("s", 12)
    rows += [(10, one), *((i, f"{line(f'o{i}x', 9)}\n{one}\n{two}\nend{i}") for i in range(11, 31))]
    got = {r.doc_id: r.n_deleted for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs_deleted(rows, L.MIN_WORDS)
    assert got[3] == 2 and all(got[i] == 2 for i in range(12, 31)) and sum(got.values()) == 40


def test_patience_aligns_passages_that_are_repeated():
    p, words_of_p = [1, 2], [12, 12]
    assert L.common_blocks([7, *p, *p, 8], [9, *p, 10], [5, *words_of_p, 5], 20) == [1, 2]
    assert L.common_blocks([7, *p, 8], [9, *p, 10, *p, 11], [5, *words_of_p, 5, *words_of_p, 5], 20) == [1, 2]
    # the first two of three lines are not consecutive with the last
    assert L.common_blocks([2, 7, *p, 8, 2, 6], [9, *p, 10], [5, *words_of_p, 5], 20) == [1, 2]
    assert L.common_blocks([7, 1, 1, 8], [9, 1, 10], [5, 12, 5], 20) == []


def test_repeated_passages_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = rng.integers(0, 4, 12).tolist(), rng.integers(0, 4, 12).tolist()
        w = [[3, 9, 12, 25][x] for x in b]
        got = L.common_blocks(a, b, w, 20)
        held = [any(a[i : i + n] == b[j : j + n] for i in range(13 - n)) and sum(w[j : j + n]) >= 20 for j in range(12) for n in range(1, 13 - j)]
        assert not got or any(held)
        pairs = L.patience(a, b, w, 20)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        # a stretch where no line is unique is never left with a common block
        if not any(a.count(x) == 1 == b.count(x) for x in set(a)) and any(held):
            assert got


def test_no_link_is_lost_beside_a_leader(spark):
    import pyarrow as pa

    # y is like x and x like l, but y is not like l; one bucket for each text, of two samples
    texts = []
    for t in range(150):
        l_text = [f"t{t}w{i}" for i in range(200)]
        x_text = [f"{w}x" if i in (20, 60, 100) else w for i, w in enumerate(l_text)]
        texts += [l_text, x_text, [f"{w}y" if i in (40, 80, 120) else w for i, w in enumerate(x_text)]]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = M.idf_table(*M.document_frequencies(df))
    doc, h, count = M.shingles(M.Words(pa.array(texts)))
    drawn = M.sampled(doc, h, M.weights_of(h, count, idf), 2).T.tolist()
    together = [t for t in range(150) if drawn[3 * t] == drawn[3 * t + 1] == drawn[3 * t + 2]]
    size = {r.doc_id: r.class_size for r in M.near_classes(df, bands=2, rows=1).collect()}
    assert len(together) > 10
    assert all(size[3 * t] == 3 for t in together)


def test_large_group_below_the_threshold_of_each_other(spark):
    # copies of one text with 0 to 40 edited words, some of them copies of a copy: far more pairs than links
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    texts = [base]
    for k in range(250):
        of = texts[int(rng.integers(len(texts)))] if k % 4 == 0 else base
        at = set(rng.integers(0, len(of), int(rng.integers(0, 40))).tolist())
        texts.append([f"e{k}x{i}" if i in at else w for i, w in enumerate(of)])
    corpus = [(i, " ".join(t)) for i, t in enumerate(texts)]
    least = dict(enumerate(weighted_classes(corpus)))
    got = {r.doc_id: r.class_id for r in M.near_classes(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == least
    assert 20 < len(set(got.values())) < 240


def test_exact_search_finds_every_pair(spark):
    # every text its own class, so that the star cannot help
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(120):
        of = texts[int(rng.integers(len(texts)))] if texts and rng.random() < 0.8 else rng.integers(0, 40, int(rng.integers(5, 60))).tolist()
        texts.append([int(rng.integers(0, 40)) if rng.random() < 0.03 else w for w in of][: int(rng.integers(len(of) * 4 // 5, len(of) + 1))])
    texts = sorted({" ".join(map(str, t)) for t in texts})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    idf = M.idf_table(*M.document_frequencies(df))
    send = spark.sparkContext.broadcast(idf)
    shingles = []
    for t in texts:
        _, h, count = M.shingles(M.Words(M.pa.array([t])))
        shingles.append(dict(zip(h.tolist(), M.weights_of(h, count, idf).tolist(), strict=True)))
    rest = spark.createDataFrame([(i, float(sum(s.values())), i) for i, s in enumerate(shingles)], "id long, weight double, root long")
    got = {frozenset([r.id, r.lead]) for r in M.prefix_pairs(rest, df, send, 0.8).collect()}
    want = set()
    for i, a in enumerate(shingles):
        for j in range(i):
            both = sum(min(w, shingles[j][h]) for h, w in a.items() if h in shingles[j])
            if both / (sum(a.values()) + sum(shingles[j].values()) - both) >= 0.8:
                want.add(frozenset([i, j]))
    assert len(want) > 20 and want <= got
