"""URL filters, personal data, quality rules, benchmark decontamination."""

import hashlib
import re
from collections import Counter

import pytest

from rankforge.llm import decontam as D
from rankforge.llm import pii as P
from rankforge.llm import quality as Q
from rankforge.llm import url_filter as U
from tests.llm.conftest import words

URLS = [
    None, "", "no scheme", "http://a.example.net/en/1", "http://A.EXAMPLE.NET/de/1", "http://net/x", "http://planet/x", "http://net", "https://x.example.com/de/2#f", "https://x.org/fr/", "https://x.org/fr",
    "http://www.site.io/p/?utm_source=a&b=2&a=1", "http://site.io/p?a=1&b=2#x", "http://site.io:80/p?a=1&b=2", "http://site.io/q", "http://site.io/q", "ftp://ÉX.io/ö",
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "block") for i, u in enumerate(URLS)] + [(None, "http://site.io/q", "x")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("http://site.io/p/?b=2&a=1&ref=q",), (None,), ("nothing",), ("http://site.io/p?a=1&b=2",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in U.filter_urls(pages, listed).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow", False)
    assert [got[i][2:4] for i in range(3, 11)] == [("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), (None, "allow"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow")]
    assert [got[i][3:] for i in (11, 12, 13)] == [("block", True)] * 3 and got[14][3:] == got[None][3:] == ("allow", False)
    assert got[4][:2] == ("a.example.net", "/de/1") and got[16][0] == "Éx.io"


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_bloom_filter_has_no_false_negatives(spark, limit):
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id % 900, '.io/', id % 1700) AS url")
    listed = pages.where("page_id % 7 = 0").select("url")
    names = {r.url for r in listed.collect()}
    got = U.filter_urls(pages, listed, max_filter_bytes=limit, bits_per_url=4).join(pages, "page_id").collect()
    assert len(got) == 4000 and all(r.listed == (r.url in names) for r in got)


def test_url_filter_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert U.filter_urls(pages, pages.where("false")).first().verdict == "allow"
    assert U.filter_urls(pages.where("false"), pages).isEmpty()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(divmod(int(c) * (1 + i % 2), 10))
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), list(BASE).index(kind), m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


TEXTS = [
    None, "", "é a@b.c@d.e, a@b.c_d@e.f x@y. 1.2.3.4.5 256.1.1.1 001.002.003.004", "+1 (017) 555-7713. +12 +123 4 5678901 ++49 123 456 789", "4111 1111 1111 1111, 4111-1111-1111-1112 4012888888881881x 12 34",
    "1 " * 3000, "9" * 5000, "a." * 2000 + "@b" + ".c" * 2000, "1.1.1.1 " * 200, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 12345678901234567 plainwordplainwordplainword', "mail: x.y+z@mail.example.com 😀 10.0.0.255",
]


def test_personal_data(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "s"), (None, TEXTS[3], "s")]
    got = P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[3] if r.doc_id is None else TEXTS[r.doc_id]
        base = [tuple(x) for x in r.base]
        assert base == base_spans(text)
        assert [tuple(x) for x in r.spans if x.kind != "secret"] == base
    secret = [r for r in got if r.doc_id == 9][0].spans
    assert [(x.kind, TEXTS[9][x.start : x.end]) for x in secret] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]


def test_long_secrets(spark):
    long = hashlib.sha512(b"k").hexdigest() * 40
    texts = [*TEXTS, f'token = "{long}" and so on']
    got = P.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where(f"doc_id = {len(TEXTS)}").first()
    assert [(x.kind, texts[-1][x.start : x.end]) for x in got.spans] == [("secret", long)]


def test_reliabilities_of_labelers_that_disagree():
    # pattern, gazetteer and assignment mostly agree; mix is a coin
    counts = {0b1111: 400, 0b1110: 400, 0b0000: 450, 0b0001: 450, 0b1101: 40, 0b0111: 30, 0b0100: 20}
    belief, rates = P.reliabilities(counts)
    assert belief[0b1110] > 0.95 and belief[0b0001] < 0.05
    assert rates[0][0] > 0.85 > 0.65 > rates[3][0] and abs(rates[3][0] - rates[3][1]) < 0.1


def test_no_personal_data(spark, no_docs):
    assert P.find_personal_data(no_docs).isEmpty()


def repeats(w):
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality_counts(docs, corpus):
    got = Counter(tuple(r) for r in Q.document_counts(docs).drop("source").collect())
    want = Counter()
    for r in corpus:
        t = r[1] or ""
        w = words(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        n = repeats(w)
        want[(r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, n, len(w) < 10 or 100 * n > 20 * len(w))] += 1
    assert got == want


def test_hosts(spark, no_docs):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "good", "en") for i in range(50)] + [(100 + i, "bad" if i % 10 else good, "bad", "en") for i in range(50)] + [(200, "short", "small", "en"), (201, good, "small", "en"), (None, good, None, None)]
    got = {r.doc_id: r for r in Q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, host string")).collect()}
    assert all(got[i].kept for i in range(50)) and not any(got[100 + i].kept for i in range(50))
    assert not got[200].kept and got[201].kept and got[None].kept
    assert got[100].base_failed is False  # the host's verdict, not its own
    assert Q.judge_documents(no_docs).isEmpty()


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma."


def test_decontamination(spark, no_docs):
    filler = " ".join(f"f{i}" for i in range(3000))
    w = ITEM.split()
    texts = [
        ITEM, f"{filler} {ITEM.upper()} {filler}", f"{filler}\n{' '.join(w[:17])} end", " ".join(w[:9]) + " x " + " ".join(w[9:]), " ".join(w[:8]) + f" {filler} " + " ".join(w[4:]),
        " ".join(reversed(w)), filler, None, "", "say yes please now",
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, ITEM, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, "Yes, please"), (9, None), (10, "..."), (None, ITEM), (11, " ".join(f"g{i}" for i in range(200)))], "item_id long, text string")

    def folded(t):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())

    def grams(t):
        f = folded(t)
        return {tuple(f[i : i + 5]) for i in range(len(f) - 4)}

    want = {(i, 7) for i, t in [*enumerate(texts), (None, ITEM)] if len(grams(t) & grams(ITEM)) >= 0.8 * len(grams(ITEM))} | {(9, 8)}
    got = {(r.doc_id, r.item_id): r.containment for r in D.contained_items(docs, items).collect()}
    assert set(got) == want and {(0, 7), (1, 7), (4, 7), (None, 7)} <= want and (3, 7) not in want
    left = {r.doc_id for r in D.uncontaminated(docs, items).collect()}
    assert left == set(range(10)) - {i for i, _ in want}
    assert D.contained_items(no_docs, items).isEmpty() and D.contained_items(docs, items.where("false")).isEmpty()


def test_short_items_in_long_documents_are_all_found():
    import pyarrow as pa

    rows, texts = [], []
    for i in range(240):
        w = [f"i{i}w{j}" for j in range(5 + (i % 16 if i < 64 else 0))]
        rows.append((i, " ".join(w)))
        texts.append(" ".join([*(f"d{i}f{j}" for j in range(150 + i)), *w, *(f"d{i}g{j}" for j in range(150))]))
    rows += [(1000, rows[0][1]), (1001, rows[15][1])]
    texts += [f"{rows[11][1].rsplit(' ', 1)[0]} x", f"{rows[1][1].rsplit(' ', 1)[0]} x", ""]
    found = D._verified(D.Words(pa.array(texts), folded=True), D.item_block(rows), 0.8)
    # of twelve shingles, all but the last are four fifths; of two they are not
    want = {(i, i) for i in range(240)} | {(0, 1000), (15, 1001), (240, 11)}
    assert {(d, i) for d, i, _, _ in found} == want and len(found) == len(want)


def test_item_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(10)], "item_id long, text string")
    assert [len(b.ids) for b in D.item_blocks(items, "item_id", "text", 50)] == [2] * 5


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
