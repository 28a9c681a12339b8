"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are found by pattern and checked by their rules.  Secrets (keys, tokens,
passwords) have no rule that decides, so four labelers vote on every candidate, a long token of mixed characters: its
pattern, a gazetteer of key words before it, an assignment before it, and its mix of letters and digits.  Expectation
maximisation over the counts of vote patterns (16 at most) estimates how reliable each labeler is, and so how likely each
pattern is a secret.  These probabilities train the final classifier, naive Bayes over shape and context features of the
span, whose counts are a sum over all candidates; spans that it finds likely are added to the base spans.

Texts are scanned once.  Only counts by vote pattern and by feature combination, both of fixed number, reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, starts
from .common import written

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The patterns of the base kinds.  Possessive where nothing that follows could use what backtracking gives back, and
#: bound to where a run of characters begins or the last match ended, so that one long run is read once.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9+/_-])=*+",
}
#: A text without this cannot hold the kind.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Key words of the gazetteer (fixed values).
GAZETTEER = ("token", "secret", "password", "passwd", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "auth", "bearer", "credential")
KNOWN_SECRETS = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,})"
LABELERS = ("pattern", "gazetteer", "assignment", "mix")
LEAST = 0.5


def _matches(t: Column, kind: str) -> tuple[Column, Column]:
    hint = t.rlike(_HINTS[kind])
    none = F.array().cast("array<string>")
    return F.when(hint, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none), F.when(hint, F.split(t, PATTERNS[kind], -1)).otherwise(none)


def _placed(m: Column, gaps: Column, kept: Column, more: bool = False) -> Column:
    """Start, end and match of every match; the text is gaps[0] m[0] gaps[1] m[1] ...  Code points, end exclusive."""
    sizes = F.transform(m, lambda x, i: F.length(gaps[i]) + F.length(x))

    def spans(before: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = before[i] + F.length(gaps[i])
            extra = [F.right(gaps[i], F.lit(48)).alias("left"), F.left(gaps[i + 1], F.lit(4)).alias("right")] if more else []
            return F.struct(start.cast("int").alias("s"), (start + F.length(x)).cast("int").alias("e"), x.alias("m"), *extra)

        return F.transform(m, span)

    return F.filter(let(starts(sizes), spans), kept)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda x: F.when(F.length(_only_digits(x["m"])).between(12, 19), _luhn(_only_digits(x["m"]))).otherwise(F.lit(False)),
    "phone": lambda x: F.length(_only_digits(x["m"])).between(9, 15),
    "secret": lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"),
}


def _votes(x: Column) -> list[Column]:
    """1 or 0 of each labeler on a candidate."""
    left = F.lower(x["left"])
    share = F.length(_only_digits(x["m"])) / F.length(x["m"])
    words = reduce(lambda a, b: a | b, (left.contains(w) for w in GAZETTEER))
    votes = (x["m"].rlike(KNOWN_SECRETS), words, left.rlike(r"[=:]>?\s*[\"'`]?$"), share.between(0.15, 0.85) & (F.length(x["m"]) >= 20))
    return [v.cast("int") for v in votes]


def _features(x: Column) -> Column:
    """One number for the span's length, digit share, character set, quotes and key word."""
    m = x["m"]
    share = F.length(_only_digits(m)) / F.length(m)
    length = F.when(F.length(m) < 20, 0).when(F.length(m) < 32, 1).when(F.length(m) < 64, 2).otherwise(3)
    digits = F.when(share < 0.15, 0).when(share < 0.4, 1).when(share < 0.85, 2).otherwise(3)
    chars = F.when(m.rlike("^[0-9a-f]+$"), 0).when(m.rlike("^[0-9A-Z]+$"), 1).when(m.rlike("^[0-9A-Za-z]+$"), 2).otherwise(3)
    quoted = (x["left"].rlike("[\"'`]$") & x["right"].rlike("^[\"'`]")).cast("int")
    key = reduce(lambda a, b: a | b, (F.lower(x["left"]).contains(w) for w in GAZETTEER)).cast("int")
    return (((length * 4 + digits) * 4 + chars) * 2 + quoted) * 2 + key


_FEATURE_SIZES = (4, 4, 4, 2, 2)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, one array of spans for each base kind, and candidates with votes and features."""
    t = F.coalesce(F.col("t"), F.lit(""))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).select("doc_id", *(c.alias(f"{n}_{k}") for k in KINDS for n, c in zip("mg", _matches(t, k), strict=True)))
    spans = [_placed(F.col(f"m_{k}"), F.col(f"g_{k}"), _CHECKS[k], k == "secret").alias(k) for k in KINDS]
    placed = found.select("doc_id", *spans)
    base = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS[:-1]]
    vote = lambda x: reduce(lambda a, b: a * 2 + b, _votes(x))
    return placed.select("doc_id", *base, F.transform("secret", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), vote(x).alias("votes"), _features(x).alias("features"))).alias("candidates"))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """By expectation maximisation over counts of vote patterns: how likely each pattern is a secret, and for each labeler
    how often it votes for secrets and for others.  Starts with labelers that are right four times in five; a weak beta
    prior keeps labelers that never disagree from certainty."""
    n = len(LABELERS)
    votes = {p: [(p >> (n - 1 - i)) & 1 for i in range(n)] for p in counts}
    prior, rates = 0.5, [(0.8, 0.2)] * n
    belief: dict[int, float] = {}
    for _ in range(rounds):
        for p, v in votes.items():
            yes = math.log(prior) + sum(math.log(a if x else 1 - a) for x, (a, _) in zip(v, rates, strict=True))
            no = math.log(1 - prior) + sum(math.log(b if x else 1 - b) for x, (_, b) in zip(v, rates, strict=True))
            belief[p] = 1 / (1 + math.exp(min(no - yes, 700)))
        secrets = sum(counts[p] * belief[p] for p in counts)
        others = sum(counts.values()) - secrets
        prior = (secrets + 2) / (secrets + others + 4)
        rates = [
            (
                (sum(counts[p] * belief[p] for p in counts if votes[p][i]) + 8) / (secrets + 10),
                (sum(counts[p] * (1 - belief[p]) for p in counts if votes[p][i]) + 2) / (others + 10),
            )
            for i in range(n)
        ]
    return belief, rates


def _digits(features: int) -> list[int]:
    out = []
    for size in reversed(_FEATURE_SIZES):
        out.append(features % size)
        features //= size
    return out[::-1]


def classifier(sums: dict[int, tuple[float, float]]) -> dict[int, float]:
    """Naive Bayes with add-one smoothing: features -> probability, from the expected numbers of secrets and others."""
    yes, no = sum(a for a, _ in sums.values()), sum(b for _, b in sums.values())
    tables = []
    for i, size in enumerate(_FEATURE_SIZES):
        seen = [[1.0, 1.0] for _ in range(size)]
        for f, (a, b) in sums.items():
            seen[_digits(f)[i]][0] += a
            seen[_digits(f)[i]][1] += b
        tables.append([(a / (yes + size), b / (no + size)) for a, b in seen])
    out = {}
    for f in sums:
        logit = math.log((yes + 1) / (no + 1)) + sum(math.log(t[d][0] / t[d][1]) for t, d in zip(tables, _digits(f), strict=True))
        out[f] = 1 / (1 + math.exp(-max(min(logit, 700), -700)))
    return out


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by start, then kind) for every row of docs.

    Null and empty texts have no spans; repeated rows have the same spans each; a table without candidates adds none.
    Kinds may overlap: a card inside a phone number counts for both, as the base rules say.
    """
    found = written(scanned(docs, doc_id, text), "spans")
    candidates = found.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    rows = [(r["votes"], r["features"], r["n"]) for r in candidates.collect()]  # at most 16 patterns times 256 combinations
    counts: dict[int, int] = {}
    for votes, _, n in rows:
        counts[votes] = counts.get(votes, 0) + n
    belief, _ = reliabilities(counts) if counts else ({}, [])
    sums: dict[int, tuple[float, float]] = {}
    for votes, f, n in rows:
        a, b = sums.get(f, (0.0, 0.0))
        sums[f] = (a + n * belief[votes], b + n * (1 - belief[votes]))
    likely = sorted(f for f, p in classifier(sums).items() if p >= least) if sums else []
    shape = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
    of = lambda k, c: F.transform(c, lambda x: F.struct(x["s"].alias("start"), F.lit(KINDS.index(k)).alias("kind_no"), x["e"].alias("end"), F.lit(k).alias("kind"))).cast(shape)
    base = F.sort_array(F.concat(*(of(k, F.col(k)) for k in KINDS[:-1])))
    added = F.filter("candidates", lambda x: x["features"].isin(likely)) if likely else F.filter("candidates", lambda x: F.lit(False))
    every = F.sort_array(F.concat(*(of(k, F.col(k)) for k in KINDS[:-1]), of("secret", added)))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", plain(base).alias("base"), plain(every).alias("spans"))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:-1]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
