"""Quality rules of documents and of their hosts, in DataFrame functions only.

Every document gets five counts of its whole text.  Hosts (the source column) get the share of their documents that
fail the document rules, shrunk towards the mean of all documents by a beta prior fitted to the hosts by moments: a
host with few documents needs more failures.  A host whose shrunk rate is above max_rate loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_RATE = 0.5
MAX_BROADCAST_HOSTS = 100_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(grams: Column) -> Column:
    """Words covered by windows that occur twice or more."""

    def at_places(places: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda j: F.least(F.lit(WINDOW), places[j] - places[j - 1]))
        return F.lit(WINDOW) + F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    def of_sorted(s: Column) -> Column:
        same = lambda j, k: s[k]["g"] == s[j]["g"]
        n = F.size(s)
        places = F.filter(
            F.transform(s, lambda x, j: F.when(((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | ((j < n - 1) & same(j, F.least(j + 1, n - 1))), x["i"])),
            lambda x: x.isNotNull(),
        )
        return _let(F.sort_array(places), at_places)

    numbered = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(F.sort_array(numbered), of_sorted))


def document_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    names = [f"keep_{i}" for i in range(len(keep))]
    split = docs.select(
        *kept,
        words_of(F.col(text)).alias("w"),
        F.length(F.regexp_replace(t, SPACE, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select(
        *names,
        "word_chars",
        "n_symbols",
        F.size("w").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    h = F.col("h")
    grams = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    counted = hashed.select(*names, "word_chars", "n_symbols", "n_words", "n_dup_lines", grams.alias("grams"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    out = counted.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *counts, _covered(F.col("grams")).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(counts: DataFrame, host: str) -> tuple[DataFrame, float, float, int]:
    """host, n, failed, the prior's alpha and beta, and how many hosts.

    The prior is a beta-binomial's by moments weighted by the hosts' numbers of documents: the variance that the sampling of
    n documents explains is taken off, so many small hosts don't make the prior weak.
    """
    hosts = counts.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    k, total, bad, squares, spread = hosts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("failed"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("failed") * F.col("failed") / F.col("n"))).first()
    if not k:
        return hosts, 1.0, 1.0, 0
    m = bad / total
    between = m * (1 - m) * (total - squares / total - (k - 1))
    share = (spread - total * m * m - m * (1 - m) * (k - 1)) / between if between > 0 else 0.0
    strength = 1 / min(max(share, 1e-6), 1 / 3) - 1
    return hosts, m * strength, (1 - m) * strength, k


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id", "source"), max_rate: float = MAX_RATE) -> DataFrame:
    """The counts of every row of docs, host_rate and kept.

    Rows with a null host share one host of their own; an empty table gives no rows; repeated rows each count and are
    each judged.  keep must hold host.  The counts are written once and read for both the hosts and the verdicts.
    """
    counts = written(document_counts(docs, text, keep), "quality")
    hosts, alpha, beta, n_hosts = host_rates(counts, host)
    shrunk = hosts.select("host", ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"))
    if n_hosts <= MAX_BROADCAST_HOSTS:  # counted: documents, which may carry their texts, then stay where they are
        shrunk = F.broadcast(shrunk)
    return (
        counts.join(shrunk, F.col(host).eqNullSafe(F.col("host")), "left")
        .drop("host")
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again WHERE n > 1) GROUP BY r),
line AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
         WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN line USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f GROUP BY source),
t AS (SELECT count(*) AS k, sum(n)::DOUBLE AS total, sum(failed) / sum(n)::DOUBLE AS m, sum(n * n)::DOUBLE AS squares, sum(failed * failed / n::DOUBLE) AS spread FROM h),
b AS (SELECT *, m * (1 - m) * (total - squares / total - (k - 1)) AS between_hosts FROM t),
p AS (SELECT m, 1 / least(greatest(CASE WHEN between_hosts > 0 THEN (spread - total * m * m - m * (1 - m) * (k - 1)) / between_hosts ELSE 0 END, 1e-6), 1 / 3.0::DOUBLE) - 1 AS s FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (failed + m * s) / (n + m * s + (1 - m) * s) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p
"""
