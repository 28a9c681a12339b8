"""Line dedup by pairwise alignment.

Documents that overlap are found through shared runs: at each line begins a minimal run, the fewest consecutive lines that
have MIN_WORDS words together.  Two documents have a common block of MIN_WORDS words or more exactly if they share such a
run.  Each run that several documents hold pairs every later document with the earliest holder, a star and not all pairs,
so a run of n documents gives n - 1 pairs, however large n is.  Each pair is aligned by patience diff, where no
line is unique by the longest common block, and aligned common blocks of MIN_WORDS words or more are deleted from the later
document.  What goes always stays in an earlier document: the
earliest holder of a line never loses it.

Alignment needs line hashes only; texts move once, to meet the numbers of their deleted lines.  Lines are compared without
white space at their ends; blank lines are never compared and stay where the lines around them stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, content_key, ints, longs, mixed, powers, words_of, written

RARE = 16  # of the tests' reference only
MIN_WORDS = 20
_U = np.uint64
_ID = ["no_id", "id", "key_a", "key_b"]  # the order of documents: by doc_id, null last, then by content


def _unique(lines: list[int], lo: int, hi: int) -> dict[int, int]:
    count = Counter(lines[lo:hi])
    return {x: i for i, x in enumerate(lines[lo:hi], lo) if count[x] == 1}


def _longest(a: list[int], b: list[int], words: list[int]) -> tuple[int, int, int, int]:
    """Of the common block with most words, the first of several: place in a, place in b, lines, words; words: of b's lines."""
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    places = {x: np.array(js) for x, js in at.items()}
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    length = np.zeros(len(b) + 1, np.int64)  # lines of the block that ends before this place of b and place i of a
    best, before = (0, 0, 0, 0), np.zeros(0, np.int64)
    for i, x in enumerate(a):
        js = places.get(x, before[:0])
        n = length[js] + 1
        length[before + 1] = 0
        length[js + 1] = n
        before = js
        if len(js):
            held = total[js + 1] - total[js + 1 - n]
            k = int(held.argmax())
            if held[k] > best[3]:
                best = (i + 1 - int(n[k]), int(js[k]) + 1 - int(n[k]), int(n[k]), int(held[k]))
    return best


def patience(a: list[int], b: list[int], words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned positions of equal lines: lines unique in both in their longest common order, then between them again.

    A stretch without such lines is split at its common block with most words, if that has least or more; words: of b's
    lines, one each if not given.
    """
    words = [1] * len(b) if words is None else words
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _unique(a, a0, a1), _unique(b, b0, b1)
        pairs = sorted((i, in_b[x]) for x, i in in_a.items() if x in in_b)
        tails: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            n = bisect_left(tails, j)
            back.append(at[n - 1] if n else -1)
            if n == len(tails):
                tails.append(j)
                at.append(k)
            else:
                tails[n], at[n] = j, k
        chain: list[tuple[int, int]] = []
        k = at[-1] if at else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        if not chain:
            held = set(a[a0:a1])
            if sum(words[j] for j in range(b0, b1) if b[j] in held) < max(least, 1):
                continue
            i, j, n, most = _longest(a[a0:a1], b[b0:b1], words[b0:b1])
            if most < max(least, 1):
                continue
            out += [(a0 + i + k, b0 + j + k) for k in range(n)]
            todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + n, a1, b0 + j + n, b1)]
            continue
        out += chain
        edges = [(a0 - 1, b0 - 1), *reversed(chain), (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Positions in b of aligned blocks, consecutive in both, with least words or more; words: of b's lines."""
    gone: list[int] = []
    run: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(a, b, words, least), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in run) >= least:
                gone += run
            run = []
        run.append(j)
        before = (i, j)
    return gone


def minimal_runs(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the different minimal runs of least words; a document's lines lie at bounds[i]:bounds[i+1]."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    end = np.searchsorted(total, total[:-1] + least)
    start = np.flatnonzero(end <= bounds[1:][doc])
    doc, end = doc[start], end[start]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(mixed(hashes.view(_U)) * up[:n], out=sums[1:])
    run = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    _, at = np.unique(mixed(run + doc.astype(_U) * _U(0xD6E8FEB86659FD93)), return_index=True)
    return doc[at], run[at]


def _runs(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, words = batch.column("lines"), batch.column("words")
            bounds = np.asarray(lines.offsets).astype(np.int64)
            doc, run = minimal_runs(ints(lines.flatten()), np.asarray(words.flatten()), bounds - bounds[0], least)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(doc)) for c in _ID), longs(run)], names=[*_ID, "run"])

    return rows


def _aligned(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lines, words, numbers = (batch.column(c).to_pylist() for c in ("first_lines", "lines", "words", "numbers"))
            gone = [[n[k] for k in common_blocks(a, b, w, least)] for a, b, w, n in zip(first, lines, words, numbers, strict=True)]
            keep = pa.array([bool(x) for x in gone])
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ID), pa.array(gone, pa.list_(pa.int32()))], names=[*_ID, "gone"])
            yield out.filter(keep)

    return rows


def deleted_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """no_id, id, key_a, key_b (a document: its doc_id and content key) and gone: numbers of its lines to delete."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, rf"^{SPACE}", ""), rf"{SPACE}$", "")
    named = docs.select(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), *content_key(F.col(text)), F.transform(F.split(t, "\n"), trimmed).alias("l"))
    told = F.filter(F.transform("l", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] != "")
    rows = named.select(*_ID, told.alias("s")).where(F.size("s") > 0)
    rows = rows.select(
        *_ID,
        F.transform("s", lambda s: F.xxhash64(s["x"])).alias("lines"),
        F.transform("s", lambda s: F.size(words_of(s["x"]))).alias("words"),
        F.transform("s", lambda s: s["i"]).alias("numbers"),
    )
    # equal rows are one document
    lined = written(rows.dropDuplicates(_ID), "lines")
    id_type = docs.schema[doc_id].dataType.simpleString()
    each = lined.select(*_ID, "lines", "words").mapInArrow(_runs(min_words), f"no_id boolean, id {id_type}, key_a long, key_b int, run long")
    who = F.struct(*_ID)
    # a table, so that a run of very many documents is one that Spark can split in the join
    holders = written(each.groupBy("run").agg(F.count(F.lit(1)).alias("n_docs"), F.min(who).alias("first")).where("n_docs > 1").select("run", "first"), "holders")
    pairs = each.join(holders, "run").where(who != F.col("first")).select("first", *_ID).distinct()
    firsts = lined.select(F.struct(*_ID).alias("f"), F.col("lines").alias("first_lines"))
    own = lined.select(*(F.col(c).alias(f"own_{c}") for c in _ID), "lines", "words", "numbers")
    mine = F.lit(True)
    for c in _ID:
        mine = mine & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    keyed = pairs.select(F.col("first").alias("f"), *_ID)
    both = keyed.join(own, mine).select("f", *_ID, "lines", "words", "numbers").join(firsts, "f").select(*_ID, "first_lines", "lines", "words", "numbers")
    found = both.mapInArrow(_aligned(min_words), f"no_id boolean, id {id_type}, key_a long, key_b int, gone array<int>")
    return found.groupBy(*_ID).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of docs with text rewritten, and n_lines, n_deleted (columns of docs with these names give way).

    Documents are ordered by doc_id, null last, then by content; rows equal in both are one document and keep the same
    lines.  Deletion only ever removes whole lines, with the line break before the next kept line.  A null text stays
    null; a text without anything to delete is returned unchanged.
    """
    gone = deleted_lines(docs, doc_id, text, **options).select(*(F.col(c).alias(f"_gone_{c}") for c in _ID), F.col("gone").alias("_gone"))
    a, b = content_key(F.col(text))
    # null-safe only for the id: the others are never null
    mine = F.col(doc_id).eqNullSafe(F.col("_gone_id")) & (a == F.col("_gone_key_a")) & (b == F.col("_gone_key_b"))
    lines = F.split(text, "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull())
    out = docs.drop("n_lines", "n_deleted").join(gone, mine, "left")
    return out.select(
        *(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))
