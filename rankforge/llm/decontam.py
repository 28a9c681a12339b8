"""Benchmark decontamination: MinHash containment search in size classes, verified by exact shingle containment.

A short item inside a long document has almost no Jaccard similarity with it.  So, as in a MinHash index partitioned by
size, items are put in classes by their number of shingles, doubling from class to class, and each class looks at windows
of the document of about its own size: windows of 3/2 of the class's size, every half of it, so that an item's passage
lies within one.  An item and a window that holds four fifths of it have a Jaccard similarity of a quarter or more; FUNCTIONS
min-hashes, of which one must agree, miss that once in 100,000 times.  Minima of small blocks are shared by all windows
and classes.  Items of fewer than LEAST_CLASS shingles are found exactly, by looking up every shingle of the text among
theirs.  Documents found this way are held exactly against the item: the share of its shingles that they hold.

Words are compared without ASCII case and punctuation.  Items come in blocks of at most BLOCK_WORDS words, one pass over
the documents each, so what is sent to the executors has a bound however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, ints, longs, mixed
from .minhash import SHINGLE, SIMILARITY, shingles

FUNCTIONS = 40
LEAST_CLASS = 16
BLOCK_WORDS = 1_000_000
_U = np.uint64
_ODD = mixed(np.arange(1, FUNCTIONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_FLIP = mixed(np.arange(1, FUNCTIONS + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


class Items:
    """Min-hashes of the items by size class, and all their shingles."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        w = Words(pa.array([r[1] or "" for r in rows], pa.string()), folded=True)
        doc, h, _ = shingles(w)
        self.shingles = [np.sort(h[doc == i]) for i in range(len(rows))] if len(rows) < 64 else np.split(h, np.searchsorted(doc, np.arange(1, len(rows))))
        self.shingles = [np.sort(x) for x in self.shingles]
        self.short: dict[int, list[int]] = {}
        self.classes: dict[int, list[int]] = {}
        few: list[int] = []
        for i, (n, s) in enumerate(zip(w.count, self.shingles, strict=True)):
            if 0 < n < SHINGLE:
                self.short.setdefault(int(n), []).append(i)
            elif n and len(s) < LEAST_CLASS:
                few.append(i)
            elif n:
                self.classes.setdefault(1 << int(len(s) - 1).bit_length(), []).append(i)
        #: Shingles of the items of few, in order, each with its item
        looked_up = np.concatenate([self.shingles[i] for i in few]) if few else np.zeros(0, _U)
        order = np.argsort(looked_up, kind="stable")
        self.few_shingles, self.few_items = looked_up[order], np.repeat(np.array(few, np.int64), [len(self.shingles[i]) for i in few])[order]
        self.least = {u: np.array([[((self.shingles[i] ^ f) * o).min() for i in of] for f, o in zip(_FLIP, _ODD, strict=True)]) for u, of in self.classes.items()}
        self.seen = {}
        for u, least in self.least.items():
            self.seen[u] = np.zeros((FUNCTIONS, 1 << 16), bool)
            for j in range(FUNCTIONS):
                self.seen[u][j, (least[j] >> _U(48)).astype(np.int64)] = True


def _looked_up(h: np.ndarray, doc: np.ndarray, items: Items, least: float) -> set[tuple[int, int]]:
    """(text, item) pairs of the items with few shingles, of which the text holds the share least or more."""
    lo = np.searchsorted(items.few_shingles, h)
    hit = np.flatnonzero(items.few_shingles[np.minimum(lo, len(items.few_shingles) - 1)] == h)
    # each shingle of a text once
    _, once = np.unique(mixed(h[hit] + doc[hit].astype(_U) * _U(0xD6E8FEB86659FD93)), return_index=True)
    hit = hit[once]
    lo, hi = lo[hit], np.searchsorted(items.few_shingles, h[hit], side="right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pair, count = np.unique(np.repeat(doc[hit], n) * np.int64(len(items.ids)) + items.few_items[at], return_counts=True)
    d, i = pair // len(items.ids), pair % len(items.ids)
    held = count >= (least - 1e-9) * np.array([len(items.shingles[k]) for k in i])
    return set(zip(d[held].tolist(), i[held].tolist(), strict=True))


def _candidates(w: Words, items: Items, least_share: float) -> set[tuple[int, int]]:
    """(text, item) pairs that shingles looked up or a min-hash of one of the text's windows propose."""
    pairs: set[tuple[int, int]] = set()
    for n, of in items.short.items():
        inside = np.flatnonzero(w.inside(n))
        # a shorter text's only shingle is hashed with its length
        h, doc = w.windows(n)[inside], w.doc[inside]
        for i in of:
            pairs |= {(int(d), i) for d in np.unique(doc[h == items.windows_of_short[i]])}
    if not items.classes and not len(items.few_shingles):
        return pairs
    inside = np.flatnonzero(w.inside(SHINGLE))
    if not len(inside):
        return pairs
    h, doc, place = w.windows(SHINGLE)[inside], w.doc[inside], w.place()[inside]
    if len(items.few_shingles):
        pairs |= _looked_up(h, doc, items, least_share)
    if not items.classes:
        return pairs
    size = min(items.classes) // 2
    block = place // size
    new = np.ones(len(h), bool)
    new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    doc, block = doc[start], block[start]
    least = np.empty((FUNCTIONS, len(start)), _U)
    for j in range(FUNCTIONS):
        x = h ^ _FLIP[j]
        x *= _ODD[j]
        least[j] = np.minimum.reduceat(x, start)
    while size * 2 <= max(items.classes):
        if size * 2 in items.classes:
            u = size * 2
            one, two = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
            for j in range(FUNCTIONS):
                v = least[j].copy()
                v[:-1][one] = np.minimum(v[:-1], least[j][1:])[one]
                v[:-2][two] = np.minimum(v[:-2], least[j][2:])[two]
                maybe = np.flatnonzero(items.seen[u][j][(v >> _U(48)).astype(np.int64)])
                for k, i in enumerate(items.classes[u]):
                    if len(maybe):
                        pairs |= {(int(d), i) for d in doc[maybe[v[maybe] == items.least[u][j, k]]]}
        block = block // 2
        new = np.ones(len(doc), bool)
        new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        doc, block, least = doc[start], block[start], np.minimum.reduceat(least, start, axis=1)
        size *= 2
    return pairs


def _verified(w: Words, items: Items, least: float) -> list[tuple[int, int, int, float]]:
    """(text, item id, shared shingles, containment) of the candidates that hold."""
    found = []
    of_text: dict[int, list[int]] = {}
    for d, i in _candidates(w, items, least):
        of_text.setdefault(d, []).append(i)
    if not of_text:
        return found
    for d in sorted(of_text):
        a, b = int(w.first[d]), int(w.first[d + 1])
        own = None
        for i in sorted(of_text[d]):
            if i in items.windows_of_short:
                shared = 1
            else:
                own = np.unique(items.window_hash(w, a, b)) if own is None else own
                s = items.shingles[i]
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                shared = int((own[at] == s).sum())
            share = shared / len(items.shingles[i])
            if share >= least - 1e-9:
                found.append((d, int(items.ids[i]), shared, share))
    return found


def _window_hash(w: Words, a: int, b: int) -> np.ndarray:
    if not hasattr(w, "_five"):
        w._five = w.windows(SHINGLE)
    return w._five[a : max(a, b - SHINGLE + 1)]


def _short_windows(rows: list[tuple[int, str]], short: dict[int, list[int]]) -> dict[int, int]:
    out = {}
    for n, of in short.items():
        for i in of:
            out[i] = Words(pa.array([rows[i][1]], pa.string()), folded=True).windows(n)[0]
    return out


def item_block(rows: list[tuple[int, str]]) -> Items:
    items = Items(rows)
    items.windows_of_short = _short_windows(rows, items.short)
    items.window_hash = _window_hash
    return items


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS):
    """Blocks of items for a pass each: a block has block_words words at most, or one longer item."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    part, words = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = r["text"].count(" ") + r["text"].count("\n") + 1
        if part and words + n > block_words:
            yield item_block(part)
            part, words = [], 0
        part.append((r["item_id"], r["text"]))
        words += n
    if part:
        yield item_block(part)


def contained_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_shared, containment: a row for each row of docs and item with containment of least or more.

    Null texts hold nothing; an item without words or id is in no document; an item of fewer than five words is one
    shingle, held by every document with those words in a row; repeated rows and items give repeated pairs.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("containment", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    rows = _verified(Words(part.column("text"), folded=True), sent.value, least)
                    if rows:
                        d, i, n, s = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d, pa.int64())), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=schema.names)

        out = out.unionByName(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, schema))
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that hold no item.  One pass for each block of items, no shuffle."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, text):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r[0] for r in _verified(Words(part.column(text), folded=True), sent.value, least)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH word AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-@\[-`{-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-@\[-`{-\x7F]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM word)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared, count(*) / any_value(n.n) AS containment
FROM s d JOIN s b ON d.g = b.g AND d.kind = 'd' AND b.kind = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) / any_value(n.n) >= 0.8
"""
