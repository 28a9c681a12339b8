"""Substring dedup with difference-cover anchors.

Two copies of a run of LENGTH words start at some offsets i and j.  COVER is a difference cover modulo PERIOD: for any
i - j there is a shift below PERIOD that brings both to a position whose remainder is in COVER.  So it is enough to hash
windows of LENGTH - PERIOD + 1 words (the anchors) that start at cover positions: every repeated run has an anchor that
both copies hash.  Only windows around anchors seen twice are then extended to their full length and compared.

Both comparisons are one shuffle by hash.  Occurrences within one Arrow batch are matched before it, so a passage that a
third of all texts share sends one row per batch; exact copies of whole texts are combined before anything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, content_key, distinct_texts, ints, longs, mixed

LENGTH = 35
PERIOD = 21
#: A perfect difference set modulo 21 (fixed values).
COVER = (0, 1, 4, 14, 16)

_U = np.uint64
_KNOWN = 1 << 31  # in ref_b: the row is known to be repeated
_ROWS = "k long, ref_a long, ref_b long"
_REFS = "ref_a long, ref_b long"
_SENTINEL = -1  # ref_b of a row that only says: this hash occurs


def _rows(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(k), longs(a), longs(b)], names=["k", "ref_a", "ref_b"])


def _combined(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle.  A hash that this batch has twice needs no partner: its rows are marked and spread evenly,
    and one sentinel tells other batches."""
    order = np.argsort(k, kind="stable")
    k, a, b = k[order], a[order], b[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    twice = (np.bincount(group) > 1)[group] if len(k) else np.zeros(0, bool)
    marked = twice & (b != _SENTINEL)
    single = ~twice
    heads = new & twice
    return _rows(
        np.concatenate([k[single], k[heads], mixed((a[marked] ^ b[marked]).view(_U))]),
        np.concatenate([a[single], np.zeros(heads.sum(), np.int64), a[marked]]),
        np.concatenate([b[single], np.full(heads.sum(), _SENTINEL), b[marked] | _KNOWN]),
    )


def _ref_b(key_b: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (key_b.astype(np.int64) << 32) | place


def _anchors(length: int, period: int, cover: tuple[int, ...]):
    covered = np.zeros(period, bool)
    covered[list(cover)] = True
    size = length - period + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in chunks(batch):
                w = Words(part.column("text"))
                place = w.place()
                n = max(0, len(place) - size + 1)
                take = np.flatnonzero(covered[place[:n] % period] & w.inside(size) & (w.count[w.doc[:n]] >= length))
                doc = w.doc[take]
                parts.append((w.windows(size)[take], ints(part.column("key_a"))[doc], _ref_b(ints(part.column("key_b"))[doc], place[take])))
            if parts:
                yield _combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return rows


def _windows(length: int, period: int):
    """Rows of the full windows around repeated anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in chunks(batch):
                w = Words(part.column("text"))
                near = np.zeros(len(w.start) + 1, np.int64)
                places = part.column("places")
                if isinstance(places, pa.ChunkedArray):
                    places = places.combine_chunks()
                at = ints(places.flatten()) + np.repeat(w.first[:-1], np.diff(ints(places.offsets)))
                at_doc = w.doc[at]
                np.add.at(near, np.maximum(at - period + 1, w.first[at_doc]), 1)
                np.add.at(near, at + 1, -1)
                n = max(0, len(w.start) - length + 1)
                take = np.flatnonzero((np.cumsum(near[:-1]) > 0)[:n] & w.inside(length))
                doc = w.doc[take]
                a, b = ints(part.column("key_a"))[doc], _ref_b(ints(part.column("key_b"))[doc], take - w.first[doc])
                copied = ints(part.column("copies"))[doc] > 1
                parts.append((w.windows(length)[take], np.where(copied, 0, a), np.where(copied, _SENTINEL, b)))
            if parts:
                yield _combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return rows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, the occurrences whose hash comes twice.  Keeps one row between batches."""
    k0, a0, b0 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def refs(a, b):
        return pa.RecordBatch.from_arrays([longs(a), longs(b & ~_KNOWN)], names=["ref_a", "ref_b"])

    for batch in batches:
        k, a, b = (np.asarray(ints(batch.column(i)), np.int64) for i in range(3))
        known = (b != _SENTINEL) & ((b & _KNOWN) != 0)
        if known.any():
            yield refs(a[known], b[known])
        k, a, b = (np.concatenate([x0, x[~known]]) for x0, x in ((k0, k), (a0, a), (b0, b)))
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        twice = (np.bincount(group) > 1)[group]
        # a sentinel stands for two occurrences or more, or for one whose own row is not needed: what meets it is repeated
        out = twice & (b != _SENTINEL)
        if out.any():
            yield refs(a[out], b[out])
        last = len(k) - 1
        if twice[last]:
            k0, a0, b0 = k[last:], np.zeros(1, np.int64), np.full(1, _SENTINEL)
        else:
            k0, a0, b0 = k[last:], a[last:], b[last:]


def _places(rows: DataFrame) -> DataFrame:
    """key_a, key_b, places: for each text, where its repeated windows start."""
    found = rows.repartition("k").sortWithinPartitions("k").mapInArrow(_repeated, _REFS)
    return (
        found.select(F.col("ref_a").alias("key_a"), F.shiftright("ref_b", 32).cast("int").alias("key_b"), F.col("ref_b").bitwiseAND(0x7FFFFFFF).cast("int").alias("place"))
        .groupBy("key_a", "key_b")
        .agg(F.collect_list("place").alias("places"))
    )


def _removal(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"), hashes=False)
                places = part.column("places")
                if isinstance(places, pa.ChunkedArray):
                    places = places.combine_chunks()
                edge = np.zeros(len(w.start) + 1, np.int64)
                sizes = np.diff(ints(places.offsets))
                at = ints(places.flatten()) + np.repeat(w.first[:-1], sizes)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                whole = (ints(part.column("copies")) > 1) & (w.count >= length)
                gone |= whole[w.doc]
                n_gone = np.bincount(w.doc[gone], minlength=w.n)
                kept = [w.text(i, ~gone[w.first[i] : w.first[i + 1]]) for i in range(w.n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key_a"), part.column("key_b"), longs(w.count), longs(n_gone), pa.array(kept, pa.string())],
                    names=["key_a", "key_b", "n_words", "n_removed", "kept_text"],
                )

    return rows


def repeats_removed(docs: DataFrame, text: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """key_a, key_b (the text's content key), n_words, n_removed, kept_text for each different text.

    Removes every word that lies in a window of length words whose word sequence starts at any other place of the input,
    in the same text included.  Windows are judged on the input.  A null text is an empty one; texts shorter than length
    words lose nothing; of repeated rows each loses all words that a window covers, as the other copies hold them.
    The result has one row per different text: join it to rows by content_key.
    """
    if not 0 < period <= length or {(x - y) % period for x in cover for y in cover} != set(range(period)):
        raise ValueError("cover is no difference cover modulo period, or period exceeds length")
    texts = distinct_texts(docs, text)
    keys = ["key_a", "key_b"]
    anchors = _places(texts.mapInArrow(_anchors(length, period, tuple(cover)), _ROWS))
    windows = _places(texts.join(anchors, keys).select(*keys, "text", "copies", "places").mapInArrow(_windows(length, period), _ROWS))
    judged = texts.join(windows, keys, "left").select(*keys, "text", "copies", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    return judged.mapInArrow(_removal(length), "key_a long, key_b int, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs; see repeats_removed."""
    done = repeats_removed(docs, text, **options)
    return docs.select(F.col(doc_id).alias("doc_id"), *content_key(F.col(text))).join(done, ["key_a", "key_b"]).drop("key_a", "key_b")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = repeats_removed(docs).select("key_a", "key_b", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    rows = docs.select("doc_id", *content_key(F.col("text")))
    return rows.join(done, ["key_a", "key_b"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM again)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.r = word.r AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
