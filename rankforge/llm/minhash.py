"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words (all words of a shorter text).  Its weight in a text is its count times an inverse document
frequency.  Document frequencies are counted over all documents in a count-min sketch of fixed size; its error is a fixed
share of the number of documents, whatever that number, and only makes very rare shingles equally heavy.

Improved consistent weighted sampling (Ioffe 2010) draws, for each of BANDS * ROWS functions, the shingle and the level
of its weight that minimise a random function of both; two texts draw the same with probability their weighted Jaccard
similarity.  Texts that agree in all rows of a band share a bucket of that band.  Two texts at the threshold share two
bands of 18 with probability 0.99995, while texts that only have a passage in common seldom do; so a text goes on only
if it shares two of its buckets with others.

Candidates are verified in two steps, neither of which lists the pairs of a bucket.

* Star: each bucket's leader is the text that meets most others over all its buckets; of a group of near copies that is
  the text that the others were made from.  Texts that share AGREE buckets with a leader of theirs are held against it.
  That links most texts of a large group, one comparison each, and no link depends on it.
* Exact search: buckets that still hold several classes are not told apart by samples.  All their texts are searched by
  prefixes: with each text's shingles ordered by how few of these texts hold them, two texts of similarity s or more share
  a shingle in front of which at most 1 - s of the weight of either lies, and what lies behind it is enough for both.
  Shingles that one text alone holds come first, so a text that is mostly its own, like a copy with many edits, has
  nothing to look for, however large its group is.  Keys hold the shingle and a size class; in a key the largest class
  never meets itself.  Two texts that meet are held against each other by bitmaps of their shingles, whose different bits
  bound from below what the texts do not share.  This search loses no pair.

Texts linked directly or through others form a class.  Exact copies are one text from the first shuffle on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, chunks, content_key, ints, longs, mixed, powers, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 18, 3
AGREE = 5
SIZE_CLASS = 1.06
#: Steps of idf, from its least value on: a bitmap of the exact search holds the shingles of one step.
IDF_STEPS = (1.0, 1.2, 1.3, 1.4, 1.49)
#: Tables of ids up to so many rows, counted, are broadcast (32 MB or so); larger ones are shuffled.
MAX_BROADCAST = 1_000_000
SKETCH_BITS = 20
_CELLS = 1 << 12
_U = np.uint64
KEYS = ["key_a", "key_b"]


# --- shingles ----------------------------------------------------------------------------------------------------------


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the different shingles, by text."""
    inside = np.flatnonzero(w.inside(size))
    doc, h = w.doc[inside], w.windows(size)[inside]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        n = len(w.hash)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(w.hash * up[:n], out=total[1:])
        a, b = w.first[short], w.first[short + 1]
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, mixed((total[b] - total[a]) * down[a] + w.count[short].astype(_U))])
    key = mixed(h + doc.astype(_U) * _U(0xD6E8FEB86659FD93))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    at, count = at[order], count[order]
    return doc[at], h[at], count


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(h ^ _U(0x5851F42D4C957F2D))
    return (x >> _U(64 - bits)).astype(np.int64), ((x << _U(bits)) >> _U(64 - bits)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text", bits: int = SKETCH_BITS) -> tuple[np.ndarray, int]:
    """A count-min sketch (2, 2**bits) of the documents that hold each shingle, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros((2, 1 << bits), np.int64), 0
        for batch in batches:
            for part in chunks(batch):
                n += part.num_rows
                _, h, _ = shingles(Words(part.column("text")))
                for row, cell in zip(cells, _cells(h, bits), strict=True):
                    row += np.bincount(cell, minlength=1 << bits)
        if n:
            parts = cells.reshape(-1, min(_CELLS, 1 << bits))
            used = np.flatnonzero(parts.any(axis=1))
            small = [x.astype(np.uint8 if x.max() < 256 else np.int64).tobytes() for x in parts[used]]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array([*small, np.int64(n).tobytes()], pa.binary())], names=["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                size = 1 if part < 0 else min(_CELLS, 1 << bits)
                x = np.frombuffer(raw, np.uint8 if len(raw) == size else np.int64)
                sums[part] = sums[part] + x if part in sums else x.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    cells, n = np.zeros((2 << bits) // min(_CELLS, 1 << bits) * min(_CELLS, 1 << bits), np.int64).reshape(-1, min(_CELLS, 1 << bits)), 0
    for part, raw in docs.select(F.col(text).alias("text")).mapInArrow(count, kind).repartition("part").mapInArrow(total, kind).collect():
        if part < 0:
            n = int(np.frombuffer(bytes(raw), np.int64)[0])
        else:
            cells[part] = np.frombuffer(bytes(raw), np.int64)
    return cells.reshape(2, -1), n


def idf_table(sketch: np.ndarray, n: int) -> np.ndarray:
    """Per cell 1 + ln(1 + n / (count + n / 100)) / (2 ln 101), so from 1 to 1.5.  A shingle takes the larger of its two
    cells.  Damped and smoothed, so that the shingles of a large group of near copies, frequent because of the group
    itself, are not outweighed by the few that differ."""
    n = max(n, 1)
    return (1 + np.log1p(n / (np.maximum(sketch, 1) + n / 100)) / (2 * np.log(101))).astype(np.float32)


def weights_of(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _cells(h, int(idf.shape[1]).bit_length() - 1)
    return count * np.maximum(idf[0][a], idf[1][b])


# --- samples -----------------------------------------------------------------------------------------------------------


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, at (i + 1/2) / n."""
    x = np.concatenate([np.geomspace(1e-6, 1, 200_000), np.linspace(1, 40, 400_000)[1:]])
    return np.interp((np.arange(n) + 0.5) / n, -np.expm1(-x) - x * np.exp(-x), x)


_tables: list[np.ndarray] = []


def sampled(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, functions: int) -> np.ndarray:
    """(functions, number of texts that occur in doc): a hash of the drawn shingle and level.  doc is in order."""
    if not _tables:
        q = _gamma_quantiles()
        _tables.extend([q.astype(np.float32), np.log(q).astype(np.float32)])
    gamma, log_gamma = _tables
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(doc)))
    log_w = np.log(weight).astype(np.float32)
    odd = mixed(np.arange(1, functions + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    flip = mixed(np.arange(1, functions + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
    out = np.empty((functions, len(first)), _U)
    if not len(first):
        return out
    for j in range(functions):
        x = (h ^ flip[j]) * odd[j]
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        r = gamma[(x >> _U(48)).astype(np.int64)]
        cost = log_gamma[((x >> _U(32)) & _U(0xFFFF)).astype(np.int64)]
        beta = ((x >> _U(16)) & _U(0xFFFF)).astype(np.float32)
        beta *= np.float32(1 / 65536)
        level = np.floor(log_w / r + beta)
        beta -= level
        beta -= np.float32(1)
        beta *= r
        cost += beta
        least = np.repeat(np.minimum.reduceat(cost, first), sizes)
        at = np.flatnonzero(cost == least)
        at = at[np.searchsorted(at, first)]
        out[j] = mixed(h[at] ^ (level[at].astype(np.int64).view(_U) * odd[j]))
    return out


def _signatures(idf, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                doc, h, count = shingles(Words(part.column("text")))
                weight = weights_of(h, count, idf.value)
                drawn = sampled(doc, h, weight, bands * rows)
                there = np.unique(doc)
                band = np.empty((len(there), bands), np.int64)
                for b in range(bands):
                    x = np.full(len(there), b + 1, _U)
                    for row in drawn[b * rows : (b + 1) * rows]:
                        x = mixed(x * _U(0x9E3779B97F4A7C15) + row)
                    band[:, b] = x.view(np.int64)
                sizes = np.zeros(part.num_rows, np.int32)
                sizes[there] = bands
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                total = np.bincount(doc, weight, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key_a"), part.column("key_b"), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.ravel()))],
                    names=["key_a", "key_b", "weight", "bands"],
                )

    return sign


def _weighted_shingles(idf):
    """Rows of each text's shingles and their weights."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                doc, h, count = shingles(Words(part.column("text")))
                w = weights_of(h, count, idf.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), longs(h), pa.array(w)], names=["id", "h", "w"])

    return rows


_BITS = 512


def _bitmaps(idf):
    """Of each text a bitmap for each step of idf: a bit says whether an odd number of its shingles of that step falls
    there.  Where two texts' bits differ, a shingle of at least that weight is in one of them alone."""
    width = len(IDF_STEPS) * _BITS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_ in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                for part in chunks(slice_):
                    doc, h, _ = shingles(Words(part.column("text")))
                    step = np.searchsorted(IDF_STEPS, weights_of(h, np.ones(len(h)), idf.value), side="right") - 1
                    cell = doc * width + step * _BITS + (mixed(h) >> _U(64 - 9)).astype(np.int64)
                    odd = np.bincount(cell, minlength=part.num_rows * width) % 2 == 1
                    bits = np.packbits(odd).view(np.int64)
                    offsets = np.arange(part.num_rows + 1, dtype=np.int32) * (width // 64)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits))], names=["id", "bits"])

    return rows


# --- verification ------------------------------------------------------------------------------------------------------


def _similar(idf, least: float):
    def one(part: pa.RecordBatch, column: str):
        doc, h, count = shingles(Words(part.column(column)))
        weight = weights_of(h, np.ones(len(h)), idf.value)
        return doc, mixed(h + doc.astype(_U) * _U(0x9FB21C651E98DF25)), count, weight

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "lead"]
        for batch in batches:
            for part in chunks(batch):
                n = part.num_rows
                d1, k1, c1, w1 = one(part, "text")
                d2, k2, c2, w2 = one(part, "lead_text")
                _, i, j = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
                both = np.bincount(d1[i], w1[i] * np.minimum(c1[i], c2[j]), minlength=n)
                total = np.bincount(d1, w1 * c1, minlength=n) + np.bincount(d2, w2 * c2, minlength=n)
                similarity = both / np.maximum(total - both, 1e-12)
                good = np.flatnonzero(similarity >= least - 1e-6)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(good)) for c in names), pa.array(similarity[good])], names=[*names, "similarity"])

    return verify


# --- links and classes -------------------------------------------------------------------------------------------------


def _small(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows, to be broadcast if that is within the bound."""
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def prefix_pairs(rest: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """id, lead: every pair of texts of rest (id, weight, root) of different roots that can have the similarity.

    texts: id, text.  Ordered by how many texts of rest hold them, rem is the weight of a text's shingles from one on.
    The first shingle that two texts share bounds what they share by rem in both, so it fulfils all conditions below.
    """
    half, slack = similarity / (1 + similarity), 1e-5
    told = texts.join(rest.select("id"), "id", "left_semi").mapInArrow(_weighted_shingles(idf), "id long, h long, w float")
    held = written(told.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "held")
    # a shingle that one text holds comes before all others and is met by none: its weight is in front of every rem
    rem = F.sum(F.col("w").cast("double")).over(W.partitionBy("id").orderBy(F.col("df").desc(), "h").rowsBetween(W.unboundedPreceding, 0))
    behind = told.join(held, "h").select("id", "h", rem.alias("rem"))
    sizes = written(rest.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    named = rest.join(sizes, "root").select("id", "weight", F.struct("n", "root").alias("class"))
    front = written(behind.join(named, "id").where(F.col("rem") >= (similarity - slack) * F.col("weight")), "prefixes")
    size_class = lambda c: F.floor(F.log(c) / float(np.log(SIZE_CLASS))).cast("int")
    # the lighter text of a pair waits in its size class, the heavier one looks in all classes that its rem allows
    wait = front.where(F.col("rem") >= (2 * half - slack) * F.col("weight")).withColumn("size", size_class(F.col("weight")))
    most = F.least(F.col("weight"), (F.col("rem") / half - F.col("weight")) * (1 + slack))
    least = size_class(similarity * F.col("weight") * (1 - slack))
    seek = front.withColumn("size", F.explode(F.sequence(least, F.greatest(size_class(most), least))))
    keys = wait.select("h", "size", "class", F.lit(1).alias("waits")).unionByName(seek.select("h", "size", "class", F.lit(0).alias("waits")))
    keys = keys.groupBy("h", "size").agg(F.max("class").alias("largest"), F.min("class").alias("other"), F.max("waits").alias("most"), F.min("waits").alias("least"))
    keys = written(keys.where("largest != other and most = 1 and least = 0").select("h", "size", "largest"), "keys")
    # the key's largest class is apart from the others, so that it never meets itself
    inside = F.col("class") == F.col("largest")
    bits = written(texts.join(rest.select("id"), "id", "left_semi").mapInArrow(_bitmaps(idf), "id long, bits array<long>"), "bits")
    wait = wait.join(keys, ["h", "size"]).join(bits, "id").select("h", "size", inside.alias("part"), F.col("id").alias("lead"), F.col("weight").alias("lead_weight"), F.col("rem").alias("lead_rem"), F.col("class.root").alias("lead_root"), F.col("bits").alias("lead_bits"))
    parts = F.when(inside, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    seek = seek.join(keys, ["h", "size"]).join(bits, "id").select("h", "size", F.explode(parts).alias("part"), "id", "weight", "rem", F.col("class.root").alias("root"), "bits")
    lighter = (F.col("lead_weight") < F.col("weight")) | ((F.col("lead_weight") == F.col("weight")) & (F.col("lead") < F.col("id")))
    enough = F.least("rem", "lead_rem") >= (half - slack) * (F.col("weight") + F.col("lead_weight"))
    n = _BITS // 64
    differ = lambda at: sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("lead_bits")[i])) for i in range(at * n, (at + 1) * n)), F.lit(0))
    apart = sum((least * differ(at) for at, least in enumerate(IDF_STEPS)), F.lit(0.0))
    near = apart <= (1 - 2 * half + slack) * (F.col("weight") + F.col("lead_weight"))
    return wait.join(seek, ["h", "size", "part"]).where((F.col("root") != F.col("lead_root")) & lighter & enough & near).select("id", "lead").distinct()


def near_links(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, lead, similarity): links between different texts, enough to connect each class; (key_a, key_b, id): the texts."""
    spark = docs.sparkSession
    keyed = docs.select(*content_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketch, n = document_frequencies(docs, text)
    idf = spark.sparkContext.broadcast(idf_table(sketch, n))
    kind = "key_a long, key_b int, weight double, bands array<long>"
    signed = keyed.mapInArrow(_signatures(idf, bands, rows), kind).groupBy(*KEYS).agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    # a number for each different text, kept in the table: two of them make a row of the tables below
    signed = written(signed.withColumn("id", F.monotonically_increasing_id()), "signatures")
    bucketed = signed.select("id", F.explode("bands").alias("bucket"))
    # counts are tables of their own, so that a bucket of very many texts is one that Spark can split in the joins
    crowded = written(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded")
    members = written(bucketed.join(crowded, "bucket"), "members")
    met = members.groupBy("id").agg(F.sum("n").alias("met"), F.count(F.lit(1)).alias("shared")).where("shared > 1").drop("shared")
    active = written(members.drop("n").join(met, "id").join(signed.select("id", "weight"), "id"), "active")
    order = F.struct((-F.col("met")).alias("less"), F.xxhash64("id").alias("o"), "id", "weight")
    leaders = active.groupBy("bucket").agg(F.min(order).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = written(leaders.select("bucket", F.col("l.id").alias("lead"), F.col("l.weight").alias("lead_weight")), "leaders")
    ids = signed.select(*KEYS, "id")
    told = written(ids.join(active.select("id").distinct(), "id", "left_semi"), "told")
    texts = written(keyed.join(_small(told, told.count()), KEYS).groupBy("id").agg(F.first("text").alias("text")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("lead"), F.col("text").alias("lead_text")), "lead").select("id", "lead", "text", "lead_text")
        return written(both.mapInArrow(_similar(idf, similarity), "id long, lead long, similarity double"), "links")

    alike = F.least("weight", "lead_weight") >= (similarity - 1e-4) * F.greatest("weight", "lead_weight")
    star = active.join(leaders, "bucket").where((F.col("id") != F.col("lead")) & alike)
    links = verified(star.groupBy("id", "lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(AGREE, bands)).drop("n"))
    # texts with two buckets that the links so far leave with several classes
    rooted = written(active.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    apart = written(rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket"), "apart")
    several = rooted.join(apart, "bucket").groupBy("id").agg(F.first("weight").alias("weight"), F.first("root").alias("root"), F.count(F.lit(1)).alias("n"))
    rest = written(several.where("n > 1").drop("n"), "rest")
    return links.unionByName(verified(written(prefix_pairs(rest, texts, idf, similarity), "pairs"))), ids


def components(links: DataFrame) -> DataFrame:
    """id, root: the least text that each linked text reaches.

    Labels spread along links and jump to their label's label, each round a table in the shared folder.
    """
    edges = written(links.select("id", "lead").unionByName(links.select(F.col("lead").alias("id"), F.col("id").alias("lead"))).distinct(), "edges")
    labels = written(edges.groupBy("id").agg(F.min("lead").alias("x")).select("id", F.least("id", "x").alias("root")), "labels")
    while True:
        reach = edges.join(labels.select(F.col("id").alias("lead"), "root"), "lead").groupBy("id").agg(F.min("root").alias("near"))
        spread = labels.join(reach, "id").select("id", F.least("root", "near").alias("next"), "root")
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("far"))
        after = written(spread.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("before")), "labels")
        labels = after.select("id", "root")
        if after.where("root != before").isEmpty():
            return labels


def _rooted(these: DataFrame, docs: DataFrame, text: str, **options) -> DataFrame:
    """these rows, which have docs' key_a and key_b, with root: a struct that all texts of a class share and no others."""
    links, ids = near_links(docs, text, **options)
    roots = written(ids.join(components(links), "id").drop("id"), "roots")
    alone = lambda c: F.when(F.col("root").isNull(), F.col(c)).alias(c)
    return these.join(_small(roots, roots.count()), KEYS, "left").withColumn("root", F.struct("root", *map(alone, KEYS)))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of docs.

    class_id is the least doc_id of the class, null only if all are null; kept marks one row of each class, one that has
    it.  Texts without words resemble nothing but exact copies of themselves.  Repeated rows are members of their own; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *content_key(F.col(text)))
    rooted = written(_rooted(rows, docs, text, **options).select("doc_id", "root", F.monotonically_increasing_id().alias("row")), "rooted")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row")).alias("best")
    classes = written(rooted.groupBy("root").agg(best, F.count(F.lit(1)).alias("class_size")), "classes")
    return rooted.join(classes, "root").select("doc_id", F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, all columns: the one with the least doc_id (null last), then the least other columns."""
    a, b = content_key(F.col(text))
    whole = docs.select(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.struct(*(F.col(c) for c in docs.columns)).alias("row")).alias("r"), a, b)
    return _rooted(whole, docs, text, **options).groupBy("root").agg(F.min("r").alias("r")).select("r.row.*")


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
