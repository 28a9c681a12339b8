"""Scorers over units: BM25, TF-IDF (words and character n-grams), dense vectors and lexical weights.

Every scorer gives hits(qid, unit_ord, unit_id, doc_id, score) without text; ranking.py makes rankings of them.  With k, a
scorer gives the hits of which the best k of each query are part, and keeps them as a table.  Units are scored in Arrow
batches against all queries (blocks.py); many queries or terms, and units of equal unit_ord, go by joins of postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLAIN, TokenRules, char_grams, char_words, let, lexical_tokens
from ..sources.shared import table
from . import blocks
from .chunking import ChunkRules
from .units import CHUNKS_OF_ONE, chunk_units, ordinal

#: Query terms, and queries, up to so many are sent to all tasks.
MAX_VOCABULARY = 10_000
MAX_QUERIES = 4_096
#: Terms of more than one unit, whose document frequencies all tasks have (12 bytes each), up to so many.
MAX_TERMS = 20_000_000


@dataclass(frozen=True)
class BM25:
    k1: float = 1.5
    b: float = 0.75
    rules: TokenRules = PLAIN


@dataclass(frozen=True)
class TfIdf:
    analyzer: str = "word"
    ngram_range: tuple[int, int] = (1, 1)
    min_df: float = 1
    max_df: float = 1.0
    rules: TokenRules = PLAIN

    def __post_init__(self):
        if self.analyzer not in ("word", "char_wb"):
            raise ValueError(f"unknown analyzer: {self.analyzer}")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def postings(units: DataFrame, rules: TokenRules = PLAIN, lemma=None) -> DataFrame:
    """term, unit_ord, tf, dl: the inverted index, one row for each term of each unit."""
    require_columns(units, "unit_ord", "text")
    terms = units.select("unit_ord", lexical_tokens(F.col("text"), rules, lemma).alias("terms"))
    each = terms.select("unit_ord", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy("term", "unit_ord").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def _query_terms(queries: DataFrame, rules: TokenRules, lemma) -> DataFrame:
    return queries.select("qid", F.explode(lexical_tokens(F.col("question"), rules, lemma)).alias("term")).distinct()


def _repeated(rows: DataFrame) -> bool:
    """Whether two rows have the same unit_ord."""
    return not rows.groupBy("unit_ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _kept(hits: DataFrame, k: int | None) -> DataFrame:
    return hits if k is None else table(hits, "hits")


def bm25(units: DataFrame, queries: DataFrame, config: BM25 = BM25(), lemma=None, k: int | None = None) -> DataFrame:
    """Hits of BM25 with idf = ln(1 + (N - df + 1/2) / (df + 1/2)); a query's terms count once each."""
    require_columns(units, "unit_ord", "unit_id", "doc_id", "text")
    return _bm25(lambda: units, lambda vocabulary: _numbered(units, vocabulary, config.rules, lemma), queries, config, lemma, k)


def bm25_chunks(documents: DataFrame, chunk: ChunkRules, queries: DataFrame, config: BM25 = BM25(), lemma=None, k: int | None = None) -> DataFrame:
    """bm25 of chunk_units.  A document is cut into terms once, and its line chunks are spans of these: chunk texts are not
    made.  Other chunks, and terms that need the plan's functions, go by chunk texts."""
    units = lambda: chunk_units(documents, chunk)
    if chunk.unit != "line" or not blocks.is_plain(config.rules, lemma):
        return bm25(units(), queries, config, lemma, k)
    return _bm25(units, lambda vocabulary: _numbered_lines(documents, chunk, vocabulary, config.rules), queries, config, lemma, k)


def _bm25(units: Callable[[], DataFrame], numbered: Callable[[list[str]], DataFrame], queries: DataFrame, config: BM25, lemma, k: int | None) -> DataFrame:
    asked = _query_terms(queries, config.rules, lemma)
    vocabulary = [r["term"] for r in asked.select("term").distinct().limit(MAX_VOCABULARY + 1).collect()]
    qids = [r["qid"] for r in asked.select("qid").distinct().limit(MAX_QUERIES + 1).collect()]
    if not 0 < len(vocabulary) <= MAX_VOCABULARY or len(qids) > MAX_QUERIES:
        terms = units().select("unit_ord", "unit_id", "doc_id", lexical_tokens(F.col("text"), config.rules, lemma).alias("terms"))
        sized = table(terms.select("unit_ord", "unit_id", "doc_id", F.size("terms").alias("dl"), "terms"), "terms")
        touched = sized.select("unit_ord", "unit_id", "doc_id", "dl", F.explode("terms").alias("term"), F.lit(1).alias("tf"))
        return _kept(_bm25_joined(sized, touched.join(asked.select("term").distinct(), "term", "left_semi"), asked, config), k)
    # texts are read and cut into terms once; numbers of query terms and their counts stay
    vocabulary.sort()
    sized = table(numbered(vocabulary), "terms")
    if _repeated(sized):
        words = queries.sparkSession.createDataFrame(list(enumerate(vocabulary)), "id int, term string")
        touched = sized.select("unit_ord", "unit_id", "doc_id", "dl", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).join(F.broadcast(words), F.col("p.ids") == F.col("id"))
        return _kept(_bm25_joined(sized, touched.select("unit_ord", "unit_id", "doc_id", "dl", "term", F.col("p.tfs").alias("tf")), asked, config), k)
    n, average = sized.agg(F.count(F.lit(1)), F.avg("dl")).first()
    seen = sized.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()
    idf = np.zeros(len(vocabulary))
    for r in seen:
        idf[r["id"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    number, place = {t: i for i, t in enumerate(vocabulary)}, {q: i for i, q in enumerate(qids)}
    has = np.zeros((len(qids), len(vocabulary)))
    for r in asked.collect():
        has[place[r["qid"]], number[r["term"]]] = 1
    return _kept(blocks.searched(sized, qids, _bm25_scores(has, idf, average or 0.0, config), k), k)


NUMBERED = "unit_ord long, unit_id string, doc_id string, dl int, ids array<int>, tfs array<int>"


def _numbers_of(units: list[pa.Array], n: np.ndarray, unit: np.ndarray, ids: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows of _numbered, from each unit's number of terms, and unit and number of each term of the vocabulary."""
    both, tfs = np.unique(unit * size + ids, return_counts=True)
    ends = pa.array(np.searchsorted(both, np.arange(len(n) + 1) * size), pa.int32())
    lists_of = lambda x: pa.ListArray.from_arrays(ends, pa.array(x, pa.int32()))
    return pa.RecordBatch.from_arrays([*units, pa.array(n, pa.int32()), lists_of(both % size), lists_of(tfs)], names=["unit_ord", "unit_id", "doc_id", "dl", "ids", "tfs"])


def _numbered(units: DataFrame, vocabulary: list[str], rules: TokenRules, lemma) -> DataFrame:
    """unit_ord, unit_id, doc_id, dl, and ids (places in the vocabulary) and tfs of the terms that it has."""
    plain = blocks.is_plain(rules, lemma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, number = blocks.Codes(rules, vocabulary) if plain else None, {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            for part in blocks.slices(batch):
                values = blocks.strings(part.column("of"))
                if plain:
                    read, at = codes.read(values)
                    found = codes.counts(read, at[:-1], at[1:])
                else:
                    sizes = np.fromiter((len(ts or ()) for ts in values), np.int64, len(values))
                    ids = np.fromiter((number.get(t, -1) for ts in values for t in ts or ()), np.int64, int(sizes.sum()))
                    found = sizes, np.repeat(np.arange(len(values)), sizes)[ids >= 0], ids[ids >= 0]
                yield _numbers_of([part.column(c) for c in ("unit_ord", "unit_id", "doc_id")], *found, len(vocabulary))

    rows = units.select("unit_ord", "unit_id", "doc_id", blocks.source(F.col("text"), rules, lemma).alias("of"))
    return rows.mapInArrow(run, NUMBERED)


def _numbered_lines(documents: DataFrame, chunk: ChunkRules, vocabulary: list[str], rules: TokenRules) -> DataFrame:
    """_numbered of the line chunks of documents(doc_id, text), under plain rules: terms end where lines do."""
    size, step = chunk.size, chunk.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = blocks.Codes(rules, vocabulary)
        for batch in batches:
            for part in blocks.slices(batch):
                # lines as line_spans() finds them: str.splitlines() ends them where LINE_END does
                lines = [[x for x in text.splitlines() if x and not x.isspace()] or [""] for text in blocks.strings(part.column("of"))]
                n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
                read, at = codes.read([x for ls in lines for x in ls])
                n = np.where(n_lines <= size, 1, -(-(n_lines - size) // step) + 1)
                doc = np.repeat(np.arange(len(lines)), n)
                position = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = (np.cumsum(n_lines) - n_lines)[doc]
                found = codes.counts(read, at[start + position * step], at[start + np.minimum(position * step + size, n_lines[doc])])
                docs = part.column("doc_id").take(pa.array(doc))
                names = [f"{chunk.unit}::{p}" if d is None else f"{d}::{chunk.unit}::{p}" for d, p in zip(blocks.strings(docs), position.tolist(), strict=True)]
                order = pc.add(pc.multiply(part.column("unit_ord").take(pa.array(doc)), CHUNKS_OF_ONE), pa.array(position))
                yield _numbers_of([order, pa.array(names, pa.string()), docs], *found, len(vocabulary))

    rows = documents.select(ordinal(documents, "doc_id").alias("unit_ord"), F.col("doc_id").cast("string").alias("doc_id"), blocks.source(F.col("text"), rules).alias("of"))
    return rows.mapInArrow(run, NUMBERED)


def _bm25_scores(has: np.ndarray, idf: np.ndarray, average: float, config: BM25):
    def start():
        def score(part: pa.RecordBatch) -> np.ndarray:
            ids, tfs = part.column("ids"), part.column("tfs")
            sizes = np.asarray(ids.value_lengths())
            t, tf = np.asarray(ids.flatten()), np.asarray(tfs.flatten()).astype(np.float64)
            row = np.repeat(np.arange(part.num_rows), sizes)
            norm = config.k1 * (1 - config.b + config.b * np.asarray(part.column("dl")) / max(average, 1e-9))
            used, column = np.unique(t, return_inverse=True)
            weights = np.zeros((len(used), part.num_rows))
            weights[column, row] = idf[t] * tf * (config.k1 + 1) / (tf + norm[row])
            there = np.zeros((len(used), part.num_rows), np.float32)
            there[column, row] = 1
            asked = has[:, used]
            return np.where(asked.astype(np.float32) @ there > 0, asked @ weights, -np.inf)

        return score

    return start


def _bm25_joined(sized: DataFrame, touched: DataFrame, asked: DataFrame, config: BM25) -> DataFrame:
    """BM25 by joins; touched: unit, dl, term and tf, to be summed."""
    stats = sized.agg(F.count(F.lit(1)).cast("double").alias("n_units"), F.avg("dl").alias("avgdl"))
    posted = touched.groupBy("term", "unit_ord", "unit_id", "doc_id", "dl").agg(F.sum("tf").cast("double").alias("tf"))
    seen = posted.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    # stats is one row: the join is a projection
    idf = seen.join(F.broadcast(stats)).select("term", "avgdl", F.log(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    norm = config.k1 * (1 - config.b + config.b * F.col("dl") / F.greatest("avgdl", F.lit(1e-9)))
    part = F.col("idf") * F.col("tf") * (config.k1 + 1) / (F.col("tf") + norm)
    return asked.join(posted, "term").join(idf, "term").groupBy("qid", "unit_ord", "unit_id", "doc_id").agg(F.sum(part).alias("score"))


def _grams(text: Column, config: TfIdf, lemma) -> Column:
    """Terms of a text under the analyzer, with repeats."""
    if config.analyzer == "char_wb":
        return F.flatten(F.transform(char_words(text), lambda w: char_grams(w, *config.ngram_range)))
    low, high = config.ngram_range
    tokens = lexical_tokens(text, config.rules, lemma)
    if (low, high) == (1, 1):
        return tokens
    runs = lambda t: F.flatten(
        F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>")))
    )
    return F.element_at(F.transform(F.array(tokens), runs), 1)


def term_counts(rows: DataFrame, key: str, text: str, config: TfIdf, lemma=None) -> DataFrame:
    """key, term, tf.  Character n-grams are made once for each different word of a row, and weighted by its count."""
    if config.analyzer == "word":
        each = rows.select(key, F.explode(_grams(F.col(text), config, lemma)).alias("term"))
        return each.groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    words = rows.select(key, F.explode(char_words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    each = words.select(key, "n", F.explode(char_grams(F.col("word"), *config.ngram_range)).alias("term"))
    return each.groupBy(key, "term").agg(F.sum("n").cast("double").alias("tf"))


def tfidf_weights(units: DataFrame, config: TfIdf = TfIdf(), lemma=None) -> tuple[DataFrame, DataFrame]:
    """(unit_ord, term, w) with unit length, and (term, idf) of the vocabulary: idf = ln((1 + N) / (1 + df)) + 1."""
    counts = term_counts(units, "unit_ord", "text", config, lemma)
    n = units.agg(F.count(F.lit(1)).cast("double").alias("n_units"))
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")).join(F.broadcast(n))
    least = F.lit(float(config.min_df)) if isinstance(config.min_df, int) else F.lit(config.min_df) * F.col("n_units")
    most = F.lit(float(config.max_df)) if isinstance(config.max_df, int) else F.lit(config.max_df) * F.col("n_units")
    idf = seen.where(F.col("df").between(least, most)).select("term", (F.log((1 + F.col("n_units")) / (1 + F.col("df"))) + 1).alias("idf"))
    return _unit_length(counts.join(idf, "term").select("unit_ord", "term", (F.col("tf") * F.col("idf")).alias("w")), "unit_ord"), idf


def _unit_length(weights: DataFrame, key: str) -> DataFrame:
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, key).select(key, "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def tfidf(units: DataFrame, queries: DataFrame, config: TfIdf = TfIdf(), lemma=None, k: int | None = None) -> DataFrame:
    """Hits of the cosine of TF-IDF vectors; query terms outside the vocabulary have no weight."""
    require_columns(units, "unit_ord", "unit_id", "doc_id", "text")
    found = None if _repeated(units) else _tfidf_blocks(units, queries, config, lemma, k)
    return _kept(_tfidf_joined(units, queries, config, lemma) if found is None else found, k)


def _tfidf_joined(units: DataFrame, queries: DataFrame, config: TfIdf, lemma) -> DataFrame:
    weights, idf = tfidf_weights(units, config, lemma)
    asked = term_counts(queries, "qid", "question", config, lemma).join(idf, "term").select("qid", "term", (F.col("tf") * F.col("idf")).alias("w"))
    asked = _unit_length(asked, "qid").withColumnRenamed("w", "qw")
    scores = asked.join(weights, "term").groupBy("qid", "unit_ord").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    return scores.join(units.select("unit_ord", "unit_id", "doc_id").distinct(), "unit_ord").select("qid", "unit_ord", "unit_id", "doc_id", "score")


def _items(text: Column, config: TfIdf, lemma) -> Column:
    """What _Counter reads."""
    if config.analyzer == "char_wb":
        return F.lower(F.coalesce(text, F.lit("")))
    return blocks.source(text, config.rules, lemma) if config.ngram_range == (1, 1) else _grams(text, config, lemma)


class _Counter:
    """Counts of the terms of slices in a task; terms have numbers of the task's own."""

    def __init__(self, config: TfIdf, lemma=None):
        self.chars, self.range = config.analyzer == "char_wb", config.ngram_range
        terms, r = blocks.Terms(config.rules), config.rules
        # single tokens of plain rules are looked up once each, in numbers that leave out what rules drop
        self.kept = terms.kept if not self.chars and self.range == (1, 1) and blocks.is_plain(r, lemma) and not r.add_bigrams else None
        self.of = str.split if self.chars else terms.raw if self.kept else terms.of
        self.clear()

    def clear(self) -> None:
        self.numbers = blocks.Numbers(self.kept)
        self.grams = blocks.Grams(*self.range, self.numbers)

    def counts(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and count of the terms of each text."""
        lists = [self.of(x) for x in texts]
        row, ids, times = self.grams.counted(lists) if self.chars else (*blocks.counted(lists, self.numbers), None)
        return blocks.summed(row, ids, times, len(self.numbers.names))


def _document_frequencies(rows: DataFrame, config: TfIdf, lemma=None) -> DataFrame:
    """hash, df of all terms of rows(of); tasks add up their own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, df = _Counter(config, lemma), np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            names = counter.numbers.names
            for i in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(blocks.hashes(names[i : i + 10_000])), pa.array(df[i : i + 10_000], pa.int64())], names=["hash", "df"])

        for batch in batches:
            for part in blocks.slices(batch, blocks.BYTES // 2):
                _, ids, _ = counter.counts(blocks.strings(part.column("of")))
                df = np.concatenate([df, np.zeros(len(counter.numbers.names) - len(df), np.int64)])
                df += np.bincount(ids, minlength=len(df))
                if len(counter.numbers) > blocks.REMEMBERED:
                    yield from told()
                    counter.clear()
                    df = np.zeros(0, np.int64)
        yield from told()

    return rows.mapInArrow(run, "hash long, df long").groupBy("hash").agg(F.sum("df").alias("df"))


def _tfidf_blocks(units: DataFrame, queries: DataFrame, config: TfIdf, lemma, k: int | None) -> DataFrame | None:
    """TF-IDF in Arrow batches; None where there are too many queries or terms.

    Units are read twice: for document frequencies, and for norms and scores.  A term that only one unit has needs no
    entry: its idf is that of df 1.  The others are known to tasks by 64 bits of hash, two sorted arrays of numbers.
    """
    asked = queries.select("qid", _items(F.col("question"), config, lemma).alias("of")).limit(MAX_QUERIES + 1).collect()
    if len(asked) > MAX_QUERIES:
        return None
    counter, of_query = _Counter(config, lemma), {}
    for r in asked:
        _, ids, counts = counter.counts([r["of"]])
        mine = of_query.setdefault(r["qid"], {})
        for i, c in zip(ids.tolist(), counts.tolist(), strict=True):
            mine[i] = mine.get(i, 0.0) + c
    spark = units.sparkSession
    n = units.count()
    least, most = (float(x) if isinstance(x, int) else x * n for x in (config.min_df, config.max_df))
    of_df = lambda df: np.where((df >= least) & (df <= most), np.log((1 + n) / (1 + df)) + 1, 0.0)
    rows = units.select("unit_ord", "unit_id", "doc_id", _items(F.col("text"), config, lemma).alias("of"))
    wanted = blocks.hashes(counter.numbers.names)
    sought = spark.createDataFrame([(h,) for h in wanted.tolist()], "hash long").distinct().withColumn("asked", F.lit(True))
    seen = _document_frequencies(rows.select("of"), config, lemma).join(F.broadcast(sought), "hash", "left").where("df > 1 or asked")
    seen = table(seen.select("hash", F.col("df").cast("int").alias("df")), "df")
    if seen.count() > MAX_TERMS:
        return None
    told = seen.toArrow().combine_chunks()
    known, dfs = told.column("hash").to_numpy(), told.column("df").to_numpy()
    by = np.argsort(known)
    known, dfs = known[by], dfs[by]

    def df_of(names: list[str], missing: int) -> np.ndarray:
        at, wanted = np.searchsorted(known, h := blocks.hashes(names)), np.full(len(names), missing, np.int64)
        there = np.append(known, 0)[at] == h
        there &= at < len(known)
        wanted[there] = dfs[at[there]]
        return wanted

    found = df_of(counter.numbers.names, 0)
    idf = np.where(found > 0, of_df(np.maximum(found, 1)), 0.0)
    # query terms by number; those that no unit has, or that min_df or max_df leave out, have no weight
    column = {counter.numbers.names[i]: j for j, i in enumerate(np.flatnonzero(idf > 0).tolist())}
    qids = [q for q, mine in of_query.items() if any(idf[i] > 0 for i in mine)]
    has = np.zeros((len(qids), len(column)))
    for i, q in enumerate(qids):
        for t, c in of_query[q].items():
            if idf[t] > 0:
                has[i, column[counter.numbers.names[t]]] = c * idf[t]
    has /= np.sqrt((has * has).sum(axis=1, keepdims=True))

    def start():
        counter = _Counter(config, lemma)
        own: list[np.ndarray] = [np.zeros(0), np.zeros(0, np.int64)]

        def score(part: pa.RecordBatch) -> np.ndarray:
            if len(counter.numbers) > blocks.REMEMBERED:
                counter.clear()
                own[:] = [np.zeros(0), np.zeros(0, np.int64)]
            row, ids, counts = counter.counts(blocks.strings(part.column("of")))
            new = counter.numbers.names[len(own[0]) :]
            own[0] = np.concatenate([own[0], of_df(df_of(new, 1))])
            own[1] = np.concatenate([own[1], np.fromiter((column.get(t, -1) for t in new), np.int64, len(new))])
            weights = counts * own[0][ids]
            norm = np.sqrt(np.bincount(row, weights=weights * weights, minlength=part.num_rows))
            to = own[1][ids]
            used, at = np.unique(to[to >= 0], return_inverse=True)
            mine = np.zeros((len(used), part.num_rows))
            mine[at, row[to >= 0]] = weights[to >= 0]
            dots = has[:, used] @ mine / np.where(norm == 0, 1.0, norm)
            return np.where(dots > 0, dots, -np.inf)

        return score

    return blocks.searched(rows, qids, start, k)


def gram_counts(rows: DataFrame, key: str, text: str, config: TfIdf) -> DataFrame:
    """key, n and n_distinct: character n-grams of each row's text, all and different ones; rows without any are left out."""
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        counts = term_counts(rows, key, text, config)
        return counts.groupBy(key).agg(F.sum("tf").cast("long").alias("n"), F.count(F.lit(1)).alias("n_distinct"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(config)
        for batch in batches:
            for part in blocks.slices(batch, blocks.BYTES // 2):
                if len(counter.numbers) > blocks.REMEMBERED:
                    counter.clear()
                row, _, counts = counter.counts(blocks.strings(part.column("of")))
                n = np.bincount(row, weights=counts, minlength=part.num_rows).astype(np.int64)
                told = [part.column(key), pa.array(n), pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(told, names=[key, "n", "n_distinct"]).filter(pa.array(n > 0))

    return rows.select(key, _items(F.col(text), config, None).alias("of")).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n long, n_distinct long")


# --- vectors -------------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), 1)


def dense(units: DataFrame, queries: DataFrame, normalize: bool = True, block: int = 4096, k: int | None = None) -> DataFrame:
    """Hits of the exact dot product of units.vector and queries.vector.

    Every query meets every unit: that is the search.  The queries are the small side and come in blocks of at most block
    rows; units are read in place, never shuffled, and with k, few tasks for each block each keep k hits a query.
    """
    require_columns(units, "unit_ord", "unit_id", "doc_id", "vector")
    if k is None or not _same_size(units, queries):
        return _kept(_dense_joined(units, queries, normalize, block), k)
    return _kept(_dense_blocks(units, queries, normalize, block, k), k)


def _same_size(units: DataFrame, queries: DataFrame) -> bool:
    """Whether all vectors are numbers of one length."""
    odd = F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    both = units.select("vector").unionByName(queries.select("vector"))
    low, high, strange = both.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.bool_or(odd)).first()
    return low == high and bool(low and low > 0) and not strange


def _dense_blocks(units: DataFrame, queries: DataFrame, normalize: bool, block: int, k: int, shares: tuple[float, float] | None = None) -> DataFrame:
    """shares: weights of the dot product and of the dot product of the maps in the column weights (hybrid)."""
    columns = ["vector"] if shares is None else ["vector", "weights"]
    asked = queries.select("qid", *columns).toArrow().combine_chunks()
    rows = units.select("unit_ord", "unit_id", "doc_id", *columns)
    n = max(1, -(-asked.num_rows // block))
    # tasks for all cores, but no more: each gives k rows a query
    rows = rows.coalesce(max(1, -(-units.sparkSession.sparkContext.defaultParallelism // n)))
    parts = [asked.slice(i * block, block) for i in range(n)]
    made = [blocks.searched(rows, p.column("qid").to_pylist(), _dense_scores(p, normalize, shares), k) for p in parts]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _matrix(vectors: pa.Array, normalize: bool) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    m = np.asarray(vectors.flatten()).astype(np.float64).reshape(len(vectors), -1)
    if not normalize:
        return m
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _dense_scores(asked: pa.Table, normalize: bool, shares: tuple[float, float] | None):
    n = asked.num_rows
    wanted = _matrix(asked.column("vector"), normalize) if n else np.zeros((0, 1))
    tokens: dict = {}
    maps = [] if shares is None else [(i, t, w) for i, m in enumerate(asked.column("weights").to_pylist()) for t, w in m or ()]
    lexical = np.zeros((len({t for _, t, _ in maps}), n))
    for i, t, w in maps:
        lexical[tokens.setdefault(t, len(tokens)), i] = w

    def start():
        def score(part: pa.RecordBatch) -> np.ndarray:
            dots = wanted @ _matrix(part.column("vector"), normalize).T if n else np.zeros((0, part.num_rows))
            if shares is None:
                return dots
            have = np.zeros((len(lexical), part.num_rows))
            for j, m in enumerate(part.column("weights").to_pylist()):
                for t, w in m or ():
                    if t in tokens:
                        have[tokens[t], j] = w
            return shares[0] * dots + shares[1] * (lexical.T @ have)

        return score

    return start


def _dense_joined(units: DataFrame, queries: DataFrame, normalize: bool, block: int) -> DataFrame:
    v = (lambda c: l2_normalized(F.col(c))) if normalize else (lambda c: F.transform(c, lambda x: x.cast("double")))
    rows = units.select("unit_ord", "unit_id", "doc_id", v("vector").alias("v"))
    asked = queries.select("qid", v("vector").alias("qv"))
    n = asked.count()
    score = lambda part: rows.join(F.broadcast(part)).select("qid", "unit_ord", "unit_id", "doc_id", dot(F.col("v"), F.col("qv")).alias("score"))
    if n <= block:
        return score(asked)
    parts = -(-n // block) * 2
    named = asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    out = score(named.where("part = 0").drop("part"))
    for i in range(1, parts):
        out = out.unionByName(score(named.where(F.col("part") == i).drop("part")))
    return out


def lexical_weights(units: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of the dot product of token weights, maps in the column weights; tokens that no unit has drop out."""
    have = units.select("unit_ord", "unit_id", "doc_id", F.explode("weights").alias("token", "w"))
    asked = queries.select("qid", F.explode("weights").alias("token", "qw"))
    return asked.join(have, "token").groupBy("qid", "unit_ord", "unit_id", "doc_id").agg(F.sum(F.col("w").cast("double") * F.col("qw").cast("double")).alias("score"))


def hybrid_search(units: DataFrame, queries: DataFrame, dense_weight: float = 0.7, lexical_weight: float = 0.3, k: int | None = None, block: int = 4096) -> DataFrame:
    """Hits of the weighted sum of dense and lexical scores; vectors and token weights of a unit meet a query at once."""
    few = k is not None and queries.select(F.explode(F.map_keys("weights")).alias("t")).distinct().limit(MAX_VOCABULARY + 1).count() <= MAX_VOCABULARY
    unit_weights = units.select(F.bool_or(F.exists(F.map_values("weights"), lambda x: x.isNull()))).first()[0] or queries.select(F.bool_or(F.exists(F.map_values("weights"), lambda x: x.isNull()))).first()[0]
    if few and not unit_weights and _same_size(units, queries) and not _repeated(units) and not _repeated(queries.select(F.col("qid").alias("unit_ord"))):
        return _kept(_dense_blocks(units, queries, True, block, k, (dense_weight, lexical_weight)), k)
    return _kept(hybrid(dense(units, queries), lexical_weights(units, queries), dense_weight, lexical_weight), k)


def hybrid(dense_hits: DataFrame, lexical_hits: DataFrame, dense_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """Weighted sum of both scores; a unit without a lexical score has 0 there."""
    keys = ["qid", "unit_ord"]
    right = lexical_hits.select(*keys, F.col("score").alias("lexical"))
    return dense_hits.join(right, keys, "left").select("qid", "unit_ord", "unit_id", "doc_id", (dense_weight * F.col("score") + lexical_weight * F.coalesce("lexical", F.lit(0.0))).alias("score"))
