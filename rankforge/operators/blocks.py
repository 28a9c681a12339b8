"""Search in Arrow batches: some units meet all queries in one product of matrices, and a task keeps each query's best k.

Scores of units against queries are never rows, so what is shuffled is k rows for each query and task.  Terms of plain
rules are cut here as well, by the same rules as in functions/text.py; the others come as arrays from the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOISE_WORDS, SHORT_CODES, STOP_WORDS, TOKEN, TokenRules, lexical_tokens

HITS = "qid string, unit_ord long, unit_id string, doc_id string, score double"
#: Text that is worked on at once, units that are, and numbers in one matrix.
BYTES, ROWS, CELLS = 1 << 19, 256, 1 << 21
#: Different words that a task remembers before it starts anew.
REMEMBERED = 500_000
_STOPS, _NOISE, _CODES, _DIGITS = map(frozenset, (STOP_WORDS, NOISE_WORDS, SHORT_CODES, "0123456789"))
_LEAST = np.iinfo(np.int64).min


# --- terms ---------------------------------------------------------------------------------------------------------------


def is_plain(rules: TokenRules, lemma=None) -> bool:
    return not rules.preserve_legal_refs and not (rules.lemmatize and lemma is not None)


def source(text: Column, rules: TokenRules, lemma=None) -> Column:
    """What terms() reads: the text in lower case, or its terms where the rules need the plan's functions."""
    return F.lower(F.coalesce(text, F.lit(""))) if is_plain(rules, lemma) else lexical_tokens(text, rules, lemma)


def strings(column: pa.Array) -> list[str]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [x if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _plain(t: str) -> bool:
    """Whether a token can be part of a bigram."""
    return t not in _STOPS and t not in _NOISE and _DIGITS.isdisjoint(t)


class Terms:
    """Terms of a batch column made by source(), one list for each row."""

    def __init__(self, rules: TokenRules):
        self.find = re.compile(TOKEN).findall
        self.rules, self.known, self.plain = rules, {}, {}

    def kept(self, t: str) -> bool:
        r = self.rules
        if 1 < r.min_len > len(t) and t not in _CODES and _DIGITS.isdisjoint(t):
            return False
        return not (r.stop_words and t in _STOPS) and not (r.legal_stop_words and t in _NOISE)

    def raw(self, value: str) -> list[str]:
        """Tokens before rules choose among them."""
        return self.find(value.replace("ё", "е"))

    def of(self, value) -> list[str]:
        if not isinstance(value, str):
            return value or []
        if len(self.known) > REMEMBERED:
            self.known, self.plain = {}, {}
        tokens = self.raw(value)
        for t in set(tokens).difference(self.known):
            self.known[t] = self.kept(t)
            self.plain[t] = _plain(t)
        known = self.known
        out = [t for t in tokens if known[t]]
        if self.rules.add_bigrams:
            plain = self.plain
            out += [f"{a}__{b}" for a, b in zip(out, out[1:], strict=False) if plain[a] and plain[b]]
        return out


class Numbers(dict):
    """Numbers of strings in the order in which they come, -1 for those not kept; names has the strings kept."""

    def __init__(self, kept: Callable[[str], bool] | None = None):
        self.names: list[str] = []
        self.kept = kept

    def __missing__(self, x):
        if self.kept and not self.kept(x):
            self[x] = -1
            return -1
        n = self[x] = len(self.names)
        self.names.append(x)
        return n


def hashes(names: list[str]) -> np.ndarray:
    """64 bits for each string, the same in every process."""
    return np.frombuffer(b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in names), "<i8") if names else np.zeros(0, np.int64)


class Codes(dict):
    """Code of a token under plain rules: -1 if they drop it, else twice its number among the parts of the asked terms (0: in
    none of them), plus 1 if it can be part of a bigram."""

    def __init__(self, rules: TokenRules, vocabulary: list[str]):
        terms = Terms(rules)
        self.find, self.kept, self.bigrams = terms.raw, terms.kept, rules.add_bigrams
        split = [t.split("__") for t in vocabulary]
        self.parts: dict[str, int] = {}
        for t in chain.from_iterable(split):
            self.parts.setdefault(t, len(self.parts) + 1)
        self.size = len(self.parts) + 1
        self.single = np.full(self.size, -1, np.int64)
        pairs = {}
        for i, ts in enumerate(split):
            if len(ts) == 1:
                self.single[self.parts[ts[0]]] = i
            else:
                pairs[self.parts[ts[0]] * self.size + self.parts[ts[1]]] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.of_pair = np.array([pairs[x] for x in sorted(pairs)], np.int64)

    def __missing__(self, t: str) -> int:
        code = -1
        if self.kept(t):
            code = 2 * self.parts.get(t, 0) + _plain(t)
        self[t] = code
        return code

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the kept tokens of all texts in a row, and where each text begins among them, with the end."""
        if len(self) > REMEMBERED:
            self.clear()
        lists = [self.find(x) for x in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(codes >= 0)])
        return codes[codes >= 0], upto[np.concatenate([[0], np.cumsum(sizes)])]

    def counts(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of units, spans of the codes which may overlap: their numbers of terms, and unit and number of each asked term in
        them, with repeats."""
        part = codes >> 1
        known = np.flatnonzero(self.single[part] >= 0)
        n, unit, ids = end - first, *_within(known, self.single[part[known]], first, end)
        if not self.bigrams:
            return n, unit, ids
        # a pair stands where its left token does
        last = np.maximum(end - 1, first)
        plain = np.flatnonzero(codes[:-1] & codes[1:] & 1)
        n = n + np.searchsorted(plain, last) - np.searchsorted(plain, first)
        key = part[plain] * self.size + part[plain + 1]
        at = np.searchsorted(self.pairs, key)
        there = np.append(self.pairs, -1)[at] == key
        more_unit, more_ids = _within(plain[there], self.of_pair[at[there]], first, last)
        return n, np.concatenate([unit, more_unit]), np.concatenate([ids, more_ids])


def _within(places: np.ndarray, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Span and value for each of some ordered places in each span."""
    low = np.searchsorted(places, first)
    n = np.searchsorted(places, end) - low
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(first)), n), values[np.repeat(low, n) + inner]


def char_grams(word: str, low: int, high: int) -> list[str]:
    """As in functions/text.py."""
    w = f" {word} "
    return [w[i : i + n] for n in range(low, min(high, max(low, len(w))) + 1) for i in range(max(len(w) - n + 1, 1))]


class Grams:
    """Numbers of the character n-grams of words, made once for each different word."""

    def __init__(self, low: int, high: int, numbers: Numbers):
        self.low, self.high, self.numbers, self.words = low, high, numbers, {}

    def of(self, word: str) -> np.ndarray:
        if word not in self.words:
            self.words[word] = np.array([self.numbers[g] for g in char_grams(word, self.low, self.high)], np.int64)
        return self.words[word]

    def counted(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and count of the n-grams of some lists of words; a row may have an n-gram more than once."""
        words = Numbers()
        row, word = counted(lists, words)
        if not len(words):
            return row, word, np.zeros(0)
        pair, times = np.unique(row * len(words) + word, return_counts=True)
        row, word = np.divmod(pair, len(words))
        grams = [self.of(w) for w in words.names]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        first = np.concatenate([[0], np.cumsum(sizes)])
        n = sizes[word]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(row, n), np.concatenate(grams)[np.repeat(first[word], n) + inner], np.repeat(times, n).astype(np.float64)


def summed(row: np.ndarray, ids: np.ndarray, times: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number below size, and count of what occurs, each pair of row and number once."""
    if times is None:
        pair, n = np.unique(row * size + ids, return_counts=True)
    else:
        pair, at = np.unique(row * size + ids, return_inverse=True)
        n = np.bincount(at, weights=times, minlength=len(pair))
    row, ids = np.divmod(pair, max(size, 1))
    return row, ids, n.astype(np.float64)


def slices(batch: pa.RecordBatch, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about limit bytes and at most ROWS rows; a longer row comes alone."""
    at, step = 0, ROWS
    while at < batch.num_rows:
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > limit:
            step = max(1, part.num_rows // 2)
            continue
        yield part
        at, step = at + part.num_rows, min(ROWS, 2 * step)


def counted(lists: list[list[str]], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each string of some lists that is kept."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(lists)), sizes)
    return (row[ids >= 0], ids[ids >= 0]) if numbers.kept else (row, ids)


# --- the best of each query ----------------------------------------------------------------------------------------------


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole billionths, as rankings compare them; where both neighbours are close, decimal digits decide."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float((Decimal(repr(float(x[i]))) * 1_000_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Best:
    """The best k units of each query by rounded score, then unit_ord; all hits, batch by batch, where k is None."""

    def __init__(self, qids: list, k: int | None):
        self.qids, self.k = np.array(qids, object), k
        self.least = np.full(len(qids), -np.inf)
        self.parts: list[tuple] = []
        self.pending = 0

    def add(self, batch: pa.RecordBatch, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        """scores: one row for each query, minus infinity where a unit is no hit."""
        n, k = batch.num_rows, self.k
        at = scores >= self.least[:, None] if k else scores > -np.inf
        at &= scores > -np.inf
        if k and n > 2 * k and at.sum() > 2 * k * len(self.qids):
            at &= scores >= np.partition(scores, n - k, axis=1)[:, n - k, None] - 2e-9
        q, row = np.nonzero(at)
        if not len(q):
            return
        score = scores[q, row]
        order = batch.column("unit_ord")
        null = np.asarray(order.is_null())
        ords = np.where(null, _LEAST, order.fill_null(0).to_numpy(zero_copy_only=False))
        ids, docs = np.array(strings(batch.column("unit_id")), object), np.array(strings(batch.column("doc_id")), object)
        part = (q, ords[row], score, null[row], ids[row], docs[row])
        if not k:
            yield self.rows(part)
            return
        self.parts.append(part)
        self.pending += len(q)
        if self.pending > max(CELLS // 4, 2 * k * len(self.qids)):
            self.prune()

    def prune(self) -> None:
        q, ords, score, null, ids, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        key = rounded(score)
        by = np.lexsort((ords, -key, q))
        sorted_q = q[by]
        first = np.searchsorted(sorted_q, np.arange(len(self.qids)))
        place = np.arange(len(by)) - first[sorted_q]
        by = by[place < self.k]
        full = np.flatnonzero(place == self.k - 1)
        # a billionth less, so that nothing is lost that rounds to the same
        self.least[sorted_q[full]] = (key[np.lexsort((ords, -key, q))[full]] - 1) * 1e-9
        self.parts = [(q[by], ords[by], score[by], null[by], ids[by], docs[by])]
        self.pending = len(by)

    def rows(self, part: tuple) -> pa.RecordBatch:
        q, ords, score, null, ids, docs = part
        columns = [pa.array(self.qids[q], pa.string()), pa.array(ords, pa.int64(), mask=null), pa.array(ids, pa.string()), pa.array(docs, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["qid", "unit_ord", "unit_id", "doc_id", "score"])

    def all(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.prune()
            whole = self.rows(self.parts[0])
            for i in range(0, whole.num_rows, 10_000):
                yield whole.slice(i, 10_000)


def searched(rows: DataFrame, qids: list, start: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], k: int | None) -> DataFrame:
    """Hits of rows(unit_ord, unit_id, doc_id, ...).  start() makes a task's function from a slice to its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, score = Best(qids, k), start()
        for batch in batches:
            for part in slices(batch):
                yield from best.add(part, score(part))
        yield from best.all()

    return rows.mapInArrow(run, HITS)
