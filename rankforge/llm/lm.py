"""Scoring with a small causal self-attention model, trained in numpy on subword ids.

Subword ids come from a public tokenizer (a parameter), word by word, each different word of a chunk once.  Texts are
tokenized once, into a table of ids.  Ids are put in BUCKETS buckets, the frequent ones each in its own, and these in CLASSES
classes of about equal sums of roots of mass.  The model is masked self-attention over a window of WINDOW ids and a hidden
layer; its output is a softmax over all ids, factored as a tree:

    P(class | window) * P(bucket | class, window) * P(id | bucket, window)

which sums to one.  At each of the three levels the hidden layer meets a vector for each class, bucket and id; the bias is
the smoothed log count, over all training documents, of the class and the bucket after the bucket before and of the id in
its bucket.  An id that shares its bucket has an input vector of its own beside the bucket's.

Training sees every id of all training documents once.  Documents are dealt by a hash of theirs to groups of about
GROUP_IDS ids, in an order by that hash, so the groups depend on the rows alone and not on how they are partitioned; every
group runs Adam over its windows from the same weights, and the mean of all groups' weights is the model.

Scoring moves a window over each document's ids, STRIDE at a time: every id is scored once, with at least
WINDOW - STRIDE ids before it unless the document begins there, in batches of windows with masked attention.

The unigram score beside it needs each word's count.  Words that make up a millionth of all tokens or more, a million at
most, are broadcast; all rarer ones are counted and joined by hash, in SLICES ranges of hashes, as flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARRAY_PARTS, Words, array_parts, chunks, ints, longs, mixed, summed_array, written

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
WINDOW, STRIDE = 16, 12
WIDTH, HIDDEN, CLASSES, BUCKETS = 8, 16, 32, 2048
GROUP_IDS = 5_000_000
SMOOTHING = 2.0
RATE = 4e-3
FREQUENT = 1e-6
SLICES = 1024
_BATCH = 512
_POOL, _ROWS = 4 * _BATCH, 1024
_TEXT_BYTES = 4 << 20
_HELD = 1 << 20
_FLAT = 1 << 18


class Pieces:
    """Subword ids of words; remembers words, beyond a number of them those of late."""

    def __init__(self, model: bytes, remembered: int = 800_000):
        import sentencepiece

        self.model, self.remembered = sentencepiece.SentencePieceProcessor(model_proto=model), remembered
        self.size = self.model.get_piece_size()
        # in the order of their hashes; their ids are in flat; the call that last had the word
        self.key, self.start, self.count, self.call = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.n_flat, self.calls = np.zeros(1 << 12, np.int32), 0, 0

    def starts(self) -> np.ndarray:
        """Which ids begin a word; the end of a text does."""
        return np.array([self.model.id_to_piece(i).startswith("\u2581") for i in range(self.size)] + [True])

    def _forget(self) -> None:
        """All words but the half that is of late."""
        kept = np.sort(np.argpartition(-self.call, self.remembered // 2)[: self.remembered // 2])
        n = self.count[kept]
        end = np.cumsum(n)
        self.flat = self.flat[np.repeat(self.start[kept] - (end - n), n) + np.arange(int(n.sum()))]
        self.key, self.start, self.count, self.call, self.n_flat = self.key[kept], (end - n).astype(np.int32), n, self.call[kept], len(self.flat)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the different words in w, by their hashes: hash, number of each word of w among them, count, and start and
        length of their ids in self.flat."""
        met = pa.array(w.hash).dictionary_encode()
        h, which = ints(met.dictionary), ints(met.indices)
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h, which = h[order], rank[which]
        count, first = np.bincount(which, minlength=len(h)), np.empty(len(h), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        if len(self.key) > self.remembered:
            self._forget()
        at = np.searchsorted(self.key, h)
        new = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] != h) if len(self.key) else np.arange(len(h))
        if len(new):
            raw = w.data.tobytes()
            sizes, ids = self._encoded([raw[x:y] for x, y in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            n = self.n_flat + len(ids)
            if n > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.n_flat], np.zeros(max(n - self.n_flat, self.n_flat // 2), np.int32)])
            self.flat[self.n_flat : n] = ids
            # a place for each new word among the others
            place = at[new] + np.arange(len(new))
            old = np.ones(len(self.key) + len(new), bool)
            old[place] = False
            for name, x in (("key", h[new]), ("start", self.n_flat + np.cumsum(sizes) - sizes), ("count", sizes), ("call", 0)):
                before = getattr(self, name)
                after = np.empty(len(old), before.dtype)
                after[old], after[place] = before, x
                setattr(self, name, after)
            self.n_flat = n
            added = np.zeros(len(h), np.int64)
            added[new] = 1
            at += np.cumsum(added) - added
        self.calls += 1
        self.call[at] = self.calls
        return h, which, count, self.start[at], self.count[at]

    def sequence(self, w: Words, which: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end (id self.size) after each, and where each text's ids begin and the last ends."""
        n, s = count[which], start[which]
        end = np.cumsum(n, dtype=np.int64)
        ids = self.flat[np.repeat(s - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]
        upto = np.concatenate([[0], end])[w.first]
        bounds = upto + np.arange(w.n + 1)
        out = np.full(len(ids) + w.n, self.size, np.int32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = ids
        return out, bounds


_pieces: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """One for all tasks of a worker process, so that words are not looked up anew in each."""
    if model not in _pieces:
        _pieces.clear()
        _pieces[model] = Pieces(model)
    return _pieces[model]


# --- the model ---------------------------------------------------------------------------------------------------------


class Vocabulary:
    """From counts of ids: each id's bucket and log share of it, and each bucket's class.

    starts: which ids begin a word; buckets are put in classes in the order of whether their ids do, then of their counts,
    and numbered in that order: class c has the buckets first[c]:first[c + 1].  Of buckets for several ids, member_share has
    the ids' log shares, a row for each; row and slot are a bucket's and an id's place there, or -1.
    """

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        n = len(counts)
        mass = counts + 0.5
        rank = np.empty(n, np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(n)
        half = BUCKETS // 2
        self.bucket = np.empty(n + 1, np.int64)
        self.bucket[:n] = np.where(rank < half - 1, rank, half + rank % half)
        self.bucket[n] = half - 1  # what stands before a text's first id; no id is in it
        total = np.bincount(self.bucket[:n], mass, minlength=BUCKETS)
        self.log_share = np.log(mass / total[self.bucket[:n]])
        begins = np.bincount(self.bucket[:n], mass * starts, minlength=BUCKETS) > total / 2
        order = np.lexsort((-total, begins))
        self.mass = total[order]
        # for equal shares of roots the sum of mass times buckets in its class, the work, is least
        root = np.sqrt(self.mass)
        upto = np.cumsum(root)
        self.of_class = np.minimum((upto - root / 2) / upto[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        self.first = np.searchsorted(self.of_class, np.arange(CLASSES + 1))
        number = np.empty(BUCKETS, np.int64)
        number[order] = np.arange(BUCKETS)
        self.bucket = number[self.bucket]
        rare = np.flatnonzero(rank >= half - 1)
        self.slot = np.full(n + 1, -1)
        self.slot[rare] = (rank[rare] - (half - 1)) // half
        self.row = np.full(BUCKETS, -1)
        self.row[number[half:]] = np.arange(half)
        self.member_share = np.full((half, self.slot.max() + 1), -np.inf, np.float32)
        self.member_share[rank[rare] % half, self.slot[rare]] = self.log_share[rare]

    def learn(self, pairs: np.ndarray) -> None:
        """From the counts (BUCKETS, BUCKETS) of pairs of neighbours: log_bucket, of a bucket in its class after another,
        and log_class, of a class after a bucket."""
        share = self.mass / self.mass.sum()
        of_class = np.bincount(self.of_class, share, minlength=CLASSES)
        inside = np.where(share > 0, share / np.maximum(of_class[self.of_class], 1e-300), 0)
        after = np.zeros((BUCKETS, CLASSES))
        for c in range(CLASSES):
            after[:, c] = pairs[:, self.of_class == c].sum(axis=1)
        with np.errstate(divide="ignore"):
            self.log_bucket = np.log((pairs + SMOOTHING * inside) / (after[:, self.of_class] + SMOOTHING)).astype(np.float32)
            # a class without mass keeps a share that no sum can see
            self.log_class = np.log(np.maximum((after + SMOOTHING * of_class) / (after.sum(axis=1, keepdims=True) + SMOOTHING), 1e-12)).astype(np.float32)
        self.blocks = None

    def block(self, c: int) -> np.ndarray:
        """The columns of log_bucket of a class's buckets, in a row of memory; not sent to workers."""
        if self.blocks is None:
            self.blocks = [np.ascontiguousarray(self.log_bucket[:, a:b]) for a, b in zip(self.first, self.first[1:], strict=False)]
        return self.blocks[c]


_SHAPES = {
    "e": (BUCKETS, WIDTH), "p": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLASSES), "b2": (CLASSES,),
}
_BEFORE = np.tri(WINDOW, dtype=np.float32)
_ONES = np.ones(max(BUCKETS, WINDOW), np.float32)
_SCALE = np.float32(WIDTH**-0.5)
_RAMP = np.arange(_ROWS)


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in _SHAPES]).astype(np.float32)


N_PARAMETERS = sum(int(np.prod(s)) for s in _SHAPES.values())
_LEAVES = ("bucket", "id", "own")


def whole(flat: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """All weights, those of single buckets and ids behind the others; a shorter array has these untrained."""
    out, at = leaves(vocabulary), N_PARAMETERS
    for name in _LEAVES if len(flat) > at else ():
        size = out[name].size
        out[name] = flat[at : at + size].reshape(out[name].shape).astype(np.float32)
        at += size
    return unpacked(flat) | out


def flattened(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([packed(p), *(p[name].ravel() for name in _LEAVES)])


def initial(seed: int = 7) -> np.ndarray:
    random = np.random.default_rng(seed)
    p = {name: random.normal(0, 0.3 if name == "e" else 0.1 if name == "p" else shape[0] ** -0.5, shape) if len(shape) > 1 else np.zeros(shape) for name, shape in _SHAPES.items()}
    p["w2"] = 0.1 * p["w2"]
    return packed(p)


def leaves(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights of single buckets and ids, before training: output vectors of both and input vectors of ids."""
    shapes = {"bucket": (BUCKETS, HIDDEN), "id": (*vocabulary.member_share.shape, HIDDEN), "own": (len(vocabulary.log_share), WIDTH)}
    return {name: np.zeros(shape, np.float32) for name, shape in shapes.items()}


def _longest(x: np.ndarray) -> float:
    return float((np.square(x) @ np.ones(x.shape[1], x.dtype)).max(initial=0)) ** 0.5


def _softmax(s: np.ndarray, t: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not small:
        s -= s.max(axis=1, keepdims=True)
    at = _RAMP[: len(s)] * s.shape[1] if len(s) <= _ROWS else np.arange(0, s.size, s.shape[1])
    at += t
    mine = s.reshape(-1)[at]
    np.exp(s, out=s)
    return s, at, mine, s @ _ONES[: s.shape[1]]


def by_class(of_class: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The order of places by class, then by the bucket before, so that rows of biases are read in their order."""
    key = of_class * BUCKETS + before
    return np.argsort(key.astype(np.uint16) if CLASSES * BUCKETS <= 1 << 16 else key, kind="stable")


def _runs(first: list[int], cut: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Classes of several buckets as (class, first place, end), neighbours together up to about _FLAT scores."""
    run, size = [], 0
    for c in range(CLASSES):
        n = first[c + 1] - first[c]
        for a in range(cut[c], cut[c + 1] if n > 1 else 0, _ROWS):
            b = min(a + _ROWS, cut[c + 1])
            if run and (size + (b - a) * n > _FLAT or run[-1][2] != a):
                yield run
                run, size = [], 0
            run.append((c, a, b))
            size += (b - a) * n
    if run:
        yield run


def _of_classes(
    p: dict[str, np.ndarray], log_class: np.ndarray, z: np.ndarray, before: np.ndarray, of_class: np.ndarray, far: float, scale: float | None, mine: np.ndarray, total: np.ndarray, g: dict
) -> np.ndarray | None:
    small = far * _longest(p["w2"].T) + float(np.abs(p["b2"]).max()) < 60
    w2, log_class = np.ascontiguousarray(p["w2"].T), log_class + p["b2"]
    dz = None if scale is None else np.empty_like(z)
    w, b2 = np.zeros_like(w2), np.zeros_like(p["b2"])
    for a in range(0, len(z), _ROWS):
        b = min(a + _ROWS, len(z))
        s = z[a:b] @ w2.T
        s += log_class.take(before[a:b], axis=0)
        s, at, mine[a:b], sums = _softmax(s, of_class[a:b], small)
        total[a:b] = sums
        if scale is not None:
            s.reshape(-1)[at] -= sums
            by = scale / sums
            b2 += by @ s
            by = by[:, None]
            np.matmul(s, w2, out=dz[a:b])
            dz[a:b] *= by
            w += s.T @ (z[a:b] * by)
    if scale is not None:
        g["w2"], g["b2"] = w.T, b2
    return dz


def _of_buckets(
    p: dict[str, np.ndarray], vocabulary: Vocabulary, z: np.ndarray, before: np.ndarray, of: np.ndarray, of_class: np.ndarray, far: float, scale: float | None, mine: np.ndarray, total: np.ndarray, dz: np.ndarray | None, g: dict
) -> None:
    """The scores of a run of classes lie behind each other in one array, as each has its own number of buckets."""
    small = far * _longest(p["bucket"]) < 60
    if scale is not None:
        g["bucket"] = np.zeros_like(p["bucket"])
    first = vocabulary.first.tolist()
    size = np.diff(vocabulary.first).take(of_class)
    place = of - vocabulary.first.take(of_class)
    for run in _runs(first, np.searchsorted(of_class, np.arange(CLASSES + 1)).tolist()):
        x, y = run[0][1], run[-1][2]
        end = np.cumsum(size[x:y])
        flat, sums, parts, at = np.empty(end[-1], z.dtype), np.empty(y - x, z.dtype), [], 0
        for c, a, b in run:
            lo, hi = first[c : c + 2]
            w, n = p["bucket"][lo:hi], (b - a) * (hi - lo)
            s = np.matmul(z[a:b], w.T, out=flat[at : at + n].reshape(b - a, hi - lo))
            s += vocabulary.block(c).take(before[a:b], axis=0)
            if not small:
                s -= s.max(axis=1, keepdims=True)
            parts.append((s, w, lo, hi, a - x, b - x))
            at += n
        end -= size[x:y]
        end += place[x:y]
        mine[x:y] = flat.take(end)
        np.exp(flat, out=flat)
        for s, _, lo, hi, a, b in parts:
            np.matmul(s, _ONES[: hi - lo], out=sums[a:b])
        total[x:y] = sums
        if scale is not None:
            flat[end] -= sums
            by = (scale / sums)[:, None]
            zs, d = z[x:y] * by, np.empty((y - x, HIDDEN), z.dtype)
            for s, w, lo, hi, a, b in parts:
                np.matmul(s, w, out=d[a:b])
                g["bucket"][lo:hi] += s.T @ zs[a:b]
            d *= by
            dz[x:y] += d


def levels(
    p: dict[str, np.ndarray], log_class: np.ndarray, z: np.ndarray, before: np.ndarray, of_class: np.ndarray, below: tuple[Vocabulary, np.ndarray, np.ndarray] | None, scale: float | None = None, wanted: bool = True
) -> tuple[np.ndarray, np.ndarray | None, dict]:
    """Natural log probability of each place's id, from the hidden layer z and the bucket before; with scale, also the
    gradients of minus their sum times scale, by z and by weights, those of p["id"] as (rows, gradients).  Places come in the
    order of by_class.  below: the vocabulary, buckets and ids; without it the log probability is the class's.  Where it is not wanted it is 0."""
    n, g = len(z), {}
    mine, total = np.zeros((2, n), z.dtype), np.ones((2, n), z.dtype)
    # biases are log probabilities that sum to one, and scores differ from them by no more than this
    far = _longest(z)
    dz = _of_classes(p, log_class, z, before, of_class, far, scale, mine[0], total[0], g)
    if below is None:
        return mine[0] - np.log(total[0]), dz, g
    vocabulary, of, ids = below
    _of_buckets(p, vocabulary, z, before, of, of_class, far, scale, mine[1], total[1], dz, g)
    if wanted:
        mine -= np.log(total, out=total)
    got = mine.sum(axis=0, dtype=np.float64) if wanted else np.zeros(n)
    several = np.flatnonzero(vocabulary.slot.take(ids) >= 0)
    if scale is not None:
        several = several[np.argsort(of[several].astype(np.int16), kind="stable")]
        g["id"] = np.zeros(0, np.int64), np.zeros((0, *p["id"].shape[1:]), z.dtype)
    for a in range(0, len(several), _ROWS) if scale is None else [0] * (len(several) > 0):
        some = several[a : a + _ROWS] if scale is None else several
        row, t = vocabulary.row[of[some]], vocabulary.slot[ids[some]]
        w, zs = p["id"].take(row, axis=0), z.take(some, axis=0)
        s = np.matmul(w, zs[:, :, None])[:, :, 0]
        s += vocabulary.member_share.take(row, axis=0)
        s, at, now, sums = _softmax(s, t, False)
        if wanted:
            got[some] += now - np.log(sums)
        if scale is not None:
            s.reshape(-1)[at] -= sums
            s *= (scale / sums)[:, None]
            dz[some] += np.matmul(s[:, None, :], w)[:, 0]
            begin = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
            g["id"] = row[begin], np.add.reduceat(s[:, :, None] * zs[:, None, :], begin, axis=0)
    return got, dz, g


def _own(vocabulary: Vocabulary, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places have an id before them that shares its bucket, and that id."""
    last = last.ravel()
    at = np.flatnonzero(vocabulary.slot.take(last) >= 0)
    return at, last[at]


def _scaled(qkv: np.ndarray) -> np.ndarray:
    """With the attention's scale in the columns of queries."""
    out = qkv.copy()
    out[:, :WIDTH] *= _SCALE
    return out


def _weights(a: np.ndarray, small: bool = False) -> np.ndarray:
    """Attention's scores, to exp of those that a place may see."""
    if not small:
        np.minimum(a, np.float32(60), out=a)
    np.exp(a, out=a)
    a *= _BEFORE[WINDOW - a.shape[1] :]
    return a


def _hidden(p: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    # operands of one shape, as numpy is slow with short rows and with a constant
    z = h @ p["w1"]
    z += p["b1"][None].take(np.zeros(len(z), np.int64), axis=0)
    return np.maximum(z, np.zeros_like(z), out=z)


def gradients(
    p: dict[str, np.ndarray], log_class: np.ndarray, x_ids: np.ndarray, target: np.ndarray, counted: np.ndarray, vocabulary: Vocabulary | None = None, last: np.ndarray | None = None, of: np.ndarray | None = None, ids: np.ndarray | None = None,
    wanted: bool = True,
) -> tuple[dict, float]:
    """Gradients of the mean loss over the counted positions, and the loss; those of single ids as (rows, gradients).

    x_ids and target are the bucket before and the class of each place.  With a vocabulary the loss is that of the ids: last
    is the id before, of and ids are the place's bucket and id.  Without one it is that of the classes alone.  wanted: whether the loss is.
    """
    n, x = len(x_ids), x_ids.ravel()
    keep = np.flatnonzero(counted)
    keep = keep[by_class(target.ravel()[keep], x[keep])]
    flat = np.take(p["e"], x, axis=0)
    if vocabulary is not None:
        own = _own(vocabulary, last)
        flat[own[0]] += p["own"].take(own[1], axis=0)
    flat.reshape(n, WINDOW, WIDTH)[...] += p["p"]
    qkv = _scaled(p["qkv"])
    q, k, v = np.split((flat @ qkv).reshape(n, WINDOW, 3 * WIDTH), 3, axis=2)
    a = _weights(np.matmul(q, k.transpose(0, 2, 1)))
    a *= (1 / (a.reshape(-1, WINDOW) @ _ONES[:WINDOW])).reshape(n, WINDOW, 1)
    seen = np.matmul(a, v)
    h = np.take(flat + seen.reshape(-1, WIDTH), keep, axis=0)
    z = _hidden(p, h)
    m = max(len(keep), 1)
    below = None if vocabulary is None else (vocabulary, of.ravel()[keep], ids.ravel()[keep])
    got, dz, g = levels(p, log_class, z, x[keep], target.ravel()[keep], below, np.float32(1 / m), wanted)
    loss = -float(got.sum()) / m
    dz *= z > 0
    g["w1"], g["b1"] = h.T @ dz, np.ones(len(dz), dz.dtype) @ dz
    # to the places' own order, zeros where none is counted
    at = np.full(len(flat), len(keep))
    at[keep] = np.arange(len(keep))
    dh = np.concatenate([dz @ p["w1"].T, np.zeros((1, WIDTH), flat.dtype)]).take(at, axis=0)
    dc = dh.reshape(n, WINDOW, WIDTH)
    da = np.matmul(dc, v.transpose(0, 2, 1))
    d = np.empty((n, WINDOW, 3 * WIDTH), dc.dtype)
    np.matmul(a.transpose(0, 2, 1), dc, out=d[:, :, 2 * WIDTH :])
    # the rows' sums of da * a
    da -= ((dc * seen).reshape(-1, WIDTH) @ np.ones(WIDTH, dc.dtype)).reshape(n, WINDOW, 1)
    da *= a
    np.matmul(da, k, out=d[:, :, :WIDTH])
    np.matmul(da.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
    d = d.reshape(-1, 3 * WIDTH)
    g["qkv"] = _scaled((d.T @ flat).T)
    dx = d @ qkv.T
    dx += dh
    g["p"] = dx.reshape(n, WINDOW, WIDTH).sum(axis=0)
    g["e"] = np.stack([np.bincount(x, y, minlength=BUCKETS) for y in np.ascontiguousarray(dx.T)], axis=1).astype(np.float32)
    if vocabulary is not None:
        rows, which = np.unique(own[1], return_inverse=True)
        d_own = dx.take(own[0], axis=0)
        g["own"] = rows, np.stack([np.bincount(which, d_own[:, i], minlength=len(rows)) for i in range(WIDTH)], axis=1).astype(np.float32)
    return g, loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = RATE):
        self.p, self.rate, self.n = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = np.float32(self.rate * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n))
        for k, x in g.items():
            rows = None
            if isinstance(x, tuple):
                # of single rows, the others stay as they are
                rows, x = x
            m, v = (y if rows is None else y.take(rows, axis=0) for y in (self.m[k], self.s[k]))
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            v *= np.float32(0.999)
            x = np.square(x)
            x *= np.float32(0.001)
            v += x
            by = np.sqrt(v, out=x)
            by += np.float32(1e-8)
            by = np.divide(m, by, out=by)
            by *= rate
            if rows is None:
                self.p[k] -= by
            else:
                self.m[k][rows], self.s[k][rows] = m, v
                self.p[k][rows] -= by


def windows(bounds: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts whose ids lie at bounds[i]:bounds[i+1] of a sequence: text, where each begins, and how many of its
    first places a window before it has scored."""
    size = np.diff(bounds)
    n = np.where(size <= WINDOW, (size > 0).astype(np.int64), 1 + -(-(size - WINDOW) // stride))
    text = np.repeat(np.arange(len(size)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, bounds[:-1][text] + number * stride, np.where(number > 0, WINDOW - stride, 0)


def _places(bounds: np.ndarray, text: np.ndarray, start: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each place of windows (the text's first where the text has ended), and whether it is to be scored."""
    place = start[:, None] + np.arange(WINDOW)
    inside = place < bounds[1:][text][:, None]
    return np.where(inside, place, bounds[:-1][text][:, None]), inside & (np.arange(WINDOW) >= done[:, None])


def _rows(x: np.ndarray, start: np.ndarray, place: np.ndarray, short: np.ndarray) -> np.ndarray:
    """x at the places of windows, read in a row of memory from each start; short: windows that go beyond their text."""
    out = sliding_window_view(x, WINDOW)[np.minimum(start, len(x) - WINDOW)] if len(x) >= WINDOW else np.empty(place.shape, x.dtype)
    out[short] = x.take(place[short])
    return out


def _inputs(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each id, bucket of the id before it, and that id."""
    last = _last(ids, bounds, vocabulary, np.int64)
    return vocabulary.bucket[ids], vocabulary.bucket[last], last


def _last(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary, kind: type) -> np.ndarray:
    last = np.empty(len(ids), kind)
    last[1:] = ids[:-1]
    last[bounds[:-1][np.diff(bounds) > 0]] = len(vocabulary.bucket) - 1
    return last


def log_probabilities(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of each text's ids.  Where p has no weights of single buckets and ids they are untrained."""
    p = {**leaves(vocabulary), **p} if "id" not in p else p
    last = _last(ids, bounds, vocabulary, np.int32)
    # of each id and each place: the input, the query, the key, the value and a one, which sums attention's weights
    x = p["e"].take(vocabulary.bucket, axis=0)
    shared = np.flatnonzero(vocabulary.slot >= 0)
    x[shared] += p["own"].take(shared, axis=0)
    qkv = _scaled(p["qkv"])
    inputs, places = (np.concatenate([y, y @ qkv, np.full((len(y), 1), one, np.float32)], axis=1) for y, one in ((x, 1), (p["p"], 0)))
    q, k = ((_longest(inputs[:, i : i + WIDTH]) + _longest(places[:, i : i + WIDTH])) for i in (WIDTH, 2 * WIDTH))
    text, start, done = windows(bounds)
    out = np.zeros(len(bounds) - 1)
    # windows of one kind have the same places to score, but for the ends of texts
    for skip in np.unique(done).tolist():
        kind = np.flatnonzero(done == skip)
        for i in range(0, len(kind), _POOL):
            at, z, of_text = [], [], []
            for j in range(i, min(i + _POOL, len(kind)), _BATCH):
                these = kind[j : min(j + _BATCH, i + _POOL)]
                place, scored = _places(bounds, text[these], start[these], done[these])
                y = inputs.take(last.take(place), axis=0)
                y += places
                a = _weights(np.matmul(y[:, skip:, WIDTH : 2 * WIDTH], y[:, :, 2 * WIDTH : 3 * WIDTH].transpose(0, 2, 1)), q * k < 60)
                seen = np.matmul(a, y[:, :, 3 * WIDTH :])
                h = seen[:, :, :WIDTH] / seen[:, :, WIDTH:]
                h += y[:, skip:, :WIDTH]
                keep = np.flatnonzero(scored[:, skip:])
                z.append(_hidden(p, h.reshape(-1, WIDTH).take(keep, axis=0)))
                at.append(place[:, skip:].ravel()[keep])
                of_text.append(text[these][keep // (WINDOW - skip)])
            at, of_text = np.concatenate(at), np.concatenate(of_text)
            these = ids.take(at)
            of, before = vocabulary.bucket.take(these), vocabulary.bucket.take(last.take(at))
            of_class = vocabulary.of_class.take(of)
            order = by_class(of_class, before)
            got = levels(p, vocabulary.log_class, np.concatenate(z).take(order, axis=0), before[order], of_class[order], (vocabulary, of[order], these[order]))[0]
            out += np.bincount(of_text[order], got, minlength=len(out))
    return out


# --- Spark -------------------------------------------------------------------------------------------------------------

_TOKENS = "kind byte, lot long, ids binary, words binary, k array<long>, c array<long>"
_WORDS = "slice int, n long, different long, raw binary"
_SLICED = "slice int, kind int, raw binary"
_FOUND = "row long, n_rare long, rare_score double"


def _token_rows(kind: int, n: int, lot=None, ids=None, words=None, k=None, c=None) -> pa.RecordBatch:
    empty = [None] * n
    lists = lambda x: pa.array(empty if x is None else [x], pa.list_(pa.int64()))
    binary = lambda x: pa.array(empty if x is None else x, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), pa.array(empty, pa.int64()) if lot is None else lot, binary(ids), binary(words), lists(k), lists(c)],
        names=["kind", "lot", "ids", "words", "k", "c"],
    )


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Each different key, in order, and the sums of its values."""
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return [key[begin], *(np.add.reduceat(x[order], begin) if len(key) else x for x in values)]


def _sliced(h: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Slices of sorted hashes that have any, and the bytes of each: those of its hashes, then of its part of each column."""
    cut = np.searchsorted(h >> np.uint64(64 - (SLICES - 1).bit_length()), np.arange(SLICES + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cut))
    return used, [b"".join([x[a:b].tobytes() for x in (h, *columns)]) for a, b in zip(cut[used].tolist(), cut[used + 1].tolist(), strict=True)]


def _columns(raw: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns of one slice's bytes."""
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _tokenized(model, n_pieces: int):
    """Rows of kind 0: a training document's ids; 1: words (hash) of some chunks and their counts, a slice of hashes each;
    2: a task's ids and counts."""

    def counted(h: list[np.ndarray], c: list[np.ndarray]) -> pa.RecordBatch:
        used, raw = _sliced(*_sums(np.concatenate(h), np.concatenate(c)))
        return _token_rows(1, len(used), lot=longs(used), words=raw)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = pieces_of(model.value), np.zeros(n_pieces + 1, np.int64)
        words, counts, held = [], [], 0
        for batch in batches:
            for part in chunks(batch, limit=_TEXT_BYTES):
                w = Words(part.column("text"), lower=True)
                h, which, count, start, size = pieces.of(w)
                ids, bounds = pieces.sequence(w, which, start, size)
                seen += np.bincount(ids, minlength=n_pieces + 1)
                # an id takes two bytes where all of them fit
                ids = ids.astype(np.int16 if n_pieces < 1 << 15 else np.int32)
                yield _token_rows(0, w.n, part.column("lot"), [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)])
                words.append(h)
                counts.append(count)
                held += len(h)
                if held > _HELD:
                    yield counted(words, counts)
                    words, counts, held = [], [], 0
        if held:
            yield counted(words, counts)
        used = np.flatnonzero(seen)
        if len(used):
            yield _token_rows(2, 1, k=used, c=seen[used])

    return rows


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("slice", "kind", "raw")), strict=True)


def _summed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of slices: the words of each slice, by hash, and their counts."""
    for number, of_slice in groupby(_by_slice(batches), lambda x: x[0]):
        h, c = zip(*(_columns(raw, np.uint64, np.int64) for _, _, raw in of_slice), strict=True)
        h, c = _sums(np.concatenate(h), np.concatenate(c))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), longs(c.sum(keepdims=True)), pa.array([len(h)]), pa.array([h.tobytes() + c.tobytes()], pa.binary())], names=["slice", "n", "different", "raw"])


def _often(least: float):
    """Words that occur so many times, and their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                h, c = _columns(raw, np.uint64, np.int64)
                at = np.flatnonzero(c >= least)
                yield pa.RecordBatch.from_arrays([longs(h[at]), longs(c[at])], names=["k", "c"])

    return rows


def _rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rare words of texts, a slice of hashes each: hash, row and count."""

    def dealt(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        h, n = np.frombuffer(b"".join([x[1] for x in held]), np.uint64), np.frombuffer(b"".join([x[2] for x in held]), np.int32)
        row = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) // 8 for x in held])
        order = np.argsort(h)
        used, raw = _sliced(h[order], row[order], n[order])
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.ones(len(used), np.int32)), pa.array(raw, pa.binary())], names=["slice", "kind", "raw"])

    held, n = [], 0
    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("row", "rare", "rare_n")), strict=True):
            held.append(x)
            n += len(x[1]) // 8
            if n > _HELD:
                yield dealt(held)
                held, n = [], 0
    if n:
        yield dealt(held)


def _rare_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of slices, each slice's words (kind 0) before its pairs (1): of some of a text's rare words,
    how many are known and the sum of their log10(count + 0.5), in slices of a hash of the row."""

    def summed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        row, n, score = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
        h = mixed(row.view(np.uint64))
        order = np.argsort(h)
        used, raw = _sliced(h[order], row[order], n[order], score[order])
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.zeros(len(used), np.int32)), pa.array(raw, pa.binary())], names=["slice", "kind", "raw"])

    held, size = [], 0
    for _, of_slice in groupby(_by_slice(batches), lambda x: x[0]):
        known, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, kind, raw in of_slice:
            if kind == 0:
                known, c = _columns(raw, np.uint64, np.int64)
            elif len(known):
                h, row, n = _columns(raw, np.uint64, np.int64, np.int32)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                met = np.flatnonzero(known[at] == h)
                n = n[met].astype(np.int64)
                held.append([row[met], n, n * np.log10(c[at[met]] + 0.5)])
                size += len(met)
                if size > _HELD:
                    yield summed(held)
                    held, size = [], 0
    if size:
        yield summed(held)


def _sequences(batches: Iterator[pa.RecordBatch], most: int, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Group, ids and bounds of some of a group's documents in a row, about most ids; cut by the documents alone."""
    held: list[np.ndarray] = []
    group, n = None, 0
    for batch in batches:
        for g, raw in zip(batch.column("group").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if held and (g != group or n >= most):
                yield group, np.concatenate(held), np.cumsum([0, *map(len, held)])
                held, n = [], 0
            group = g
            held.append(np.frombuffer(raw, kind))
            n += len(held[-1])
    if held:
        yield group, np.concatenate(held), np.cumsum([0, *map(len, held)])


def _pairs(vocabulary, kind: type):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, seen = vocabulary.value, np.zeros(BUCKETS * BUCKETS, np.int64)
        rows_of = voc.bucket * BUCKETS
        for _, ids, bounds in _sequences(batches, 1 << 20, kind):
            key = rows_of.take(_last(ids, bounds, voc, np.int32))
            key += voc.bucket.take(ids)
            np.add.at(seen, key, 1)
        # four bytes a number, in several arrays where one is too large for that
        most = np.iinfo(np.int32).max
        while seen.any():
            yield array_parts(np.minimum(seen, most).astype(np.int32))
            seen = np.maximum(seen - most, 0)

    return rows


def _trained(vocabulary, weights, rate: float, kind: type):
    """Weights after each group's windows, times their ids, and the number of these."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, adam, last, n = vocabulary.value, None, None, 0
        for group, ids, bounds in _sequences(batches, 1 << 20, kind):
            if group != last:
                if n:
                    yield array_parts(np.append(flattened(adam.p) * np.float32(n), np.float32(n)))
                adam, last, n = Adam(whole(weights, voc), rate), group, 0
            before = _last(ids, bounds, voc, np.int32)
            text, start, done = windows(bounds, WINDOW)
            order = np.random.default_rng(n).permutation(len(text))
            for i in range(0, len(order), _BATCH):
                pick = order[i : i + _BATCH]
                place, counted = _places(bounds, text[pick], start[pick], done[pick])
                short = np.flatnonzero(start[pick] + WINDOW > bounds[1:][text[pick]])
                these, last_ids = _rows(ids, start[pick], place, short), _rows(before, start[pick], place, short)
                of = voc.bucket.take(these)
                adam.step(gradients(adam.p, voc.log_class, voc.bucket.take(last_ids), voc.of_class.take(of), counted, voc, last_ids, of, these, wanted=False)[0])
            n += len(ids)
        if n:
            yield array_parts(np.append(flattened(adam.p) * np.float32(n), np.float32(n)))

    return rows


def _summed_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of slices: the sums of each text."""
    for _, of_slice in groupby(_by_slice(batches), lambda x: x[0]):
        _, *columns = zip(*(_columns(raw, np.uint64, np.int64, np.int64, np.float64) for _, _, raw in of_slice), strict=True)
        row, n, score = _sums(*map(np.concatenate, columns))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(n), pa.array(score)], names=["row", "n_rare", "rare_score"])


def _binaries(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of x[cut[i]:cut[i + 1]] for each i."""
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut * x.itemsize).astype(np.int64)), pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _scored(model, vocabulary, weights, frequent):
    names = ["doc_id", "held_out", "n_tokens", "log_p", "n_frequent", "frequent_score", "rare", "rare_n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, voc, p = pieces_of(model.value), vocabulary.value, whole(weights.value, vocabulary.value)
        often, log_often = frequent.value
        for batch in batches:
            for part in chunks(batch, limit=_TEXT_BYTES):
                w = Words(part.column("text"), lower=True)
                h, which, _, start, size = pieces.of(w)
                ids, bounds = pieces.sequence(w, which, start, size)
                log_p = log_probabilities(p, voc, ids, bounds) / np.log(10)
                at = np.minimum(np.searchsorted(often, h), max(len(often) - 1, 0))
                known = often[at] == h if len(often) else np.zeros(len(h), bool)
                value = np.where(known, log_often[at], 0.0) if len(often) else np.zeros(len(h))
                of_word = known[which]
                # words of each text that are not frequent, each once with its count
                rest = np.flatnonzero(~of_word)
                pair, count = np.unique(w.doc[rest] * np.int64(len(h) + 1) + which[rest], return_counts=True)
                doc = pair // (len(h) + 1)
                cut = np.searchsorted(doc, np.arange(w.n + 1))
                rare, rare_n = (_binaries(x, cut) for x in (h[pair % (len(h) + 1)], count.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), longs(w.count), pa.array(log_p), longs(np.bincount(w.doc, of_word, minlength=w.n)), pa.array(np.bincount(w.doc, value[which], minlength=w.n)), rare, rare_n],
                    names=names,
                )

    return rows


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = TOKENIZER, group_ids: int = GROUP_IDS, frequent: float = FREQUENT, rate: float = RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Documents whose crc32(doc_id as text) modulo 5 is 1 are held out; a null doc_id counts as an empty text.  A null text
    is an empty one: its only token is the end.  Without training documents counts are 0 and the model is untrained.
    Repeated rows count each time and get a row each.  The tokenizer's file is read by the driver alone.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    with open(model, "rb") as f:
        raw = f.read()
    tokenizer, pieces = Pieces(raw), send(raw)
    n_pieces = tokenizer.size
    crc = F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc % 5 == 1).alias("held_out"), body.alias("text"), F.xxhash64(crc, body).alias("lot"))
    training = rows.where("not held_out").select("lot", "text")
    tokens = written(training.mapInArrow(_tokenized(pieces, n_pieces), _TOKENS), "tokens")
    of_pieces = np.zeros(n_pieces + 1, np.int64)
    counted = tokens.where("kind = 2").select(F.explode(F.arrays_zip("k", "c")).alias("x")).groupBy("x.k").agg(F.sum("x.c").alias("c"))
    for r in counted.collect():  # at most as many as the tokenizer has pieces
        of_pieces[r["k"]] = r["c"]
    n_ends, n_ids = int(of_pieces[n_pieces]), int(of_pieces.sum())
    of_words = tokens.where("kind = 1").select(F.col("lot").cast("int").alias("slice"), F.lit(0).alias("kind"), F.col("words").alias("raw"))
    words = written(of_words.repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed_words, _WORDS), "words")
    n_words, different = (x or 0 for x in words.agg(F.sum("n"), F.sum("different")).first())
    n_tokens, different = n_words + n_ends, different + (n_ends > 0)
    vocabulary = Vocabulary(of_pieces, tokenizer.starts())
    groups, id_type = max(1, -(-n_ids // group_ids)), np.int16 if n_pieces < 1 << 15 else np.int32
    ids = tokens.where("kind = 0").select(F.pmod("lot", F.lit(groups)).cast("int").alias("group"), "lot", "ids")
    vocabulary.learn(summed_array(ids.select(F.lit(0).alias("group"), "ids").mapInArrow(_pairs(send(vocabulary), id_type), ARRAY_PARTS), BUCKETS * BUCKETS, np.int32).reshape(BUCKETS, BUCKETS))
    known = send(vocabulary)
    weights = initial()
    # the same documents in the same order, however the rows are partitioned
    dealt = ids.repartitionById(groups, "group").sortWithinPartitions("group", "lot", "ids").select("group", "ids")
    n_weights = len(flattened(whole(weights, vocabulary)))
    total = summed_array(dealt.mapInArrow(_trained(known, weights, rate, id_type), ARRAY_PARTS), n_weights + 1, np.float32)
    if total[-1]:
        weights = (total[:-1] / total[-1]).astype(np.float32)
    often = words.select("raw").mapInArrow(_often(max(frequent * n_tokens, 1)), "k long, c long").toArrow()  # one millionth of the tokens each: a million at most
    k, c = ints(often.column("k").combine_chunks()).view(np.uint64), ints(often.column("c").combine_chunks())
    order = np.argsort(k)
    often = send((k[order], np.log10(c[order] + 0.5)))
    kind = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, n_tokens long, log_p double, n_frequent long, frequent_score double, rare binary, rare_n binary"
    done = written(rows.select("doc_id", "held_out", "text").mapInArrow(_scored(pieces, known, send(weights), often), kind).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = done.select("row", "rare", "rare_n").mapInArrow(_rare_pairs, _SLICED)
    sides = words.select("slice", F.lit(0).alias("kind"), "raw").union(rare)
    scores = sides.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(_rare_scores, _SLICED)
    found = scores.repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed_scores, _FOUND)
    n_known = F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))
    end = float(np.log10(n_ends + 0.5))
    base = F.col("frequent_score") + F.coalesce("rare_score", F.lit(0.0)) + (F.col("n_tokens") - n_known) * float(np.log10(0.5)) + end - (F.col("n_tokens") + 1) * float(np.log10(n_tokens + 0.5 * (different + 1)))
    return done.join(found, "row", "left").select(
        "doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (n_known + int(n_ends > 0)).cast("long").alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("log_p").alias("score")
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
