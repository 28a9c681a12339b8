"""Shared pieces: words, content keys, tables in the shared folder and hashing of whole Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that the array code below works on at once.
CHUNK_BYTES = 1 << 20


def words_of(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- tables in the shared folder -------------------------------------------------------------------------------------

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  One of our own only where the session names none and runs on one
    machine; a cluster's executors would each write to their own disk, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        if not named:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="rankforge-")
        _own_folder[app] = f"{named.rstrip('/')}/rankforge-{app}"
        atexit.register(_forget, spark, _own_folder[app])
    return _own_folder[app]


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before: nothing is left to ask
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder.  Cuts the lineage; lost executors do not lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- content keys ------------------------------------------------------------------------------------------------------


def content_key(text: Column) -> list[Column]:
    """96 bits that name a text: the same in every run and after a lost task, unlike a row number."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key_a"), F.hash(text).alias("key_b")]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """key_a, key_b, text, copies: each different text once.

    Copies are combined before the shuffle, so a text that makes up a third of all rows costs one row per map task.
    """
    return (
        docs.select(*content_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .groupBy("key_a", "key_b")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )


# --- words and hashes of Arrow batches ---------------------------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), CHUNK_BYTES + 1)
        for way, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, _U)
            out[0] = 1
            _powers[way] = np.cumprod(out, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For matching without case and punctuation: ASCII letters, digits and all bytes of other scripts make words.
_IS_GAP = ~np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_FOLDED = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)


class Words:
    """The words of some texts: byte range, text number and 64-bit hash of each; first[i]: number of text i's first word."""

    def __init__(self, texts: pa.Array, folded: bool = False, hashes: bool = True, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and n else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if folded or lower:
            data = _FOLDED[data]
        gap = (_IS_GAP if folded else _IS_SPACE)[data]
        before = np.ones(len(data) + 1, bool)
        before[1:] = gap
        before[bounds] = True
        solid = ~gap
        self.start = np.flatnonzero(solid & before[:-1])
        after = np.ones(len(data) + 1, bool)
        after[:-1] = gap
        after[bounds] = True
        self.end = np.flatnonzero(solid & after[1:]) + 1
        self.data, self.n = data, n
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        if hashes:
            up, down = powers(len(data) + 1)
            total = np.zeros(len(data) + 1, _U)
            np.cumsum(_BYTE_CODE[data] * up[:-1], out=total[1:])
            self.hash = mixed((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(_U))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the windows of size words; those that would leave their text are of no use (see inside)."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, _U)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(self.hash * up[:n], out=total[1:])
        return mixed((total[size:] - total[:-size]) * down[: n - size + 1])

    def inside(self, size: int) -> np.ndarray:
        """Whether the window of size words that starts at each word ends in the same text."""
        n = len(self.start)
        return self.doc[: n - size + 1] == self.doc[size - 1 :] if n >= size else np.zeros(0, bool)

    def place(self) -> np.ndarray:
        """Number of each word in its own text."""
        return np.arange(len(self.start)) - self.first[self.doc]

    def text(self, i: int, keep: np.ndarray | None = None) -> str:
        """Words of text i, where keep holds, joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        if keep is None or keep.all():
            picks = range(a, b)
        else:
            picks = (np.flatnonzero(keep) + a).tolist()
        raw, start, end = self.data.tobytes() if not hasattr(self, "_raw") else self._raw, self.start, self.end
        self._raw = raw
        return b" ".join([raw[start[j] : end[j]] for j in picks]).decode()


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    texts = batch.column(column).cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == _U else x.astype(np.int64))


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


# --- sums of arrays over all tasks -------------------------------------------------------------------------------------

_PIECE = 4096
ARRAY_PARTS = "part int, raw binary"


def array_parts(x: np.ndarray) -> pa.RecordBatch:
    """Rows of a flat array for summed_array: pieces of fixed size, those of zeros left out.  The sum is told of float32 and int32."""
    pieces = [x[i : i + _PIECE] for i in range(0, len(x), _PIECE)]
    used = [i for i, p in enumerate(pieces) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pieces[i].astype(x.dtype if x.dtype in (np.float32, np.int32) else np.int64).tobytes() for i in used], pa.binary())], names=["part", "raw"])


def summed_array(parts: DataFrame, size: int, kind: type = np.int64) -> np.ndarray:
    """The sum over all tasks' arrays of size numbers.  Pieces are summed where they are shuffled to; the driver gets
    one array, whatever the number of tasks."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                x = np.frombuffer(raw, kind).astype(np.float64 if kind is np.float32 else np.int64)
                sums[part] = sums[part] + x if part in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "raw"])

    out = np.zeros(size, np.float64 if kind is np.float32 else np.int64)
    for part, raw in parts.repartition("part").mapInArrow(total, ARRAY_PARTS).collect():
        x = np.frombuffer(bytes(raw), out.dtype)
        out[part * _PIECE : part * _PIECE + len(x)] = x
    return out
