"""Chunks: overlapping windows over lines, characters or paragraphs of a text, as arrays and as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, let, starts, strip

LINE_END = r"(?<=\r\n)|(?<=[\n\x0b\x0c\x1c-\x1e\x85  ])|(?<=\r)(?!\n)"
UNITS = ("line", "char", "paragraph")


@dataclass(frozen=True)
class ChunkRules:
    unit: str = "line"
    size: int = 10
    overlap: int = 5

    def __post_init__(self):
        if self.unit not in UNITS:
            raise ValueError(f"unknown chunk unit: {self.unit}")
        if self.size <= 0:
            raise ValueError("chunk size must be positive")

    @property
    def step(self) -> int:
        return max(1, self.size - self.overlap)

    @property
    def label(self) -> str:
        return f"{self.unit}_{self.size}_{self.overlap}"


def _running(parts: Column) -> Column:
    """Span of each string of an array, when they follow one another."""
    span = lambda s, x: F.struct(s.cast("int").alias("s"), (s + F.length(x)).cast("int").alias("e"))
    return let(parts, lambda ps: F.zip_with(starts(F.transform(ps, F.length)), ps, span))


def line_spans(text: Column) -> Column:
    """Spans of the lines that are not blank, line ends included."""

    def of(lines: Column) -> Column:
        told = F.zip_with(_running(lines), lines, lambda x, line: F.struct(x["s"].alias("s"), x["e"].alias("e"), line.rlike(rf"(?U)[^\s\x1c-\x1f\x85]").alias("full")))
        return F.transform(F.filter(told, lambda x: x["full"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return let(F.split(text, LINE_END), of)


def paragraph_spans(text: Column) -> Column:
    """Spans of paragraphs: from a character that is not white space to the last one before a blank line.

    White space right before that line joins both sides to one paragraph, and the last paragraph counts only if at most
    one line end follows it: fixed behaviour, kept as it is.
    """
    edge = rf"(?U)(?<=[^\s\x1c-\x1f\x85])\n{SPACES}*\n{SPACES}*"
    texts = F.split(text, edge, -1)
    gaps = F.regexp_extract_all(text, F.lit(edge), F.lit(0))
    # texts[0] gaps[0] texts[1] gaps[1] ... is the whole text
    parts = F.flatten(F.transform(texts, lambda x, i: F.array(x, F.coalesce(F.get(gaps, i), F.lit("")))))
    last = 2 * F.size(gaps)
    numbered = F.transform(_running(parts), lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), i.alias("i")))

    def trimmed(x: Column) -> Column:
        inner = F.substr(text, x["s"] + 1, x["e"] - x["s"])
        front = F.length(inner) - F.length(F.regexp_replace(inner, rf"(?U)^{SPACES}+", ""))
        back = F.length(inner) - F.length(F.regexp_replace(inner, rf"(?U){SPACES}+$", ""))
        ends = (x["i"] < last) | (back == 0) | ((back == 1) & inner.endswith("\n"))
        return F.when(ends, F.struct((x["s"] + front).cast("int").alias("s"), (x["e"] - back).cast("int").alias("e")))

    return F.filter(F.transform(F.filter(numbered, lambda x: x["i"] % 2 == 0), trimmed), lambda x: x["e"] > x["s"])


def _windows(spans: Column, rules: ChunkRules) -> Column:
    n = F.size(spans)
    last = F.when(n <= rules.size, F.lit(0)).otherwise(F.ceil((n - rules.size) / F.lit(rules.step)).cast("int"))

    def window(i: Column) -> Column:
        return F.struct(i.cast("int").alias("position"), spans[i * rules.step]["s"].alias("s"), spans[F.least(i * rules.step + rules.size, n) - 1]["e"].alias("e"))

    return F.transform(F.sequence(F.lit(0), last), window)


def chunk_spans(text: Column, rules: ChunkRules) -> Column:
    """array<struct<position, s, e>>; a text without content is one chunk, all of it."""
    whole = F.array(F.struct(F.lit(0).alias("position"), F.lit(0).alias("s"), F.length(text).alias("e")))
    if rules.unit == "char":
        n = F.length(text)
        last = F.when(n <= rules.size, F.lit(0)).otherwise(F.ceil((n - rules.size) / F.lit(rules.step)).cast("int"))
        every = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("int").alias("position"), (i * rules.step).cast("int").alias("s"), F.least(i * rules.step + rules.size, n).cast("int").alias("e")))
        found = F.filter(every, lambda x: strip(F.substr(text, x["s"] + 1, x["e"] - x["s"])) != "")
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))
    spans = line_spans(text) if rules.unit == "line" else paragraph_spans(text)
    return let(spans, lambda s: F.when(F.size(s) > 0, _windows(s, rules)).otherwise(whole))


def chunks(documents: DataFrame, rules: ChunkRules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk_id, doc_id, text, start, end, position of every chunk; text without white space at its ends."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    rows = rows.select("doc_id", "whole", F.explode(chunk_spans(F.col("whole"), rules)).alias("c"))
    inner = F.substr("whole", F.col("c.s") + 1, F.col("c.e") - F.col("c.s"))
    blank = strip(F.col("whole")) == ""
    return rows.select(
        F.concat_ws("::", F.col("doc_id").cast("string"), F.lit(rules.unit), F.col("c.position").cast("string")).alias("chunk_id"),
        "doc_id",
        F.when(blank, F.col("whole")).otherwise(strip(inner)).alias("text"),
        F.col("c.s").alias("start"),
        F.col("c.e").alias("end"),
        F.col("c.position").alias("position"),
    )
