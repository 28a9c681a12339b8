"""Retrieval units: whole documents or chunks of them.

Canonical relations: units(unit_ord, unit_id, doc_id, text), queries(qid, question), and
ranking(qid, rank, doc_id, unit_id, score, source) with ranks from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_aware_text
from .chunking import ChunkRules, chunks

#: unit_ord of a chunk is that of its document times so many, plus its position.
CHUNKS_OF_ONE = 1_000_000


def document_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", field_aware: bool = False) -> DataFrame:
    """One unit per document.  unit_ord, which breaks ties, is the document's id if it is a number, else its hash."""
    body = field_aware_text(F.col(text)) if field_aware else F.coalesce(F.col(text), F.lit(""))
    key = F.col(doc_id).cast("string")
    return documents.select(ordinal(documents, doc_id).alias("unit_ord"), key.alias("unit_id"), key.alias("doc_id"), body.alias("text"))


def chunk_units(documents: DataFrame, rules: ChunkRules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One unit per chunk; ordered by document, then position (up to a million chunks in one document)."""
    found = chunks(documents, rules, doc_id, text)
    order = ordinal(found, "doc_id") * CHUNKS_OF_ONE + F.col("position")
    return found.select(order.alias("unit_ord"), F.col("chunk_id").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")


def ordinal(df: DataFrame, doc_id: str):
    numeric = df.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(doc_id).cast("long") if numeric else F.shiftrightunsigned(F.xxhash64(doc_id), 22)


def query_rows(table: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    return table.select(F.col(qid).cast("string").alias("qid"), F.coalesce(F.col(question).cast("string"), F.lit("")).alias("question"))
