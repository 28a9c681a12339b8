"""Training data from gold evidence and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip


def holding(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents(text, ...) with each of the items(item, ...) that the text contains.

    An item's words between two spaces stand between spaces, or ends, in any text that holds it, so only texts that have
    the longest of them are searched for the item; those without such a word are sought in every text.
    """
    words = F.split("item", " ", -1)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    sought = items.withColumn("word", F.coalesce(longest, F.lit("")))
    # the empty word, for items without one, is in every text
    rows = documents.withColumn("word", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split("text", " ", -1)))))
    return rows.join(F.broadcast(sought), "word").where(F.contains("text", "item")).drop("word")


def evidence_windows(train: DataFrame, documents: DataFrame, window_chars: int = 1200) -> DataFrame:
    """qid, question, doc_id, start, end, text: a window around each gold evidence, wide enough to hold all of it."""
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("whole"))
    rows = train.select("qid", "question", F.col("gold_doc_id").cast("string").alias("doc_id"), F.col("gold_evidence_char_start").cast("long").alias("s"), F.col("gold_evidence_char_end").cast("long").alias("e")).join(docs, "doc_id")
    center, half = F.floor((F.col("s") + F.col("e")) / 2), window_chars // 2
    start = F.least(F.greatest(center - half, F.lit(0)), F.col("s"))
    end = F.greatest(F.least(center + half, F.length("whole")), F.col("e"))
    placed = rows.withColumns({"start": start.cast("long"), "end": end.cast("long")})
    return placed.select("qid", "question", "doc_id", "start", "end", strip(F.substr("whole", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).alias("text"))


def training_pairs(windows: DataFrame) -> DataFrame:
    """qid, question, positive_doc_id, positive_text."""
    return windows.select("qid", "question", F.col("doc_id").alias("positive_doc_id"), F.col("text").alias("positive_text"))


def hard_negatives(train: DataFrame, ranking: DataFrame, n: int = 5) -> DataFrame:
    """qid, gold_doc_id, negative_doc_id, negative_rank: the first n ranked documents that are not the gold one."""
    gold = train.select(F.col("qid").cast("string").alias("q"), F.col("gold_doc_id").cast("string").alias("gold_doc_id"))
    wrong = ranking.join(gold, F.col("qid").cast("string") == F.col("q")).where(F.col("doc_id").cast("string") != F.col("gold_doc_id"))
    placed = wrong.withColumn("negative_rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")).cast("long")).where(F.col("negative_rank") <= n)
    return placed.select("qid", "gold_doc_id", F.col("doc_id").alias("negative_doc_id"), "negative_rank")
