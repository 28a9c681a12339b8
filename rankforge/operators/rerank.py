"""Reranking: pairs of query and document text, a pluggable scorer, and a grid of ways to blend the scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens, number_label, pair_text, slug
from ..sources.shared import table
from .fusion import z_score

INTRO_CHARS = 2500
MODES = ("ce", "ce_plus_candidate")
PAIR_AGGREGATIONS = ("max", "top2_mean", "max_plus_second")

#: A scorer makes a score of two text columns: built-in functions or a pandas UDF around a model.
Scorer = Callable[[Column, Column], Column]


def token_overlap(question: Column, text: Column) -> Column:
    """Share of the question's terms that the text has.  A stand-in for tests, not a model."""
    q = F.array_distinct(lexical_tokens(question))
    return F.size(F.array_intersect(q, lexical_tokens(text))) / F.greatest(F.size(q), F.lit(1)).cast("double")


def cross_encoder(model_name: str, batch_size: int = 16, max_length: int = 1024) -> Scorer:
    """Scores pairs with a sentence-transformers cross-encoder, loaded once in each Python worker."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as e:
        raise ImportError("a cross-encoder needs the package sentence-transformers") from e
    from collections.abc import Iterator

    import pandas as pd

    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from sentence_transformers import CrossEncoder

        model = CrossEncoder(model_name, max_length=max_length)
        for question, text in batches:
            yield pd.Series(model.predict(list(zip(question, text, strict=True)), batch_size=batch_size)).astype("float64")

    return F.pandas_udf(predict, "double")


def sequence_classifier(model_name: str, batch_size: int = 16, max_length: int = 1024) -> Scorer:
    """Scores pairs with a sequence classifier's raw logit (no sigmoid)."""
    try:
        import transformers  # noqa: F401
    except ImportError as e:
        raise ImportError("a sequence classifier needs the packages transformers and torch") from e
    from collections.abc import Iterator

    import pandas as pd

    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(model_name), AutoModelForSequenceClassification.from_pretrained(model_name).eval()
        for question, text in batches:
            scores: list[float] = []
            for i in range(0, len(question), batch_size):
                inputs = tokenizer(question[i : i + batch_size].tolist(), text[i : i + batch_size].tolist(), padding=True, truncation=True, max_length=max_length, return_tensors="pt")
                with torch.no_grad():
                    scores += model(**inputs).logits.view(-1).float().tolist()
            yield pd.Series(scores, dtype="float64")

    return F.pandas_udf(predict, "double")


def flag_reranker(model_name: str, batch_size: int = 16, max_length: int = 1024) -> Scorer:
    """Scores pairs with a reranker of the package FlagEmbedding."""
    try:
        import FlagEmbedding  # noqa: F401
    except ImportError as e:
        raise ImportError("a flag reranker needs the package FlagEmbedding") from e
    from collections.abc import Iterator

    import pandas as pd

    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from FlagEmbedding import FlagReranker

        model = FlagReranker(model_name)
        for question, text in batches:
            asked = [list(x) for x in zip(question, text, strict=True)]
            scores = model.compute_score(asked, batch_size=batch_size, max_length=max_length) if asked else []
            yield pd.Series(scores if isinstance(scores, list) else [scores], dtype="float64")

    return F.pandas_udf(predict, "double")


BACKENDS = {"cross_encoder": cross_encoder, "sequence": sequence_classifier, "flag": flag_reranker}


def scorer_for(model_name: str, batch_size: int = 16, max_length: int = 1024, backend: str | None = None) -> Scorer:
    """The scorer of a model, by the backend named or else by the model's name; token_overlap is built in."""
    if model_name == "token_overlap":
        return token_overlap
    if backend is not None and backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend}")
    return BACKENDS[backend or ("sequence" if model_name.startswith("BAAI/bge-reranker") else "cross_encoder")](model_name, batch_size, max_length)


def pairs(candidates: DataFrame, chunk_ranking: DataFrame, chunk_texts: DataFrame, documents: DataFrame, depth: int, chunks_per_doc: int, char_limit: int = INTRO_CHARS) -> DataFrame:
    """qid, doc_id, candidate_rank, candidate_score, chunk_rank, chunk_id, text of each pair to score.

    candidates: a ranking of documents; chunk_ranking: of chunks, by unit_id; a document without a ranked chunk is
    represented by its beginning.  Texts are joined last, to the chosen pairs only; the others are left where they are
    read.  A candidate that is no document is an error.
    """
    top = candidates.where(F.col("rank") <= depth).groupBy("qid", "doc_id").agg(F.min("rank").alias("candidate_rank"), F.max_by("score", -F.col("rank")).alias("candidate_score"))
    own = chunk_ranking.select("qid", "doc_id", F.col("unit_id").alias("chunk_id"), F.col("rank").alias("at")).join(top.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    own = own.withColumn("chunk_rank", F.row_number().over(W.partitionBy("qid", "doc_id").orderBy("at")).cast("long")).where(F.col("chunk_rank") <= chunks_per_doc)
    both = top.join(own.drop("at"), ["qid", "doc_id"], "left").withColumn("chunk_rank", F.coalesce("chunk_rank", F.lit(1).cast("long")))
    both = table(both, "pairs")
    chosen = lambda rows, key: rows.join(F.broadcast(both.select(key).distinct()), key, "left_semi")
    texts = chosen(chunk_texts.select(F.col("unit_id").alias("chunk_id"), F.col("text").alias("chunk_text")), "chunk_id")
    intro = chosen(documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.substring(F.coalesce("text", F.lit("")), 1, INTRO_CHARS).alias("intro")), "doc_id")
    told = both.join(texts, "chunk_id", "left").join(intro, "doc_id", "left")
    body = F.when(F.col("intro").isNull(), F.raise_error(F.concat(F.lit("no such document: "), "doc_id")).cast("string")).otherwise(F.coalesce("chunk_text", "intro"))
    return told.select("qid", "doc_id", "candidate_rank", "candidate_score", "chunk_rank", "chunk_id", pair_text(body, char_limit).alias("text"))


def scored_pairs(pair_rows: DataFrame, queries: DataFrame, scorer: Scorer = token_overlap) -> DataFrame:
    """The pairs with ce_score and text_hash, without text.  Each pair is scored once, at the greatest depth of the grid."""
    asked = pair_rows.join(queries, "qid")
    return asked.withColumns({"ce_score": scorer(F.col("question"), F.col("text")), "text_hash": F.xxhash64("text")}).drop("question", "text")


@dataclass(frozen=True)
class RerankConfig:
    name: str
    candidate: str
    model: str
    depth: int
    chunks_per_doc: int
    chunk_agg: str
    score_mode: str
    candidate_weight: float = 0.0


def rerank_grid(candidate: str, model: str, depths=(20, 50), chunks_per_doc=(1, 2), chunk_aggs=("max", "top2_mean"), score_modes=MODES, candidate_weights=(0.25,)) -> list[RerankConfig]:
    """All combinations; with one chunk a document only max makes sense, and only a blend has a weight."""
    out = []
    for depth, n, agg, mode in product(depths, chunks_per_doc, chunk_aggs, score_modes):
        if n == 1 and agg != "max":
            continue
        for weight in (0.0,) if mode == "ce" else candidate_weights:
            suffix = "" if mode == "ce" else f"_cw{number_label(weight)}"
            name = f"rerank_{slug(candidate, 48)}_{slug(model, 42)}_d{depth}_c{n}_{agg}_{mode}{suffix}"
            out.append(RerankConfig(name, candidate, model, depth, n, agg, mode, weight))
    return out


def reranked(scored: DataFrame, configs: list[RerankConfig]) -> DataFrame:
    """experiment, qid, rank, doc_id, score for every configuration, from one table of scored pairs."""
    for c in configs:
        if c.score_mode not in MODES:
            raise ValueError(f"unknown score mode: {c.score_mode}")
        if c.chunk_agg not in PAIR_AGGREGATIONS:
            raise ValueError(f"unknown aggregation of pairs: {c.chunk_agg}")
    spark = scored.sparkSession
    grid = spark.createDataFrame([(c.name, c.depth, c.chunks_per_doc, c.chunk_agg, c.score_mode, c.candidate_weight) for c in configs], "experiment string, depth int, n int, agg string, mode string, weight double")
    rows = scored.join(F.broadcast(grid), (F.col("candidate_rank") <= F.col("depth")) & (F.col("chunk_rank") <= F.col("n")))
    by = W.partitionBy("experiment", "qid", "doc_id").orderBy(F.col("ce_score").desc(), "chunk_rank")
    best = rows.withColumn("place", F.row_number().over(by)).where("place <= 2")
    s1, s2 = F.max(F.when(F.col("place") == 1, F.col("ce_score"))), F.max(F.when(F.col("place") == 2, F.col("ce_score")))
    docs = best.groupBy("experiment", "qid", "doc_id", "agg", "mode", "weight").agg(F.min("candidate_rank").alias("candidate_rank"), F.first("candidate_score").alias("candidate_score"), s1.alias("s1"), s2.alias("s2"))
    ce = F.when(F.col("agg") == "max", F.col("s1")).when(F.col("agg") == "top2_mean", (F.col("s1") + F.coalesce("s2", "s1")) / 2).otherwise(F.col("s1") + 0.2 * F.coalesce("s2", F.lit(0.0)))
    scaled = docs.withColumn("ce", ce).withColumns({"z_ce": z_score("ce", "experiment", "qid"), "z_candidate": z_score("candidate_score", "experiment", "qid")})
    blend = F.when(F.col("mode") == "ce", F.col("ce")).otherwise((1 - F.col("weight")) * F.col("z_ce") + F.col("weight") * F.col("z_candidate"))
    final = scaled.withColumn("score", blend)
    rank = F.row_number().over(W.partitionBy("experiment", "qid").orderBy(F.round("score", 9).desc(), "candidate_rank", "doc_id"))
    return final.select("experiment", "qid", rank.cast("long").alias("rank"), "doc_id", "score")
