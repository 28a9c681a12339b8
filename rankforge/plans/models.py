"""Encoders for dense and hybrid experiments: pandas UDFs around models, loaded once in each Python worker."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentence_encoder(rows: DataFrame, config: dict, is_query: bool) -> DataFrame:
    """rows with vector, from a sentence-transformers model."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as e:
        raise ImportError("dense retrieval needs the package sentence-transformers") from e
    import pandas as pd

    name, batch = config["model_name"], int(config.get("batch_size", 32))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.tolist(), batch_size=batch)))

    prefix = config.get("query_prefix" if is_query else "passage_prefix", "")
    return rows.withColumn("vector", F.pandas_udf(encode, "array<float>")(F.concat(F.lit(prefix), F.col("text"))))


def dense_lexical_encoder(rows: DataFrame, config: dict, is_query: bool) -> DataFrame:
    """rows with vector and weights, from a model that gives both."""
    try:
        import FlagEmbedding  # noqa: F401
    except ImportError as e:
        raise ImportError("hybrid retrieval needs the package FlagEmbedding") from e
    import pandas as pd

    batch, length = int(config.get("batch_size", 4)), int(config.get("max_length", 2048))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from FlagEmbedding import BGEM3FlagModel

        model = BGEM3FlagModel(config.get("model_name", "BAAI/bge-m3"))
        for texts in batches:
            got = model.encode(texts.tolist(), batch_size=batch, max_length=length, return_dense=True, return_sparse=True)
            yield pd.DataFrame({"vector": list(got["dense_vecs"]), "weights": [{str(k): float(v) for k, v in w.items()} for w in got["lexical_weights"]]})

    both = F.pandas_udf(encode, "vector array<float>, weights map<string,float>")
    return rows.withColumn("m", both("text")).select(*rows.columns, "m.vector", "m.weights")
