"""Input tables, their validation, and the files that runs leave."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id string, text string"
TRAIN = "qid string, question string, gold_doc_id string, ideal_answer string, gold_evidence_text string, gold_evidence_char_start int, gold_evidence_char_end int, topic string"
TEST = "qid string, question string"
SAMPLE = "qid string, doc_id string"
#: File name and schema of each input (fixed values).
INPUTS = {"documents": ("documents.csv", DOCUMENTS), "train": ("train.csv", TRAIN), "test": ("test.csv", TEST), "sample_submission": ("sample_submission.csv", SAMPLE)}
REQUIRED = {name: [c.split()[0] for c in schema.split(", ")] for name, (_, schema) in INPUTS.items()}


@dataclass(frozen=True)
class Layout:
    """Where inputs are and where a run writes; any file system that Spark knows."""

    root: str

    def input(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{INPUTS[name][0]}"

    def artifact(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), "artifacts", *parts))

    @property
    def metrics(self) -> str:
        return self.artifact("reports", "metrics")

    @property
    def submissions(self) -> str:
        return self.artifact("submissions")

    def require_inputs(self, spark: SparkSession) -> None:
        """FileNotFoundError that names every missing input."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        missing = []
        for name in INPUTS:
            path = hadoop.Path(self.input(name))
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                missing.append(self.input(name))
        if missing:
            raise FileNotFoundError("missing input files: " + ", ".join(missing))

    def ensure_dirs(self, spark: SparkSession) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for folder in (self.metrics, self.submissions):
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


@dataclass(frozen=True)
class Bundle:
    documents: DataFrame
    train: DataFrame
    test: DataFrame
    sample_submission: DataFrame | None = None

    def validated(self) -> Bundle:
        for name in ("documents", "train", "test"):
            missing = missing_columns(getattr(self, name), REQUIRED[name])
            if missing:
                raise ValueError(f"{name} lacks columns: {missing}")
        twice = [r["doc_id"] for r in duplicate_docs(self.documents).orderBy("doc_id").limit(5).collect()]
        if twice:
            raise ValueError(f"documents have repeated doc_id: {twice}")
        unknown = [r["gold_doc_id"] for r in unknown_gold(self.train, self.documents).orderBy("gold_doc_id").limit(5).collect()]
        if unknown:
            raise ValueError(f"gold_doc_id not among documents: {unknown}")
        return self


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Texts hold line breaks and quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def load_bundle(spark: SparkSession, root: str, validate: bool = True) -> Bundle:
    layout = Layout(root)
    layout.require_inputs(spark)
    bundle = Bundle(**{name: read_csv(spark, layout.input(name), schema) for name, (_, schema) in INPUTS.items()})
    return bundle.validated() if validate else bundle


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- validators ----------------------------------------------------------------------------------------------------------


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def present_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in the wanted order."""
    return df.select(*(F.col(f"`{c}`") for c in wanted if c in df.columns))


def duplicate_docs(documents: DataFrame) -> DataFrame:
    return documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_gold(train: DataFrame, documents: DataFrame) -> DataFrame:
    """Gold documents that there are none of."""
    known = documents.select(F.col("doc_id").cast("string").alias("d"))
    gold = train.select(F.col("gold_doc_id").cast("string").alias("gold_doc_id")).distinct()
    return gold.join(known, F.col("gold_doc_id") == F.col("d"), "left_anti")


def evidence_errors(train: DataFrame, documents: DataFrame) -> DataFrame:
    """qid, doc_id, expected, found where the evidence's offsets do not give the evidence's text."""
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("whole"))
    rows = train.select("qid", F.col("gold_doc_id").cast("string").alias("doc_id"), F.col("gold_evidence_text").alias("expected"), F.col("gold_evidence_char_start").alias("s"), F.col("gold_evidence_char_end").alias("e"))
    found = rows.join(docs, "doc_id").withColumn("found", F.substr("whole", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")))
    return found.where("not (expected <=> found)").select("qid", "doc_id", "expected", "found")


# --- sinks ---------------------------------------------------------------------------------------------------------------


def jsonable(value):
    """value with dataclasses, paths, tuples and sets as what JSON has."""
    if is_dataclass(value) and not isinstance(value, type):
        return jsonable(asdict(value))
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(map(jsonable, value), key=str)
    return str(value) if isinstance(value, Path) else value


def params_json(params: dict) -> str:
    return json.dumps(jsonable(params), ensure_ascii=False, sort_keys=True)


def append_jsonl(df: DataFrame, folder: str) -> None:
    """Adds rows to a folder of JSON lines; earlier lines stay."""
    df.write.mode("append").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
