"""Tables that several queries of a run read: written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A folder of this run in the session's spark.checkpoint.dir, removed at the end.  One of our own only where that is
    unset on one machine; a cluster's executors would each write to their own disk, so there it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="rankforge-")
        _own[app] = f"{named.rstrip('/')}/rankforge-tables-{app}"
        atexit.register(_forget, spark, _own[app])
    return _own[app]


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before: nothing is left to ask
        pass


def table(df: DataFrame, label: str) -> DataFrame:
    """df's rows as a table."""
    path = f"{_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
