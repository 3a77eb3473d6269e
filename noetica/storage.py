"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all run on this machine."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="noetica-shared-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage as cut() does, in columns and compressed."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(table: DataFrame) -> None:
    """Gives back the room of a table that kept() has made, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, or None: a table to which no row was ever written has no files."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path; one without rows of a schema if there is none yet."""
    have = there(spark, path)
    return spark.createDataFrame([], schema) if have is None else have


_MADE: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], *by: str) -> DataFrame:
    """A table that is derived from the tables of a source: written by the first who asks in an application, read by all others.

    by: columns that the table is partitioned by.
    """
    key = (spark.sparkContext.applicationId, source, name)
    have = there(spark, _MADE[key]) if key in _MADE else None
    if have is None:
        path = new_path(spark, name)
        build().write.partitionBy(*by).parquet(path)
        _MADE[key], have = path, spark.read.parquet(path)
    return have
