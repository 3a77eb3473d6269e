"""What the training-data operators share: reading tables, sizing shuffles from data, folders, blobs."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one task of a group-wise operator should get, and beyond so many tasks.
TASK_BYTES, MANY_TASKS, LARGE_TASK_BYTES = 12 << 20, 4096, 256 << 20
#: Text bytes of a group, and of a slice of an Arrow batch: what Python holds at once.
GROUP_BYTES, SLICE_BYTES = 3 << 20, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where it is unset and all run on this machine."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="noetica-shared-")
        spark.conf.set("spark.checkpoint.dir", have)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(have)
    return have


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(table: DataFrame) -> None:
    """Gives back the room of a table that written() has made, once nothing reads it any more."""
    spark, (path,) = table.sparkSession, {f.rpartition("/")[0] for f in table.inputFiles()} or {None}
    if path:
        spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one column scan and a one-row aggregate."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def tasks_for(n_bytes: int) -> int:
    """Small tasks while they are few, large ones from then on."""
    small = max(8, math.ceil(n_bytes / TASK_BYTES))
    return small if small <= MANY_TASKS else max(MANY_TASKS, math.ceil(n_bytes / LARGE_TASK_BYTES))


def groups_for(n_bytes: int) -> int:
    """Groups of one size, however large the input; also the buckets of values that groups exchange."""
    return max(8, math.ceil(n_bytes / GROUP_BYTES))


def _gid(n_bytes: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(groups_for(n_bytes))).cast("int").alias("gid")


def grouped_documents(docs: DataFrame, n_bytes: int, seed: int = 7) -> DataFrame:
    """(gid, doc_id, text), dealt into random groups by id and text.

    The one shuffle of whole texts: every later join on gid finds this partitioning in place.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(_gid(n_bytes, seed), "doc_id", "text").repartition(tasks_for(n_bytes), "gid")


def carried_documents(docs: DataFrame, n_bytes: int, seed: int = 7) -> DataFrame:
    """(gid, doc_id, text, rest): as grouped_documents, with all other columns in the struct `rest`, whatever their names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    return rows.select(_gid(n_bytes, seed), "doc_id", "text", "rest").repartition(tasks_for(n_bytes), "gid")


def uncarried(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` from (text, rest)."""
    return df.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in like.columns])


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is a column, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def released() -> None:
    """Gives what a worker has freed back to the system: groups differ in size, and workers outlive stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The texts, nulls as empty."""
    return [t or "" for t in column.to_pylist()]


def batches(items: list, sizes: list[int], limit: int):
    """Slices (start, end) of consecutive items of at most `limit` in size together, single larger items alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(items):
        yield start, len(items)


def sliced(arrived, column: str | int = "text"):
    """The Arrow batches in slices of SLICE_BYTES of text at most, single longer texts alone: a batch has 10,000 rows of any length."""
    for batch in arrived:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        for a, b in batches(sizes, [n or 0 for n in sizes], SLICE_BYTES):
            yield batch.slice(a, b - a)


def binary_rows(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary array whose row i is data[offsets[i]:offsets[i + 1]]."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of five; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
