"""Shared helpers of the training-data operators: reading, lineage cuts, word splitting, hashing.

Words are everywhere the maximal runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` breaks at
exactly those six ASCII characters, so Python code splits UTF-8 bytes and never ``str``.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and broadcasts of steps that nothing refers to any more: it does so when the driver collects its garbage.

    Python's references to the driver's objects are let go in another thread, after a first collection; a second one finds them gone.
    """
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def give_back() -> None:
    """Return freed memory to the system, where the C library can; Python workers outlive their tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work (for mapInArrow) that gives back at its end what it no longer holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def placed(docs: DataFrame) -> DataFrame:
    """__doc (a struct of all columns of docs) and __place, a string that names the row in its file.

    The place is the same whenever the table is read. What is not a table of files is written first.
    """
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("__place")
    try:
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), place)
    except AnalysisException:
        docs = written(docs)
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), place)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def n_words(text: Column) -> Column:
    """Number of words as long; null gives 0."""
    return F.size(words(text)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
