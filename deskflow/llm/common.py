"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing
    the stage) and lets several consumers use one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already.

    What ``--py-files`` does at submit time; needed where only the driver's path
    holds the repository. Once per application.
    """
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get("deskflow.shipped", None):
        return
    path = Path(tempfile.mkdtemp(prefix="deskflow-py-")) / "deskflow.zip"  # the driver's file server hands it out
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "deskflow").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.conf.set("deskflow.shipped", "true")


def lean(run: Callable) -> Callable:
    """``run`` (a task's function over Arrow batches), giving its freed memory back to the system when it ends.

    Spark keeps Python workers for the next task; without this, each holds on
    to the most that any of its tasks needed, beside the executor's own memory.
    """
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # only the C library of Linux has it
                pass
    return task


def document_columns(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string); other columns, whatever their names, are ignored."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def crc_fold(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_rows(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each value (null: empty), without building Python strings."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece hold about ``max_bytes``.

    A single larger text stays whole in a piece of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        piece = np.cumsum(sizes) // max_bytes
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    from ..sources.tables import read_table
    ship_package(spark)
    return read_table(spark, sf_dir, name)
