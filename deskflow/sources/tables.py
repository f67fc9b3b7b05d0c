"""Readers for the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


READ_PARTITIONS = "deskflow.read.partitions"  # session setting: spread every scanned table over so many tasks


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """Lazily scan one table; Catalyst prunes columns and pushes filters into it.

    A file of one row group is read by one task. A caller who wants its rows
    spread before CPU-heavy projections says so, with ``partitions`` or the
    session setting ``deskflow.read.partitions``; unset (the default) means
    the scan's own splits and no shuffle. Nothing is decided from sizes.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    table = spark.read.parquet(table_path(sf_dir, name))
    wanted = partitions or int(spark.conf.get(READ_PARTITIONS, None) or 0)
    return table.repartition(wanted) if wanted else table


def scan_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Load a corpus table from parquet, optionally with an explicit schema."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)
