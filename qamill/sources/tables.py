"""Scans of the provided parquet tables.

Each scan names the columns it needs, so the parquet reader only decodes those
(``ReadSchema`` in the plan) and filters written on top are pushed into it. A
scan is defined anew on every call: files added to a table are seen. Split sizes
are left to Spark's settings (``spark.sql.files.maxPartitionBytes``), so the
plan has one shape at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"no table {name!r} among {sorted(TABLES)}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every given table as a temp view for ``spark.sql``."""
    for name in TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
