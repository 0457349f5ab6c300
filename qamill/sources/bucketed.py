"""Outputs and gold answers as tables bucketed by sample, for scoring the same samples again and again.

The gold side is prepared and reduced to one row a sample once, when it is written. Both tables have the
same number of buckets on ``sample_id``, so a join of them, and an aggregate by sample above it, reads the
buckets as they lie: nothing is shuffled, whatever the size of either side. A sample with very many outputs is
one bucket's; tables where one sample holds a large share of all outputs are better scored by
``scoring.reward``, whose join Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.operators import scoring
from qamill.operators.tasks import GSM8K, TaskSpec

#: Buckets of a table unless the caller says otherwise; both sides need the same number.
BUCKETS = 64


def _write(df: DataFrame, table: str, path: str, buckets: int) -> None:
    # one task a bucket, so a bucket is one file
    (df.repartition(buckets, "sample_id").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "sample_id").sortBy("sample_id").saveAsTable(table))


def write_gold(samples: DataFrame, table: str, path: str, task: TaskSpec = GSM8K,
               buckets: int = BUCKETS) -> None:
    """The prepared gold side (``scoring.gold_table``), one row a sample: of several rows of one
    ``sample_id`` the one with the least gold text counts. Samples without an id have no bucket to be found in
    and are left out."""
    gold = scoring.gold_table(samples.where(F.col("sample_id").isNotNull()), task)
    others = [c for c in gold.columns if c != "sample_id"]
    one = gold.groupBy("sample_id").agg(F.min(F.struct(*others)).alias("_g"))
    _write(one.select("sample_id", *[F.col(f"_g.{c}").alias(c) for c in others]), table, path, buckets)


def write_outputs(outputs: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Outputs as they are, all columns and all rows."""
    _write(outputs, table, path, buckets)


def reward_tables(spark: SparkSession, outputs: str, gold: str, task: TaskSpec = GSM8K) -> DataFrame:
    """``scoring.reward`` of two bucketed tables."""
    return scoring.reward_prepared(spark.table(outputs), spark.table(gold), task)
