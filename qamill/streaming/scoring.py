"""Scoring generated outputs as they arrive.

Scoring is stateless apart from the gold lookup, so the batch operator runs
unchanged on a stream: a stream-static join against the (static) sample
table, then extraction and checking. Per-run totals are a streaming
aggregation whose state is one row per run.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from qamill.operators import scoring, summary
from qamill.operators.tasks import GSM8K, TaskSpec
from qamill.session import checkpoint_dir


def score_stream(outputs: DataFrame, samples: DataFrame, task: TaskSpec = GSM8K) -> DataFrame:
    """Streaming outputs joined to static samples, with ``extracted_answer``
    and ``correct`` (the same expressions as the batch path)."""
    return scoring.score(outputs, samples, task)


def summary_stream(scored: DataFrame) -> DataFrame:
    """Running per-run totals (use output mode ``complete`` or ``update``)."""
    return summary.run_summary(scored)


def start_scoring(spark: SparkSession, outputs_dir: str, outputs_schema, samples: DataFrame,
                  sink_dir: str, name: str = "scored_outputs",
                  task: TaskSpec = GSM8K) -> StreamingQuery:
    """Score parquet files landing in ``outputs_dir`` into ``sink_dir``.

    The query's checkpoint lives under the session's shared checkpoint folder,
    so a restarted driver resumes where it stopped."""
    stream = spark.readStream.schema(outputs_schema).parquet(outputs_dir)
    scored = score_stream(stream, samples, task)
    location = os.path.join(checkpoint_dir(spark), "streams", name)
    return (scored.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", location)
            .start(sink_dir))
