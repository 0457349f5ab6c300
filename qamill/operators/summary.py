"""Run summaries (totals, correct, accuracy) and run-metadata enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.functions import text as T
from qamill.operators.scoring import RUN_COLS

SUMMARY_COLS = ["experiment_name", "train_method", "train_chat_template",
                "train_mask_question", "eval_chat_template", "model_path", "task",
                "total_samples", "correct", "accuracy"]


def accuracy(correct, total):
    """``correct / total``, 0.0 for an empty input."""
    return F.coalesce(F.try_divide(correct.cast("double"), total), F.lit(0.0))


def run_summary(scored: DataFrame, requested: DataFrame | None = None,
                run_cols: list[str] | None = None) -> DataFrame:
    """One row per run. A hash aggregate: every task pre-aggregates its rows
    (partial count / count_if) before the shuffle, so a run holding most of the
    rows costs one small row per task, not one big task.

    ``requested`` holds the samples that every run was asked for: their number is the
    total, so samples without an output count as wrong. Without it (a stream) the total
    is the number of scored rows. ``scored`` has one row for each run and sample."""
    cols = run_cols or RUN_COLS
    agg = scored.groupBy(*cols).agg(F.count(F.lit(1)).alias("total_samples"),
                                    F.count_if(F.col("correct")).alias("correct"))
    if requested is not None:
        total = requested.agg(F.count(F.lit(1))).scalar()
        agg = agg.withColumn("total_samples", total)
    return agg.withColumn("accuracy", accuracy(F.col("correct"), F.col("total_samples")))


def overall_summary(scored: DataFrame) -> DataFrame:
    """Global totals; unlike a grouped aggregate this yields a row (accuracy
    0.0) for an empty input."""
    agg = scored.agg(F.count(F.lit(1)).alias("total_samples"),
                     F.count_if(F.col("correct")).alias("correct"))
    return agg.withColumn("accuracy", accuracy(F.col("correct"), F.col("total_samples")))


def enrich_runs(summaries: DataFrame, run_info: DataFrame) -> DataFrame:
    """Fill training metadata from the run-info dimension: an explicit value
    wins; an empty method is inferred from the config path; a false flag takes
    the stored flag, a stored null included. Runs without metadata keep their values. Of
    several metadata rows for one model the greatest counts, so a run stays one row."""
    fields = ["original_config_path", "use_chat_template", "mask_question"]
    info = run_info.groupBy("model_path").agg(F.max(F.struct(*fields)).alias("_m")) \
        .select("model_path", *[F.col(f"_m.{c}").alias(c) for c in fields])
    info = info.select(F.col("model_path").alias("_ri_path"),
                           F.col("original_config_path").alias("_ri_cfg"),
                           F.col("use_chat_template").alias("_ri_chat"),
                           F.col("mask_question").alias("_ri_mask"),
                           F.lit(True).alias("_ri_found"))
    j = summaries.join(info, summaries.model_path == info._ri_path, "left")
    found = F.coalesce(F.col("_ri_found"), F.lit(False))
    inferred = F.coalesce(T.infer_method(F.coalesce(F.col("_ri_cfg"), F.lit(""))),
                          F.col("train_method"))
    method = F.when(found & (F.coalesce(F.col("train_method"), F.lit("")) == ""), inferred) \
        .otherwise(F.col("train_method"))
    chat = F.when(found & ~F.coalesce(F.col("train_chat_template"), F.lit(False)),
                  F.col("_ri_chat")) \
        .otherwise(F.col("train_chat_template"))
    mask = F.when(found & ~F.coalesce(F.col("train_mask_question"), F.lit(False)),
                  F.col("_ri_mask")) \
        .otherwise(F.col("train_mask_question"))
    return (j.withColumn("train_method", method)
            .withColumn("train_chat_template", chat)
            .withColumn("train_mask_question", mask)
            .drop("_ri_path", "_ri_cfg", "_ri_chat", "_ri_mask", "_ri_found"))
