"""Comparison report over run summaries: labels, first-wins per eval format,
grouped chat/raw accuracies, chat-vs-raw pairs, label order, best accuracy.

Inputs are run summaries (one row per evaluation run), so every table here is
already aggregated to run granularity before these operators see it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qamill.functions import text as T


def with_labels(runs: DataFrame) -> DataFrame:
    """Adds ``train_label`` and ``label``; missing columns count as null
    (null method -> ``?``, null flags -> ``raw`` / no ``mask_q``)."""
    def col(c):
        return F.col(c) if c in runs.columns else F.lit(None)
    return runs.withColumn(
        "train_label", T.train_label(col("train_method"), col("train_chat_template"),
                                     col("train_mask_question"))
    ).withColumn(
        "label", T.full_label(col("train_method"), col("train_chat_template"),
                              col("train_mask_question"), col("eval_chat_template")))


def comparison(runs: DataFrame) -> DataFrame:
    """The comparison table in report order (run directory ascending)."""
    return with_labels(runs).orderBy("eval_dir")


def _firsts(labelled: DataFrame) -> DataFrame:
    """Per (train label, eval flag): the first row by ``eval_dir``."""
    first = F.min_by(F.struct("eval_dir", "accuracy"), F.col("eval_dir"))
    return labelled.groupBy("train_label", "eval_chat_template").agg(first.alias("_f")) \
        .select("train_label", "eval_chat_template", F.col("_f.eval_dir").alias("eval_dir"),
                F.col("_f.accuracy").alias("accuracy"))


def first_per_format(labelled: DataFrame) -> DataFrame:
    """First row (by ``eval_dir``) of each (train label, eval format); later
    duplicates are ignored. Rows whose eval flag is null belong to neither
    format. ``min_by`` is a hash aggregate with partial aggregation."""
    return _firsts(labelled).where(F.col("eval_chat_template").isNotNull())


def _label_rank(df: DataFrame) -> DataFrame:
    # one row per training label: a table bounded by the number of runs
    w = Window.orderBy("first_dir", "train_label")
    return df.withColumn("label_order", F.row_number().over(w).cast("bigint"))


def label_order(labelled: DataFrame) -> DataFrame:
    """Distinct training labels in first-appearance (``eval_dir``) order."""
    firsts = labelled.groupBy("train_label").agg(F.min("eval_dir").alias("first_dir"))
    return _label_rank(firsts)


def _sides(labelled: DataFrame) -> DataFrame:
    """Per training label: first chat and first raw accuracy (null when that
    side is missing) and the label's first directory -- one pass over the
    runs, two small aggregates."""
    f = _firsts(labelled)
    return f.groupBy("train_label").agg(
        F.max(F.when(F.col("eval_chat_template"), F.col("accuracy"))).alias("chat_accuracy"),
        F.max(F.when(~F.col("eval_chat_template"), F.col("accuracy"))).alias("raw_accuracy"),
        F.min("eval_dir").alias("first_dir"))


def grouped(labelled: DataFrame) -> DataFrame:
    """Per training label: chat and raw accuracy, 0.0 when a side is missing,
    with the label's first-appearance order."""
    s = _label_rank(_sides(labelled))
    return s.select("train_label", F.coalesce("chat_accuracy", F.lit(0.0)).alias("chat_accuracy"),
                    F.coalesce("raw_accuracy", F.lit(0.0)).alias("raw_accuracy"), "label_order")


def chat_raw_pairs(labelled: DataFrame) -> DataFrame:
    """Labels evaluated in both formats, with both accuracies."""
    s = _sides(labelled)
    return s.where(F.col("chat_accuracy").isNotNull() & F.col("raw_accuracy").isNotNull()) \
        .select("train_label", F.col("chat_accuracy").alias("chat"), F.col("raw_accuracy").alias("raw"))


def best_accuracy(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("accuracy").alias("max_accuracy"))
