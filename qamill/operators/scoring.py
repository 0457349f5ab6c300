"""Scoring generated outputs against gold answers (extraction, checking,
rewards, group-relative advantages, detail rows).

Plan shape: gold values are extracted on the sample side, once per sample row,
before the join; the output side is
joined on ``sample_id`` (AQE picks broadcast when the sample table measures
small, otherwise a sort-merge join whose skewed partitions it splits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qamill.functions import text as T
from qamill.operators.indexing import number_keys
from qamill.operators.tasks import GSM8K, TaskSpec

RUN_COLS = ["run_id", "experiment_name", "train_method", "train_chat_template",
            "train_mask_question", "eval_chat_template", "model_path", "task"]


def gold_table(samples: DataFrame, task: TaskSpec = GSM8K,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """sample_id, gold (value if truthy else full answer) and its prepared
    comparison forms, plus any ``carry`` sample columns."""
    gold = T.gold_select(F.col("answer_value"), F.col("answer"))
    g = samples.select("sample_id", *carry, gold.alias("gold"))
    gv = task.gold_value(F.col("gold"))
    g = g.withColumn("_gold_val", gv)
    return _parsed(g, "_gold_val", "_gold_num", task)


def _parsed(df: DataFrame, text: str, out: str, task: TaskSpec) -> DataFrame:
    """``df`` with the number ``out`` of a text: the text's cleaned form, read several times by the parser,
    is a projection of its own (Catalyst keeps it apart for that), so it is made once a row."""
    clean = df.withColumn("_clean", task.number_text(F.col(text)))
    return clean.withColumn(out, task.to_number(F.col("_clean"))).drop("_clean")


def with_extracted(outputs: DataFrame, task: TaskSpec = GSM8K) -> DataFrame:
    return outputs.withColumn("extracted_answer", task.extract(F.col("model_output")))


def score(outputs: DataFrame, samples: DataFrame, task: TaskSpec = GSM8K,
          how: str = "inner", carry: tuple[str, ...] = ()) -> DataFrame:
    """Outputs joined to their gold answer, with ``extracted_answer`` and
    ``correct``. ``how='left'`` keeps outputs without a sample (gold null).
    ``carry`` names sample columns to bring along in the same join."""
    return score_prepared(outputs, gold_table(samples, task, carry), task, how)


def score_prepared(outputs: DataFrame, gold: DataFrame, task: TaskSpec = GSM8K,
                   how: str = "inner") -> DataFrame:
    """``score`` against a gold side that ``gold_table`` has made."""
    ext = with_extracted(outputs, task)
    # parsed once here; the check reads it three times
    ext = _parsed(ext, "extracted_answer", "_ext_num", task)
    scored = ext.join(gold, "sample_id", how)
    correct = task.check_parsed(F.col("extracted_answer"), F.col("_ext_num"),
                                F.col("_gold_val"), F.col("_gold_num"))
    correct = F.when(F.col("gold").isNull(), F.lit(False)).otherwise(correct)
    return scored.withColumn("correct", correct).drop("_ext_num", "_gold_val", "_gold_num")


def first_outputs(outputs: DataFrame, order_cols: list[str]) -> DataFrame:
    """The output that an evaluation counts: the first of each (run, sample). A sort
    aggregate (its buffer holds a text), pre-combined in every task; it sorts by sample first, which tells rows
    apart without a look at the run's texts."""
    first = F.min_by(F.col("model_output"), F.struct(*order_cols))
    return outputs.groupBy("sample_id", *RUN_COLS).agg(first.alias("model_output"))


def reward(outputs: DataFrame, samples: DataFrame, task: TaskSpec = GSM8K) -> DataFrame:
    """1.0 for a correct completion, else 0.0; a completion whose sample has no
    gold answer gets 0.0 (left join keeps it)."""
    return reward_prepared(outputs, gold_table(samples, task), task)


def reward_prepared(outputs: DataFrame, gold: DataFrame, task: TaskSpec = GSM8K) -> DataFrame:
    """``reward`` against a gold side that ``gold_table`` has made."""
    scored = score_prepared(outputs, gold, task, how="left")
    return scored.withColumn(
        "reward", F.when(F.col("gold").isNotNull() & F.col("correct"), F.lit(1.0))
        .otherwise(F.lit(0.0)))


def reward_by_prompt(rewards: DataFrame) -> DataFrame:
    """Mean reward per prompt; partial aggregation runs before the shuffle."""
    return rewards.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_completions"),
        F.avg("reward").alias("mean_reward"))


def reward_by_run(rewards: DataFrame) -> DataFrame:
    """Mean reward per run (partial aggregation before the shuffle)."""
    return rewards.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_completions"),
        F.avg("reward").alias("mean_reward"))


def group_advantage(rewards: DataFrame, group_size: int = 4, eps: float = 1e-4,
                    digits: int = 9) -> DataFrame:
    """Group-relative advantage ``(r - mean) / (std + eps)`` over consecutive
    groups of ``group_size`` generations of the same prompt (sample std). A
    group of one has no spread: its std is 0 and its advantage 0.

    The window key ``(sample_id, group_id)`` holds at most ``group_size`` rows,
    so no window partition grows with the data."""
    g = rewards.withColumn("group_id", F.floor((F.col("gen_no") - 1) / group_size).cast("bigint"))
    w = Window.partitionBy("sample_id", "group_id")
    mean = F.avg("reward").over(w)
    std = F.coalesce(F.stddev_samp("reward").over(w), F.lit(0.0))
    return (g.withColumn("group_mean", mean)
            .withColumn("group_std", std)
            .withColumn("advantage", F.round((F.col("reward") - F.col("group_mean"))
                                             / (F.col("group_std") + F.lit(eps)), digits)))


DETAIL_CARRY = ("question", "gold_answer", "answer_value")


def detail_samples(samples: DataFrame) -> DataFrame:
    """Sample columns a detail row shows, in the shape ``score(carry=...)`` takes."""
    return samples.select("sample_id", "question", "answer_value",
                          F.col("answer").alias("gold_answer"), "answer")


def details_from_scored(scored: DataFrame, keys: DataFrame) -> DataFrame:
    """Detail rows with ``index``: the 0-based position of a sample inside its run. ``keys``
    has the (run_id, sample_id) pairs of the runs; only they are ranged and checkpointed."""
    rows = scored.withColumnRenamed("answer_value", "gold_value")
    rows = number_keys(rows, keys, ["run_id"], ["sample_id"], "index")
    return rows.select("run_id", "index", "sample_id", "question", "gold_answer",
                       "gold_value", "model_output", "extracted_answer", "correct")
