"""The experiment grid: experiments x evaluation formats, name selection, and
the grid cells that have no evaluation result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.functions import text as T

CELL_KEYS = ["name", "eval_chat_template"]


def select_experiments(experiments: DataFrame, names: list[str]) -> DataFrame:
    """Exact-name selection; unknown names are dropped silently, but an empty
    selection is an error that lists what exists. The check reads only the
    experiment dimension (a handful of rows)."""
    chosen = experiments.where(F.col("name").isin(names))
    if chosen.isEmpty():
        available = [r.name for r in experiments.select("name").orderBy("ordinal").collect()]
        raise ValueError(f"none of {names} is an experiment; there are {available}")
    return chosen


def grid(experiments: DataFrame) -> DataFrame:
    """Every experiment evaluated with and without the chat template, chat
    first; the second dimension is a generator, not a join."""
    g = experiments.select("*", F.posexplode(F.array(F.lit(True), F.lit(False)))
                           .alias("eval_order", "eval_chat_template"))
    return (g.withColumn("eval_order", F.col("eval_order").cast("bigint"))
            .withColumn("eval_name", T.eval_run_name(F.col("name"), F.col("eval_chat_template"))))


def _run_cells(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("experiment_name").alias("name"), "eval_chat_template", "run_id",
                       "accuracy")


def with_results(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """Grid cells with the run that evaluated them (null when none did). Both
    sides are small: the grid is the experiment dimension times two, the runs
    side one row per evaluation run; AQE broadcasts from measured sizes."""
    return cells.join(_run_cells(runs), CELL_KEYS, "left")


def missing(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """Cells with no evaluation result."""
    return cells.join(_run_cells(runs), CELL_KEYS, "left_anti")
