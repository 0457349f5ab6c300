"""Task specifications and their registry.

A task says where its question/answer samples come from and how an answer is
extracted from model output and checked against the gold answer. Extraction
and checking are Column expressions, so every scoring query built from a task
stays JVM-side; a task that truly needs Python returns a ``pandas_udf``
Column instead, as ``FRACTIONS`` does: scoring gives each side's texts a projection
of their own, so a side passes through Python once, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from re import ASCII, compile as pattern

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.functions import text as T


@dataclass(frozen=True)
class TaskSpec:
    name: str
    # (spark, sf_dir) -> raw samples: sample_id, split, question, answer
    raw_samples: Callable[[SparkSession, str], DataFrame]
    # model output -> extracted answer (nullable)
    extract: Callable[[Column], Column]
    # gold text -> value compared against (may equal the input)
    gold_value: Callable[[Column], Column]
    # (extracted, extracted as number, gold value, gold as number) -> boolean, never null
    check_parsed: Callable[[Column, Column, Column, Column], Column]
    # text -> nullable value used by the comparison (a double for numbers)
    to_number: Callable[[Column], Column]
    # text -> the form that ``to_number`` reads; a projection of its own, so it is made once a row
    number_text: Callable[[Column], Column] = lambda text: text

    def samples(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Load the samples: strip both fields, derive the gold value."""
        raw = self.raw_samples(spark, sf_dir)
        return (raw.withColumn("question", T.py_strip("question"))
                .withColumn("answer", T.py_strip("answer"))
                .withColumn("answer_value", self.gold_value(F.col("answer"))))

    def load_split(self, spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
        return self.samples(spark, sf_dir).where(F.col("split") == F.lit(split))

    def check(self, extracted: Column, gold: Column) -> Column:
        """Check any extracted text against a gold answer."""
        gv = self.gold_value(gold)
        return self.check_parsed(extracted, self.to_number(self.number_text(extracted)),
                                 gv, self.to_number(self.number_text(gv)))


def _gsm_raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qamill.sources.fixtures import qa_raw
    return qa_raw(spark, sf_dir)


GSM8K = TaskSpec(
    name="gsm8k",
    raw_samples=_gsm_raw_samples,
    extract=T.extract_answer,
    gold_value=T.gold_value,
    check_parsed=T.check_parsed,
    to_number=T.parsed_number,
    number_text=T.number_text,
)


_RATIONAL = pattern(r"[+-]?[0-9]+(\.[0-9]*)?|[+-]?\.[0-9]+|[+-]?[0-9]+/[0-9]+", ASCII)


def canonical_fraction(text: str | None) -> str | None:
    """``p/q`` in lowest terms of a whole number, a decimal or a fraction, else None. No exponents, so a short
    text has a short value; more digits than Python converts (some thousands) are no number."""
    if text is None or not _RATIONAL.fullmatch(text := text.strip()):
        return None
    try:
        value = Fraction(text)
    except (ValueError, ZeroDivisionError):
        return None
    return f"{value.numerator}/{value.denominator}"


def _canonical_fractions(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([canonical_fraction(x) for x in s], dtype=object)

    return run(text)


def _same_fraction(extracted: Column, fraction: Column, gold: Column, gold_fraction: Column) -> Column:
    """Equal values where both are numbers, else equal texts; never null."""
    both = fraction.isNotNull() & gold_fraction.isNotNull()
    return F.coalesce(F.when(both, fraction == gold_fraction)
                      .otherwise(T.py_strip(extracted) == T.py_strip(gold)), F.lit(False))


def _fraction_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qamill.sources.fixtures import fraction_raw
    return fraction_raw(spark, sf_dir)


#: Answers that are exact fractions: 3/8, 6/16 and 0.375 are one answer, 0.37 is another.
FRACTIONS = TaskSpec(
    name="fractions",
    raw_samples=_fraction_samples,
    extract=T.extract_answer,
    gold_value=T.gold_value,
    check_parsed=_same_fraction,
    to_number=_canonical_fractions,
)

_tasks: dict[str, TaskSpec] = {}


def register_task(spec: TaskSpec) -> None:
    """Make ``spec`` known under its name; a later task of the same name replaces it."""
    _tasks[spec.name] = spec


def task_names() -> list[str]:
    return sorted(_tasks)


def get_task(name: str) -> TaskSpec:
    """The task registered as ``name``; KeyError names the known ones."""
    try:
        return _tasks[name]
    except KeyError:
        raise KeyError(f"no task is registered as {name!r}; known: {task_names()}") from None


register_task(GSM8K)
register_task(FRACTIONS)
