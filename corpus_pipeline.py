"""Corpus preparation: toxicity, language, near-duplicates, benchmark leaks, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``, whatever they are, for the rows they
keep. ``run`` applies them to ``documents``.

What goes, stage by stage: documents scored toxic (0.5 or more); documents without a
determined language, or whose stated language differs from a confident prediction (score of
``LANGUAGE_SCORE`` or more); all but one document of each group of near-duplicates (the smallest
doc_id stays); documents that hold a benchmark item. The last stage packs what is left. A null
text has no toxic evidence and no language: the language stage drops it. Empty inputs give empty
outputs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.llm import decontamination, language_id, packing, simhash_dedup, toxicity
from qamill.llm.common import table
from qamill.session import checkpoint_dir

#: A stated language gives way to a prediction of at least this score.
LANGUAGE_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the field scores below 0.5."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.where(F.col("score") < 0.5).select("row.*")


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a determined language that their stated one doesn't contradict."""
    model = language_id.fit(language_id.training_rows(docs.select("doc_id", "text", "lang")))
    named = language_id.predict(docs.select(F.struct("*").alias("row"), "text"), model)
    differs = F.coalesce(F.col("row.lang") != F.col("lang_pred"), F.lit(False)) \
        & (F.col("score") >= LANGUAGE_SCORE)
    return named.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~differs).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash_dedup.dedup(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_undetermined),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No SQL can express the trained stages; the tests hold each stage to its expected rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
