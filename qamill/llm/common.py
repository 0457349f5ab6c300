"""Helpers shared by the training-data operators.

Scans name their columns, labels are read under one rule (hash folds of the
document id), and a fitted model reaches the tasks as a broadcast of stated
size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; whole texts are long, so batches are kept small.
ARROW_ROWS = "2000"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of ``sf_dir``, narrowed to ``columns`` (all when none is named)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def aside(df: DataFrame, *inputs: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """Columns with a leading underscore, which operators name their working columns with, out of the way.

    ``df`` with such columns renamed, the new names of ``inputs``, and a function that gives a result's columns
    their old names back."""
    names = {c: f"_{k}_{c}" for k, c in enumerate(df.columns) if c.startswith("_")}
    back = {v: k for k, v in names.items()}
    return (df.withColumnsRenamed(names), [names.get(c, c) for c in inputs],
            lambda out: out.withColumnsRenamed(back))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def smallest_hashes(ids: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` distinct ``key`` values with the smallest hash: a sample that
    depends on the values alone (top-n in every task, then one merge of n rows)."""
    return (ids.where(F.col(key).isNotNull()).select(key).distinct()
            .orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n))


def fetch_texts(docs: DataFrame, ids: Sequence[int], max_chars: int) -> list[tuple]:
    """(doc_id, text) of the named rows in the order of ``ids``, whole texts only and at most
    ``max_chars`` characters: a text that does not fit any more is passed over, and those
    after it that fit are taken. ``ids`` is a sample of bounded size, so it is broadcast; one
    row is taken for a repeated id."""
    if not ids:
        return []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(int(i), k) for k, i in enumerate(ids)],
                                   "doc_id bigint, _rank int")
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    by_rank = found.groupBy("_rank")
    sizes = sorted((r[0], r[1]) for r in by_rank.agg(
        F.max(F.coalesce(F.length("text"), F.lit(0)))).collect())
    total, taken = 0, []
    for rank, chars in sizes:
        if total + chars <= max_chars:
            total += chars
            taken.append((rank, chars))
    got: dict[int, tuple] = {}
    if not taken:
        return []
    # the longest text of a repeated id, whose length was counted
    fits = spark.createDataFrame(taken, "_rank int, _chars int")
    rows = found.join(F.broadcast(fits), "_rank") \
        .where(F.coalesce(F.length("text"), F.lit(0)) == F.col("_chars")).groupBy("_rank") \
        .agg(F.first("doc_id"), F.max(F.coalesce("text", F.lit("")))).collect()
    for rank, doc_id, text in rows:
        got[rank] = (doc_id, text)
    return [got[k] for k in sorted(got)]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int,
                    max_chars: int, folds: int = 5, held_out: int = 0, seed: int = 11,
                    classes: Sequence[int] = (0, 1)) -> dict[int, list[str]]:
    """Texts of a bounded sample of labelled rows, by class.

    Only label rows outside the held-out fold are read. Per class the
    ``per_class`` ids of smallest hash are taken, and of those, by rank, the ones whose
    whole texts still fit ``max_chars`` characters together. Rows that carry
    contradicting labels for one id are left out."""
    lab = (labels.where(F.col(column).isin(*classes) & (fold("doc_id", folds) != held_out))
           .groupBy("doc_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
           .where("lo = hi"))
    out = {}
    for c in classes:
        ids = [r[0] for r in smallest_hashes(lab.where(F.col("lo") == c), "doc_id",
                                             per_class, seed).collect()]
        out[c] = [t for _, t in fetch_texts(docs, ids, max_chars)]
    return out
