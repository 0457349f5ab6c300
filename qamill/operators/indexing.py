"""Position numbering without funnelling a group into one task.

``row_number() over (partition by g order by o)`` sends every row of ``g`` to a
single task. A run, or the whole table when there is no group, can hold a large
share of all rows, so that window does not scale. ``dense_index`` computes the
same 0-based position with the work spread over range partitions:

1. range-partition the rows on ``(g, o)`` (``spark.sql.shuffle.partitions``
   ranges, coalesced by AQE) and sort inside each; a group may now span several partitions, each holding a contiguous
   slice of the global order;
2. tag rows with the partition id and ``monotonically_increasing_id`` (which
   increases by one per row inside a partition), and cut lineage with a
   reliable checkpoint in the shared checkpoint folder. Range bounds are
   sampled per execution, so without the checkpoint two uses of the tagged
   rows could disagree; after it they read the same files, also when an
   executor is lost;
3. a small table of per ``(g, partition)`` row counts and first ids gives each
   slice its offset (a running sum over earlier partitions of the group); it
   has at most ``groups + partitions`` rows and is joined on ``(g, partition)``, a
   key a hot group cannot skew (Spark broadcasts it where it measures small);
4. position = offset + id - first id.

One range shuffle of the rows, one checkpoint write, no second pass over the
upstream plan. The order must be total (unique within a group). Callers pass key
columns only and join the positions back (``number_keys``), so texts are
neither sorted nor checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qamill.session import materialize

_PID, _MID, _FIRST, _COUNT, _OFF = "_ix_pid", "_ix_mid", "_ix_first", "_ix_count", "_ix_off"


def dense_index(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str,
                descending: tuple[str, ...] = (),
                num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = 0-based position of each row inside its group, in the
    total order ``order_cols`` (ascending, except names in ``descending``)."""
    sort = [F.col(g).asc() for g in group_cols] + \
        [F.col(c).desc() if c in descending else F.col(c).asc() for c in order_cols]
    # Without an explicit count AQE may coalesce adjacent range partitions to
    # its advisory size; ids are assigned inside the one checkpointed run, so
    # a coalesced partition is still one contiguous, ordered slice.
    by_range = (df.repartitionByRange(num_partitions, *sort) if num_partitions
                else df.repartitionByRange(*sort))
    ranged = (by_range
              .sortWithinPartitions(*sort)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    ranged = materialize(ranged)
    counts = ranged.groupBy(*group_cols, _PID).agg(F.min(_MID).alias(_FIRST),
                                                    F.count(F.lit(1)).alias(_COUNT))
    earlier = Window.partitionBy(*group_cols).orderBy(_PID) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_ix_g{i}") for i, g in enumerate(group_cols)],
                            F.col(_PID).alias("_ix_p"), _FIRST,
                            F.coalesce(F.sum(_COUNT).over(earlier), F.lit(0)).alias(_OFF))
    cond = F.col(_PID) == F.col("_ix_p")
    for i, g in enumerate(group_cols):
        cond = cond & ranged[g].eqNullSafe(F.col(f"_ix_g{i}"))
    joined = ranged.join(offsets, cond, "inner")
    out = (F.col(_OFF) + F.col(_MID) - F.col(_FIRST)).cast("bigint").alias(out_col)
    return joined.select(*df.columns, out)


def number_keys(df: DataFrame, keys: DataFrame, group_cols: list[str], order_cols: list[str],
                out_col: str) -> DataFrame:
    """``df`` with the position of each row among ``keys``: a narrow table that has one
    row for each (group, order) value, of which ``df`` holds some or all. Group and
    order columns together identify a row, so the join back has no hot key."""
    cols = [*group_cols, *order_cols]
    numbered = dense_index(keys.select(*cols), group_cols, order_cols, out_col)
    names = [f"_nk{i}" for i in range(len(cols))]
    right = numbered.select(*[F.col(c).alias(n) for c, n in zip(cols, names)], out_col)
    cond = None
    for c, n in zip(cols, names):
        part = df[c].eqNullSafe(F.col(n))
        cond = part if cond is None else cond & part
    return df.join(right, cond, "inner").select(*df.columns, out_col)
