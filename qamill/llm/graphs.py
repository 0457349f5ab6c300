"""Connected components and blocked groups for operators on pairs.

``components`` finds the connected components of an edge table by alternating
large-star and small-star steps: each node's edges are moved to the smallest
node it sees, first among larger neighbours, then among smaller ones, until
only stars are left. A step is a min per node (combined map-side) and one join back; the
minima are checkpointed, so the join has an exchange on both sides and
Spark may split a hub that holds most edges.

``blocked`` deals the members of groups to tasks so that every pair of a
group meets in exactly one place and no place holds more than two blocks:
a group over ``block`` members is cut into blocks by a hash of the member, and each
pair of blocks is a place of its own. ``places`` then reads sorted places
as a stream of arrays inside a task, and ``forest`` reduces the links found in
one place to one edge per linked member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.session import materialize

#: Members of one block; a place holds one block or two.
BLOCK = 1024


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of ``edges`` with the smallest node it can reach.
    An empty edge table gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .where("u <> v").distinct()
    e = materialize(e)
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                          .select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = (both.where("v > u").join(low, F.col("u") == F.col("n"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"))
                          .select(F.col("u").alias("n"), "m"))
        small = (large.join(low, F.col("u") == F.col("n")).where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
        e = materialize(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def blocked(members: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """``members`` (one row per group and member) with columns ``_i``, ``_j`` (the pair of
    blocks of a place) and ``_side`` (the member's block), sorted by place within
    partitions. The table of large groups is checkpointed, so the join that numbers their
    blocks has an exchange on both sides and Spark may split a hot group there."""
    big = materialize(members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
                      .where(F.col("_n") > block)
                      .select(F.col(group).alias("_g"),
                              F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocks")))
    sided = (members.join(big, F.col(group) == F.col("_g"), "left")
             .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
             .withColumn("_side", F.pmod(F.xxhash64(member, F.lit(3)), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)"))))
    return (sided.withColumn("_i", F.least("_side", "_other"))
            .withColumn("_j", F.greatest("_side", "_other")).drop("_g", "_blocks", "_other")
            .repartition(F.col(group), F.col("_i"), F.col("_j"))
            .sortWithinPartitions(group, "_i", "_j"))


def places(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole places from sorted batches: a place that spans batches is put together; each
    frame handed out holds one or many whole places."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(new):
            yield pd.concat([*held, batch.iloc[:new[-1]]], ignore_index=True)
            held = [batch.iloc[new[-1]:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def candidate_pairs(place: np.ndarray, side: np.ndarray,
                    same_block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the same place, ``place`` being sorted place numbers: each pair of
    different blocks, or of one block where the place is one block with itself."""
    n, step = len(place), 1
    left = np.arange(n)
    while len(left):
        left = left[left + step < n]
        left = left[place[left] == place[left + step]]
        right = left + step
        wanted = same_block[left] | (side[left] != side[right])
        yield left[wanted], right[wanted]
        step += 1


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows 0..n-1 with links (a, b): the rows that aren't the first of their
    component, and the first row of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def place_numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Numbers 0, 1, ... of the places of a sorted frame."""
    k = frame[keys].to_numpy()
    return np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
