"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: the text's A-Z are lowered, words are maximal runs of bytes
other than ASCII white space, shingles are ``words`` words joined by one space (the
whole sequence when there are fewer, repeats included); bit k is 1 if more
than half of the shingles' XXH64 (seed 42) have it. No word: zero.

Pairs: equal fingerprints form one class. A class's fingerprint is cut into
32 segments of 2 bits, and its embedding is the number of ones in each segment. The
Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so fingerprints within ``distance`` bits are within that
distance in the embedding, and within half of it on one half of the segments. The
grid has a cell for each embedding of a half; a class is posted to every
cell within ``reach`` = ceil(distance / 4) steps of its own, so any two classes within
2 * reach on that half meet in a cell: a midpoint of a shortest lattice path between
them is within reach of both. In a cell, pairs pass the Manhattan bound over all
32 segments (thermometer-coded, so one xor and popcount) and are then verified on
the fingerprints. A cell with many classes is split into pairs of blocks, and each place
emits a spanning forest of its links, never all pairs; connected components follow.

Defined results: null and empty texts, and texts of white space only, have
fingerprint zero and link like any other; rows with a null id are
fingerprinted and grouped, and never name a group (a group of such rows only has a
null component); repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import table
from qamill.llm.graphs import (BLOCK, blocked, candidate_pairs, components, forest, place_numbers,
                               places)
from qamill.session import materialize

SEED = 42
WORDS = 4
DISTANCE = 4
SEGMENTS = 32
HALF = SEGMENTS // 2

_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    if not text:
        return 0
    w = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if not n:
        return 0
    line = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:n - words] + 1]).tolist()
    h = np.fromiter([digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1:].tolist())],
                    dtype="<u8", count=n - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):  # bounded memory for long texts
        bits = np.unpackbits(h[k:k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp",
                 words: int = WORDS) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer of the same bits."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(x, words) for x in s], dtype=np.uint64)
                            .view(np.int64))

    return docs.withColumn(out, run(F.col(text)))


def embed(fp: np.ndarray) -> np.ndarray:
    """Thermometer code of the segment popcounts: in each 2-bit segment the low bit says
    at least one, the high bit says two. Hamming distance of codes = Manhattan distance."""
    high = fp >> _ONE
    return ((fp | high) & _LOW) | ((fp & high & _LOW) << _ONE)


def cells(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) postings: all cells of either half within ``reach`` unit steps."""
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(2)
    counts = np.bitwise_count((fp[:, None] >> shifts) & np.uint64(3)).astype(np.int64)
    weight = 3 ** np.arange(HALF, dtype=np.int64)
    rows, keys = [], []
    for half in range(2):
        c = counts[:, half * HALF:(half + 1) * HALF]
        at = np.arange(len(fp))
        seen = np.stack([at, c @ weight], axis=1)
        points = c
        for _ in range(reach):
            near_r, near_c = [seen[:, 0]], [points]
            for d in range(HALF):
                for step in (-1, 1):
                    moved = points[:, d] + step
                    ok = (moved >= 0) & (moved <= 2)
                    p = points[ok].copy()
                    p[:, d] = moved[ok]
                    near_r.append(seen[ok, 0])
                    near_c.append(p)
            points, r = np.concatenate(near_c), np.concatenate(near_r)
            seen = np.stack([r, points @ weight], axis=1)
            seen, first = np.unique(seen, axis=0, return_index=True)
            points = points[first]
        rows.append(seen[:, 0])
        keys.append(seen[:, 1] * 2 + half)
    return np.concatenate(rows), np.concatenate(keys)


def links(classes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints ``fp`` of ``classes`` exactly as all pairs
    within ``distance`` bits do (a spanning forest for each place)."""
    reach = -(-distance // 4)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy().astype(np.int64)
            row, cell = cells(fp.view(np.uint64), reach)
            yield pd.DataFrame({"cell": cell, "fp": fp[row]})

    keys = ["cell", "_i", "_j"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in places(batches, keys):
            fp = g["fp"].to_numpy().astype(np.int64).view(np.uint64)
            code, place = embed(fp), place_numbers(g, keys)
            side, same = g["_side"].to_numpy(), (g["_i"] == g["_j"]).to_numpy()
            found_a, found_b = [], []
            for a, b in candidate_pairs(place, side, same):
                near = np.bitwise_count(code[a] ^ code[b]) <= distance
                a, b = a[near], b[near]
                near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
                found_a.append(a[near])
                found_b.append(b[near])
            if found_a:
                rows, roots = forest(len(g), np.concatenate(found_a), np.concatenate(found_b))
                if len(rows):
                    signed = fp.view(np.int64)
                    yield pd.DataFrame({"a": signed[rows], "b": signed[roots]})

    posts = classes.select("fp").mapInPandas(post, "cell bigint, fp bigint")
    return blocked(posts, "cell", "fp", block).mapInPandas(verify, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id): one row for each row of ``docs``; component_id is the
    smallest key reachable by links, the row's own included."""
    prints = materialize(fingerprints(docs.select(key, text), text, "fp", words).select(key, "fp"))
    classes = materialize(prints.groupBy("fp").agg(F.min(key).alias("_low")))
    tree = components(links(classes, distance))
    of = tree.join(classes, F.col("node") == F.col("fp"))
    low = of.groupBy("root").agg(F.min("_low").alias("_least")).withColumnRenamed("root", "_root")
    named = of.join(low, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "_least")
    # checkpointed, so that the join to the rows can split a fingerprint with many copies
    final = materialize(classes.join(named, F.col("fp") == F.col("_node"), "left")
                        .select(F.col("fp").alias("_fp"),
                                F.coalesce("_least", "_low").alias("component_id")))
    return prints.join(final, F.col("fp") == F.col("_fp")).select(key, "fp", "component_id")


def dedup(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest doc_id (one row of
    it). Rows without an id stay only where their whole group has none, one for each text."""
    groups = near_duplicates(docs, "doc_id", "text", words, distance)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    if docs.where("doc_id is null").limit(1).count() == 0:
        return named
    nameless = fingerprints(docs.where("doc_id is null"), "text", "_f", words)
    alone = groups.where("doc_id is null and component_id is null").select(F.col("fp").alias("_f"))
    return named.unionByName(nameless.join(alone.distinct(), "_f", "left_semi")
                             .dropDuplicates(["_f"]).drop("_f"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    done = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id")
