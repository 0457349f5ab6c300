"""Benchmark decontamination by SimHash of item-sized windows, in SQL functions only.

Words are runs of letters and digits of the lower-cased text; a shingle is ``WORDS``
words. A benchmark item of n words is compared with the n-word windows of the
documents (the whole text where it is shorter):

1. every shingle of every document is looked up among the items' shingles; a window
   without a shared shingle has similarity zero, so only windows around such
   anchors are formed: each start from which a window of the item's size holds one;
2. a window's SimHash is the majority of its shingles' 64-bit hashes, counted in
   packed lanes of long integers; items get theirs the same way;
3. fingerprints are cut into ``BLOCKS`` blocks. If two differ in at most ``RADIUS``
   bits, some block differs in at most RADIUS // BLOCKS bits, so items are posted to all
   such neighbours of each block's value and windows look up their own: every pair
   within the radius meets, with item size as part of the key;
4. candidates within the radius are verified: the weighted Jaccard similarity of
   their shingles, a shingle weighing as often as it occurs, must reach ``SIMILARITY``.

At similarity 0.8 two fingerprints differ in about 10 of 64 bits (standard
deviation 3), so the radius of 19 loses fewer than one pair in a thousand.

Texts are handled once however often they are copied: anchors are combined
by a hash of the text in the tasks, before any shuffle. The item shingles are
broadcast when their counted number is within ``BROADCAST_SHINGLES``, else joined by a shuffle.

Defined results: null and empty texts hit nothing; an item with fewer than ``WORDS`` words
has no shingle and is hit by nothing; equal items are each reported; repeated rows
are each reported; empty tables give no hits. Items may have up to 500,000 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import aside, table
from qamill.session import materialize

WORDS = 5
SIMILARITY = 0.8
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
RADIUS = 19
#: Item shingles up to this number (under 100 MB as rows) are broadcast.
BROADCAST_SHINGLES = 1_000_000
#: Lanes of a packed counter: a long holds three counts.
LANES = 22
_LANE_ONES = 1 | 1 << LANES | 1 << 2 * LANES


def shingle_hashes(text: str, words: int = WORDS) -> Column:
    """64-bit hashes of a text's shingles in order; empty for fewer than ``words`` words."""
    w = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(F.array(w), lambda a: F.when(
        F.size(a) >= words,
        F.transform(F.sequence(F.lit(0), F.size(a) - words),
                    lambda i: F.xxhash64(*[a[i + k] for k in range(words)])))
        .otherwise(F.array().cast("array<bigint>")))[0]


def _text_key(text: str) -> Column:
    return F.md5(F.col(text).cast("binary"))


def simhash(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """``df`` with the majority fingerprint of an array of 64-bit hashes."""
    zero = ", ".join(f"'c{k}', 0L" for k in range(LANES))
    add = ", ".join(f"'c{k}', s.c{k} + (shiftrightunsigned(h, {k}) & {_LANE_ONES}L)"
                    for k in range(LANES))
    df = df.withColumn("_c", F.expr(f"aggregate({hashes}, named_struct({zero}), "
                                    f"(s, h) -> named_struct({add}))"))
    bits = None
    for k in range(64):
        lane, shift = k % LANES, k // LANES * LANES
        count = F.shiftrightunsigned(F.col(f"_c.c{lane}"), shift).bitwiseAND(F.lit((1 << LANES) - 1))
        if k // LANES == 2:  # the top lane keeps what is above it
            count = F.shiftrightunsigned(F.col(f"_c.c{lane}"), shift)
        value = (1 << k) - (1 << 64 if k == 63 else 0)
        bit = F.when(count * 2 > F.size(hashes), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return df.withColumn(out, bits).drop("_c")


def _blocks(df: DataFrame, fp: str) -> DataFrame:
    """One row for each block: ``_b`` and its value ``_v``."""
    values = [F.struct(F.lit(k).alias("b"), F.shiftrightunsigned(F.col(fp), k * BLOCK_BITS)
                       .bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("v"))
              for k in range(BLOCKS)]
    return (df.withColumn("_bv", F.explode(F.array(*values)))
            .withColumn("_b", F.col("_bv.b")).withColumn("_v", F.col("_bv.v")).drop("_bv"))


def prepare(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, hashes, n): items with shingles; n is the number of shingles."""
    return materialize(items.select(F.col(key).alias("item_id"), shingle_hashes(text).alias("hashes"))
                       .withColumn("n", F.size("hashes")).where("n > 0"))


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
         similarity: float = SIMILARITY) -> DataFrame:
    """(key, item_id, similarity, word_start, n_words): the best window of each document
    for every item that it holds."""
    bench = prepare(items)
    known = materialize(bench.select(F.explode("hashes").alias("h"), "n").distinct())
    texts = docs.where(F.col(text).isNotNull())
    shingled = (texts.select(_text_key(text).alias("k"), shingle_hashes(text).alias("hashes"))
                .select("k", F.posexplode("hashes").alias("pos", "h")))
    few = known.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    met = shingled.join(F.broadcast(known) if few else known, "h")
    # a document's anchors for one item size: no more than it has words
    anchors = materialize(met.groupBy("k", "n").agg(F.array_sort(F.collect_set("pos")).alias("pos")))
    sizes = materialize(anchors.groupBy("k").agg(
        F.collect_list(F.struct("n", "pos")).alias("anchors")))
    # the shingles of anchored texts, one copy each: copies are combined in the tasks first
    anchored = materialize(
        texts.select(_text_key(text).alias("_k"), text)
        .groupBy("_k").agg(F.first(text).alias("_t"))
        .join(sizes.select("k"), F.col("_k") == F.col("k"), "left_semi")
        .select(F.col("_k").alias("k"), shingle_hashes("_t").alias("hashes")))
    # starts of windows with an anchor, each once: those that no earlier anchor gave
    starts = """flatten(transform(anchors, g -> transform(flatten(transform(g.pos, (p, i) ->
        CASE WHEN least(p, greatest(size(hashes) - g.n, 0))
                  >= greatest(p - g.n + 1, 0, IF(i = 0, 0, g.pos[greatest(i - 1, 0)] + 1))
             THEN sequence(greatest(p - g.n + 1, 0, IF(i = 0, 0, g.pos[greatest(i - 1, 0)] + 1)),
                           least(p, greatest(size(hashes) - g.n, 0)))
             ELSE array() END)), s -> named_struct('n', g.n, 's', s))))"""
    windows = (anchored.join(sizes, "k").withColumn("_w", F.explode(F.expr(starts)))
               .select("k", F.col("_w.n").alias("n"), F.col("_w.s").alias("s"),
                       F.slice("hashes", F.col("_w.s") + 1, F.col("_w.n")).alias("own")))
    prints = simhash(windows, "own", "fp").select("k", "n", "s", "fp")
    near = RADIUS // BLOCKS
    masks = F.expr(f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), m -> bit_count(m) <= {near})")
    posted = (_blocks(simhash(bench, "hashes", "item_fp"), "item_fp")
              .select("item_id", "n", "item_fp", "_b", "_v")
              .withColumn("_m", F.explode(masks))
              .select("item_id", "n", "item_fp", "_b", F.col("_v").bitwiseXOR(F.col("_m")).alias("_v")))
    # Spark's estimate of the posted items misses their expansion: never broadcast them
    candidates = (_blocks(prints, "fp").join(posted.hint("merge"), ["n", "_b", "_v"])
                  .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
                  .select("k", "n", "s", "item_id").distinct())
    # exact verification: shared and total weight of the two bags of shingles
    checked = (candidates.join(anchored, "k")
               .select("k", "n", "s", "item_id", F.slice("hashes", F.col("s") + 1, F.col("n")).alias("a"))
               .join(bench.select("item_id", F.col("hashes").alias("b")).dropDuplicates(["item_id"]),
                     "item_id")
               .withColumn("both", F.expr("""aggregate(array_distinct(a), 0, (t, x) -> t
                   + least(size(filter(a, y -> y = x)), size(filter(b, y -> y = x))))"""))
               .withColumn("similarity", F.col("both") / (F.size("a") + F.size("b") - F.col("both")))
               .where(F.col("similarity") >= similarity))
    best = materialize(checked.groupBy("k", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("s")).alias("s"), F.size("a").alias("n"))).alias("_best")))
    named = texts.select(F.col(key), _text_key(text).alias("_k")) \
        .join(best, F.col("_k") == F.col("k"))
    return named.select(key, "item_id", F.col("_best.similarity").alias("similarity"),
                        (-F.col("_best.s")).alias("word_start"),
                        (F.col("_best.n") + WORDS - 1).alias("n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    docs, _, back = aside(docs)
    found = materialize(hits(docs, items, "doc_id").select(F.col("doc_id").alias("_hit")).distinct())
    return back(docs.join(found, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_anti"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: benchmark items held by the documents."""
    return hits(table(spark, sf_dir, "documents", "doc_id", "text"),
                table(spark, sf_dir, "benchmark", "item_id", "text"))
