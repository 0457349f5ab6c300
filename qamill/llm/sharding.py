"""Size-bounded shards by extendible hashing.

A row's key is hashed; a shard is a bucket of the directory, named by the leading
bits of the hash. All buckets start as one; only a bucket over the byte limit
splits on its next bit, until every bucket fits. The shard of a row depends
on the hashes and sizes alone, not on file layout or partitioning.

The splitting runs on a histogram, not on rows. In each round the rows of the
buckets still too large are summed into cells, ``bits`` further hash bits deep
(map-side combined); every cell looks at the sums of its 0..bits leading bits
and takes the shallowest that fits. Cells in which none fits go on to the next
round, and only their rows are read again. The first round is as deep as the total
size asks, so one round is the usual case; later ones hold rows of rare cells.

The hash is md5 of the key's text (``HASH_BITS`` leading bits). Rows whose keys are
equal or null share a hash: when the bits are used up, they are dealt
over further bits drawn from md5 of a row's content and its place among equal
rows, so that a key holding a third of all rows also splits. One row larger than
the limit is a shard of its own and is marked ``oversized``.

Defined results: null text counts zero bytes; an empty table gives no shards;
repeated rows are all kept; columns named like the output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import aside, table
from qamill.session import materialize

#: Leading bits of md5 that are used, as a 60-bit integer.
HASH_BITS = 60
#: Byte limit of a shard.
LIMIT = 16 * 1024 * 1024
#: Cells for each expected shard in the first round: 2 ** SPARE_BITS.
SPARE_BITS = 3
ROUND_BITS = 8


def _bits60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _lead(h: Column, used: int, n: int) -> Column:
    """The ``n`` bits after the first ``used`` of a 60-bit hash, as an integer."""
    return F.shiftright(h, HASH_BITS - used - n).bitwiseAND(F.lit((1 << n) - 1))


def _binary(value: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(value), width, "0"))


def _rounds(rows: DataFrame, limit: int, hash_col: str, first_bits: int, max_bits: int):
    """Split ``rows`` (_bucket, hash, _size) until all fit or the bits run out. Yields
    (assignments on (_bucket, cell), rows left over, bits used so far)."""
    used, active = 0, rows
    while used < max_bits:
        n = min(first_bits if used == 0 else ROUND_BITS, max_bits - used)
        active = active.withColumn("_cell", _lead(F.col(hash_col), used, n))
        cells = active.groupBy("_bucket", "_cell").agg(F.sum("_size").alias("_size"),
                                                        F.count(F.lit(1)).alias("_rows"))
        # every cell reports to its bucket at each depth of this round
        levels = cells.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(n)))) \
            .withColumn("_lead", F.expr(f"shiftright(_cell, {n} - _d)"))
        sums = levels.groupBy("_bucket", "_d", "_lead").agg(
            F.sum("_size").alias("_bytes"), F.sum("_rows").alias("_n"))
        fits = sums.where((F.col("_bytes") <= limit) | (F.col("_n") == 1))
        taken = (levels.join(fits, ["_bucket", "_d", "_lead"])
                 .groupBy("_bucket", "_cell")
                 .agg(F.min(F.struct("_d", "_lead", "_bytes", "_n")).alias("_t")))
        chosen = materialize(cells.select("_bucket", "_cell").join(taken, ["_bucket", "_cell"], "left")
                             .select("_bucket", "_cell",
                                     F.concat("_bucket", _binary(F.col("_t._lead"), F.col("_t._d")))
                                     .alias("shard"),
                                     F.concat("_bucket", _binary(F.col("_cell"), n)).alias("_deeper"),
                                     F.col("_t._bytes").alias("shard_bytes"),
                                     F.col("_t._n").alias("shard_rows")))
        used += n
        yield active, chosen, used
        if chosen.where("shard is null").limit(1).count() == 0:
            return
        deeper = chosen.where("shard is null").select(F.col("_bucket").alias("_b"),
                                                      F.col("_cell").alias("_c"), "_deeper")
        active = (active.join(deeper, (F.col("_bucket") == F.col("_b")) & (F.col("_cell") == F.col("_c")))
                  .withColumn("_bucket", F.col("_deeper")).select(*rows.columns))


def shard(df: DataFrame, key: str, size: Column, limit: int = LIMIT) -> DataFrame:
    """``df`` with shard (bits of its hash prefix), shard_bytes, shard_rows, oversized."""
    out = ("shard", "shard_bytes", "shard_rows", "oversized")
    sized = "size"
    while sized.lower() in {c.lower() for c in df.columns}:
        sized += "_"
    df = df.select("*", F.coalesce(size.cast("bigint"), F.lit(0)).alias(sized))
    df, (key,), back = aside(df, key)
    keep = [c for c in df.columns if c not in (*out, sized)]
    rows = df.select(*keep, F.col(sized).alias("_size")) \
        .withColumn("_hash", _bits60(F.coalesce(F.col(key).cast("string"), F.lit("")))) \
        .withColumn("_bucket", F.lit(""))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    first = min(24, max(1, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    parts, left = [], None

    def place(active: DataFrame, chosen: DataFrame) -> DataFrame:
        got = chosen.select(F.col("_bucket").alias("_b"), F.col("_cell").alias("_c"),
                            "shard", "_deeper", "shard_bytes", "shard_rows")
        return active.join(got, (F.col("_bucket") == F.col("_b")) & (F.col("_cell") == F.col("_c")))

    last = None
    for active, chosen, used in _rounds(rows, limit, "_hash", first, HASH_BITS):
        last = place(active, chosen)
        parts.append(last.where("shard is not null"))
    if used >= HASH_BITS and chosen.where("shard is null").limit(1).count():
        # rows of equal keys: bits of the content, then of the place among equal rows
        left = last.where("shard is null").withColumn("_bucket", F.col("_deeper"))
        left = materialize(left.select(*keep, "_size", "_bucket")
                           .withColumn("_uid", F.monotonically_increasing_id()))
        content = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keep
                                      if c != key], F.col("_uid").cast("string"))
        left = left.withColumn("_hash", _bits60(content)).drop("_uid")
        for active, chosen, used in _rounds(left, limit, "_hash", ROUND_BITS, HASH_BITS):
            parts.append(place(active, chosen).where("shard is not null"))
    result = None
    for p in parts:
        p = p.select(*keep, "shard", "shard_bytes", "shard_rows",
                     (F.col("shard_bytes") > limit).alias("oversized"))
        result = p if result is None else result.unionByName(p)
    return back(result)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to its own folder ``shard=<bits>`` under ``path``."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: shard of every document by doc_id under the production byte limit."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sized = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    done = shard(sized, "doc_id", F.col("n_bytes"))
    return done.select("doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "shard",
                       "shard_bytes", "shard_rows", "oversized")


ORACLE = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
levels AS (
  SELECT d::INTEGER AS d, hash >> (60 - d::INTEGER) AS lead, sum(n_bytes) AS b, count(*) AS n
  FROM h, range(0, 33) t(d) GROUP BY 1, 2),
fits AS (SELECT * FROM levels WHERE b <= {LIMIT} OR n = 1),
best AS (
  SELECT h.doc_id, h.n_bytes, arg_min(f.d, f.d) AS d, arg_min(f.lead, f.d) AS lead,
         arg_min(f.b, f.d) AS b, arg_min(f.n, f.d) AS n
  FROM h JOIN fits f ON (h.hash >> (60 - f.d)) = f.lead GROUP BY h.doc_id, h.n_bytes, h.hash)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(repeat('0', 60) || bin(lead), d) END AS shard,
       b::BIGINT AS shard_bytes, n::BIGINT AS shard_rows, b > {LIMIT} AS oversized
FROM best
"""
