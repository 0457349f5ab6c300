from collections import defaultdict

from pyspark.sql import functions as F

from qamill.llm import sharding as S
from tests.llm.helpers import awkward_docs, no_docs


def check(rows, limit, total):
    assert len(rows) == total
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for name, own in by.items():
        assert all(r["shard_rows"] == len(own) for r in own)
        assert own[0]["shard_bytes"] == sum(r["size"] or 0 for r in own)
        assert own[0]["shard_bytes"] <= limit or (len(own) == 1 and own[0]["oversized"])
    assert not any(a != b and b.startswith(a) for a in by for b in by)  # a prefix code
    return by


def test_every_shard_fits(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "id % 50 + 1 AS size", "'x' AS shard")
    by = check(S.shard(docs, "doc_id", F.col("size"), limit=700).collect(), 700, 3000)
    assert len(by) > 100


def test_only_oversized_buckets_split(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "1 AS size")
    assert len(check(S.shard(docs, "doc_id", F.col("size"), limit=500).collect(), 500, 500)) == 1
    by = check(S.shard(docs, "doc_id", F.col("size"), limit=499).collect(), 499, 500)
    assert set(by) == {"0", "1"}


def test_equal_and_null_keys_split_too(spark):
    docs = spark.range(400).selectExpr("IF(id < 200, 7, NULL) AS doc_id", "10 AS size", "id AS other")
    check(S.shard(docs, "doc_id", F.col("size"), limit=100).collect(), 100, 400)


def test_awkward_rows(spark):
    docs = awkward_docs(spark).withColumn("size", F.octet_length("text"))
    by = check(S.shard(docs, "doc_id", F.col("size"), limit=1000).collect(), 1000, docs.count())
    assert any(r[0]["oversized"] for r in by.values())
    empty = no_docs(spark)
    assert S.shard(empty, "doc_id", F.octet_length("text")).count() == 0


def test_written_shards(spark, scratch):
    docs = spark.range(100).selectExpr("id AS doc_id", "10 AS size")
    sharded = S.shard(docs, "doc_id", F.col("size"), limit=200)
    S.write_shards(sharded, scratch + "/shards")
    assert spark.read.parquet(scratch + "/shards").count() == 100
