"""Queries that SQL can express, over whole tables, against their SQL."""
import pytest

from qamill.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_MID
from tools.oracle_check import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert name in QUERIES
    assert compare(spark, SF_MID, [name], verbose=False) == {name: "OK"}


def test_embedding_links_against_sql_where_there_are_many(spark, scratch):
    """The given small table has no link; a tenth of it repeated with noise has."""
    import duckdb
    from pyspark.sql import functions as F
    base = spark.read.parquet(f"{SF_MID}/embeddings.parquet").where("vec_id % 10 = 0")
    noisy = base.select((F.col("vec_id") + 100_000).alias("vec_id"),
                        F.transform("embedding", lambda x: (x + 0.01 * F.sin(x * 1000)).cast("float"))
                        .alias("embedding"), "label")
    base.unionByName(noisy).unionByName(base.withColumn("vec_id", F.col("vec_id") + 200_000)) \
        .coalesce(1).write.parquet(f"{scratch}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{scratch}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(ORACLE["op9_embedding_dedup"]).fetchall())
    got = QUERIES["op9_embedding_dedup"](spark, scratch)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want
    assert sum(r[1] for r in want) >= 300
