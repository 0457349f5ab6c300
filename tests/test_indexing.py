"""The distributed position index must equal row_number() exactly, for any
number of partitions, with and without groups."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from qamill.operators.indexing import dense_index, number_keys
from tests.conftest import SF_MID


def _lineitem(spark):
    return spark.read.parquet(f"{SF_MID}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _expected(df, groups, order, desc=()):
    sort = [F.col(c).desc() if c in desc else F.col(c) for c in order]
    w = Window.partitionBy(*groups).orderBy(*sort) if groups else Window.orderBy(*sort)
    return df.withColumn("ix", (F.row_number().over(w) - 1).cast("bigint"))


def test_dense_index_grouped(spark):
    df = _lineitem(spark)
    for n in (3, 8, 17):
        got = dense_index(df, ["l_returnflag"], ORDER, "ix", num_partitions=n)
        exp = _expected(df, ["l_returnflag"], ORDER)
        assert got.count() == df.count()
        assert got.exceptAll(exp).count() == 0


def test_dense_index_global_descending(spark):
    df = _lineitem(spark)
    got = dense_index(df, [], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey",
                               "l_suppkey"], "ix", descending=("l_extendedprice",))
    exp = _expected(df, [], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey",
                             "l_suppkey"], desc=("l_extendedprice",))
    assert got.exceptAll(exp).count() == 0


def test_dense_index_many_groups(spark):
    df = _lineitem(spark)
    got = dense_index(df, ["l_partkey"], ORDER, "ix")
    assert got.exceptAll(_expected(df, ["l_partkey"], ORDER)).count() == 0


def test_number_keys_joins_positions_back(spark):
    df = _lineitem(spark)
    keys = df.select("l_partkey", *[c for c in ORDER if c != "l_partkey"])
    order = [c for c in ORDER if c != "l_partkey"]
    got = number_keys(df.where("l_orderkey % 2 = 0"), keys, ["l_partkey"], order, "ix")
    exp = _expected(df, ["l_partkey"], order).where("l_orderkey % 2 = 0")
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0


def test_dense_index_is_stable_across_executions(spark):
    """Re-running the plan (as after a lost executor) gives the same numbers."""
    df = _lineitem(spark)
    got = dense_index(df, ["l_returnflag"], ORDER, "ix")
    first = sorted(map(tuple, got.collect()))
    second = sorted(map(tuple, got.collect()))
    assert first == second


def test_scans_see_new_files(spark, scratch):
    from qamill.sources.tables import read_table
    path = f"{scratch}/part.parquet"
    spark.range(5).write.parquet(path)
    assert read_table(spark, scratch, "part").count() == 5
    spark.range(5).write.mode("append").parquet(path)
    assert read_table(spark, scratch, "part").count() == 10
