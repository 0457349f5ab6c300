from pyspark.sql import functions as F

from qamill.functions import arrays as A


def _one(spark, expr, data, schema):
    return spark.createDataFrame([data], schema).select(expr.alias("x")).first()["x"]


def test_common_prefix(spark):
    cases = [([1, 2, 3], [1, 2, 9, 4], 2), ([1, 2], [1, 2, 3], 2), ([5], [6], 0),
             ([1, 2, 3], [1, 2], 2), ([], [1], 0)]
    for p, f, expected in cases:
        got = _one(spark, A.common_prefix_len("p", "f"), (p, f), "p array<int>, f array<int>")
        assert got == expected, (p, f)


def test_masked_labels(spark):
    got = _one(spark, A.masked_labels("ids", F.lit(2)), ([7, 8, 9],), "ids array<int>")
    assert got == [-100, -100, 9]
    got = _one(spark, A.masked_labels("ids", F.lit(3)), ([7, 8, 9],), "ids array<int>")
    assert got == [-100, -100, -100]


def test_completion_slice(spark):
    got = _one(spark, A.completion_slice("g", 2, 2), ([0, 0, 5, 6, 7, 8],), "g array<int>")
    assert got == [7, 8]
    got = _one(spark, A.completion_slice("g", 2, 4), ([0, 0, 5, 6],), "g array<int>")
    assert got == []


def test_padding(spark):
    df = spark.createDataFrame([([1, 2],)], "ids array<int>")
    r = df.select(A.pad_right("ids", 4, 0).alias("r"), A.pad_left("ids", 4, 0).alias("l"),
                  A.pad_right("ids", 1, 0).alias("cut")).first()
    assert r["r"] == [1, 2, 0, 0] and r["l"] == [0, 0, 1, 2] and r["cut"] == [1]


def test_counts(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 1],)], "m array<int>")
    r = df.select(A.array_sum("m").alias("s"), A.count_value("m", 0).alias("z")).first()
    assert (r["s"], r["z"]) == (3, 2)
