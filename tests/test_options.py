import json

import pytest
from pyspark.sql import functions as F

from qamill.functions import options as O


def test_merge_and_default(spark):
    df = spark.createDataFrame([('{"k": 69}',), ('{"k": null, "x": "y"}',), (None,)], "p string")
    merged = O.merge_override(O.literal_options({"k": "0", "src": "cfg"}), O.parse_options("p"))
    out = df.select(merged.alias("m")).select(
        F.col("m"), O.get_option("m", "k", "dflt").alias("k"),
        O.get_option("m", "temperature", "0.0").alias("t")).collect()
    assert out[0]["m"] == {"k": "69", "src": "cfg"} and out[0]["k"] == "69"
    # a key present with null wins over the base and stays null (not the default)
    assert out[1]["m"] == {"src": "cfg", "k": None, "x": "y"} and out[1]["k"] is None
    assert out[2]["m"] == {"k": "0", "src": "cfg"}
    assert all(r["t"] == "0.0" for r in out)


def test_repeated_and_malformed_json(spark):
    df = spark.createDataFrame([('{"k":1,"k":2}',), ('{"k":',), (None,), ("{}",)], "p string")
    got = df.select(O.parse_options("p").alias("m"), O.malformed("p").alias("bad")).collect()
    assert got[0]["m"] == {"k": "2"} and [r["bad"] for r in got] == [False, True, False, False]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_stamps_do_not_depend_on_the_session_zone(spark, zone):
    from qamill.functions import times
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("SELECT timestamp'2024-01-02 00:03:21 UTC' AS t, "
                       "timestamp_ntz'2024-01-02 00:03:21' AS n")
        r = df.select(times.instant_stamp("t").alias("t"), times.local_stamp("n").alias("n")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert r.t == r.n == "20240101_160321"


def test_session_choices_win(spark):
    from qamill.session import configure
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        configure(spark)
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_typed_options_keep_their_types(spark):
    rows = [(1, '{"a":1,"b":{"c":true},"d":null}', '{"b":{"e":"x"},"f":[1,2.5]}'), (2, None, '{"a":2,"a":3}'),
            (3, "[1]", "{bad"), (4, "{}", '{"a":"1","d":0}')]
    df = spark.createDataFrame(rows, "id int, base string, over string")
    m = df.select("id", O.merge_typed(O.parse_typed("base"), O.parse_typed("over")).alias("m"),
                  O.malformed_typed("base").alias("bad_base"), O.malformed_typed("over").alias("bad_over"))
    got = {r.id: r for r in m.select(
        "id", "bad_base", "bad_over", O.typed_json("m").alias("json"), O.get_typed("m", "a", "bigint", 7).alias("a"),
        O.get_typed("m", "b", "boolean", path="$.c").alias("c"), O.get_typed("m", "b", "string", path="$.e").alias("e"),
        O.get_typed("m", "d", "bigint", 9).alias("d"), O.has_option("m", "d").alias("has_d"),
        O.get_typed("m", "f", "double", path="$[1]").alias("f")).collect()}
    assert json.loads(got[1].json) == {"a": 1, "b": {"e": "x"}, "d": None, "f": [1, 2.5]}
    assert (got[1].a, got[1].c, got[1].e, got[1].d, got[1].has_d, got[1].f) == (1, None, "x", None, True, 2.5)
    assert (got[2].a, got[2].d, got[2].has_d) == (3, 9, False)   # the last of a repeated key; a default
    assert (got[3].bad_base, got[3].bad_over, got[3].json, got[3].a) == (True, True, "{}", 7)
    assert (got[4].a, got[4].d, got[4].bad_base) == (1, 0, False)


def test_typed_survive_alone(spark):
    one = spark.range(1).select(O.literal_typed({"a": 1, "b": {"c": True}, "d": None}).alias("m"))
    r = one.select(O.typed_json("m").alias("j"), O.get_typed("m", "b", "boolean", path="$.c").alias("c"),
                   O.get_typed("m", "a", "string").alias("s")).first()
    assert json.loads(r.j) == {"a": 1, "b": {"c": True}, "d": None} and r.c is True and r.s == "1"
