"""Columns of the caller that are named like an operator's working columns pass through."""
from pyspark.sql import functions as F

from qamill.llm import decontamination, language_id, sharding, toxicity, url_filters
from tests.llm.helpers import FREMD, WORDS, prose

NAMES = ["_h", "_p", "_s", "_n", "_w", "_short", "_full", "_size", "_hash", "_bucket", "_b", "_c", "_uid", "_d",
         "_toxic", "_lang", "_hit", "_K"]


def wide(df):
    return df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def passed(out):
    got = out.collect()
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in NAMES)
    return got


def test_working_names(spark):
    docs = spark.createDataFrame(
        [(i, prose(i, 40, FREMD if i % 2 else WORDS), "de" if i % 2 else "en",
          f"http://a{i}.net/en/x") for i in range(40)],
        "doc_id bigint, text string, lang string, url string")
    df = wide(docs)
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    assert len(passed(toxicity.score(df, model))) == 40
    assert len(passed(language_id.predict(df, language_id.fit(docs)))) == 40
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert {r["verdict"] for r in passed(url_filters.judge(df, rules))} == {"block"}
    for size in (F.length("text"), F.length("_size") + 100):
        got = passed(sharding.shard(df, "doc_id", size, 1000))
        assert len(got) == 40 and len({r["shard"] for r in got}) > 1
    assert len(passed(sharding.shard(df, "_size", F.length("text"), 1000))) == 40
    items = spark.createDataFrame([(1, prose(2, 40))], "item_id bigint, text string")
    assert {r["doc_id"] for r in passed(decontamination.clean(df, items))} == set(range(40)) - {2}
