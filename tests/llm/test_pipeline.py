import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from qamill.llm import packing, simhash_dedup, toxicity
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOC_SCHEMA, awkward_docs, no_docs, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100, 200)],
                          "doc_id bigint, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(1, prose(777, 40))], "item_id bigint, text string") \
        .write.parquet(folder + "/benchmark.parquet")
    return folder


def corpus(spark):
    rows = []
    for i in range(100, 200):
        text = prose(i, 60)
        if i % 5 == 0:
            words = text.split()
            for k in (5, 20, 40):
                words.insert(k, "vilething")
            text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
    rows += [(300, prose(101, 60), "en", "s", 1), (301, "start " + prose(777, 40) + " end", "en", "s", 1),
             (302, "123 456", "en", "s", 7), (303, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def test_stages_decide(spark, tables, scratch):
    docs, ids = corpus(spark), {}
    columns = docs.columns
    for name, stage in C.STAGES:
        out = stage(spark, docs, tables)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{scratch}/{name}")
        docs = spark.read.parquet(f"{scratch}/{name}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = {i for i in range(100, 200) if i % 5}
    assert ids["toxicity"] == clean | {300, 301, 302, 303}
    assert ids["language_id"] == clean | {300, 301}
    assert ids["simhash_dedup"] == clean | {301}
    assert ids["decontamination"] == ids["packing"] == clean


def test_run_equals_plain_code(spark, tables):
    """All rows of ``run``: the documents that should stay, known from how they were made, are cut and encoded by
    ``tokenizers``; their places have no gaps and no overlaps."""
    from tokenizers import Tokenizer
    docs = corpus(spark)
    docs = docs.unionByName(spark.createDataFrame([(400, prose(400, 5000), "en", "s", 1)], DOC_SCHEMA))
    for name in ("score", "_hit", "_toxic", "lang_pred", "piece", "fingerprint"):  # names of columns inside
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(tables + "/documents.parquet")
    got = C.run(spark, tables).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want, total = Counter(), 0
    for r in docs.select("doc_id", "text").collect():
        if r.doc_id == 400 or (r.doc_id < 200 and r.doc_id % 5):
            ids = tok.encode(r.text, add_special_tokens=False).ids + [0]
            total += len(ids)
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[r.doc_id, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 1


def test_awkward_and_empty_tables(spark, tables):
    docs = awkward_docs(spark)
    for name, stage in C.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() >= 1 and (name == "packing" or out.columns == docs.columns), name
        assert stage(spark, no_docs(spark), tables).count() == 0, name


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    got = names["pipeline"](spark, SF_SMALL)
    assert got.count() > 50
    assert toxicity.PER_CLASS > 0 and simhash_dedup.WORDS == 4 and simhash_dedup.DISTANCE == 4
