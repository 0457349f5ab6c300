import re
from collections import Counter

import pytest

from qamill.llm import decontamination as D
from tests.llm.helpers import awkward_docs, no_docs, prose

ITEMS = [(1, prose(50, 30)), (2, "Alpha beta, gamma: delta epsilon zeta eta theta iota kappa."), (3, "too short item"),
         (4, None), (5, ""), (6, "rep rep rep rep rep rep rep rep rep"), (7, prose(50, 30)),
         (8, "one two three four five")]


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    out = {}
    for i, t in docs:
        h = shingles(t)
        for j, x in items:
            b = shingles(x)
            n = len(b)
            best = 0.0
            for s in range(max(len(h) - n, 0) + 1 if n and h else 0):
                a = Counter(h[s:s + n])
                both = sum((a & Counter(b)).values())
                best = max(best, both / (sum(a.values()) + n - both))
            if best >= 0.8:
                out[i, j] = best
    return out


def texts():
    item = ITEMS[0][1]
    words = item.split()
    near = " ".join(words[:28] + ["changed", "words"])
    return [(1, "before " + item.upper() + " after that"), (2, item), (3, prose(51, 200)),
            (4, prose(60, 40) + " " + near + " " + prose(61, 40)), (5, " ".join(words[:15])),
            (6, "x alpha BETA gamma delta epsilon zeta eta theta iota kappa y"),
            (7, "rep " * 30), (8, "rep " * 8), (9, None), (10, ""), (11, "one two three four five"),
            (12, " ".join(words[1:])), (13, item + ". " + item), (1, "before " + item.upper() + " after that")]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", bound)
    docs = spark.createDataFrame(texts(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = D.hits(docs, items).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    want = brute(texts(), ITEMS)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert sum(r["doc_id"] == 1 and r["item_id"] == 1 for r in rows) == 2  # repeated rows


def test_simhash_is_the_majority(spark):
    values = [[1, 3, -1], [5], [-1, -1, 0], [1 << 62, -(1 << 63), -(1 << 63)], list(range(300))]
    df = spark.createDataFrame([(v,) for v in values], "h array<bigint>")
    for r in D.simhash(df, "h", "fp").collect():
        bits = sum(1 << b for b in range(64)
                   if 2 * sum((x & (1 << 64) - 1) >> b & 1 for x in r["h"]) > len(r["h"]))
        assert r["fp"] & (1 << 64) - 1 == bits


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(texts(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    plan = D.hits(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_awkward_and_empty_tables(spark):
    docs = awkward_docs(spark)
    items = spark.createDataFrame([(1, prose(3, 30_000)[1000:1400]), (2, prose(1, 80))],
                                  "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.hits(docs, items).collect()}
    assert (4, 2) in got and (5, 2) in got and (6, 1) in got
    kept = [r["doc_id"] for r in D.clean(docs, items).collect()]
    assert 6 not in kept and 4 not in kept and kept.count(None) == 2 and 1 in kept
    assert D.hits(no_docs(spark), items).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.hits(docs, none).count() == 0 and D.clean(docs, none).count() == docs.count()
