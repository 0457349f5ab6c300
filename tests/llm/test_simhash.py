import random

import numpy as np
import pytest

from qamill.llm import simhash_dedup as S
from tests.llm.helpers import awkward_docs, no_docs, prose


def slow(text, words=4):
    import re
    import xxhash
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b C d", "a b c d e\x0bf\x1cg É z",
                                  prose(1, 300), "same " * 40])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow(text)


def test_fingerprint_equals_spark_hash(spark):
    df = spark.createDataFrame([("a b c d",)], "t string")
    assert df.selectExpr("xxhash64(t) AS h").first()["h"] & (1 << 64) - 1 == S.fingerprint("a b c d")


def test_embedding_is_a_lower_bound_and_cells_meet():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << k
        fp = np.array([a, b], dtype=np.uint64)
        code = S.embed(fp)
        assert bin(int(code[0] ^ code[1])).count("1") <= bin(a ^ b).count("1")
        row, cell = S.cells(fp, 1)
        assert set(cell[row == 0]) & set(cell[row == 1])


def classes_by_hand(prints):
    root = {v: v for v in prints.values()}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if bin(a ^ b).count("1") <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    low = {}
    for i, v in prints.items():
        low[root[v]] = min(low.get(root[v], i), i)
    return {i: low[root[v]] for i, v in prints.items()}


@pytest.mark.parametrize("block", [4, 1024])
def test_components_against_brute_force(spark, block):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        base = 1 + rng.getrandbits(63)
        for _ in range(rng.choice([1, 1, 2, 8])):
            rows.append((len(rows), base))
            for k in rng.sample(range(63), rng.randint(0, 3)):
                base ^= 1 << k
    df = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    tree = {r["node"]: r["root"] for r in S.components(S.links(df.select("fp").distinct(), 4, block)).collect()}
    want = classes_by_hand(dict(rows))
    groups = {}
    for i, v in rows:
        groups.setdefault(tree.get(v, v), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == want


def test_documents(spark):
    docs = awkward_docs(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["fp"] == 0 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[5]["component_id"] == 4 and by[6]["component_id"] == 6
    assert S.near_duplicates(no_docs(spark)).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    docs = awkward_docs(spark)
    kept = S.dedup(docs)
    assert kept.columns == docs.columns or set(kept.columns) == set(docs.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 1 in ids and 2 not in ids
    assert ids.count(None) == 1  # the text without any identified copy
    assert S.dedup(no_docs(spark)).count() == 0
