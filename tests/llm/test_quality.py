import random
from zlib import crc32

import numpy as np

from qamill.llm import quality as Q
from tests.llm.helpers import awkward_docs, no_docs, prose


def corpus(n=700):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text, good = prose(i, rng.randint(30, 200)), rng.random() < 0.8
        if not good:
            kind = i % 3
            words = text.split()
            text = (text.upper().replace(" ", "!! ") if kind == 0 else
                    " ".join(w for w in words[:8] for _ in range(15)) if kind == 1 else
                    " ".join(w + "$%&" for w in words))
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert 0.7 < model.prior < 0.9
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    held_out = [(i, y) for i, y in labels if crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= Q.CUTOFF) == bool(y) for i, y in held_out])
    assert right > 0.97 and len(held_out) > 100


def test_bad_labels_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    both = Q.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    good = Q.fit(docs, spark.createDataFrame([x for x in labels if x[1]], "doc_id bigint, quality int"))
    assert both.prior == good.prior
    x = Q._rows([t for _, t in rows])
    assert np.array_equal(both.score(x), good.score(x))


def test_prior_of_mixtures():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.9):
        p = rng.normal(2, 1, (1500, 6))
        n = int(3000 * prior)
        u = np.concatenate([rng.normal(2, 1, (n, 6)), rng.normal(-2, 1, (3000 - n, 6))])
        assert abs(Q.estimated_prior(p, rng.permutation(u)) - prior) < 0.06
    assert Q.estimated_prior(p[:2], u) == Q.estimated_prior(p, u[:0]) == 0.5
    assert Q.PRIORS[0] <= Q.estimated_prior(np.zeros((9, 6)), np.zeros((9, 6))) <= Q.PRIORS[1]


def test_defined_results(spark):
    docs = awkward_docs(spark)
    none = Q.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    out = Q.score(docs, none).collect()
    assert len(out) == docs.count() and {r["score"] for r in out} == {0.0}
    labels = spark.createDataFrame([(i, 1) for i in range(1, 11)], "doc_id bigint, quality int")
    model = Q.fit(docs, labels)
    out = Q.score(docs, model)
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert Q.score(no_docs(spark), model).count() == 0
    assert not Q.features(None).any() and not Q.features("").any()


def test_bounds_leave_whole_texts(spark):
    from qamill.llm.common import fetch_texts
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(5)] + [(0, None)],
                                 "doc_id bigint, text string")
    assert fetch_texts(docs, [4, 0, 2], 20) == [(4, "x" * 10), (0, "x" * 10)]
    assert fetch_texts(docs, [], 20) == []


def test_a_text_that_does_not_fit_is_passed_over(spark):
    from qamill.llm.common import fetch_texts, labelled_sample, smallest_hashes
    docs = spark.createDataFrame([(i, "y" * (1000 if i == 3 else 10)) for i in range(6)],
                                 "doc_id bigint, text string")
    assert fetch_texts(docs, [3, 0, 2], 25) == [(0, "y" * 10), (2, "y" * 10)]
    assert fetch_texts(docs, [0, 3, 2], 25) == [(0, "y" * 10), (2, "y" * 10)]
    assert fetch_texts(docs, [3], 25) == []
    # one very long labelled text at rank 0
    ids = spark.range(60).withColumnRenamed("id", "doc_id")
    labels = ids.selectExpr("doc_id", "1 as quality")
    first = smallest_hashes(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"),
                            "doc_id", 60, 11).first()[0]
    docs = ids.selectExpr("doc_id", f"repeat('z', if(doc_id = {first}, 5000, 10)) as text")
    got = labelled_sample(docs, labels, "quality", 20, 1000)
    assert got == {0: [], 1: ["z" * 10] * 19}
