import itertools
import random
from zlib import crc32

import numpy as np

from qamill.llm import toxicity as T
from tests.llm.helpers import WORDS, awkward_docs, no_docs, prose

BAD = ["grumblefex", "grumbleton", "vilething", "nastyword"]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, rng.randint(20, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    emit, first = rng.normal(0, 2, 25), np.zeros(25, bool)
    first[[0, 1, 8, 16]] = True
    trans, start = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    got = T.marginals(emit, first, trans, start)
    ends = [*np.flatnonzero(first), 25]
    for s, e in zip(ends, ends[1:]):
        total, on = 0.0, np.zeros(e - s)
        for y in itertools.product((0, 1), repeat=e - s):
            p = np.exp(start[y[0]] + sum(emit[s + i] * y[i] for i in range(e - s))
                       + sum(trans[y[i], y[i + 1]] for i in range(e - s - 1)))
            total, on = total + p, on + p * np.array(y)
        assert np.allclose(on / total, got[s:e])


def test_held_out_accuracy_and_offsets(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = T.fit(docs, lab)
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    held_out = [(i, y) for i, y in labels if crc32(str(i).encode()) % 5 == 0]
    wrong = sum((got[i]["score"] >= 0.5) != bool(y) for i, y in held_out)
    assert wrong == 0 and {y for _, y in held_out} == {0, 1}
    for i, text in rows:
        for s in got[i]["spans"]:
            assert set(text[s["start"]:s["end"]].split()) <= set(BAD)
    assert got[0]["spans"]


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows, labels = corpus(60)
    model = T.train({0: [t for (_, t), (_, y) in zip(rows, labels) if not y],
                     1: [t for (_, t), (_, y) in zip(rows, labels) if y]})
    got = T.score(docs, model)
    out = got.collect()
    assert len(out) == docs.count() and all(0 <= r["score"] < 0.5 and r["spans"] == [] for r in out)
    assert T.score(no_docs(spark), model).count() == 0


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = T.fit(awkward_docs(spark), none)
    assert {r["score"] for r in T.score(awkward_docs(spark), model).collect()} == {0.0}
    assert T.train({1: ["a b"]}).constant == 1.0


def test_cues_are_shared_words_only():
    toxic = [["bad", *prose(i, 30).split()] for i in range(20)]
    clean = [prose(100 + i, 30).split() for i in range(60)]
    assert "bad" in T._cues(toxic, clean) and not set(WORDS) & T._cues(toxic, clean)
