import numpy as np
from pyspark.sql import functions as F

from qamill.llm import language_id as L
from tests.llm.helpers import FREMD, awkward_docs, no_docs, prose


def corpus(spark, n=200):
    rows = [(i, prose(i, 30, FREMD) if i % 3 == 0 else prose(i, 30), "de" if i % 3 == 0 else "en")
            for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows


def test_held_out_accuracy(spark):
    docs, rows = corpus(spark)
    model = L.fit(L.training_rows(docs))
    got = {r["doc_id"]: r for r in L.predict(docs.drop("lang"), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1 for i, _, lang in rows)


def test_defined_results(spark):
    docs, _ = corpus(spark, 60)
    model = L.fit(docs)
    wide = awkward_docs(spark)
    out = L.predict(wide, model).collect()
    assert len(out) == wide.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    for i in (1, 2, 3, 8):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[7]["lang_pred"] == "de" and by[6]["lang_pred"] == "en"
    empty = L.fit(no_docs(spark))
    assert {r["lang_pred"] for r in L.predict(wide, empty).collect()} == {"und"}
    assert L.predict(no_docs(spark), model).count() == 0


def test_filters_hold_what_was_inserted():
    key, _ = L.grams([" ".join(FREMD)])
    key = np.unique(key)
    model = L.build([("de", int(g), 1) for g in key] + [("en", 5, 1)], {"de": 2, "en": 1})
    mask = None
    for s in L.slots(key):
        mask = model.masks[s] if mask is None else mask & model.masks[s]
    assert (mask & 1).all() and model.wrong[0] < 1e-6


def test_ngrams_stay_inside_words_and_texts():
    key, owner = L.grams(["ab", "", "É!c"])
    text = ["".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in key]
    assert text == [" ab", "ab ", " é ", " c "] and owner.tolist() == [0, 0, 2, 2]


def test_more_than_64_languages(spark):
    letters = [chr(0x4E00 + k) for k in range(70)]  # 70 languages, each of letters of its own
    rows = [(i * 70 + k, " ".join(c * n for n in (3, 4, 5)), f"l{k:02d}")
            for k, c in enumerate(letters) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fit(docs)
    assert len(model.languages) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs.drop("lang"), model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_filters_hold_every_ngram_of_a_large_language(spark):
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, w)) for w in rng.integers(0x4E00, 0x9000, (30_000, 3))]
    docs = spark.createDataFrame([(1, " ".join(words), "zh"), (2, "the river", "en")],
                                 "doc_id bigint, text string, lang string")
    model = L.fit(docs)
    key = np.unique(L.grams([" ".join(words)])[0])
    assert len(key) > 60_000
    mask, k = None, model.languages.index("zh")
    for s in L.slots(key, len(model.masks).bit_length() - 1):
        mask = model.masks[s] if mask is None else mask & model.masks[s]
    assert (mask >> k & 1).all()


def test_marks_are_no_letters():
    key = np.unique(L.grams(["hello wórld"])[0])
    model = L.build([("en", int(g), 1) for g in key], {"en": 1})
    names, score = L.decide(["́", "́ ́", "ा", "hello", "", "ó"], model)
    assert names == ["und", "und", "und", "en", "und", "en"]
    assert score[:3].tolist() == [0, 0, 0] and score[3] > 0.5
    # a spacing mark does not split a word
    key, _ = L.grams(["काम"])
    assert len(key) == 3


def test_training_is_bounded_by_characters(spark):
    docs, rows = corpus(spark, 600)
    docs = docs.union(spark.createDataFrame([(1000 + i, rows[0][1], "de") for i in range(300)], docs.schema))
    sizes = {"de": 0, "en": 0}
    for _, text, lang in rows:
        sizes[lang] += len(text)
    sizes["de"] += 300 * len(rows[0][1])
    known = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    got = L.sampled(known, list(sizes.items()), 10_000).groupBy("lang").agg(F.sum(F.length("text"))).collect()
    assert {r[0] for r in got} == {"de", "en"} and all(5_000 < r[1] < 15_000 for r in got)
    # no more than all rows, whole where they fit
    assert L.sampled(known, list(sizes.items()), 10**9).count() == docs.count()
    model = L.fit(docs, chars=10_000)
    named = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs.drop("lang"), model).collect()}
    assert all(named[i] == lang for i, _, lang in rows)
    # the same rows in another layout are sampled alike
    again = L.fit(docs.repartition(7), chars=10_000)
    assert again.languages == model.languages and (again.masks == model.masks).all()
