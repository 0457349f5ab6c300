"""Phrases and scores against a brute-force count, the trie against plain counting, awkward rows."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from qamill.llm import collocations as C
from tests.llm.helpers import DOC_SCHEMA, awkward_docs, no_docs

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, support, top, longest=4):
    """The contract, by plain counting."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items() if len(q) > len(p)):
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                 for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = ["the", "of", "é", "Zug", "über", "a-b", "x y", "　", "naïve", "to", "be", "or", "\x1fz"]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(["to be or not", "New York City", " ".join(rng.choices(words, k=3)), "a a a a"]))
            parts.append(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; "]))
        rows.append((k, "".join(parts), rng.choice(["en", "en", "de", None, "und"]), None, None))
    return rows


def test_equals_brute_force_over_blocks_and_shards(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    want = brute([(r[2], r[1]) for r in rows], 8, 50)
    assert len(want) > 40
    assert got(C.collocations(docs, top=50, support=8)) == want
    assert got(C.collocations(docs, top=50, support=8, shard=7, block=300)) == want


def test_more_shards_take_no_more_passes(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    made, materialize = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: made.append(1) or materialize(df))
    want = got(C.collocations(docs, top=50, support=8))
    few = len(made)
    assert got(C.collocations(docs, top=50, support=8, shard=7)) == want
    assert len(made) == 2 * few


def test_hashed_counts_over_parts_that_share_a_chunk(spark):
    rows = corpus()
    held = C.materialize(C.blocks(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), size=300))
    words = C.word_counts(held).where("f >= 8")
    bits, pairs = 16, Counter()
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", r[1].translate(FOLD)):
            w = re.findall(r"[^ \t]+", piece)
            pairs.update((r[2] or "und", x.encode(), y.encode()) for x, y in zip(w, w[1:]))
    frequent = [p for p, n in pairs.items() if n >= 8]
    hashes = np.array([C._joined(*C._word_hashes(p[0], list(p[1:])).reshape(2, 1))[0] for p in frequent])
    maps = [C.frequent_bitmap(words, bits, 8)]
    for parts in (1, 50):
        found, phrases, _ = C.hashed_counts(held, maps, bits, 8, parts)
        assert phrases == len(frequent) > 40
        on = np.flatnonzero(np.unpackbits(C.opened_bitmap(found, bits)))
        assert on.tolist() == sorted(set(C._buckets(hashes, bits).tolist()))


def test_trie_adds_up_listed_phrases():
    rng = np.random.default_rng(1)
    rows, times = rng.integers(1, 9, (5000, 3)), rng.integers(1, 50, 5000)
    phrases = np.unique(rows, axis=0)[::2]
    seen = Counter()
    for row, n in zip(map(tuple, rows.tolist()), times.tolist()):
        seen[row] += n
    found = C.DoubleArray(phrases, 8).count(rows.ravel(), np.arange(0, rows.size, 3), times)
    assert found.tolist() == [seen[tuple(p)] for p in phrases.tolist()]


def test_rows_of_many_words_are_numbered_anew():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 4, (500, 4))
    for size in (4, 1 << 30):
        order, starts = C._distinct(list(rows.T), size)
        assert len(starts) == len(np.unique(rows, axis=0))
        assert (np.diff(starts, append=len(order)) == [(rows == rows[order[k]]).all(axis=1).sum() for k in starts]).all()
    assert [len(x) for x in C._distinct([np.zeros(0, np.int32)] * 4, 5)] == [0, 0]
    for kind in (np.int32, np.int64):
        numbers = rng.integers(0, 1 << 30, 1000).astype(kind)
        assert (C._of_planes(C._planes(numbers), kind) == numbers).all()


def test_covered_phrases_go_even_by_longer_ones_that_go_too(spark):
    text = "alpha beta gamma delta. " * 10 + "alpha beta. " * 3
    docs = spark.createDataFrame([(1, text, "en", "", 0)], DOC_SCHEMA)
    want = brute([("en", text)], 5, 10)
    assert got(C.collocations(docs, top=10, support=5)) == want
    assert {r[2] for r in want} == {"alpha beta", "alpha beta gamma delta"}


def test_very_long_piece_crosses_slices(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 64)
    text = "one two three four five " * 400
    words = [w for part in C.words_of(text) for w in part]
    assert words == text.encode().split() + [b"."]
    long = "é" * 500 + " b"
    assert [w for part in C.words_of(long) for w in part] == ["é".encode() * 500, b"b", b"."]
    assert [w for part in C.words_of("A.b,,C\x0bd\te") for w in part] == \
        [b"a", b".", b"b", b".", b".", b"c", b".", b"d", b"e", b"."]


def test_trie_counts_overlaps():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 40, 20_000).astype(np.int32)
    for m in (2, 3, 4):
        seen = Counter(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
        keys = [k for k in seen if all(k)][:3000] + [tuple([39] * (m - 1) + [1])]
        phrases = np.unique(np.array(keys), axis=0)
        trie = C.DoubleArray(phrases, 40)
        assert trie.count(words).tolist() == [seen.get(tuple(p), 0) for p in phrases.tolist()]
    assert C.DoubleArray(np.array([[1, 1]]), 1).count(np.array([1, 1, 1, 0, 1], np.int32)).tolist() == [2]
    assert C.DoubleArray(np.array([[1, 1]]), 1).count(np.array([1], np.int32)).tolist() == [0]


def test_saturated_counts_over_tasks(spark):
    counts = np.zeros(1 << 16, np.uint8)
    counts[[5, 9]] = 20, 29
    part = C._chunks(counts)
    parts = spark.createDataFrame(part.values.tolist() * 2, "chunk int, n binary").repartition(2)
    bitmap = C.opened_bitmap(C._bitmap(parts, 30), 16)
    assert C._test(bitmap, np.array([5, 9, 10])).tolist() == [True, True, False]


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert got(C.collocations(docs)) == brute(rows, 30, 2000)
    assert C.collocations(no_docs(spark)).count() == 0
    clash = docs.withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1)).withColumn("_lang", F.lit("q"))
    assert C.collocations(clash).count() == len(brute(rows, 30, 2000))


def test_scores_past_64_bits(spark):
    big = 9_000_000_000_000_000
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], "lang string, phrase string, f bigint")
    pairs = spark.createDataFrame([("en", "a b", big - 3)], "lang string, phrase string, f bigint")
    empty = pairs.limit(0)
    row = C.scored([words, pairs, empty, empty]).first()
    assert row.score == 2_000_000 * (big - 3) // (2 * big + 1)
