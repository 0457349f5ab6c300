import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qamill.llm import packing as P
from tests.llm.helpers import awkward_docs, no_docs


@pytest.fixture(scope="module")
def own():
    from tokenizers import Tokenizer
    return P.Encoder(P.tokenizer_path()), Tokenizer.from_file(P.tokenizer_path())


@given(st.lists(st.text(alphabet=" \n\t\x1c abcé's'd1,.!<|endoftext|>", max_size=40), max_size=5))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_tokenizer(own, texts):
    encoder, t = own
    got = [array("I", b).tolist() for b in encoder.batch(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_plan_holds_the_histogram_and_is_tight():
    histogram = {2048: 3, 1500: 10, 548: 10, 1024: 5, 700: 9, 600: 9, 748: 9, 1: 40}
    configs = P.plan(histogram)
    held = Counter()
    for lengths, counts, times in configs:
        assert lengths @ counts <= 2048
        for x, n in zip(lengths.tolist(), counts.tolist()):
            held[x] += n * times
    assert held == Counter(histogram)
    area = sum(k * v for k, v in histogram.items())
    assert sum(t for _, _, t in configs) <= -(-area // 2048) + 1
    assert P.plan({}) == [] and sum(t for *_, t in P.plan({2048: 4})) == 4


def test_knapsack_is_exact():
    import itertools
    import numpy as np
    lengths, value = np.array([3, 5, 7]), np.array([0.4, 0.75, 1.0])
    best = max((sum(n * v for n, v in zip(c, value)) for c in itertools.product(range(8), repeat=3)
                if sum(n * x for n, x in zip(c, lengths)) <= 23))
    assert abs(P._knapsack(lengths, value, 23) @ value - best) < 1e-12


def test_documents(spark, own):
    docs = awkward_docs(spark)
    got = P.pack(docs, P.tokenizer_path()).collect()
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own_places in places.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= 2048
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(own[1].encode(r["text"] or "", add_special_tokens=False).ids + [0])
    want = Counter()
    for key, all_ids in texts.items():
        for ids in all_ids:
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[key, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert P.pack(no_docs(spark), P.tokenizer_path()).count() == 0


def test_sequences_round_trip(spark, own):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id bigint, text string")
    packed = P.sequences(P.place(P.pieces(docs, P.tokenizer_path()))).collect()
    total = sum(len(own[1].encode("word " * i, add_special_tokens=False).ids) + 1 for i in range(40))
    assert sum(len(r["ids"]) // 4 for r in packed) == total


def test_special_tokens_are_read_as_by_default(own):
    got = own[0].batch(["end <|endoftext|> here", "a<|endoftext|>", "plain <|endof"])
    assert array("I", got[0]).tolist() == [437, 220, 50256, 994]
    assert [array("I", b).tolist() for b in got[1:]] == \
        [own[1].encode(x, add_special_tokens=False).ids for x in ("a<|endoftext|>", "plain <|endof")]


def test_plain_texts_are_merged_in_one_call_without_words():
    encoder = P.Encoder(P.tokenizer_path())
    calls, merge = [], encoder.merge
    encoder.merge = lambda text, **options: calls.append(text) or merge(text, **options)
    texts = ["one two\nthree", "", "don't é 12", "x  y", "über 你好 two", "a\0b", "a\x01b", "end\n", " <|endoftext|>", "two"]
    got = [array("I", b).tolist() for b in encoder.batch(texts)]
    assert got == [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert calls[0] == "one two\nthree\0\0don't é 12\0end\n\0two"
    assert {w.strip() for w in encoder.words} == {"über", "你好", "two", "a\0b", "a\x01b"}
    for none in ([], [""], ["", ""]):
        assert encoder.batch(none) == [b""] * len(none)


def test_large_tables_of_configurations_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id bigint, text string")
    want = sorted(map(tuple, P.pack(docs, P.tokenizer_path()).collect()))
    monkeypatch.setattr(P, "BROADCAST_SLOTS", 0)
    assert sorted(map(tuple, P.pack(docs, P.tokenizer_path()).collect())) == want


@given(st.lists(st.text(max_size=30), max_size=4))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_text(own, texts):
    encoder, t = own
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    got = [array("I", b).tolist() for b in encoder.batch(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ranks_are_the_vocabulary(own):
    ranks = P.vocabulary_ranks(P.tokenizer_path())
    assert len(ranks) == own[1].get_vocab_size() - 1 and len(set(ranks.values())) == len(ranks)


def test_skewed_histogram_stays_near_the_area_bound():
    import numpy as np
    rng = np.random.default_rng(3)
    histogram = Counter(np.clip(rng.gamma(1.2, 450, 6000), 10, 2047).astype(int).tolist())
    histogram[700] += 3000  # a third of all pieces
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[x] for x in lengths.tolist()])
    area = -(-int(lengths @ demand) // 2048)
    used, left, bound = P.program(lengths, demand)
    assert left.sum() < demand.sum() / 4 and area - 1 <= np.ceil(bound) <= area
    configs = P.plan(histogram)
    held = Counter()
    for sizes, counts, times in configs:
        assert sizes @ counts <= 2048
        for x, n in zip(sizes.tolist(), counts.tolist()):
            held[x] += n * times
    assert held == histogram
    assert sum(t for *_, t in configs) <= 1.06 * area
