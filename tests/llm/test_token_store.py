"""Round trips of the token store against ``tokenizers``, keyed access, the hash index."""
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from qamill.llm import token_store as S
from qamill.llm.packing import tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOC_SCHEMA, awkward_docs, no_docs, prose


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(S.TOKENIZER))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids + [2]


def back(spark, folder):
    rows = S.read(S.find(S.stored_keys(spark, folder), folder), folder).collect()
    return sorted(((r.start, r.key, r.copy, r.n_tokens, array("I", bytes(r.ids)).tolist()) for r in rows))


def test_query_equals_tokenizers(spark, plain):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want, start = [], 0
    for d in sorted(docs, key=lambda r: r.doc_id):
        ids = plain(d.text)
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = S.query(spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want


def test_ids_of_any_words(plain):
    import random
    rng, codec = random.Random(9), S.Encoder(tokenizer_path(S.TOKENIZER))
    letters = "abcdeABC'ÀÉÖØßàéöøÿ×÷ª²½ıİΣσ́0123.,!?-_<|>\"\t\x1c\u3000 \n"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["it's WE'LL they're I'd 've '' 's' can't", "<|endoftext|>x <|startoftext|>", "x" * 5000, "É" * 700]
    for k in range(0, len(texts), 500):
        S.CACHE_WORDS, keep = 300, S.CACHE_WORDS
        got = codec.batch(texts[k:k + 500])
        S.CACHE_WORDS = keep
        assert [array("H", b).tolist() + [2] for b in got] == [plain(t) for t in texts[k:k + 500]]


def test_awkward_rows_and_keyed_access(spark, scratch, plain):
    docs = awkward_docs(spark).withColumn("key", F.lit("x")).withColumn("_row", F.lit(1))
    odd = ["end <|endoftext|> here", "a<|startoftext|>b", "Ä́ ÉCOLE it's we'LL 12 34²", "tab\there now　x",
           "é ́x", "İstanbul ΣΑΣ", "😀‍😀 \x1c a\x1cb", "a\r\n\r\nb"]
    more = spark.createDataFrame([(100 + k, t, None, None, None) for k, t in enumerate(odd)], DOC_SCHEMA)
    both = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    S.write(both, scratch, tokenizer_path(S.TOKENIZER), shard_ids=500)
    rows = [tuple(r) for r in both.collect()]
    got = back(spark, scratch)
    assert sorted((k or "", ids) for _, k, _, _, ids in got) == \
        sorted((str(i) if i is not None else "", plain(t)) for i, t in rows)
    starts, end = [r[0] for r in got], 0
    for start, _, _, n, ids in got:  # ascending keys, gapless
        assert start == end and n == len(ids)
        end += n
    assert starts == sorted(starts)
    keys = [int(r[1]) if r[1] is not None else -1 for r in got]
    assert keys == sorted(keys)
    store = S.Store(scratch)
    for key, text in rows:
        if key not in (4, None):
            assert store.get(key).tolist() == plain(text)
    assert store.get(4, 0).tolist() == store.get(4, 1).tolist() == plain(prose(1, 80))
    assert store.get(4, 2) is None and store.get(999_999) is None
    assert sorted(len(store.get(None, c)) for c in (0, 1)) == sorted(len(plain(t)) for k, t in rows if k is None)
    asked = spark.createDataFrame([("4", 1), ("nobody", 0), ("7", 0)], "key string, copy bigint")
    assert sorted((r.key, r.copy) for r in S.find(asked, scratch).collect()) == [("4", 1), ("7", 0)]


def test_a_hot_key_spreads_over_shards(spark, scratch, plain):
    docs = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                   F.lit("same words again").alias("text")).repartition(4)
    S.write(docs, scratch, tokenizer_path(S.TOKENIZER), shard_ids=50)
    held = S.manifest(scratch)
    assert len(held["shards"]) > 4 and held["documents"] == 400
    got = back(spark, scratch)
    assert sorted(r[2] for r in got if r[1] == "7") == list(range(266))
    assert len({(r[1], r[2]) for r in got}) == 400 and {tuple(r[4]) for r in got} == {tuple(plain("same words again"))}


def test_empty_table_and_text_keys(spark, scratch, plain):
    S.write(no_docs(spark), f"{scratch}/a", tokenizer_path(S.TOKENIZER))
    assert back(spark, f"{scratch}/a") == [] and S.Store(f"{scratch}/a").get(1) is None
    docs = spark.createDataFrame([("b é", "one"), ("a", "two"), ("", "three")], "name string, body string")
    S.write(docs, f"{scratch}/b", tokenizer_path(S.TOKENIZER), key="name", text="body")
    store = S.Store(f"{scratch}/b")
    assert [store.get(k).tolist() for k in ("", "a", "b é")] == [plain(t) for t in ("three", "two", "one")]
    assert store.get(None) is None


def test_index_is_minimal_perfect_and_knows_strangers():
    for n in (0, 1, 2, 1000, 20_000):
        low, high = S.key_hashes([str(k) for k in range(n)], [0] * n)
        entries = np.zeros(n, S.ENTRY)
        entries["offset"] = np.arange(n)
        index = S.Index(S.build_index(low, high, entries))
        at = index.find(low, high)
        assert sorted(at.tolist()) == list(range(n))
        assert index.entries["offset"][at].tolist() == list(range(n))
        low, high = S.key_hashes([str(k) for k in range(n, n + 1000)], [0] * 1000)
        assert (index.find(low, high) == -1).all()
    low, high = S.key_hashes(["a", "a"], [0, 0])
    with pytest.raises(ValueError):
        S.build_index(low, high, np.zeros(2, S.ENTRY))


def test_ranks_are_the_ids_of_a_suffixed_vocabulary():
    import json
    model = json.load(open(tokenizer_path(S.TOKENIZER), encoding="utf-8"))["model"]
    ranks = S.word_ranks(model)
    assert sorted(ranks.values()) == sorted(model["vocab"].values())
    assert ranks[b"in"] == model["vocab"]["in"] and ranks[b"!\x01"] == model["vocab"]["!</w>"]
    # no suffix, or ids that don't follow the merges: the whole tokenizer encodes
    assert S.word_ranks({**model, "end_of_word_suffix": None}) is None
    assert S.word_ranks({**model, "merges": model["merges"][::-1]}) is None


def test_merged_words_equal_the_tokenizer(plain):
    import random
    rng, codec = random.Random(5), S.Encoder(tokenizer_path(S.TOKENIZER))
    parts = [t.removesuffix("</w>") for t in codec.tokenizer.get_vocab()]
    words = [a + b for a, b in zip(parts, rng.sample(parts, len(parts)))]
    got = codec.batch(words)
    assert [array("H", b).tolist() + [2] for b in got] == [plain(w) for w in words]
