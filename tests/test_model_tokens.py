"""Ids of a model's tokenizer against plain merging by rank, and the texts back from the ids."""
import json

import pandas as pd
import regex

from qamill.operators import sft, tokens
from qamill.plans.catalog import TOKENIZER
from qamill.sources import fixtures
from tests.conftest import SF_SMALL

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
AWKWARD = [None, "", " ", "\n\n  x  \t", "Don't we'll it's 12,345.67!", "naïve über 你好 🙂", "a" * 3000,
           "x <|endoftext|> y<|endoftext|>", "é    z", "!!<|endoftext|"]


def _alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(others)}}


def _merged(text, vocab, ranks, alphabet):
    """Ids by merging the pair of least rank, first occurrence first, until none is left."""
    out = []
    for k, part in enumerate((text or "").split("<|endoftext|>")):
        out += [50256] if k else []
        for piece in PIECES.findall(part):
            w = [alphabet[b] for b in piece.encode()]
            while len(w) > 1:
                rank, i = min((ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(w, w[1:])))
                if rank == 10**9:
                    break
                w[i:i + 2] = [w[i] + w[i + 1]]
            out += [vocab[x] for x in w]
    return out


def test_ids_are_the_models(spark):
    with open(TOKENIZER, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ranks, alphabet = {p: i for i, p in enumerate(pairs)}, _alphabet()
    talk = [r.text for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("text").limit(300).collect()]
    texts = AWKWARD + talk
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.ids for r in tokens.model_token_ids(df, ("i",), {"text": "ids"}, TOKENIZER).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == _merged(t, model["vocab"], ranks, alphabet), t


def test_texts_come_back(spark):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "i long, text string")
    ids = tokens.model_token_ids(df, ("i",), {"text": "ids"}, TOKENIZER)
    back = ids.select("i", tokens.model_text(ids, "ids", TOKENIZER).alias("t")).collect()
    assert {r.i: r.t for r in back} == {i: t or "" for i, t in enumerate(AWKWARD)}


def test_a_batch_is_worked_on_in_parts(spark, monkeypatch):
    sizes, seen = [3, 0, 4, 9, 1, 1], []
    assert list(tokens._groups(sizes, 7)) == [(0, 3), (3, 4), (4, 6)] and list(tokens._groups([], 7)) == []
    monkeypatch.setattr(tokens, "PART", 7)
    run = tokens._with_tokenizer(spark, TOKENIZER, "string", len, lambda tok, values: seen.append(len(values)) or values)
    texts = pd.Series(["x" * n for n in sizes])
    assert run.func(texts).tolist() == texts.tolist() and seen == [3, 1, 2]


def test_both_texts_of_an_example_share_a_worker(spark):
    ids = spark.createDataFrame([(1, [1, 2], [3])], "i long, a array<int>, b array<int>")
    both = ids.select(tokens.model_text(ids, "a", TOKENIZER).alias("a"), tokens.model_text(ids, "b", TOKENIZER).alias("b"))
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_no_shuffle_and_one_python_pass(spark):
    tok = sft.tokenized(spark.createDataFrame([(1, 1, "q", "a")], "conv_id long, turn long, question string, answer string"),
                        tokenizer=TOKENIZER)
    plan = tok._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert tok.count() == 1 and sft.tokenized(fixtures.pairs(spark, SF_SMALL).limit(0), tokenizer=TOKENIZER).count() == 0
