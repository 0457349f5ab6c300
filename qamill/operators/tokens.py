"""Token ids: of a model's tokenizer, or of a vocabulary built over the corpus.

``model_token_ids`` encodes texts with a tokenizer file as a model ships it: row-local, in
Arrow batches, without a shuffle. The other functions split text into runs of
letters/marks/digits/underscore and single other non-space characters, with ids from a corpus
vocabulary: masks, padding and prompt lengths computed from them are exact, the ids
are no model's.

Plan shape: tokens are exploded into (key, kind, position, token) rows with
one explode for all text columns; counting is a hash aggregate with map-side
combine (frequent tokens are pre-aggregated per task); the id lookup joins on
the token, where Spark broadcasts the vocabulary if it measures small and
splits frequent tokens otherwise. The texts are partitioned by key first, so with a
broadcast vocabulary the regroup per text moves no exploded rows. A regroup group
is one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.functions.text import WS_CLASS
from qamill.operators.indexing import dense_index

# The token pattern and id conventions.
_WORD = r"\p{L}\p{M}\p{N}_"
_SPACE = WS_CLASS[1:-1]
TOKEN_PATTERN = "[" + _WORD + "]+|[^" + _WORD + _SPACE + "]"
#: Characters of a tokenizer file at most: it is sent to every executor.
MAX_TOKENIZER = 64_000_000
#: Characters that are encoded, and ids that are decoded, at once.
PART = 200_000
FIRST_ID = 1   # ids start at 1; 0 is the pad id
PAD_ID = 0


def tokenize(text) -> F.Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), 0)


def build_vocab(texts: DataFrame, text_cols: list[str]) -> DataFrame:
    """token, n (corpus count), token_id (by count desc, token asc, from 1)."""
    toks = None
    for c in text_cols:
        part = texts.select(F.explode(tokenize(c)).alias("token"))
        toks = part if toks is None else toks.unionByName(part)
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = dense_index(counts, [], ["n", "token"], "token_id", descending=("n",))
    return ranked.withColumn("token_id", F.col("token_id") + FIRST_ID)


def _is_kind(i: int):
    # a one-argument lambda: Spark reads a second parameter as the element index
    return lambda t: t["_kind"] == F.lit(i)


def _tagged(kind: int):
    # (token, position) -> struct(kind, position, token)
    return lambda t, pos: F.struct(F.lit(kind).alias("_kind"), pos.alias("_pos"), t.alias("token"))


def token_ids(texts: DataFrame, keys: tuple[str, ...], text_cols: dict[str, str],
              vocab: DataFrame) -> DataFrame:
    """For each text column ``c`` -> output array column ``text_cols[c]`` of
    vocabulary ids, in token order. All columns share one explode, one join
    and one regroup by ``keys``, which identify a text. Texts without tokens get
    empty arrays; tokens missing from the vocabulary get null ids."""
    kinds = list(text_cols)
    tagged = F.concat(*[F.transform(tokenize(c), _tagged(i)) for i, c in enumerate(kinds)])
    exploded = texts.repartition(*keys).select(*keys, F.explode_outer(tagged).alias("_t")) \
        .select(*keys, "_t._kind", "_t._pos", "_t.token")
    ids = exploded.join(vocab.select("token", "token_id"), "token", "left")
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_kind", "_pos", "token_id"))
    grouped = ids.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_toks"))
    out = [F.col(k) for k in keys]
    for i, c in enumerate(kinds):
        out.append(F.transform(F.filter("_toks", _is_kind(i)),
                               lambda t: t["token_id"]).alias(text_cols[c]))
    return grouped.select(*out)


#: Tokenizers that this worker has built, one file's at a time, by the file's digest.
_built: dict[str, object] = {}


def _tokenizer(digest: str, shared):
    """The worker's tokenizer of a broadcast file, kept from task to task."""
    if digest not in _built:
        from tokenizers import Tokenizer
        made = Tokenizer.from_str(shared.value)
        made.no_truncation()
        made.no_padding()
        _built.clear()
        _built[digest] = made
    return _built[digest]


def _groups(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values whose sizes sum up to ``most``; a larger value is a range of its own."""
    start, stop, total = 0, 0, 0
    for stop, size in enumerate(sizes, 1):
        if total + size > most and stop - 1 > start:
            yield start, stop - 1
            start, total = stop - 1, 0
        total += size
    if stop > start:
        yield start, stop


def _with_tokenizer(spark, path: str, kind: str, size, work) -> Callable[[Column | str], Column]:
    """A pandas UDF that applies ``work(tokenizer, values)`` to parts of batches, as many values at once as
    have a total ``size`` of ``PART``: what the tokenizer makes of a part, many times its size, is gone before the
    next one. The tokenizer file is read once on the driver and broadcast, so executors need no copy of it. Not an
    iterator, so Spark sends several such columns of one projection through one worker."""
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > MAX_TOKENIZER:
        raise ValueError(f"tokenizer file {path!r} is larger than {MAX_TOKENIZER} characters")
    shared, digest = spark.sparkContext.broadcast(text), sha256(text.encode()).hexdigest()

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        tokenizer, values, out = _tokenizer(digest, shared), s.tolist(), []
        for start, stop in _groups(map(size, values), PART):
            out += work(tokenizer, values[start:stop])
        return pd.Series(out, index=s.index, dtype=object)

    return run


def model_token_ids(texts: DataFrame, keys: tuple[str, ...], text_cols: dict[str, str],
                    tokenizer: str) -> DataFrame:
    """For each text column ``c`` -> output array column ``text_cols[c]`` of the ids of the ``tokenizers`` file
    ``tokenizer``, without the special tokens a model adds around a text. Null and empty texts get empty
    arrays; whole texts are encoded, whatever their length. Rows stay where they are."""
    def encode(tok, rows):
        done = iter(tok.encode_batch_fast([v or "" for row in rows for v in row], add_special_tokens=False))
        return [[np.array(next(done).ids, dtype=np.int32) for _ in row] for row in rows]

    # the columns of a row go to Python together, so there is one pass
    ids = _with_tokenizer(texts.sparkSession, tokenizer, "array<array<int>>",
                          lambda row: sum(len(v or "") for v in row), encode)
    done = texts.select(*keys, ids(F.array(*text_cols)).alias("_ids"))
    return done.select(*keys, *[F.col("_ids")[i].alias(out) for i, out in enumerate(text_cols.values())])


def model_text(df: DataFrame, ids: Column | str, tokenizer: str) -> Column:
    """The text that an array of ids stands for (null for a null array), special tokens included."""
    def decode(tok, values):
        some = [v for v in values if v is not None]
        done = iter(tok.decode_batch([[int(i) for i in v] for v in some], skip_special_tokens=False))
        return [None if v is None else next(done) for v in values]

    return _with_tokenizer(df.sparkSession, tokenizer, "string", lambda v: 0 if v is None else len(v), decode)(ids)
