"""Language identification with bit-sliced Bloom filters of character n-grams.

Texts become words of lower-cased letters with one space around each; an n-gram is three
characters of that stream, packed into an integer. Training counts n-grams by
language over a sample of whole documents of about ``TRAINING_CHARS`` characters a language, or all
of them where they are fewer (combined in the tasks, then summed by
Spark). The sample is chosen by a hash of key and text, and bounds what is broadcast. A language's filter holds an n-gram if its share of that language's n-grams is
at least ``SHARE`` of the largest share any language gives it, so stray foreign
passages add nothing. The filters are bit-sliced: one array of slots, a slot's
bit k belonging to language k, so ``HASHES`` reads joined by AND return the
bitmask of all languages that hold an n-gram.

A document's n-grams give each language a count of set bits. A filter says yes to
an n-gram it does not hold with a known probability f (its fill to the power
``HASHES``), so a count c of n is corrected to (c - n f) / (1 - f). The language of the
largest corrected count is predicted; ties go to the language more frequent in
training, then the first by name. The score is the winner's share of it and the
runner-up, (c1 + 1/2) / (c1 + c2 + 1).

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0, as is
every text when there is nothing to learn from; repeated rows are predicted
alike; other columns pass through, columns named like the output are replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import aside, fold, table
from qamill.session import materialize

SHARE = 0.1
#: Characters of training texts that a language is learned from, about: rows beyond it are sampled.
TRAINING_CHARS = 32_000_000
#: Slots of the filter array at least (more where a language's n-grams would fill over FILL of
#: them), and probes.
SLOT_BITS = 20
FILL = 0.18
HASHES = 3
#: Characters handled at once.
CHUNK = 1_000_000
UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9],
                        dtype=np.uint64)  # fixed odd values
_LETTERS: list[np.ndarray] = []
_MARKS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or a space for all else. Combining marks
    stay, as parts of the words they stand in."""
    if not _LETTERS:
        out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low[0])
            elif unicodedata.category(ch) in ("Mn", "Mc"):
                out[c] = c
        _LETTERS.append(out)
    return _LETTERS[0]


def mark_table() -> np.ndarray:
    """Whether a code point is a combining mark that ``letter_table`` keeps."""
    if not _MARKS:
        kept = np.flatnonzero(letter_table() != 32)
        out = np.zeros(sys.maxunicode + 1, dtype=bool)
        out[[c for c in kept.tolist() if not chr(c).isalpha()]] = True
        _MARKS.append(out)
    return _MARKS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text number) of all texts, joined by a space that no n-gram crosses."""
    joined = "\n".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[:len(c)]
    c = letter_table()[c]
    # one space between words, and one at either end
    keep = np.ones(len(c), dtype=bool)
    if len(c) > 1:
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c, owner = c[keep], owner[keep]
    space = np.array([32], dtype=np.uint32)
    c = np.concatenate([space, c, space]).astype(np.uint64)
    middle = c[1:-1]
    key = (c[:-2] << np.uint64(42)) | (middle << np.uint64(21)) | c[2:]
    real = middle != 32  # the middle is a letter: no n-gram crosses words or texts
    return key[real], owner[real]


def _chunks(texts: list[str], *more: list) -> Iterator[tuple]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > CHUNK:
            yield (texts[at:k], *(m[at:k] for m in more))
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield (texts[at:], *(m[at:] for m in more))


def slots(key: np.ndarray, bits: int = SLOT_BITS) -> Iterator[np.ndarray]:
    for m in _MULTIPLIERS[:HASHES]:
        yield ((key ^ (key >> np.uint64(29))) * m) >> np.uint64(64 - bits)


def slot_bits(most: int) -> int:
    """Bits of a slot number for filters of at most ``most`` n-grams."""
    bits = SLOT_BITS
    while most * HASHES > FILL * (1 << bits):
        bits += 1
    return bits


@dataclass
class Model:
    """Bit-sliced filters: ``masks[slot]`` has bit k for ``languages[k]``, or, of more than 64
    languages, a word for each 64; ``wrong[k]`` is the probability of a false yes of language k."""
    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray


def _bit(masks: np.ndarray, k: int) -> np.ndarray:
    """Bit k of slot masks."""
    word = masks if masks.ndim == 1 else masks[:, k // 64]
    return (word >> word.dtype.type(k % 64)) & word.dtype.type(1)


def _order(docs: dict[str, int]) -> list[str]:
    return sorted(docs, key=lambda x: (-docs[x], x))


def _model(languages: list[str], masks: np.ndarray) -> Model:
    """The model of (slot, word) masks of 64 bits."""
    if masks.shape[1] == 1:
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64)
                     if len(languages) <= np.iinfo(t).bits)
        masks = masks[:, 0].astype(width)
    fill = np.array([np.count_nonzero(_bit(masks, k)) for k in range(len(languages))]) / len(masks)
    return Model(languages, masks, fill ** HASHES)


def build(counts: list[tuple[str, int, int]], docs: dict[str, int]) -> Model:
    """Filters from (language, n-gram, count) rows; ``docs``: documents by language."""
    languages = _order(docs)
    keys = {x: [] for x in languages}
    for x, g, _ in counts:
        keys[x].append(g)
    bits = slot_bits(max(map(len, keys.values()), default=0))
    masks = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    for k, x in enumerate(languages):
        for s in slots(np.array(keys[x], dtype=np.int64).view(np.uint64), bits):
            masks[s, k // 64] |= np.uint64(1 << k % 64)
    return _model(languages, masks)


def sampled(known: DataFrame, sizes: list[tuple[str, int]], chars: int) -> DataFrame:
    """Rows of (lang, text, hash) by a share of the hashes such that a language of ``sizes`` keeps about
    ``chars`` characters; all of its rows where it has no more."""
    shares = known.sparkSession.createDataFrame(
        [(x, min(1.0, chars / max(1, n))) for x, n in sizes], "lang string, part double")
    # one row for each language, so broadcast
    at = F.shiftrightunsigned("hash", 1) / F.lit(float(1 << 63))
    return known.join(F.broadcast(shares), "lang").where((F.col("part") >= 1) | (at < F.col("part")))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        chars: int | None = None) -> Model:
    """Learn from the rows of ``docs`` with a text and a language, ``chars`` (``TRAINING_CHARS``) characters a
    language. Copies of a text are sampled one by one where ``docs`` has the column ``key``."""
    choice = [F.col(c) for c in (key, text) if c in docs.columns]
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(*choice).alias("hash"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()
    docs_by = {r[0]: r[1] for r in sizes}
    chars = TRAINING_CHARS if chars is None else chars
    known = sampled(known, [(r[0], r[2]) for r in sizes], chars).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for language, own in b.groupby("lang"):
                for (part,) in _chunks(own["text"].tolist()):
                    key, n = np.unique(grams(part)[0], return_counts=True)
                    if language in held:
                        both = np.concatenate([held[language][0], key])
                        key, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[language][1], n])).astype(np.int64)
                    held[language] = key, n
            for language in [x for x, (k, _) in held.items() if len(k) > 1_000_000]:
                key, n = held.pop(language)  # bounded memory
                yield pd.DataFrame({"lang": language, "gram": key.view(np.int64), "n": n})
        for language, (key, n) in held.items():
            yield pd.DataFrame({"lang": language, "gram": key.view(np.int64), "n": n})

    counted = known.mapInPandas(count, "lang string, gram bigint, n bigint") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    languages = _order(docs_by)
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    if not totals:
        return build([], docs_by)
    # one row for each language, so broadcast
    numbers = docs.sparkSession.createDataFrame(
        [(x, k, totals[x]) for k, x in enumerate(languages) if x in totals],
        "lang string, k int, total bigint")
    shared = counted.join(F.broadcast(numbers), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shared.groupBy("gram").agg(F.max("share").alias("top"))
    own = materialize(shared.join(top, "gram").where(F.col("share") >= F.lit(SHARE) * F.col("top"))
                      .select("k", "gram"))
    bits = slot_bits(max(r[1] for r in own.groupBy("k").count().collect()))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = b["k"].to_numpy(dtype=np.uint64)
            bit = (np.uint64(1) << (k & np.uint64(63))).view(np.int64)
            word = (k >> np.uint64(6)).astype(np.int32)
            for s in slots(b["gram"].to_numpy(dtype=np.int64).view(np.uint64), bits):
                yield pd.DataFrame({"slot": s.view(np.int64), "word": word, "mask": bit})

    found = own.mapInPandas(probe, "slot bigint, word int, mask bigint") \
        .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((1 << bits, -(-len(languages) // 64)), dtype=np.uint64)
    slot, word, mask = (found[c].to_numpy() for c in ("slot", "word", "mask"))
    masks[slot, word] = mask.view(np.uint64)
    return _model(languages, masks)


def decide(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Predicted languages and scores of some texts."""
    n_lang = len(model.languages)
    key, owner = grams(texts)
    n = np.bincount(owner, minlength=len(texts)).astype(float)
    if not n_lang:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    mask = None
    for s in slots(key, len(model.masks).bit_length() - 1):
        mask = model.masks[s] if mask is None else mask & model.masks[s]
    counts = np.empty((len(texts), n_lang))
    for k in range(n_lang):
        counts[:, k] = np.bincount(owner, _bit(mask, k), minlength=len(texts))
    counts = np.maximum(0, (counts - n[:, None] * model.wrong) / (1 - model.wrong))
    order = np.argsort(-counts, axis=1, kind="stable")
    best = np.take_along_axis(counts, order[:, :2], axis=1)
    second = best[:, 1] if n_lang > 1 else np.zeros(len(texts))
    # a text of marks alone has n-grams but no letter
    middle = (key >> np.uint64(21)) & np.uint64((1 << 21) - 1)
    letters = np.bincount(owner, ~mark_table()[middle], minlength=len(texts)) > 0
    score = np.where(letters, (best[:, 0] + 0.5) / (best[:, 0] + second + 1), 0.0)
    names = [model.languages[o] if has else UNDETERMINED for o, has in zip(order[:, 0], letters)]
    return names, score


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    # 1 MB for each 8 languages, doubled where n-grams need it: bounded by TRAINING_CHARS, not by the corpus
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            names, scores = [], [np.zeros(0)]
            for (part,) in _chunks([x or "" for x in s]):
                a, b = decide(part, m)
                names += a
                scores.append(b)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    docs, (text,), back = aside(docs, text)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return back(docs.select(*keep, run(F.col(text)).alias("_lang"))
                .select(*keep, "_lang.lang_pred", "_lang.score"))


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fold (crc32 of the id modulo 3 is 1); a null id has no
    fold and is left out."""
    return docs.where(fold("doc_id", 3) != 1)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: predicted language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(training_rows(docs))
    done = predict(docs.select("doc_id", "text"), model)
    return done.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                       "lang_pred", "score")
