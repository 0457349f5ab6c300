"""Toxicity by a linear-chain conditional random field over tokens.

Training reads a bounded sample of labelled documents (``PER_CLASS`` rows and
``MAX_CHARS`` characters a class, whole texts, equal texts once). Tokens are tagged from the
document labels: a word is a toxic cue if it is at least ``CUE_RATIO`` times as frequent
in toxic documents as in clean ones, and among the ``CUES_PER_DOC`` most widespread
such words of at least two toxic documents; cues are tagged toxic inside toxic documents,
every other token clean. The field has two states, hashed word, prefix and
suffix features, and transition weights; it is trained by gradient ascent on the
conditional likelihood with forward-backward expectations.

Scoring runs forward-backward over whole documents. A token's marginal is its
probability of being toxic; a document's evidence is -log of the chance that no
token is, and a logistic curve over the evidence and its density, fitted on the training
documents, gives the score. Offending offsets are the character ranges of
tokens with a marginal of at least 0.5.

All documents of a batch form one chain: a first token's transition ignores
the state before it. Chains are cut into equal lanes; lane products, then lane
starts, then states give the exact forward and backward messages with array
operations only.

Defined results: null, empty and word-free texts have no evidence and get the
curve's lowest score; without labels of both classes every score is the only class seen
(0 when none); repeated rows are scored alike; other columns pass through, and
columns named like the output are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import aside, fold, labelled_sample, table

#: Bounds of the training sample, for each class.
PER_CLASS = 2_000
MAX_CHARS = 2_500_000
CUE_RATIO = 20.0
CUES_PER_DOC = 2
FEATURE_BITS = 18
STEPS = 40
L2 = 0.02
#: Words whose emission scores a worker keeps, and tokens of one chain.
CACHE_WORDS = 300_000
CHAIN_TOKENS = 250_000

_TOKEN = re.compile(r"[^\W_]+")
SPANS = "array<struct<start:int,end:int>>"


def word_features(word: str) -> list[int]:
    """Hashed features of a token: the word, its prefixes of 2 to 6 and suffixes of 2 to 4
    bytes, and a constant."""
    w = word.lower().encode("utf-8", "surrogatepass")
    mask = (1 << FEATURE_BITS) - 1
    out = [0, crc32(w, 1) & mask]
    for k in range(2, min(6, len(w)) + 1):
        out.append(crc32(w[:k], 2) & mask)
    for k in range(2, min(4, len(w)) + 1):
        out.append(crc32(w[-k:], 3) & mask)
    return out


def _lanes(x: np.ndarray, lanes: int, fill: float) -> np.ndarray:
    """Consecutive stretches of ``x`` as columns, padded with ``fill``."""
    steps = -(-len(x) // lanes)
    return np.concatenate([x, np.full(steps * lanes - len(x), fill, x.dtype)]).reshape(lanes, steps).T


def _sweep(m00, m01, m10, m11) -> np.ndarray:
    """Forward share of state 1 after each step, as (steps, lanes), for row vectors
    times the given matrices along one chain that runs down each lane in turn."""
    steps, lanes = m00.shape
    p = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]
    for k in range(steps):
        a, b, c, d = p
        p = [a * m00[k] + b * m10[k], a * m01[k] + b * m11[k],
             c * m00[k] + d * m10[k], c * m01[k] + d * m11[k]]
        scale = 1 / np.maximum(p[0] + p[1], p[2] + p[3])
        p = [q * scale for q in p]
    start = np.empty(lanes)
    one = 0.5
    for k, (a, b, c, d) in enumerate(zip(*(q.tolist() for q in p))):
        start[k] = one
        x, y = (1 - one) * a + one * c, (1 - one) * b + one * d
        one = y / (x + y)
    out = np.empty((steps, lanes))
    s = start
    for k in range(steps):
        t = 1 - s
        x, y = t * m00[k] + s * m10[k], t * m01[k] + s * m11[k]
        s = y / (x + y)
        out[k] = s
    return out


def messages(emit: np.ndarray, first: np.ndarray, trans: np.ndarray,
             start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward shares of state 1 for each token of one chain of documents.
    ``emit``: score of state 1 over 0; ``first``: marks first tokens of documents."""
    n = len(emit)
    lanes = max(1, int(np.sqrt(n)))
    e = np.clip(emit, -30, 30)
    t, s = np.exp(trans), np.exp(start)
    # halves of the emission on both states keep the products in range
    up, down = np.exp(e / 2), np.exp(-e / 2)
    m = [[np.where(first, s[j], t[i, j]) * (up if j else down) for j in range(2)] for i in range(2)]
    fwd = _sweep(*[_lanes(m[i][j], lanes, 1.0) for i in range(2) for j in range(2)])
    fwd = fwd.T.reshape(-1)[:n]
    # backward: the message at token k is the matrix of token k + 1 times the next message
    back = [[np.append(m[i][j][1:], 1.0)[::-1] for j in range(2)] for i in range(2)]
    bwd = _sweep(*[_lanes(back[j][i], lanes, 1.0) for i in range(2) for j in range(2)])
    return fwd, bwd.T.reshape(-1)[:n][::-1]


def marginals(emit, first, trans, start) -> np.ndarray:
    fwd, bwd = messages(emit, first, trans, start)
    one, none = fwd * bwd, (1 - fwd) * (1 - bwd)
    return one / np.maximum(one + none, 1e-300)


@dataclass
class Model:
    """Trained weights; ``constant`` is the score of all documents if there was no field to train."""
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    curve: np.ndarray
    constant: float | None = None


def _cues(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    in_toxic, in_clean = Counter(), Counter()
    sets = [set(d) for d in toxic]
    for s in sets:
        in_toxic.update(s)
    for d in clean:
        in_clean.update(set(d))
    n, m = len(toxic), len(clean)
    marked = {w for w, c in in_toxic.items()
              if c >= 2 and (c / n) / ((in_clean[w] + 0.5) / m) >= CUE_RATIO}
    votes = Counter()
    for s in sets:
        votes.update(sorted(s & marked, key=lambda w: (-in_toxic[w], w))[:CUES_PER_DOC])
    return {w for w, c in votes.items() if c >= 2} or marked


def evidence(gamma: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(documents, 2): log evidence and log density of marginals cut by ``sizes``."""
    each = -np.log1p(-np.minimum(gamma, 1 - 1e-9))
    total = np.zeros(len(sizes))
    full = sizes > 0
    if full.any():
        total[full] = np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
    return np.stack([np.log(total + 1e-4), np.log((total + 1e-4) / (sizes + 20))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (bias last) of a ridge logistic curve by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def train(texts: dict[int, list[str]]) -> Model:
    """Train the field on texts by label (1 toxic, 0 clean)."""
    zero = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
    docs, y = [], []
    for c in (0, 1):
        for t in dict.fromkeys(texts.get(c, [])):
            tokens = [w.lower() for w in _TOKEN.findall(t)]
            if tokens:
                docs.append(tokens)
                y.append(c)
    if len(set(y)) < 2:
        return Model(zero, np.zeros((2, 2)), np.zeros(2), np.zeros(3), float(max(y, default=0)))
    labels = np.array(y)
    cues = _cues([d for d, c in zip(docs, y) if c], [d for d, c in zip(docs, y) if not c])
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d])
    sizes = np.array([len(d) for d in docs])
    first = np.zeros(len(ids), dtype=bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    is_cue = np.array([w in cues for w in number])
    tags = is_cue[ids] & np.repeat(labels == 1, sizes)
    held, widths = array("i"), []
    for word in number:
        found = word_features(word)
        held.extend(found)
        widths.append(len(found))
    n_words = len(number)
    flat, owner = np.frombuffer(held, dtype=np.intc), np.repeat(np.arange(n_words, dtype=np.intc), widths)
    del docs, number
    w = np.zeros(1 << FEATURE_BITS)
    trans, start = np.zeros((2, 2)), np.zeros(2)
    inner = np.flatnonzero(~first)
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (tags[inner - 1].astype(int), tags[inner].astype(int)), 1)
    gold_s = np.bincount(tags[first].astype(int), minlength=2)
    state = [np.zeros_like(w), np.zeros_like(trans), np.zeros_like(start)]
    pace = [np.zeros_like(w), np.zeros_like(trans), np.zeros_like(start)]
    rate = 0.5
    for step in range(1, STEPS + 1):
        emit = np.bincount(owner, w[flat], n_words)[ids]
        fwd, bwd = messages(emit, first, trans, start)
        one, none = fwd * bwd, (1 - fwd) * (1 - bwd)
        gamma = one / np.maximum(one + none, 1e-300)
        by_word = np.bincount(ids, tags - gamma, n_words)
        g_w = np.bincount(flat, by_word[owner], len(w)) - L2 * w
        a, b, e = fwd[inner - 1], bwd[inner], np.clip(emit[inner], -30, 30)
        joint = np.stack([x * np.exp(trans[i, j] + (e if j else 0)) * z
                          for i, x in enumerate((1 - a, a)) for j, z in enumerate((1 - b, b))])
        joint /= np.maximum(joint.sum(axis=0), 1e-300)
        g_t = gold_t - joint.sum(axis=1).reshape(2, 2) - L2 * trans
        at = gamma[first]
        g_s = gold_s - np.array([(1 - at).sum(), at.sum()]) - L2 * start
        for k, (p, g) in enumerate(((w, g_w), (trans, g_t), (start, g_s))):  # Adam
            state[k] = 0.8 * state[k] + 0.2 * g
            pace[k] = 0.98 * pace[k] + 0.02 * g * g
            p += rate * (state[k] / (1 - 0.8 ** step)) / (np.sqrt(pace[k] / (1 - 0.98 ** step)) + 1e-3)
        rate *= 0.96
    emit = np.bincount(owner, w[flat], n_words)[ids]
    curve = _logistic(evidence(marginals(emit, first, trans, start), sizes), labels)
    return Model(w.astype(np.float32), trans, start, curve)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
        max_chars: int = MAX_CHARS) -> Model:
    """Train on labelled rows of ``docs`` outside the held-out fold."""
    return train(labelled_sample(docs, labels, "toxic", per_class, max_chars))


class _Words(dict):
    """Token -> emission score, computed once while it is kept."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = self.weights
        value = self[word] = sum([w[k] for k in word_features(word)])
        return value


def _chains(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about CHAIN_TOKENS tokens together, or one longer text."""
    run, chars = [], 0
    for t in texts:
        if run and chars + len(t) > 6 * CHAIN_TOKENS:
            yield run
            run, chars = [], 0
        run.append(t)
        chars += len(t)
    if run:
        yield run


def _spans(text: str, gamma: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    last = -2
    for k, m in enumerate(_TOKEN.finditer(text)):
        if gamma[k] >= 0.5:
            if last == k - 1 and out:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            last = k
    return out


def _tag(texts: list[str], words: _Words, model: Model) -> tuple[np.ndarray, list[list]]:
    tokens = [_TOKEN.findall(t) for t in texts]
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    n = int(sizes.sum())
    gamma = np.zeros(n)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if n:
        emit = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)),
                           dtype=np.float64, count=n)
        first = np.zeros(n, dtype=bool)
        first[starts[:-1][sizes > 0]] = True
        gamma = marginals(emit, first, model.trans, model.start)
    x = np.column_stack([evidence(gamma, sizes), np.ones(len(sizes))]) @ model.curve
    hot = np.unique(np.searchsorted(starts, np.flatnonzero(gamma >= 0.5), side="right") - 1)
    spans: list[list] = [[] for _ in texts]
    for k in hot:
        spans[k] = _spans(texts[k], gamma[starts[k]:starts[k + 1]])
    return 1 / (1 + np.exp(-np.clip(x, -30, 30))), spans


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and the offending ``spans`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB of weights

    @F.pandas_udf(f"score double, spans {SPANS}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        words = _Words(m.weights)
        for s in batches:
            texts = [x or "" for x in s]
            if m.constant is not None:
                yield pd.DataFrame({"score": [m.constant] * len(s), "spans": [[]] * len(s)})
                continue
            scores, spans = [], []
            for run_ in _chains(texts):
                a, b = _tag(run_, words, m)
                scores.append(a)
                spans += b
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else [],
                                "spans": [[{"start": p, "end": q} for p, q in x] for x in spans]})

    docs, (text,), back = aside(docs, text)
    keep = [c for c in docs.columns if c not in ("score", "spans")]
    return back(docs.select(*keep, run(F.col(text)).alias("_toxic"))
                .select(*keep, "_toxic.score", "_toxic.spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: toxicity score of every document and the places of its toxic spans (start-end, in characters)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    done = score(docs, model)
    places = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return done.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       F.concat_ws(" ", places).alias("spans"))
