"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is a sample
of the whole table. With class prior p the unbiased risk of the negatives in the
unlabelled set is R_u(-) - p R_p(-), which a flexible model can drive below
zero; the non-negative estimator p R_p(+) + max(0, R_u(-) - p R_p(-)) is
minimised: where the bracket is negative only the positive part moves the
model. The prior is estimated from the positives and the unlabelled rows alone; labels of bad
documents are not read. A network that tells the two samples apart ranks the other half of both:
among the rows above a cut, the share of all unlabelled rows over the share of all positives is
at least the prior, and close to it where the cut leaves few bad rows. The cut taken has the
least upper confidence bound of that ratio; the two halves' estimates are averaged.

Features describe a whole text at any length: shares of character classes,
word shapes, repetition of neighbouring words, lines and distinct words, and, over windows of
``WINDOW`` words, the largest and mean of the main shares, so that junk inside a long
text is seen. The model is a small network (one hidden layer) on standardised
features; an ensemble of ``MODELS`` seeds is averaged. The logistic loss makes its
output the probability of being good.

The training bounds are parameters: ``PER_CLASS`` positives, ``UNLABELLED`` unlabelled rows
and ``MAX_CHARS`` characters each; the prior is estimated from the same rows.

Defined results: null and empty texts have all-zero features and are scored like any
other; without positives every score is 0; repeated rows score alike; other columns
pass through, columns named like the output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import fetch_texts, fold, labelled_sample, smallest_hashes, table

PER_CLASS = 3_000
UNLABELLED = 6_000
MAX_CHARS = 6_000_000
WINDOW = 64
HIDDEN = 16
MODELS = 2
STEPS = 300
BATCH = 800
CUTOFF = 0.3
#: Failure probability and margin of the prior's confidence bound, and the range it is kept in.
DELTA = 0.1
MARGIN = 0.01
PRIORS = (0.02, 0.98)

# Classes of bytes.
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _COMMON, _SYMBOL, _HIGH = range(8)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, dtype=np.int64)
    out[ord("A"):ord("Z") + 1] = _UPPER
    out[ord("a"):ord("z") + 1] = _LOWER
    out[ord("0"):ord("9") + 1] = _DIGIT
    out[[32, 9]] = _SPACE
    out[[10, 13]] = _LINE
    out[[ord(c) for c in ".,;:'\"?()-"]] = _COMMON
    out[128:] = _HIGH
    return out


_CLASS = _byte_classes()
N_FEATURES = 30


def features(text: str | None) -> np.ndarray:
    """Feature vector of one whole text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, by_byte, minlength=8)
    total = len(raw)
    out[:8] = by_class / total
    words = raw.split()
    n = len(words)
    if not n:
        return out
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64, count=n)
    same1 = np.zeros(n)
    same1[1:] = ids[1:] == ids[:-1]
    # shape of each distinct word, spread to its places
    distinct = list(number)
    shout = np.fromiter([w.isupper() and len(w) > 1 for w in distinct], dtype=float)[ids]
    odd = np.fromiter([not w.isalnum() and w.strip(b".,;:'\"?()-").isascii()
                       and not w.strip(b".,;:'\"?()-").isalnum() for w in distinct], dtype=float)[ids]
    counts = np.bincount(ids)
    lines = raw.split(b"\n")
    top = np.sort(counts)[::-1]
    out[8] = np.log1p(n)
    out[9] = sizes.mean()
    out[10] = sizes.std()
    out[11] = len(number) / n
    out[12] = top[0] / n
    out[13] = top[:5].sum() / n
    out[14] = same1.mean()
    out[15] = shout.mean()
    out[16] = odd.mean()
    out[17] = np.log1p(len(lines))
    out[18] = len(set(lines)) / len(lines)
    out[19] = np.log1p(n / len(lines))
    out[20] = by_byte[ord("!")] / n
    out[21] = by_byte[ord("|")] / n
    out[22] = by_byte[ord(".")] / n
    out[23] = by_byte[ord(",")] / n
    at = np.arange(0, n, WINDOW)
    width = np.diff(np.append(at, n))
    for k, v in enumerate((same1, shout, odd)):
        share = np.add.reduceat(v, at) / np.maximum(width, WINDOW // 2)
        out[24 + 2 * k] = share.max()
        out[25 + 2 * k] = (share > 0.2).mean()
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    nets: list[tuple]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.nets or not len(x):
            return np.zeros(len(x))
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.mean([_sigmoid(_forward(net, z)[1]) for net in self.nets], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(net: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = net
    h = np.tanh(x @ w1 + b1)
    return h, h @ w2 + b2


def _step(net: tuple, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
    """Gradient of the net's parameters for given slopes of the risk by output."""
    h, _ = _forward(net, x)
    back = (slope[:, None] * net[2]) * (1 - h * h)
    return [x.T @ back, back.sum(axis=0), h.T @ slope, slope.sum()]


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, seed: int) -> tuple:
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    net = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN),
           rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.float64(np.log(prior / (1 - prior)))]
    m1 = [np.zeros_like(w) for w in net]
    m2 = [np.zeros_like(w) for w in net]
    for t in range(1, STEPS + 1):
        bp = p[rng.integers(0, len(p), min(len(p), BATCH))]
        bu = u[rng.integers(0, len(u), min(len(u), 2 * BATCH))]
        yp, yu = _sigmoid(_forward(net, bp)[1]), _sigmoid(_forward(net, bu)[1])
        # logistic losses: + is -log y, - is -log(1 - y); slopes by output
        negative = -np.log1p(-yu * (1 - 1e-9)).mean() + prior * np.log1p(-yp * (1 - 1e-9)).mean()
        up = _step(net, bp, -(1 - yp) / len(bp))
        down_u, down_p = _step(net, bu, yu / len(bu)), _step(net, bp, yp / len(bp))
        grads = []
        for a, b, c, w in zip(up, down_u, down_p, net):
            bracket = b - prior * c
            grads.append(prior * a + (bracket if negative >= 0 else 0) + 1e-5 * w)
        for k, g in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            rate = 0.01 * (0.5 + 0.5 * np.cos(np.pi * t / STEPS))
            net[k] = net[k] - rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(net)


def mixture_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior by scores of positive and unlabelled rows that trained nothing."""
    p, u = np.sort(positive), np.sort(unlabelled)
    above_p = 1 - np.searchsorted(p, p, "left") / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    slack = np.sqrt(np.log(4 / DELTA) / (2 * len(u))) + np.sqrt(np.log(4 / DELTA) / (2 * len(p)))
    best = int(np.argmin((above_u + (1 + MARGIN) * slack) / above_p))
    return float(above_u[best] / above_p[best])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from feature rows: each half's scores by a network of the other half. One in two
    where there are too few rows to tell."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    found = []
    for (p, u), (other_p, other_u) in (halves, halves[::-1]):
        model = train(p, u, 0.5, models=1)
        found.append(mixture_bound(model.score(other_p), model.score(other_u)))
    return float(np.clip(np.mean(found), *PRIORS))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, models: int = MODELS) -> Model:
    """Minimise the non-negative risk on feature rows."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [], prior)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    return Model(mean, scale, [_minimise(p, u, prior, s) for s in range(models)], prior)


def _rows(texts: list[str]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
        unlabelled: int = UNLABELLED, max_chars: int = MAX_CHARS) -> Model:
    """Train on good documents outside the held-out fold and an unlabelled sample."""
    good = labelled_sample(docs, labels, "quality", per_class, max_chars, classes=(1,))[1]
    ids = [r[0] for r in smallest_hashes(docs, "doc_id", unlabelled, 29).collect()]
    mixed = [t for _, t in fetch_texts(docs, ids, max_chars)]
    positive, other = _rows(good), _rows(mixed)
    return train(positive, other, estimated_prior(positive, other))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few KB

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shared.value.score(_rows(list(s))))

    return docs.withColumn("score", run(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
