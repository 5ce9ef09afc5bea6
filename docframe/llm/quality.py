"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their smoothed shares in the two classes; a linear model with hinge
loss is fitted on them by dual coordinate descent; margins on rows kept from the fit set the scale of the score.

n-grams: words; 1 to 4 characters of the text's shape (lower case, upper case, digit, other letter, each sign itself); and
1 to 3 word shapes, in which a word that repeats the one before has a shape of its own.

Defined results: null and empty texts have no n-grams and get the score of the bare bias; very long texts are read whole,
in pieces that overlap by a shape n-gram; equal texts score alike; extra columns are not read; with no labelled rows, or
one label only, every score is that label's share (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_text, held_out, map_text, table, trim
from .samples import MOST_PER_LABEL, labelled, platt, prior_weights, sigmoid

BITS = 17
THRESHOLD = 0.7
PIECE = 1 << 20
#: Dual coordinate descent: cost of a wrong row, and passes over the sample.
COST, PASSES = 1.0, 15
#: Part of the sample that is kept from the fit and sets the score's scale.
CALIBRATION_SHARE = 0.25

_CLASS = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if "a" <= _c <= "z" or _b >= 0x80 else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() else 4 if _c in " \t" else 5 if _c in "\r\n" else 6 + _b % 58
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = 63


def _hashed(codes: np.ndarray, kind: int) -> np.ndarray:
    return (((codes << np.uint64(3)) + np.uint64(kind)) * _MIX) >> np.uint64(64 - BITS)


def _shape(word: bytes) -> int:
    """A word's shape: how it starts, whether it has capitals after that, its last sign and how long it is."""
    first = 0 if word[:1].islower() or word[0] >= 0x80 else 1 if word[:1].isupper() else 2
    return first * 16 + 8 * (len(word) > 1 and word.isupper()) + 4 * (not word[-1:].isalnum() and word[-1] < 0x80) + min(len(word).bit_length() - 1, 3)


def mark(data: bytes, seen: np.ndarray) -> None:
    """Sets the flags of the n-grams of a text."""
    for at in range(0, len(data), PIECE):
        c = _CLASS[np.frombuffer(data, dtype=np.uint8, count=min(PIECE + 3, len(data) - at), offset=at)]
        code = c
        for n in range(1, 5):
            if n > 1:
                if len(c) < n:
                    break
                code = (code[:-1] << np.uint64(6)) | c[n - 1 :]
            seen[_hashed(code, n - 1)] = True
    words = data.split()
    if not words:
        return
    distinct = set(words)
    hashed = xxhash.xxh64_intdigest
    seen[_hashed(np.fromiter([hashed(w.lower(), 7) >> 3 for w in distinct], dtype=np.uint64, count=len(distinct)), 4)] = True
    shape = {w: _shape(w) for w in distinct}
    s = np.fromiter([shape[w] for w in words], dtype=np.uint64, count=len(words))
    again = np.fromiter([a == b for a, b in zip(words, words[1:])], dtype=bool, count=len(words) - 1)
    s[1:][again] = _REPEAT
    code = s
    for n in range(1, 4):
        if n > 1:
            if len(s) < n:
                break
            code = (code[:-1] << np.uint64(6)) | s[n - 1 :]
        seen[_hashed(code, 4 + n)] = True


def features(data: bytes | None) -> np.ndarray:
    """Sorted numbers of the n-grams that a text has."""
    seen = np.zeros(1 << BITS, dtype=bool)
    if data:
        mark(data, seen)
    return np.flatnonzero(seen).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    share = []
    for label in (1, 0):
        p = np.full(1 << BITS, smooth)
        for k in np.flatnonzero(y == label):
            p[rows[k]] += 1
        share.append(np.log(p / (max((y == label).sum(), 1) + 2 * smooth)))
    return share[0] - share[1]


def dual_coordinate_descent(rows: list[np.ndarray], value: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = PASSES, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L1-loss support vector machine on rows of indicators scaled by value and to unit length."""
    w, bias = np.zeros(len(value)), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    xs = []
    for r in rows:
        v = value[r]
        xs.append((v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32))
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            r, x = rows[k], xs[k]
            gradient = sign[k] * (w[r] @ x + bias) - 1
            new = min(max(alpha[k] - gradient / (x @ x + 1.0), 0.0), cost[k])
            step = (new - alpha[k]) * sign[k]
            if step:
                w[r] += step * x
                bias += step
                alpha[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


class Model:
    """value: log count ratios; weight: of the scaled indicators; a, b: from margin to score."""

    def __init__(self, value: np.ndarray, weight: np.ndarray, bias: float, a: float, b: float) -> None:
        self.square = (value * value).astype(np.float64)
        self.product = (value * weight).astype(np.float64)
        self.bias, self.a, self.b = bias, a, b

    def margin(self, rows: np.ndarray) -> float:
        if not len(rows):
            return self.bias
        return float(self.product[rows].sum() / max(np.sqrt(self.square[rows].sum()), 1e-12) + self.bias)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return sigmoid(self.a * np.array([self.margin(features(t)) for t in texts], dtype=np.float64) + self.b)


def fit(sample: list[tuple[bytes, int]], counts: dict[int, int]) -> Model:
    y = np.array([label for _, label in sample], dtype=np.int64)
    none = np.zeros(1 << BITS)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    rows = [features(t) for t, _ in sample]
    kept = np.arange(len(y)) % round(1 / CALIBRATION_SHARE) == 0
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept[:] = False
    fitted = np.flatnonzero(~kept)
    own = [rows[k] for k in fitted]
    value = log_count_ratio(own, y[fitted])
    cost = COST * prior_weights(y[fitted], {0: 1, 1: 1})
    weight, bias = dual_coordinate_descent(own, value, y[fitted], cost)
    model = Model(value, weight, bias, 1.0, 0.0)
    use = kept if kept.any() else ~kept
    margin = np.array([model.margin(rows[k]) for k in np.flatnonzero(use)])
    model.a, model.b = platt(margin, y[use], prior_weights(y[use], counts))
    return model


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_LABEL) -> Model:
    model = fit(*labelled(docs, labels, "quality", most))
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: 2 ** BITS numbers, twice

    def make():
        m = shared.value
        return lambda texts: {"score": m.scores(texts)}

    return map_text(docs, ["doc_id"], "score double", make)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: m.scores(texts) >= threshold

    return filter_text(docs, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
