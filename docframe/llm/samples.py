"""Bounded samples of labelled texts for fitting, and calibration of scores. Nothing here bounds what is scored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction, held_out

#: Rows of each label that a model is fitted on, at most.
MOST_PER_LABEL = 2500
#: Characters of a text that a model is fitted on, at most: a piece, at a place that a hash picks, stands for a longer one.
#: Scoring reads whole texts.
MOST_TRAIN_CHARACTERS = 60_000


def by_label(rows: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[object, int]]:
    """Rows (doc_id, label) that a sample of about `most` per label takes, by hash of doc_id; and all rows by label.

    The share is set from the counts, so sampling is a filter: no sort, no shuffle of rows.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0), counts
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, 1.1 * most / n))).otherwise(share)
    return rows.where(fraction(F.lit("sample"), F.col("doc_id")) < share), counts


def trimmed(rows: list, most: int) -> list[tuple[bytes, object]]:
    """(text, label) of at most `most` rows of each label, in an order that does not hang on how Spark dealt them."""
    taken: dict[object, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["order"], r["doc_id"], bytes(r["data"]))):
        taken[r["label"]] = taken.get(r["label"], 0) + 1
        if taken[r["label"]] <= most:
            out.append((bytes(r["data"]), r["label"]))
    return out


def _collected(df: DataFrame, most: int) -> list[tuple[bytes, object]]:
    over = F.length("text") - MOST_TRAIN_CHARACTERS
    at = F.floor(fraction(F.lit("piece"), F.col("doc_id"), F.col("text")) * (over + 1)).cast("int") + 1
    piece = F.when(over > 0, F.substring(F.col("text"), at, F.lit(MOST_TRAIN_CHARACTERS))).otherwise(F.col("text"))
    rows = df.select("doc_id", "label", piece.cast("binary").alias("data"), fraction(F.lit("order"), F.col("doc_id")).alias("order"))
    return trimmed(rows.collect(), most)


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int = MOST_PER_LABEL) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """Texts with labels[column], of rows that are not held out, and how many rows have each label.

    A doc_id with several labels has the highest.
    """
    own = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked, counts = by_label(rows, "label", most)
    # broadcast: about `most` ids for each of two labels
    return _collected(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id"), most), counts


def own_labelled(docs: DataFrame, column: str, most: int = MOST_PER_LABEL) -> list[tuple[bytes, object]]:
    """Texts with a label of their own row, of rows that are not held out."""
    known = F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return _collected(by_label(docs.select("doc_id", "text", F.col(column).alias("label")).where(known), "label", most)[0], most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def log_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Coefficients of margins (one, or a row for each) and a constant, for scores sigmoid(...) of labels y.

    By Newton's method with smoothed targets.
    """
    x = np.append(np.atleast_2d(margin), np.ones((1, len(y))), axis=0)
    start = np.eye(len(x))[0]
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return tuple(start)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(c: np.ndarray) -> float:
        z = c @ x
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    c, now = start, loss(start)
    for _ in range(rounds):
        p = sigmoid(c @ x)
        g = x @ (weight * (p - target))
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(len(x))
        step = np.linalg.solve(h, g)
        scale = 1.0
        while scale > 1e-6 and loss(c - scale * step) > now:
            scale /= 2
        c = c - scale * step
        if now - loss(c) < 1e-9:
            break
        now = loss(c)
    return tuple(c.tolist())


def prior_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights by which a sample of each label stands for all rows of that label."""
    weight = np.ones(len(y))
    total = sum(counts.values())
    for value, n in counts.items():
        own = y == value
        if own.any():
            weight[own] = n / own.sum() * len(y) / max(total, 1)
    return weight
