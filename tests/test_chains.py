"""Chains of styles that are longer than what is walked at once: in order, shuffled, with rings, tails and parents that are not there."""

import random

import pytest

from docframe.operators import inheritance as I


def _resolve(styles):
    out = {}
    for s in styles:
        seen, at, size = [], s, None
        while at in styles and at not in seen:
            seen.append(at)
            size = styles[at][1] if size is None else size
            at = styles[at][0]
        out[s] = (size, len(seen) - 1)
    return out


def _shuffled(n, rng):
    order = rng.sample(range(n), n)
    return {a: (b, a if rng.random() < 0.1 else None) for a, b in zip(order, [*order[1:], n + 7])}


def _rings(n, rng):
    styles = {k: (k - k % 5 + (k + 1) % 5, rng.choice([None, k])) for k in range(n // 2)}
    return styles | {k: (rng.choice([k, rng.randrange(n), None]), rng.choice([None, None, k])) for k in range(n // 2, n)}


@pytest.mark.parametrize("make", [_shuffled, _rings])
def test_more_than_a_chunk(spark, monkeypatch, make):
    monkeypatch.setattr(I, "CHUNK_ROWS", 24)
    styles = make(150, random.Random(5))
    df = spark.createDataFrame([(f"s{k}", f"s{p}" if p is not None else None, v) for k, (p, v) in styles.items()], "style string, parent string, size int")
    got = {int(r["style"][1:]): (r["size"], r["depth"]) for r in I.inherited(df, ["size"]).collect()}
    assert got == _resolve(styles)


def test_rows_written_grow_with_the_table(spark, monkeypatch):
    """A chain in order is written three times (given, walked, answered) and not once for each doubling of a step."""
    monkeypatch.setattr(I, "CHUNK_ROWS", 256, raising=False)
    rows, write = [], I.written
    monkeypatch.setattr(I, "written", lambda df: (made := write(df), rows.append(made.count()))[0])
    df = spark.range(4000).selectExpr("id AS style", "id - 1 AS parent", "if(id % 100 = 50, id, null) AS size")
    assert I.inherited(df, ["size"]).where("style >= 50 and (size <> style - (style - 50) % 100 or depth <> style)").isEmpty()
    assert sum(rows) < 4 * 4000
