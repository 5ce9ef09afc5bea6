"""Outlines and list numbers of groups that are cut into ranges, and of groups that stay whole, in small batches."""

import random

import pytest

from docframe.operators import ordered as O
from docframe.plans import queries as Q

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("whole", [0, 60, 1000])
def test_against_plain_loops(spark, monkeypatch, whole):
    rng = random.Random(whole)
    monkeypatch.setattr(O, "WHOLE_ROWS", whole)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), float(rng.randrange(2)) if k % 3 else float("nan"), k, rng.choice([None, 1, 2, 2, 3, 4, 6])) for k in range(400)]
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, 7)
        df = spark.createDataFrame(rows, "doc string, side double, pos long, level int").repartition(3)
        parents = {r["pos"]: r["parent"] for r in O.outline_parents(df, ["doc", "side"], "pos", "level").collect()}
        numbers = {r["pos"]: r["number"] for r in O.list_numbers(df, ["doc", "side"], "pos", "level").collect()}
        free = {r["pos"]: r["number"] for r in O.list_numbers(df, [], "pos", "level").collect()}
    finally:
        spark.conf.set(BATCH, before)
    for got, own in ((numbers, lambda r: (r[0], str(r[1]))), (free, lambda r: 0)):
        seen, want, up = {}, {}, {}
        for k, row in enumerate(rows):
            up[k] = next((r[2] for r in reversed(rows[:k]) if own(r) == own(row) and None not in (r[3], row[3]) and r[3] < row[3]), None)
            key = (own(row), row[3], up[k])
            want[k] = seen[key] = seen.get(key, 0) + 1
        assert got == want
        assert got is free or parents == up


def test_small_groups_take_one_shuffle(spark):
    """Groups that stay whole are sorted once: no joins, and no group handed to Python by itself."""
    plan = Q.QUERIES["list_numbers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "FlatMapGroups" not in plan
