"""Closed itemsets against all sets of small baskets, and the query against its SQL."""

import glob
import hashlib
import itertools
import os
import random

import duckdb
import pytest

from docframe.llm import itemsets


def brute(baskets, least, confidence=30):
    """{items: (support, rules)} by trying all sets that some basket holds."""
    total, count = len(baskets), {}
    for b in baskets.values():
        for n in range(1, len(b) + 1):
            for s in itertools.combinations(sorted(b), n):
                count[s] = count.get(s, 0) + 1
    often = {s: n for s, n in count.items() if n >= least}
    closed = {s: n for s, n in often.items() if not any(n == often.get(tuple(sorted({*s, x}))) for (x,) in (t for t in often if len(t) == 1) if x not in s)}
    out = {}
    for s, n in closed.items():
        rules = []
        for c in s if len(s) > 1 else ():
            a, own = often[tuple(x for x in s if x != c)], often[(c,)]
            if 100 * n >= confidence * a and n * total > a * own:
                rules.append((c, a, own))
        out[s] = (n, rules)
    return out


def found(spark, baskets, least, **more):
    rows = [(b, i, "x", 0) for b, items in baskets.items() for i in items]
    rows += [(b, i, "y", 1) for b, i, *_ in rows[: len(rows) // 3]] + [(None, 1, "z", 2), (1, None, "z", 2)]
    df = spark.createDataFrame(rows, "sale_id long, item_id long, items string, support int")
    return {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in itemsets.closed_itemsets(df, "sale_id", "item_id", least=least, **more).collect()}


def planted(seed):
    rng = random.Random(seed)
    groups = [rng.sample(range(14), k) for k in (2, 3, 4, 3)]
    baskets = {}
    for b in range(70):
        own = {x for g in groups if rng.random() < 0.35 for x in g if rng.random() < 0.9} | {rng.randrange(14) for _ in range(rng.randrange(3))}
        if 3 in own:
            own |= {5}  # 3 never comes without 5
        if (8 in own) or (9 in own):
            own |= {8, 9, 11}  # equal tidsets
        baskets[b] = own or {0}
    return baskets


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("cut", [1000, 1])
def test_against_all_sets(spark, seed, cut):
    baskets = planted(seed)
    assert found(spark, baskets, 4, least_cut=cut, most_entries=40) == brute(baskets, 4)


def test_shuffled_joins_and_long_basket(spark, monkeypatch):
    baskets = planted(7)
    baskets[500] = set(range(14))
    monkeypatch.setattr(itemsets, "MOST_BROADCAST", 0)
    assert found(spark, baskets, 6, least_cut=2) == brute(baskets, 6)


def test_share(spark):
    baskets = {b: {1, 2} if b % 2 else {3} for b in range(40)}
    assert found(spark, baskets, 1, least_share=2) == {(1, 2): (20, [(1, 20, 20), (2, 20, 20)]), (3,): (20, [])}
    assert found(spark, baskets, 21) == {}


def test_none(spark):
    df = spark.createDataFrame([], "sale_id long, item_id long")
    assert itemsets.closed_itemsets(df, "sale_id", "item_id").collect() == []


def test_large_numbers_and_digest(spark):
    big = 1 << 61
    rows = [(b * big // 20, i) for b in range(15) for i in (big, -3, 10)]
    df = spark.createDataFrame(rows, "sale_id long, item_id long")
    r = itemsets.digest(itemsets.closed_itemsets(df, "sale_id", "item_id")).collect()
    assert [(x["items"], x["n_items"], x["support"], x["n_rules"], x["best_item"]) for x in r] == [(f"-3,10,{big}", 3, 15, 0, None)]
    assert r[0]["rules_sha256"] == hashlib.sha256(b"").hexdigest()


def test_query(spark):
    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = itemsets.query(spark, data)
    want = con.sql(itemsets.SQL)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(want.select(*names).fetchall(), key=str)
