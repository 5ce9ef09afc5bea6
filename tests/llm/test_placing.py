"""Sharding, mixing and embeddings."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import embeddings, mixing, sharding
from tests.llm.helpers import none, odd, words


def many(n=600):
    rng = random.Random(1)
    out = [(100 + k, words(rng, rng.randint(1, 80)), "en", f"s{k % 5}" if k % 3 else "s0") for k in range(n)]
    return out + [(5000 + k, "one text that very many documents share", "en", "s1") for k in range(n // 2)] + [(9000 + k, out[k // 3][1], "en", "s2") for k in range(90)]


def test_shards_are_even_and_gapless(spark):
    df, rows = odd(spark, many())
    got = sharding.assign(df).collect()
    assert len(got) == len(rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = sum(load.values()) / 8
    big = max(len((r[1] or "").encode()) for r in rows)  # one document is larger than a shard
    others = sorted(load.values())[:-1]
    assert big > size and max(others) - min(others) < 0.05 * size + 1000
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_small_groups_stay_together(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in many()], "doc_id long, text string")
    by_text = defaultdict(set)
    text = {r[0]: r[1] for r in many()}
    n = Counter(text.values())
    for r in sharding.assign(df).collect():
        by_text[text[r["doc_id"]]].add(r["shard"])
    small = [s for t, s in by_text.items() if 1 < n[t] < 10]
    assert small and sum(len(s) == 1 for s in small) >= 0.9 * len(small)


def test_quotas_keep_capacity():
    rng = np.random.default_rng(1)
    demand = rng.random((8, 8)) * 100
    demand[:, 3] *= 50
    np.fill_diagonal(demand, 0)
    load = np.full(8, 800.0) + demand.sum(axis=1)
    share = sharding.quotas(demand, load, 1.1 * load.mean())
    moved = demand * share
    after = load - moved.sum(axis=1) + moved.sum(axis=0)
    assert (share <= 1).all() and (after <= np.maximum(load, 1.1 * load.mean()) + 1e-6).all()


def test_no_documents_to_place(spark):
    assert sharding.assign(none(spark)).count() == 0 and mixing.mix(none(spark)).count() == 0 and mixing.apply(none(spark)).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [n for n in names if n not in full]
        rest = total - sum(2 * sizes[n] for n in full)
        w = sum(weight[n] for n in open_)
        over = {n for n in open_ if w and rest * weight[n] / w >= 2 * sizes[n]}
        if not over:
            return {n: 2 * sizes[n] if n in full else rest * weight[n] / w for n in names}
        full |= over


def test_mix_meets_its_targets(spark):
    df, rows = odd(spark, many())
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]


def test_mix_does_not_hang_on_partitions(spark):
    df, _ = odd(spark, many(200))
    key = lambda d: sorted((r["doc_id"] or -1, r["row_mark"], r["copies"]) for r in mixing.mix(d).collect())
    assert key(df) == key(df.repartition(7)) == key(df.coalesce(1))


def test_mix_copies_rows(spark):
    df, rows = odd(spark, many(200))
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.apply(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({k: n for k, n in copies.items() if n})


def test_pivot_keeps_the_sum_and_the_mean():
    size = np.array([3, 7, 11, 2, 5, 5, 9])
    p = np.array([0.3, 0.5, 0.2, 0.9, 0.4, 1.0, 0.6])
    total, rng = np.zeros(7), np.random.default_rng(1)
    for _ in range(4000):
        out, held = mixing.pivot(p, size, rng.random(7))
        assert (out * size).sum() == pytest.approx((p * size).sum())
        assert sum(0 < x < 1 for x in out) <= 1 and (held < 0 or 0 < out[held] < 1)
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


def test_spread_keeps_the_sum_and_the_mean():
    """Large documents are rounded, small ones take their words; a document larger than what the others have room for is left."""
    size = np.array([60, 50, 40, 30, *[9] * 20, *[5] * 20, *[2] * 20])
    rng = np.random.default_rng(1)
    p = rng.uniform(0.2, 0.8, len(size))
    p[3] = 1.0
    total = np.zeros(len(size))
    for _ in range(4000):
        out = mixing.spread(p, size, rng.random(len(size)))
        assert (out * size).sum() == pytest.approx((p * size).sum()) and (out >= 0).all() and (out <= 1).all()
        assert set(out[:4]) <= {0.0, 1.0} and max(size[(out > 0) & (out < 1)], default=0) <= 9
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04
    alone = np.array([0.5, 0.5])
    assert (mixing.spread(alone, np.array([100, 1]), np.array([0.1, 0.1])) == alone).all()


def test_mix_is_near_its_targets(spark):
    """Sources of 500 documents, some of thousands of words: words taken are within a thousandth of the target."""
    rows = mixing.query(spark, "/root/testdata/sf0.1").groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(rows) == 20 and all(abs(r["taken"] - r["target"]) <= r["target"] / 1000 for r in rows)


def test_e8_points_are_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)) * 2
    got = embeddings.nearest_e8(x)
    near = ((x - got / 2) ** 2).sum(axis=1)
    for s in embeddings.roots():
        assert (((x - (got + s) / 2) ** 2).sum(axis=1) >= near - 1e-9).all()
    assert len(embeddings.roots()) == 240 and set((embeddings.roots() ** 2).sum(axis=1)) == {8}
    even = (got % 2 == 0).all(axis=1)
    assert ((got % 2 != 0).all(axis=1) | even).all() and (got.sum(axis=1) % 4 == 0).all()


def vectors(rng, n=150, dim=64):
    out = []
    for k in range(n):
        base = rng.standard_normal(dim)
        out.append((base, k % 3))
        for _ in range(k % 4):
            out.append((base + rng.standard_normal(dim) * 0.15, k % 3 if k % 7 else 5))
    return out


@pytest.mark.parametrize("cap", [4096, 40])
def test_embeddings_against_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cap)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in v], l) for k, (v, l) in enumerate(vectors(rng))]
    center = rng.standard_normal(64)
    rows += [(1000 + k, [float(x) for x in center + rng.standard_normal(64) * 0.05], 1) for k in range(100)]  # a large group
    rows += [(2000 + k, rows[4][1], rows[4][2]) for k in range(5)] + [(2100, [2 * x for x in rows[4][1]], rows[4][2])]
    rows += [(3000, None, 1), (3001, [0.0] * 64, 1), (3002, [float("nan")] * 64, 1), (3003, [float("inf")] + [1.0] * 63, 1), (3004, [None] + [1.0] * 63, 1), (3005, rows[4][1], None), (3006, [], 1), (3007, rows[4][1][:32], rows[4][2])]
    rows += [(3007, rows[4][1][:32], rows[4][2])]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<float>, label int, h long, id long")
    got = {(r["vec_id"], k): r for k, r in enumerate(sorted(embeddings.near_duplicates(df).collect(), key=lambda r: r["vec_id"]))}
    assert len(got) == len(rows)
    sound = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    x = [np.array(r[1], dtype=np.float32).astype(float) for r in sound]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sound)):
        for b in range(a):
            if sound[a][2] == sound[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= embeddings.COSINE:
                links[sound[a][0]] += 1
                if sound[a][0] != sound[b][0]:
                    links[sound[b][0]] += 1
                    p, q = find(sound[a][0]), find(sound[b][0])
                    root[max(p, q)] = min(p, q)
    found = sum(r["n_links"] for r in got.values())
    want = sum(links[r[0]] for r in rows)
    assert 0.98 * want <= found <= want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert sum(find(r["vec_id"]) == r["component_id"] for r in got.values()) >= 0.98 * len(got)


def pairs_at(rng, n, dim, cosine):
    u, w = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(axis=1)[:, None] * u
    return u, cosine * u + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w, axis=1)[:, None]


@pytest.mark.parametrize("rows,dim", [(5000, 64), (50_000, 64), (50_000, 768), (1_000_000, 256), (1 << 40, 64)])
def test_recall_of_pairs_at_the_threshold(rows, dim):
    u, v = pairs_at(np.random.default_rng(4), 400, dim, embeddings.COSINE)
    label, plan = np.zeros((400, 2), np.int64), embeddings.plan_for(rows)
    (a, at_home), (b, b_home) = embeddings.cell_keys(u, label, plan), embeddings.cell_keys(v, label, plan)
    keys, own = np.concatenate([a, b]), np.concatenate([at_home, b_home])
    met = embeddings.smallest_common(keys, own, np.arange(400), np.arange(400, 800)) < np.iinfo(np.int64).max
    brute = [bool(set(a[k][at_home[k]]) & set(b[k])) or bool(set(b[k][b_home[k]]) & set(a[k])) for k in range(400)]
    assert met.tolist() == brute and met.mean() >= 0.93


@pytest.mark.parametrize("rows", [5000, 20_000, 1_000_000])
def test_random_vectors_seldom_meet(rows):
    """Others that a vector meets by chance: under 1 % of 5,000 and about 100 at most of any number."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    keys, own = embeddings.cell_keys(x / np.linalg.norm(x, axis=1)[:, None], np.zeros((4000, 2), np.int64), embeddings.plan_for(rows))
    home, visits = Counter(keys[own].tolist()), Counter(keys.ravel().tolist())
    met = sum(n * (visits[k] - 1) for k, n in home.items()) * 2 / 4000**2
    assert met < 0.01 and met * rows < 150


def test_labels_and_scales_as_they_are(spark):
    near = [1.0, 2.0, 3.0]
    for kind, labels in (("string", ["a", "a", "b", "01", "1", None]), ("double", [1.2, 1.2, 1.7, 0.0, -0.0, None])):
        rows = [(k, [c * f for c in near], v) for k, (v, f) in enumerate(zip(labels, (1.0, 1e200, 1.0, 1e-200, 1.0, 1.0)))]
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
        zeros = int(kind == "double")
        assert got == {0: 1, 1: 1, 2: 0, 3: zeros, 4: zeros, 5: 0}


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
