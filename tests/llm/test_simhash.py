import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docframe.llm import cells
from docframe.llm import simhash as S
from tests.llm.helpers import none, odd, row, SCHEMA, words


def brute(text, n=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[k : k + n]) for k in range(max(1, len(tokens) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(a)] = find(b)
    best = {}
    for k, i in enumerate(ids):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [best.get(find(k)) for k in range(len(ids))]


def test_fingerprints_by_definition():
    rng = random.Random(1)
    for text in [None, "", " ", "one", "one TWO", "A b c", "x " * 10, words(rng, 300), "É é É"]:
        assert int(S.fingerprint(text.encode() if text is not None else None)[0]) == brute(text)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    extra = []
    for k in range(12):
        base = words(rng, 200).split()
        for j in range(5):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(200)] = "new"
            extra.append((100 + 10 * k + j, " ".join(copy)))
    df, rows = odd(spark, extra)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df).collect())
    prints = [brute(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], prints)
    want = sorted((r[0] is None, r[0] or 0, f"{p:016x}", c) for r, p, c in zip(rows, prints, comp))
    assert got == want


def test_pairs_at_every_distance_are_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, size=300, dtype=np.uint64)
    other = base.copy()
    flips = rng.integers(0, 6, size=300)
    for k, n in enumerate(flips):
        for b in rng.choice(64, n, replace=False):
            other[k] ^= np.uint64(1 << int(b))
    fps = np.unique(np.concatenate([base, other])).view(np.int64)
    prints = spark.createDataFrame([(int(x),) for x in fps], "fp0 long")
    found = {r["node"]: r["component"] for r in S.classes(prints, F.col("fp0")).collect()}
    assert all((found[int(a)] == found[int(b)]) == (n <= 3) for a, b, n in zip(base.view(np.int64), other.view(np.int64), flips))


def test_cut_keys_lose_nothing(spark, monkeypatch):
    """Groups of many fingerprints, tight ones and loose ones, cut into many chunks."""
    monkeypatch.setattr(S, "CELL_ROWS", 8)
    monkeypatch.setattr(cells, "TIES", 1)
    rng = np.random.default_rng(8)
    fps = {int(x) for x in rng.integers(0, 1 << 63, size=3, dtype=np.uint64)}
    for x in list(fps):
        for _ in range(60):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    ids = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    want = brute_components(ids, [x & ((1 << 64) - 1) for x in ids])
    found = {r["node"]: r["component"] for r in S.classes(spark.createDataFrame([(x,) for x in ids], "fp0 long"), F.col("fp0")).collect()}
    assert [found[x] for x in ids] == want


def test_large_groups_give_components_not_pairs():
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 63, size=3, dtype=np.uint64)
    fp = np.array([center[k % 3] ^ np.uint64(1 << int(rng.integers(64))) for k in range(900)], dtype=np.uint64)
    lab = S.link_large(np.unique(fp)[:, None], 3, np.arange(len(np.unique(fp))))
    assert len(np.unique(lab)) == 3


def test_carry_save_counts(radius=(3, 5, 46)):
    rng = np.random.default_rng(5)
    for r in radius:
        a, b = (rng.integers(0, 1 << 63, size=(64, 4), dtype=np.uint64) for _ in range(2))
        b[:32] = a[:32] ^ (np.uint64(1) << rng.integers(0, 64, size=(32, 4)).astype(np.uint64))
        d = np.bitwise_count(a ^ b).sum(axis=1)
        p, q = S.planes(a)[:, :-1], S.planes(b)[:, :-1]
        over = S.carry_save(np.zeros(1, np.uint64), 256, r, lambda k: (p[k] ^ q[k], p[k + 1] ^ q[k + 1]))
        assert (np.unpackbits(over.view(np.uint8), bitorder="little") == (d > r)).all()


def test_deduplicate_keeps_one_of_each_group(spark):
    rng = random.Random(6)
    base = words(rng, 400).split()
    near = list(base)
    near[50], near[51] = "changed", "words"
    far = words(rng, 400)
    df = spark.createDataFrame([row(3, " ".join(near)), row(1, " ".join(base)), row(2, " ".join(base)), row(2, " ".join(base)), row(9, far), row(4, None), row(5, ""), row(7, "short one here"), row(7, "short one here")], SCHEMA)
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 7, 9]


def test_empty_table(spark):
    assert S.near_duplicates(none(spark)).count() == 0
    assert S.deduplicate(none(spark)).count() == 0
