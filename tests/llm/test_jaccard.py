import random

import numpy as np

from docframe.llm import cells
from docframe.llm import jaccard as J
from docframe.llm import simhash as S
from tests.llm.helpers import row, SCHEMA, words


def shingled(text):
    t = (text or "").lower().split()
    return frozenset(tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))) if t else frozenset()


def kept_by_definition(rows):
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def corpus(rng):
    """Pairs on both sides of similarity 0.8, short texts among them, and chains and groups of copies."""
    texts = ["a b c d e f g h", "a b c d e f g h i", "q r s t u v", "k l m n o p", None, "", " \n", "one", "one", "ONE two"]
    for n in (9, 14, 25, 60, 140, 170, 400):
        for share in (0.02, 0.08, 0.1, 0.11, 0.12, 0.15, 0.2, 0.3):
            base = words(rng, n).split()
            cut = max(1, round(share * n))
            texts += [" ".join(base), " ".join(base[:-cut] + words(rng, cut).split()), " ".join(base[cut:])]
    base = words(rng, 300).split()
    texts += [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(20, 280, 10)]
    return [(k, t) for k, t in enumerate(texts)]


def test_deduplicate_by_definition(spark):
    rows = corpus(random.Random(1))
    df = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in S.deduplicate(df).collect()) == kept_by_definition(rows)


def test_deduplicate_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 4)
    monkeypatch.setattr(S, "SET_ROWS", 8)
    monkeypatch.setattr(cells, "TIES", 1)
    rows = corpus(random.Random(2))
    df = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in S.deduplicate(df).collect()) == kept_by_definition(rows)


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(3)
    for n in (5, 9, 45, 117, 144, 153, 450, 1800):
        for _ in range(200):
            v = np.unique(rng.integers(0, 1 << 63, 10 * n // 9 + 1, dtype=np.uint64))
            rng.shuffle(v)
            a, b = np.sort(v[:n]), np.sort(v[n // 9 : n + n // 9])  # 8/9 of n in both: similarity 0.8 where 9 divides n
            common = n - n // 9
            if J.alike(len(a), len(b), common):
                assert len(np.intersect1d(J.keys(a), J.keys(b)))


def test_links_of_a_large_group():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.r_[base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for _ in range(150)] + [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))]
    lab, want = J.link(sets, np.arange(len(sets))), np.arange(len(sets))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if J.alike(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))]
    for _ in range(len(sets)):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert (lab == want).all() and lab[-1] == len(sets) - 1
    apart = np.r_[np.arange(len(sets) - 1), 0]  # the first and the last are connected already
    assert (J.link(sets, apart) == np.r_[want[:-1], want[0]]).all()
