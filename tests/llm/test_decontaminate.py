import pickle
import random

import numpy as np
import pytest

from docframe.llm import decontaminate as D
from tests.llm.helpers import none, odd, words


def distance(item, text):
    """Least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    return [(k, words(rng, 12 + k)) for k in range(15)]


def edited(text, n, rng):
    s = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abcxyz")
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rng.choice("abcxyz"))
    return "".join(s)


def test_against_brute_force(items):
    rng = random.Random(2)
    index = D.Index([(k, t.encode()) for k, t in items])
    texts = []
    for _ in range(60):
        k, t = rng.choice(items)
        texts.append(words(rng, rng.randrange(40)) + " " + edited(t, rng.randrange(int(0.2 * len(t))), rng) + " " + words(rng, rng.randrange(40)))
    got = {(k, i) for k, i, *_ in D.matches(index, [t.encode() for t in texts])}
    want = {(k, i) for k, t in enumerate(texts) for i, x in items if distance(x, t) <= index.budget[index.ids.index(i)]}
    assert got == want and want


def test_spans_and_distances(items):
    rng = random.Random(3)
    index = D.Index([(k, t.encode()) for k, t in items])
    t = items[3][1]
    text = "Start " + t.upper().replace(" ", "\n\t ") + " end"
    (k, i, a, b, d), = D.matches(index, [text.encode()])
    assert (k, i, a, b, d) == (0, 3, 6, 6 + len(t), 0)
    made = edited(t, 4, rng)
    (_, _, a, b, d), = D.matches(index, [("Start " + made + " end").encode()])
    assert d == distance(t, "start " + made + " end") and distance(t, ("start " + made + " end")[a:b]) == d


def test_align_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(40):
        item, text = ("".join(rng.choice("ab") for _ in range(n)) for n in (rng.randrange(1, 9), rng.randrange(0, 14)))
        c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        p = np.frombuffer(item.encode("utf-32-le"), dtype=np.uint32)
        d, _ = D.align([p], c, np.array([-len(item)]), len(item) + len(text) + 1, np.array([99]))
        assert d[0] == distance(item, text)


def test_very_long_text_and_pieces(items, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 2000)
    index = D.Index([(k, t.encode()) for k, t in items])
    rng = random.Random(5)
    text = ""
    for k, t in items:
        text += words(rng, 300) + " " + t + " "
    got = D.matches(index, [None, text.encode(), b"", items[0][1].encode()])
    assert {(k, i) for k, i, *_ in got} == {(1, i) for i, _ in items} | {(3, 0)}
    assert all(" ".join(text.split())[a:b] == dict(items)[i] for k, i, a, b, d in got if k == 1)


def test_texts_do_not_run_into_each_other(items):
    index = D.Index([(k, t.encode()) for k, t in items])
    t = items[9][1]
    assert D.matches(index, [t[: len(t) // 2].encode(), t[len(t) // 2 :].encode()]) == []


def test_items_cut_at_a_texts_ends(items):
    rng = random.Random(6)
    index = D.Index([(k, t.encode()) for k, t in items])
    seen = 0
    for k, t in items[::3]:
        n = int(index.budget[index.ids.index(k)])
        cut = [words(rng, 20) + " " + t[:-n], t[n:] + " " + words(rng, 20), t[n // 2 : len(t) - (n - n // 2)]]
        for own in cut:
            # neighbours that go on with the missing characters or nearly so, and neighbours that do not
            for before, after in [(t[:n], t[-n:]), ("x" + t[: n - 1], t[-n + 1 :] + "x"), (words(rng, 9), words(rng, 9)), ("", "z")]:
                texts = [before, own, after, t[-n:]]
                got = {(j, i) for j, i, *_ in D.matches(index, [x.encode() for x in texts])}
                want = {(j, i) for j, x in enumerate(texts) for i, y in items if distance(y, " ".join(x.split())) <= index.budget[index.ids.index(i)]}
                assert got == want
                seen += (1, k) in got
    assert seen > 30  # of 60; a cut beside a blank takes the blank too


def test_short_and_empty_items():
    index = D.Index([(1, b"abc"), (2, b""), (3, None), (4, b"  ")])
    assert [(k, i) for k, i, *_ in D.matches(index, [b"x ABC y", b"ab c"])] == [(0, 1)]


def test_odd_rows(spark, items):
    df, rows = odd(spark, [(50, "a " + items[0][1]), (50, "a " + items[0][1])])
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, items[0][1])], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in D.search(df, bench).collect())
    assert found == [(50, 0), (50, 0), (50, 97), (50, 97)]
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - 2
    assert D.search(none(spark), bench).count() == 0 and D.clean(df, bench.limit(0)).count() == len(rows)


def test_benchmark_in_slices(spark, items, monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 300)
    df, _ = odd(spark, [(50 + k, "a " + t) for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.search(df, bench).collect()) == [(50 + k, k) for k, _ in items]
    assert D.clean(df, bench).count() == df.count() - len(items)
    assert len(D.Shared(bench).slices) > 3


def test_bytes_of_an_index():
    """What a slice takes when it is broadcast: about 16 times its text, and the filter."""
    rng = random.Random(7)
    items = [(k, words(rng, 200).encode()) for k in range(400)]
    size = len(pickle.dumps(D.Index(items)))
    assert size < 20 * sum(len(t) for _, t in items) + (1 << D.FILTER_BITS) + 10_000
