import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import language, quality, samples, toxicity
from docframe.llm.common import held_out
from tests.llm.helpers import none, odd, words


def sample(n=480, seed=1):
    """Texts with labels: bad words make toxic ones, shouting makes poor ones."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = words(rng, 60).split()
        toxic, poor = k % 3 == 0, k % 4 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(["scum", "filth"])
        if poor:
            w = [x.upper() + "!!" for x in w]
        out.append((" ".join(w).encode(), int(toxic), int(not poor)))
    return out


def test_held_out_is_crc32(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", held_out(F.col("id"))).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(200)}


def test_toxicity_learns():
    rows = sample()
    net = toxicity.fit([(t, y) for t, y, _ in rows[:400]], {0: 266, 1: 134})
    s = net.scores([t for t, _, _ in rows[400:]])
    y = np.array([y for _, y, _ in rows[400:]])
    assert ((s >= toxicity.THRESHOLD) == y).mean() > 0.9 and (s >= 0).all() and (s <= 1).all()


def test_toxicity_finds_a_word_anywhere_in_a_very_long_text():
    rows = sample()
    net = toxicity.fit([(t, y) for t, y, _ in rows], {0: 320, 1: 160})
    rng = random.Random(3)
    w = words(rng, toxicity.WORDS_AT_ONCE + 5000).split()
    clean = net.best([" ".join(w).encode()])[0][0]
    for at in (0, 70_000, toxicity.WORDS_AT_ONCE - 1, toxicity.WORDS_AT_ONCE, len(w) - 1):
        dirty = [*w[:at], "scum", *w[at + 1 :]]
        logit, where, _ = net.best([" ".join(dirty).encode()])
        assert logit[0] > clean and where[0] <= at < where[0] + toxicity.WINDOW


def plain_logit(net, words):
    """One window, word by word and number by number."""
    h, p = toxicity.HIDDEN, net.p
    x = []
    for w in words:
        word, char, _ = toxicity.word_inputs([w])
        x.append(np.concatenate([p["word"][word[0]], p["char"][char].max(axis=0)]))
    sigmoid, states = lambda v: 1 / (1 + np.exp(-v)), {}
    for way, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        state, out = np.zeros(h), {}
        for t in order:
            a = x[t] @ p[f"w{way}"] + p[f"z{way}"]
            fresh, reset = (sigmoid(a[k * h : (k + 1) * h] + state @ p[f"r{way}"][:, k * h : (k + 1) * h]) for k in (0, 1))
            new = np.tanh(a[2 * h :] + (reset * state) @ p[f"r{way}"][:, 2 * h :])
            out[t] = state = state + fresh * (new - state)
        states[way] = out
    if not x:
        return float(p["c"][0])
    both = np.array([np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(x))])
    share = np.exp(both @ p["u"] - (both @ p["u"]).max())
    return float((share / share.sum()) @ both @ p["v"] + p["c"][0])


@pytest.mark.parametrize("at_once", [1 << 17, 64])
def test_scores_against_a_plain_loop_over_windows(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", at_once)
    net = toxicity.fit([(t, y) for t, y, _ in sample(160)], {0: 106, 1: 54}, passes=2)
    rng = random.Random(8)
    texts = [words(rng, n).encode() for n in (1, 5, 23, 24, 25, 40, 100, 150)] + ["Ärger, scum! x".encode()]
    logit, where, windows = net.best(texts)
    for k, t in enumerate(texts):
        w = toxicity.words_of(t)
        every = {int(s): plain_logit(net, w[s : s + toxicity.WINDOW]) for s in toxicity.windows_of(len(w))}
        assert windows[k] == len(every) and (at_once == 64 and len(w) > 64 or int(where[k]) in every)
        if at_once > 64 or len(w) <= 64:  # pieces of a longer text start windows of their own as well
            assert logit[k] == pytest.approx(max(every.values()), abs=1e-3) and every[int(where[k])] == pytest.approx(logit[k], abs=1e-3)
        else:
            assert logit[k] >= max(every.values()) - 1e-3


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = toxicity.Network()
    x = rng.standard_normal((6, 2 * toxicity.DIM)).astype(np.float32)
    ids = rng.integers(0, 7, size=(5, toxicity.WINDOW))
    mask = (ids < 6).astype(np.float32)
    mask[:, 0] = 1
    y, w = np.array([0, 1, 0, 1, 1]), np.ones(5)

    def loss():
        z = net.run(net.project(x), ids, mask)[0].astype(np.float64)
        return (np.logaddexp(0, z) - y * z).mean()

    g, d_x = net.gradients(x, net.project(x), ids, mask, y, w)
    for name in ("wf", "rb", "zf", "u", "v", "c", "rf", "wb"):
        p = net.p[name]
        at = tuple(rng.integers(0, n) for n in p.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)
    old = x[2, 3]
    x[2, 3] = old + 1e-2
    up = loss()
    x[2, 3] = old - 1e-2
    down = loss()
    x[2, 3] = old
    assert d_x[2, 3] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_windows_cover_all_words():
    for n in (0, 1, 23, 24, 25, 36, 100, 1001):
        seen = np.zeros(n, bool)
        for s in toxicity.windows_of(n):
            seen[s : s + toxicity.WINDOW] = True
        assert seen.all() and toxicity.windows_of(n).min() >= 0


def test_quality_learns():
    rows = sample()
    model = quality.fit([(t, q) for t, _, q in rows[:400]], {0: 100, 1: 300})
    s = model.scores([t for t, _, _ in rows[400:]])
    y = np.array([q for _, _, q in rows[400:]])
    assert ((s >= quality.THRESHOLD) == y).mean() > 0.95


def test_quality_reads_long_texts_like_short_pieces():
    a, b = quality.features(b"ab!! " * 10), quality.features(b"ab!! " * 500_000)
    assert set(a) == set(b)


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual objective meet, so the weights are those of the exact optimum."""
    rng = np.random.default_rng(9)
    rows = [np.flatnonzero(rng.random(30) < 0.4) for _ in range(60)]
    y, value, cost = rng.integers(0, 2, 60), rng.random(30) + 0.5, np.full(60, 0.7)
    w, bias = quality.dual_coordinate_descent(rows, value, y, cost, passes=3000)
    x = np.zeros((60, 31))
    for k, r in enumerate(rows):
        x[k, r] = value[r] / np.sqrt((value[r] ** 2).sum())
    x[:, 30] = 1
    full, sign = np.append(w, bias), np.where(y == 1, 1.0, -1.0)
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best = primal(full)
    for scale in (1e-1, 1e-2, 1e-3):
        assert all(primal(full + scale * rng.standard_normal(31)) > best - 1e-4 for _ in range(300))


def brute_features(text):
    """n-grams of a short text, by definition: signs of 1 to 4 characters, words, and shapes of 1 to 3 words."""
    shape = lambda c: quality._CLASS[c]
    out = {("sign", tuple(shape(c) for c in text[k : k + n])) for n in range(1, 5) for k in range(len(text) - n + 1)}
    w = text.split()
    s = [quality._REPEAT if k and w[k] == w[k - 1] else quality._shape(w[k]) for k in range(len(w))]
    return out | {("word", x.lower()) for x in w} | {("shape", tuple(s[k : k + n])) for n in range(1, 4) for k in range(len(w) - n + 1)}


def test_quality_features_by_definition():
    texts = [b"", b"a", b"Ab ab AB!! x x x 12", "Über alles, ja ja.".encode(), b"\n\t 7 .."]
    number = {}
    for t in texts:
        for f in brute_features(t):
            number.setdefault(f, len(number))
    got = [set(quality.features(t).tolist()) for t in texts]
    want = [{number[f] for f in brute_features(t)} for t in texts]
    for a, b, c, d in ((x, y, z, v) for (x, z) in zip(got, want) for (y, v) in zip(got, want)):
        assert abs(len(a & b) - len(c & d)) <= 1  # equal n-grams, but for a chance meeting of hashes


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(50) < 0.3) for _ in range(80)]
    y = np.array([int(3 in r) for r in rows])
    w, bias = quality.dual_coordinate_descent(rows, np.ones(50), y, np.full(80, 10.0), passes=200)
    margin = [w[r].sum() / max(np.sqrt(len(r)), 1e-9) + bias for r in rows]
    assert ((np.array(margin) > 0) == y).all()


def test_language_learns():
    rng = random.Random(4)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n)).encode()
    model = language.fit([(make("aeioklmn", 80), "xx") for _ in range(20)] + [(make("uybdgpöß", 80), "yy") for _ in range(20)])
    names, score = model.predict([make("aeioklmn", 30), make("uybdgpöß", 30), None, b"", b" 12 !", "漢字".encode(), make("aeioklmn", 300_000)])
    assert [n for n in names] == ["xx", "yy", "und", "und", "und", "xx", "xx"] and score[2] == 0 and (score <= 1).all()


def test_language_counts_against_sets_of_ngrams():
    """Corrected filter counts are the counts of exact sets, by language, up to the filters' noise."""
    rng = random.Random(6)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)).encode()
    rows = [(make("aeioklmn", 200), "xx") for _ in range(8)] + [(make("uybdgpaek", 200), "yy") for _ in range(8)]
    model = language.fit(rows)
    ngrams = lambda t: [c[k : k + n] for c in [tuple(language.cleaned(t).tolist())] for n in language.ORDERS for k in range(len(c) - n + 1)]
    known = {name: {g for t, l in rows if l == name for g in ngrams(t)} for name in ("xx", "yy")}
    weight = lambda g: math.log(3 / max(sum(g in k for k in known.values()), 1))
    for text in (make("aeioklmn", 60), make("uybdgpaek", 60), make("aekqrs", 60)):
        count, total = model.counts(text)
        grams = ngrams(text)
        assert total == len(grams)
        for k, name in enumerate(model.names):
            assert abs(count[k] - sum(weight(g) for g in grams if g in known[name])) <= 0.02 * total + 2


def test_language_of_many_languages():
    """Masks of more than 8 and of more than 64 languages give what masks of few give: each language's own letters decide."""
    rng = random.Random(8)
    make = lambda k, n: " ".join("".join(chr(0x4E00 + 10 * k + rng.randrange(10)) for _ in range(4)) for _ in range(n)).encode()
    for n in (9, 70):
        model = language.fit([(make(k, 60), f"l{k:02d}") for k in range(n) for _ in range(2)])
        names, score = model.predict([make(k, 20) for k in range(n)])
        assert names == [f"l{k:02d}" for k in range(n)] and (score > 0.9).all()


def test_bloom_counts_are_corrected():
    model = language.Model(["a"], np.zeros((1, 1 << language.CELL_BITS), np.uint64), 0)
    model.false_rate = np.array([0.25])
    model.masks[0][:] = 1
    count, total = model.counts(b"some text here")
    assert count[0] == pytest.approx(total * math.log(2))


@pytest.mark.parametrize("model", ["toxicity", "quality", "language"])
def test_odd_rows(spark, model):
    df, rows = odd(spark)
    texts = sample()
    if model == "language":
        out = language.identify(df, language.fit([(t, "en") for t, _, _ in texts[:20]]))
        assert language.identify(none(spark), language.fit([])).count() == 0
    else:
        m = toxicity if model == "toxicity" else quality
        out = m.score(df, m.fit([(t, y) for t, y, _ in texts[:90]], {0: 60, 1: 30}))
        assert m.score(none(spark), m.fit([], {})).count() == 0
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (5, 6)]
    assert len(same) == 3 and max(same) - min(same) < 1e-6


def test_one_label_gives_its_share():
    for m in (toxicity, quality):
        assert m.fit([(b"a", 1), (b"b", 1)], {1: 2}).scores([b"x", None]).min() > 0.9
        assert m.fit([], {}).scores([b"x"])[0] == pytest.approx(0.5)


def test_labels_come_only_from_rows_that_are_not_held_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("text"))
    got, counts = samples.labelled(docs, labels, "toxic", most=50)
    ids = [int(t.split()[1]) for t, _ in got]
    assert all(zlib.crc32(str(k).encode()) % 4 != 2 for k in ids) and all(k % 2 == y for k, (_, y) in zip(ids, got))
    assert max(sum(y == v for _, y in got) for v in (0, 1)) <= 50 and sum(counts.values()) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(400))


def test_quality_filter_keeps_columns(spark):
    df, _ = odd(spark)
    model = quality.fit([(t, q) for t, _, q in sample()], {0: 120, 1: 360})
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() <= df.count()
