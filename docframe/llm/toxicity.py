"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Input, per word: a word embedding and a character embedding (the largest value, per dimension, over the embeddings of the
word's character n-grams with word ends marked). Both tables are hashed; their first dimension starts from the log ratio of
document frequencies in the two classes, drawn towards zero by SURE standard errors, so that what few texts have tells
little. Windows of WINDOW words start every STRIDE words, so that they overlap and each word is met away from a window's
edge; a text's score comes from its highest window, and from how many windows that is the highest of. Fitting takes, in each
pass, the window that the network finds highest (of toxic texts only that one, of others also some more), and so learns from
labels of whole texts; the pass whose scores of held-back texts are best gives the network.

Inputs of a word are computed once for each distinct word of a batch, as are their products with the input weights.

Defined results: null and empty texts, and texts of white space, are one empty window; very long texts are scored whole;
equal texts score alike, but for the rounding of 32-bit sums; extra columns are not read; without labels of both kinds every
score is that label's share (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_text, table
from .samples import MOST_PER_LABEL, labelled, log_loss, platt, prior_weights, sigmoid

WINDOW, STRIDE = 24, 8
WORD_BITS, CHAR_BITS = 14, 18
DIM, HIDDEN = 4, 8
CHAR_ORDERS = (3, 4, 5, 6, 7)
PASSES, RATE, BATCH = 6, 0.01, 128
#: Fitting looks for the highest window of a text among fewer.
FIT_STRIDE = 16
#: Words and n-grams that fewer texts of the sample have get no embedding; standard errors off the starting ratios.
LEAST_TEXTS, SURE = 5, 1.5
CALIBRATION_SHARE = 0.25
THRESHOLD = 0.3
#: Words that are scored at once, and distinct words whose inputs are made at once.
WORDS_AT_ONCE, WORDS_MADE = 1 << 17, 1 << 14
_STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-case words of a text. Letters other than A-Z keep their case."""
    return data.lower().split() if data else []


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the word table; rows in the character table, word after word; where each word's rows start)."""
    parts = [_word_inputs(words[at : at + WORDS_MADE]) for at in range(0, max(len(words), 1), WORDS_MADE)]
    before = np.cumsum([0, *(len(char) for _, char, _ in parts)])
    return np.concatenate([w for w, _, _ in parts]), np.concatenate([c for _, c, _ in parts]), np.concatenate([b + n for (_, _, b), n in zip(parts, before)])


def _word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bare = [w.strip(_STRIP) or w for w in words]
    hashed = xxhash.xxh32_intdigest
    word = np.fromiter([hashed(w) for w in bare], dtype=np.int64, count=len(bare)) & ((1 << WORD_BITS) - 1)
    text = np.frombuffer(b"".join([b"^%b$" % w for w in bare]), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, bare), dtype=np.int64, count=len(bare)) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(bare), dtype=np.int32), size)
    left = np.repeat(start + size, size) - np.arange(len(text))  # bytes from here to the word's end
    codes, owners = [], []
    code = text
    for n in range(2, max(CHAR_ORDERS) + 1):
        if len(text) < n:
            break
        code = (code[:-1] << np.uint64(8)) | text[n - 1 :]
        if n in CHAR_ORDERS:
            ok = left[: len(code)] >= n
            codes.append((((code[ok] << np.uint64(3)) + np.uint64(n)) * _MIX >> np.uint64(64 - CHAR_BITS)).astype(np.int32))
            owners.append(owner[: len(code)][ok])
    short = np.flatnonzero(size < min(CHAR_ORDERS))  # a word always has an n-gram
    codes.append((word[short] & ((1 << CHAR_BITS) - 1)).astype(np.int32))
    owners.append(short.astype(np.int32))
    owners_ = np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    begin = np.searchsorted(owners_[order], np.arange(len(bare)))
    return word, np.concatenate(codes)[order], begin


def windows_of(n: int, stride: int | None = None) -> np.ndarray:
    """Starts of the windows of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    starts = np.arange(0, n - WINDOW, stride or STRIDE)
    return np.append(starts, n - WINDOW)


class Network:
    """Parameters by name, all float32; word: words' embeddings, char: those of character n-grams."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)

        def near_zero(*shape: int, scale: float = 0.3) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        d, h = 2 * DIM, HIDDEN
        self.p = {"word": near_zero(1 << WORD_BITS, DIM, scale=0.05), "char": near_zero(1 << CHAR_BITS, DIM, scale=0.05), "u": near_zero(2 * h), "v": near_zero(2 * h), "c": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": near_zero(d, 3 * h), f"r{way}": near_zero(h, 3 * h), f"z{way}": np.zeros(3 * h, np.float32)}
        self.a, self.c, self.b = 1.0, 0.0, 0.0  # of the highest window's logit, of the logarithm of the windows, and by itself

    def inputs(self, word: np.ndarray, char: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of each word and, for fitting, which character rows gave the largest values."""
        rows = self.p["char"][char]
        most = np.maximum.reduceat(rows, begin, axis=0)
        return np.concatenate([self.p["word"][word], most], axis=1), most

    def run(self, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logit of each window. ids: (windows, WINDOW) rows of projected; mask: 1 where there is a word."""
        n, steps, h = len(ids), ids.shape[1], HIDDEN
        out = np.zeros((steps, n, 2 * h), dtype=np.float32)
        tape: dict = {}
        for k, way in enumerate("fb"):
            state, r = np.zeros((n, h), dtype=np.float32), self.p[f"r{way}"]
            r_gates, r_new = np.ascontiguousarray(r[:, : 2 * h]), np.ascontiguousarray(r[:, 2 * h :])
            order = range(steps) if way == "f" else range(steps - 1, -1, -1)
            saved = []
            for t in order:
                x = projected[way][ids[:, t]]
                gates = np.tanh((x[:, : 2 * h] + state @ r_gates) * np.float32(0.5))
                gates *= np.float32(0.5)
                gates += np.float32(0.5)
                fresh, reset = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + (reset * state) @ r_new)
                step = fresh * mask[:, t, None]
                after = state + step * (new - state)
                if keep:
                    saved.append((t, state, fresh, reset, new))
                state = after
                out[t, :, k * h : (k + 1) * h] = state
            tape[way] = saved
        energy = out @ self.p["u"]
        energy[mask.T == 0] = -1e9
        energy -= energy.max(axis=0)
        share = np.exp(energy)
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", share, out)
        return pooled @ self.p["v"] + self.p["c"], tape | {"out": out, "share": share, "pooled": pooled}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Products of inputs with the input weights; the last row is for no word."""
        out = {}
        for way in "fb":
            rows = np.empty((len(x) + 1, 3 * HIDDEN), dtype=np.float32)
            rows[:-1] = x @ self.p[f"w{way}"] + self.p[f"z{way}"]
            rows[-1] = self.p[f"z{way}"]
            out[way] = rows
        return out

    def gradients(self, x: np.ndarray, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted log loss by parameter, and by input row."""
        logit, tape = self.run(projected, ids, mask, keep=True)
        h, out, share = HIDDEN, tape["out"], tape["share"]
        d = ((sigmoid(logit) - y) * weight / max(weight.sum(), 1e-9)).astype(np.float32)
        g = {"v": tape["pooled"].T @ d, "c": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.p["v"]
        d_share = np.einsum("nh,tnh->tn", d_pooled, out)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        g["u"] = np.einsum("tn,tnh->h", d_energy, out)
        d_out = share[:, :, None] * d_pooled + d_energy[:, :, None] * self.p["u"]
        d_x = np.zeros((len(x) + 1, x.shape[1]), dtype=np.float32)
        for k, way in enumerate("fb"):
            r = self.p[f"r{way}"]
            g_r, g_rows = np.zeros_like(r), np.zeros_like(projected[way])
            d_state = np.zeros((len(ids), h), dtype=np.float32)
            for t, state, fresh, reset, new in reversed(tape[way]):
                d_state = d_state + d_out[t, :, k * h : (k + 1) * h]
                m = mask[:, t, None]
                d_new = d_state * fresh * m * (1 - new * new)
                d_fresh = d_state * (new - state) * m * fresh * (1 - fresh)
                d_rs = d_new @ r[:, 2 * h :].T
                d_reset = d_rs * state * reset * (1 - reset)
                d_gates = np.concatenate([d_fresh, d_reset], axis=1)
                g_r[:, : 2 * h] += state.T @ d_gates
                g_r[:, 2 * h :] += (reset * state).T @ d_new
                np.add.at(g_rows, ids[:, t], np.concatenate([d_gates, d_new], axis=1))
                d_state = d_state * (1 - fresh * m) + d_gates @ r[:, : 2 * h].T + d_rs * reset
            g[f"r{way}"], g[f"z{way}"] = g_r, g_rows.sum(axis=0)
            g[f"w{way}"] = x.T @ g_rows[:-1]
            d_x += g_rows @ self.p[f"w{way}"].T
        return g, d_x[:-1]

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """By text the logit of the highest window and the logarithm of the number of windows."""
        logit, _, windows = self.best(texts)
        return np.stack([logit, np.log(windows)])

    def best(self, texts: list[bytes | None], stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of each text's highest window, where in the text that starts, and how many windows there are."""
        top, where = np.full(len(texts), -np.inf, dtype=np.float64), np.zeros(len(texts), dtype=np.int64)
        windows = np.ones(len(texts))
        waiting: list[tuple[int, int, list[bytes]]] = []
        held = 0
        for k, t in enumerate(texts):
            words = words_of(t)
            windows[k] = len(windows_of(len(words)))
            for at in range(0, max(len(words), 1), WORDS_AT_ONCE):  # pieces overlap by a window
                waiting.append((k, at, words[max(at - WINDOW, 0) if at else 0 : at + WORDS_AT_ONCE]))
                held += len(waiting[-1][2])
                if held >= WORDS_AT_ONCE:
                    self._score(waiting, top, where, stride)
                    waiting, held = [], 0
        if waiting:
            self._score(waiting, top, where, stride)
        return top, where, windows

    def _score(self, parts: list[tuple[int, int, list[bytes]]], top: np.ndarray, where: np.ndarray, stride: int | None) -> None:
        number: dict[bytes, int] = {}
        flat = np.fromiter([number.setdefault(w, len(number)) for _, _, words in parts for w in words], dtype=np.int64)
        projected = self.project(self.inputs(*word_inputs(list(number)))[0]) if number else self.project(np.zeros((0, 2 * DIM), np.float32))
        blank = len(number)
        flat = np.append(flat, np.full(WINDOW, blank))
        base, starts, owner, left = 0, [], [], []
        for j, (_, _, words) in enumerate(parts):
            s = windows_of(len(words), stride)
            starts.append(s + base)
            owner.append(np.full(len(s), j))
            left.append(np.minimum(len(words) - s, WINDOW))
            base += len(words)
        start, own, size = np.concatenate(starts), np.concatenate(owner), np.concatenate(left)
        logit = np.empty(len(start))
        place = np.arange(WINDOW)
        for at in range(0, len(start), 8192):
            part = slice(at, at + 8192)
            mask = place < size[part, None]
            ids = np.where(mask, flat[np.minimum(start[part, None] + place, len(flat) - 1)], blank)
            logit[part] = self.run(projected, ids, mask.astype(np.float32))[0]
        first = np.searchsorted(own, np.arange(len(parts)))
        begun = np.concatenate([[0], np.cumsum([len(w) for _, _, w in parts])])
        for j, ((k, at, words), value) in enumerate(zip(parts, np.maximum.reduceat(logit, first))):
            if value > top[k]:
                stop = first[j + 1] if j + 1 < len(parts) else len(logit)
                top[k] = value
                where[k] = start[first[j] + int(logit[first[j] : stop].argmax())] - begun[j] + max(at - WINDOW, 0)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return sigmoid(np.array([self.a, self.c]) @ self.features(texts) + self.b)


class Adam:
    """Steps for dense parameters and, by touched rows, for tables."""

    def __init__(self, rate: float) -> None:
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def dense(self, name: str, p: np.ndarray, g: np.ndarray) -> None:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
        p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)

    def rows(self, name: str, p: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
        own, back = np.unique(at, return_inverse=True)
        total = np.zeros((len(own), p.shape[1]), dtype=np.float32)
        np.add.at(total, back, g)
        v = self.v.setdefault(name, np.zeros(p.shape, dtype=np.float32))
        v[own] += total * total
        p[own] -= self.rate * total / (np.sqrt(v[own]) + 1e-8)


def log_ratio(rows: Iterable[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By row of a table: the log ratio of the shares of toxic and other texts that have it, SURE standard errors nearer to
    zero or zero; and whether LEAST_TEXTS texts have it. rows: those that each text has, once each."""
    have = np.full((2, size), 0.5)
    for own, label in zip(rows, y):
        have[label, own] += 1
    share = have / (np.bincount(y, minlength=2)[:, None] + 1)
    ratio, error = np.log(share[1] / share[0]), np.sqrt((1 / have).sum(axis=0))
    known = have.sum(axis=0) >= LEAST_TEXTS + 1
    return np.where(known, np.sign(ratio) * np.maximum(np.abs(ratio) - SURE * error, 0.0), 0.0), known


def fit(sample: list[tuple[bytes, int]], counts: dict[int, int], passes: int = PASSES, seed: int = 7) -> Network:
    y = np.array([label for _, label in sample], dtype=np.int64)
    net = Network(seed)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        net.a, net.b = 0.0, float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % round(1 / CALIBRATION_SHARE) == 0
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept[:] = False
    texts, labels = [t for (t, _), k in zip(sample, kept) if not k], y[~kept]
    number: dict[bytes, int] = {}
    docs = [np.fromiter([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts]
    word, char, begin = word_inputs(list(number)) if number else (np.zeros(0, np.int64),) * 3
    ends = np.append(begin[1:], len(char))
    learned = {}
    has = np.zeros(1 << max(WORD_BITS, CHAR_BITS), dtype=bool)

    def rows_of(d: np.ndarray, name: str) -> np.ndarray:
        """The rows of a table that a text has; one text at a time, as those of all texts are many."""
        has[:] = False
        for w in np.unique(d):
            has[word[w] if name == "word" else char[begin[w] : ends[w]]] = True
        return np.flatnonzero(has)

    for name, bits in (("word", WORD_BITS), ("char", CHAR_BITS)):
        ratio, learned[name] = log_ratio((rows_of(d, name) for d in docs), labels, 1 << bits)
        net.p[name][~learned[name]] = 0  # what few texts have tells nothing, and stays so
        net.p[name][:, 0] = ratio
    use = [s for s, k in zip(sample, kept) if k] or sample
    truth = np.array([label for _, label in use])
    weight = prior_weights(truth, counts)
    step, best = Adam(RATE), (np.inf, {}, (1.0, 0.0, 0.0))
    for _ in range(passes):
        at = net.best(texts, FIT_STRIDE)[1]
        picks = []
        for k, d in enumerate(docs):
            picks.append((k, at[k]))
            if not labels[k] and len(d) > WINDOW:
                picks += [(k, s) for s in rng.integers(0, len(d) - WINDOW + 1, size=1)]
        for part in np.array_split(rng.permutation(len(picks)), max(1, len(picks) // BATCH)):
            owner = np.array([picks[j][0] for j in part])
            ids = np.full((len(part), WINDOW), -1, dtype=np.int64)
            for row, j in enumerate(part):
                own = docs[picks[j][0]][picks[j][1] : picks[j][1] + WINDOW]
                ids[row, : len(own)] = own
            mask = (ids >= 0).astype(np.float32)
            used, back = np.unique(ids[ids >= 0], return_inverse=True)
            local = np.full(ids.shape, len(used), dtype=np.int64)
            local[ids >= 0] = back
            rows = np.concatenate([char[begin[w] : ends[w]] for w in used]) if len(used) else np.zeros(0, np.int64)
            size = (ends - begin)[used]
            starts = np.cumsum(size) - size
            if not len(used):
                continue
            x, most = net.inputs(word[used], rows, starts)
            g, d_x = net.gradients(x, net.project(x), local, mask, labels[owner], np.ones(len(part)))
            step.t += 1
            for name, value in g.items():
                step.dense(name, net.p[name], value)
            own = learned["word"][word[used]]
            step.rows("word", net.p["word"], word[used][own], d_x[own, :DIM])
            own = learned["char"][rows]
            chosen = net.p["char"][rows] == np.repeat(most, size, axis=0)
            step.rows("char", net.p["char"], rows[own], np.where(chosen, np.repeat(d_x[:, DIM:], size, axis=0), np.float32(0))[own])
        x = net.features([t for t, _ in use])
        scale = platt(x, truth, weight)
        found = log_loss(np.append(x, np.ones((1, len(truth))), axis=0).T @ scale, truth, weight)
        if found < best[0]:
            best = found, {k: v.copy() for k, v in net.p.items()}, scale
    _, net.p, (net.a, net.c, net.b) = best
    return net


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_LABEL) -> Network:
    return fit(*labelled(docs, labels, "toxic", most))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: two tables of hashed embeddings

    def make():
        m = shared.value
        return lambda texts: {"score": m.scores(texts)}

    return map_text(docs, ["doc_id"], "score double", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
