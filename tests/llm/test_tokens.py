import random
import struct
import zlib

import numpy as np
import pytest

from docframe.llm import counts, tokens
from tests.llm.helpers import none, odd, words

ALPHABET = "abcXYZ éÉßñ'sdlmtrev 0123 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　́ͅΣσς!?%$#@|<|endoftext|>İǆJ̌漢字\U0001f600​᠎﻿.,"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.tokenizer_path())


def test_words_encode_like_whole_texts(encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["a<|endoftext|>b", "Plain, words! THEN more.", "J̌ ǰ", "ΣΑΣ"]
    for t, got in zip(texts, encoder.encode(texts)):
        assert got.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 10)
    rng = random.Random(2)
    for _ in range(5):
        t = words(rng, 50)
        assert encoder.encode([t])[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def grammar(docs):
    last = np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    terminals, rules, seq, ends = tokens.repair(np.concatenate(docs), last)
    return tokens.Grammar(tokens.pack(terminals, rules, seq)), np.r_[0, np.flatnonzero(ends) + 1]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for n, k in ((1, 2), (5000, 3), (20_000, 300), (3000, 1)):
        docs = [rng.integers(0, k, size=rng.integers(0, 80)).astype(np.uint32) for _ in range(max(1, n // 40))]
        docs = [np.append(d, np.uint32(48_999)) for d in docs]
        g, start = grammar(docs)
        assert (g.expand() == np.concatenate(docs)).all()
        assert not len(g.rules) or g.n < sum(map(len, docs))
        assert len(start) == len(docs) + 1  # no rule crosses a document's end
        for j in range(0, len(docs), 7):
            n = len(docs[j])
            for a, b in ((0, n), (n // 3, n), (n // 2, n // 2 + 1)):
                assert (g.slice(start[j], start[j + 1], a, b) == docs[j][a:b]).all()


def test_slices_open_only_what_they_need():
    docs = [np.append(np.tile(np.arange(8, dtype=np.uint32), 4096), np.uint32(9)) for _ in range(4)]
    g, start = grammar(docs)
    assert g.n < 200 and int(g.lengths.max()) >= 8192  # rules stand for very long repeats
    assert g.slice(start[2], start[3], 20_001, 20_004).tolist() == [1, 2, 3]
    assert 0 < g.opened <= 4 * 20  # a path through the grammar, not what stands beside it


def test_no_pair_that_pays_is_left():
    rng = np.random.default_rng(5)
    pool = [rng.integers(0, 3000, size=rng.integers(2, 6)).astype(np.uint32) for _ in range(500)]
    docs = [np.concatenate([*(pool[k] for k in rng.integers(0, 500, 300)), [3000]]).astype(np.uint32) for _ in range(60)]
    last = np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    terminals, rules, seq, ends = tokens.repair(np.concatenate(docs), last)
    pair = (seq[:-1].astype(np.int64) << 32 | seq[1:])[~ends[:-1] & (seq[:-1] != seq[1:])]
    room = (1 << int(seq.max()).bit_length()) - len(terminals) - len(rules)
    assert not room or np.unique(pair, return_counts=True)[1].max() < 2 * tokens.LEAST
    assert len(tokens.pack(terminals, rules, seq)) < 0.9 * len(zlib.compress(np.concatenate(docs).astype("<u2").tobytes(), 9))


def test_bits_come_back():
    rng = np.random.default_rng(6)
    for width in (1, 7, 8, 13, 31):
        v = rng.integers(0, 1 << width, 1001).astype(np.uint32)
        data = memoryview(b"xyz" + tokens.pack_bits(v, width))
        assert (tokens.unpack_bits(data, 3, 0, 1001, width) == v).all() and (tokens.unpack_bits(data, 3, 333, 10, width) == v[333:343]).all()


def test_digest_against_the_tokenizer(spark, encoder, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 500)
    df, rows = odd(spark, [(k, words(random.Random(k), k)) for k in range(20, 60)])
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.digest(tokens.written(df)).collect()), key=lambda r: r[2])
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0] is not None, r[0] or 0, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want


def test_empty_table(spark):
    assert tokens.digest(tokens.written(none(spark))).count() == 0 and counts.count(none(spark)).count() == 0


@pytest.fixture(scope="module")
def automaton():
    pieces = counts.pieces_of(counts.tokenizer_path())
    return pieces, counts.Automaton(pieces)


def greedy(word, pieces, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if k == 1 or word[at : at + k] in pieces)
        n += 1
    return n


def test_counts_are_greedy_longest_match(automaton):
    pieces, a = automaton
    rng = random.Random(4)
    made = [b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))[: rng.randint(1, 25)] for _ in range(5000)] + [b"", b"\xff\xfe", b"a" * 3000]
    known, longest = set(pieces), max(map(len, pieces))
    assert a.count(made).tolist() == [greedy(w, known, longest) for w in made]


def test_small_vocabularies():
    rng = random.Random(5)
    for _ in range(50):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))).encode() for _ in range(6)]
        a, known = counts.Automaton(pieces), set(pieces)
        made = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))).encode() for _ in range(60)]
        assert a.count(made).tolist() == [greedy(w, known, 6) for w in made]


def test_words_are_parted_as_the_pattern_says(automaton):
    _, a = automaton
    for text in ("a\x1cb c\x1fd", "a\x85b\xa0c\u3000d", "\x1d", "x\x0by"):
        assert counts.PATTERN.findall(text) == [f for w in counts.words_of(text) for f in counts.PATTERN.findall(w)]
        assert a.count_texts([text.encode()])[0][0] == len(counts.PATTERN.findall(text))


def test_counts_of_odd_rows(spark, automaton):
    pieces, _ = automaton
    df, rows = odd(spark)
    known, longest = set(pieces), max(map(len, pieces))
    want = []
    for r in rows:
        found = counts.PATTERN.findall((r[1] or "").lower())
        want.append((r[0] or 0, len(found), sum(greedy(w.encode(), known, longest) for w in found)))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in counts.count(df).collect()) == sorted(want)
