"""Token counts by a linear longest-match automaton.

Greedy word pieces: at each place of a word the longest vocabulary piece that fits is taken. A trie over the pieces with
failure links finds all of them in one pass: where no edge goes on, the pieces that are certain by then are popped and the
walk goes on from the failure state. Only counts are wanted, so a state holds how many pieces its link pops, and how many
its own string has at the end of a word; no piece is built.

The vocabulary is that of a byte-level tokenizer file: the distinct byte strings of its tokens, without word-end marks and
special tokens. Words are what its pattern finds in a text in lower case and normal form C. The walk runs over all distinct
words of a batch together, one byte at a time.

Defined results: null and empty texts have no words and no tokens; very long texts are counted whole; a byte that is no
piece by itself counts as one; equal texts have equal counts; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_text, table

TOKENIZER = "word_bpe_49k.json"
#: The tokenizer file's own pattern for words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Python takes these for blanks, the pattern does not.
_ODD = regex.compile("[\x1c-\x1f]")


def words_of(text: str) -> list[str]:
    """What stands between the pattern's blanks."""
    return [w for w in regex.split(r"\s+", text) if w] if _ODD.search(text) else text.split()


WORD_END = "</w>"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces_of(path: str) -> list[bytes]:
    """Distinct byte strings of a tokenizer file's vocabulary, sorted."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    table_ = byte_of()
    found = set()
    for token in data["model"]["vocab"]:
        bare = token.removesuffix(WORD_END)
        if token not in special and bare and all(c in table_ for c in bare):
            found.add(bytes(table_[c] for c in bare))
    return sorted(found)


class Automaton:
    """edge: sorted state * 256 + byte; child: by edge; fail, pops, tail: by state (0 is the root)."""

    def __init__(self, pieces: list[bytes]) -> None:
        pieces = sorted({*pieces, *(bytes([b]) for b in range(256))})
        goto: dict[int, int] = {}
        parent, symbol, whole = [0], [0], [False]
        for p in pieces:
            state = 0
            for b in p:
                key = state * 256 + b
                if key not in goto:
                    goto[key] = len(parent)
                    parent.append(state)
                    symbol.append(b)
                    whole.append(False)
                state = goto[key]
            whole[state] = True
        n = len(parent)
        fail, pops, tail, depth = [-1] * n, [0] * n, [0] * n, [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, n), key=depth.__getitem__):
            if whole[v]:
                fail[v], pops[v], tail[v] = 0, 1, 1
                continue
            z, popped = fail[parent[v]], pops[parent[v]]
            while z * 256 + symbol[v] not in goto:  # the root has an edge for every byte
                popped += pops[z]
                z = fail[z]
            fail[v], pops[v] = goto[z * 256 + symbol[v]], popped
            tail[v] = popped + tail[fail[v]]
        order = sorted(goto)
        self.edge = np.array(order, dtype=np.int64)
        self.child = np.array([goto[k] for k in order], dtype=np.int64)
        self.fail, self.pops, self.tail = (np.array(x, dtype=np.int64) for x in (fail, pops, tail))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        start = (np.cumsum(size) - size)[order]
        state, total = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        falling = -size[order]
        for at in range(int(size.max()) if len(size) else 0):
            live = np.searchsorted(falling, -at, side="left")  # words longer than at
            byte = flat[start[:live] + at]
            todo = np.arange(live)
            while len(todo):
                key = state[todo] * 256 + byte[todo]
                k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                ok = self.edge[k] == key
                state[todo[ok]] = self.child[k[ok]]
                todo = todo[~ok]
                total[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        total += self.tail[state]
        out = np.zeros(len(words), dtype=np.int64)
        out[order] = total
        return out

    def count_texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words, pieces) of each text."""
        number: dict[str, int] = {}
        rows = [np.fromiter([number.setdefault(w, len(number)) for w in words_of(t.decode("utf-8", "replace"))] if t else (), dtype=np.int64) for t in texts]
        found = [PATTERN.findall(unicodedata.normalize("NFC", w.lower())) for w in number]
        n_words = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        pieces = self.count([w.encode("utf-8", "surrogatepass") for f in found for w in f])
        end = np.cumsum(n_words)
        total = np.r_[0, np.cumsum(pieces)]
        n_pieces = total[end] - total[end - n_words]
        return np.array([n_words[r].sum() for r in rows], dtype=np.int64), np.array([n_pieces[r].sum() for r in rows], dtype=np.int64)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces_of(path or tokenizer_path())))  # as large as the vocabulary

    def make():
        automaton = shared.value

        def work(texts: list[bytes | None]) -> dict[str, object]:
            words, pieces = automaton.count_texts(texts)
            return {"n_words": words, "n_tokens": pieces}

        return work

    return map_text(docs, ["doc_id"], "n_words long, n_tokens long", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
