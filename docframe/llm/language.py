"""Language identification by language-bitmask n-gram filters.

A Bloom filter whose cells are bit masks over languages: bit l of a cell belongs to language l's filter. One lookup of an
n-gram (the AND of its cells) gives all languages that have it. A text's n-grams are counted per language bit and number
of languages in the mask, the counts are corrected for the filters' false positives, and the largest weighted sum decides:
an n-gram of p among n languages weighs log((n + 1) / p), so that what all languages have hardly counts.

A language's filter takes every n-gram of that language's sampled texts.

Defined results: texts that are null or without a letter get `und` and score 0; texts none of whose n-grams is known get
the language with most sampled rows and score 0; ties go to the smaller name by code point; very long texts are read
whole, in pieces; equal texts get equal results; extra columns are not read; without labelled rows all is `und`; an empty
table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_text, table
from .samples import own_labelled

ORDERS = (2, 3, 4)
CELL_BITS = 19
HASHES = 3
MOST_PER_LANGUAGE = 600
PIECE = 1 << 19

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_CELLS = np.uint64((1 << CELL_BITS) - 1)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def cleaned(data: bytes) -> np.ndarray:
    """Lower-case code points of a text; each run of other characters than letters is one blank, and blanks surround it."""
    c = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letter_table()[c]
    if not letter.any():
        return np.zeros(0, np.uint32)
    c = np.where(letter, c, np.uint32(32))
    return np.concatenate([[32], c[letter | np.r_[False, letter[:-1]]], [32][: int(letter[-1])]]).astype(np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of cleaned code points."""
    wide = c.astype(np.uint64)
    out, code = [], wide * _A
    for n in range(2, max(ORDERS) + 1):
        if len(wide) < n:
            break
        code = (code[:-1] ^ (code[:-1] >> np.uint64(29))) * _B + wide[n - 1 :] * _C
        if n in ORDERS:
            out.append((code ^ (code >> np.uint64(32))) * _A)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def cells(hashed: np.ndarray, k: int) -> np.ndarray:
    return ((hashed >> np.uint64(1 + k * CELL_BITS)) & _CELLS).astype(np.int64)


class Model:
    """names: languages in code point order; masks: words of 64 languages by cell; false_rate: by language."""

    def __init__(self, names: list[str], masks: np.ndarray, common: int) -> None:
        self.names, self.masks, self.common = names, masks, common
        fill = [((masks[l // 64] >> np.uint64(l % 64)) & np.uint64(1)).mean() for l in range(len(names))]
        self.false_rate = np.array(fill) ** HASHES

    def counts(self, data: bytes) -> tuple[np.ndarray, int]:
        """For each language the corrected, weighted number of n-grams of the text that its filter holds; and the number of n-grams."""
        n = len(self.names)
        found, every, total = np.zeros((n, n + 1)), np.zeros(n + 1), 0  # by the number of languages in the mask
        c = cleaned(data)
        reach = max(ORDERS) - 1
        for at in range(0, max(len(c) - 1, 0), PIECE):
            h = grams(c[at : at + PIECE + reach])
            total += len(h)
            at_cells = [cells(h, k) for k in range(HASHES)]
            hits = [np.bitwise_and.reduce([mask[k] for k in at_cells]) for mask in self.masks]
            if n <= 8:  # population counts of all masks at once
                by_mask = np.bincount(hits[0].astype(np.int64), minlength=1 << n)
                sizes = np.bitwise_count(np.arange(1 << n))
                every += np.bincount(sizes, by_mask, n + 1)
                for l in range(n):
                    own = np.arange(1 << n) >> l & 1 == 1
                    found[l] += np.bincount(sizes[own], by_mask[own], n + 1)
            else:
                size = np.sum([np.bitwise_count(hit) for hit in hits], axis=0, dtype=np.int64)
                every += np.bincount(size, minlength=n + 1)
                for l in range(n):
                    found[l] += np.bincount(size[hits[l // 64] & np.uint64(1 << (l % 64)) != 0], minlength=n + 1)
        # a false positive makes an n-gram of p - 1 languages, without this one, an n-gram of p languages with it
        false = self.false_rate[:, None] * (every - found)[:, :-1]
        return np.maximum(found[:, 1:] - false, 0.0) @ np.log((n + 1) / np.arange(1, n + 1)), total

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        names, score = [], np.zeros(len(texts))
        for k, t in enumerate(texts):
            n, total = self.counts(t) if t and self.names else (np.zeros(0), 0)
            if not total:
                names.append("und")
            elif not n.any():
                names.append(self.names[self.common])
            else:
                best = int(n.argmax())
                names.append(self.names[best])
                score[k] = n[best] / n.sum()
        return names, score


def fit(sample: list[tuple[bytes, str]]) -> Model:
    names = sorted({str(l) for _, l in sample})
    at = {l: k for k, l in enumerate(names)}
    words = max(1, (len(names) + 63) // 64)
    masks = np.zeros((words, 1 << CELL_BITS), dtype=np.uint64)
    if not names:
        return Model(names, masks, 0)
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for t, l in sample:
        parts[at[l]].append(grams(cleaned(t)))
    for l, part in enumerate(parts):
        own = np.unique(np.concatenate(part))
        for k in range(HASHES):
            masks[l // 64][cells(own, k)] |= np.uint64(1 << (l % 64))
    return Model(names, masks, int(np.argmax([len(p) for p in parts])))


def trained(docs: DataFrame, most: int = MOST_PER_LANGUAGE) -> Model:
    return fit(own_labelled(docs, "lang", most))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size for each 64 languages

    def make():
        m = shared.value

        def work(texts: list[bytes | None]) -> dict[str, object]:
            names, scores = m.predict(texts)
            return {"lang_pred": pa.array(names, pa.string()), "score": scores}

        return work

    return map_text(docs, ["doc_id"], "lang_pred string, score double", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
