"""Near copies by the Jaccard similarity of distinct five-word shingles: keys that make candidates, and the exact decision.

Texts of equal shingle sets are one node. Sets of up to SMALL shingles meet by prefix filter: with the shingles in order of
their hash, two sets of similarity LEAST or more share one of the first n - ceil(LEAST n) + 1, so no pair is lost. Larger
sets meet by minima of ROWS hash functions in BANDS bands: a pair at 0.8 is missed with a chance of 7 in a million, a closer
one less often; sets that only share a line or a passage rarely meet. simhash.deduplicate() compares the fingerprints of
sets that meet, and brings the sets of what its links connect together here, where a pair is linked when its similarity,
counted on the sets, is LEAST or more.

A cell gives a spanning forest of its links: rows of the largest group so far need no queries of their own.

Defined results: null and empty texts, and texts of white space, have the empty set and are copies of each other; texts of
fewer words than a shingle are one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash

from .common import unite

SEED = 42
WORDS = 5
#: Similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Sets of so many shingles meet by prefix filter alone.
SMALL = 16
BANDS, ROWS = 30, 5

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_values(data: bytes | None, words: int) -> np.ndarray:
    """The XXH64 value of each word shingle of a UTF-8 text."""
    tokens = (data or b"").lower().split()  # bytes: A-Z only, and exactly 0x20 and 0x09 to 0x0D
    if not tokens:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(tokens)
    hashed = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([hashed(joined, SEED)], dtype="<u8")
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    n = len(tokens) - words + 1
    return np.fromiter([hashed(joined[s : e - 1], SEED) for s, e in zip(starts[:n], starts[words:])], dtype="<u8", count=n)


def shingles(data: bytes | None) -> np.ndarray:
    """The set of a text: its distinct shingle values in order."""
    return np.unique(shingle_values(data, WORDS))


def keys(own: np.ndarray) -> np.ndarray:
    """Keys of a set, one of which it shares with every set like it."""
    n, (p, q) = len(own), LEAST
    found = []
    if n * p <= SMALL * q:  # a set of SMALL shingles is like sets of this size
        found.append(own[: n - -(-p * n // q) + 1] if n else own)
    if n > SMALL:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, n, 512):
            np.minimum(least, (own[at : at + 512] * _FACTORS[:, None]).min(axis=1), out=least)
        least = least.reshape(BANDS, ROWS)
        key = _MIX.copy()
        for k in range(ROWS):
            key = (key ^ least[:, k]) * _MIX
            key ^= key >> np.uint64(31)
        found.append(key)
    return np.concatenate(found)


def alike(a: int | np.ndarray, b: int | np.ndarray, common: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of a and b shingles, `common` of them in both, have similarity LEAST or more."""
    p, q = LEAST
    return (p + q) * common >= p * (a + b)


def link(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """For each set the first one that links lead to; sets of equal numbers in `known` are linked from the start."""
    n = len(sets)
    _, first, back = np.unique(known, return_index=True, return_inverse=True)
    lab = first[back]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        if lab[1] and alike(size[0], size[1], min(size)) and alike(size[0], size[1], len(np.intersect1d(*sets, assume_unique=True))):
            lab[1] = 0
        return lab
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    new = np.r_[True, flat[order][1:] != flat[order][:-1]]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(flat)])
    value = np.empty(len(flat), dtype=np.int64)
    value[order] = np.cumsum(new) - 1
    row, begin = row[order], np.r_[0, np.cumsum(size)]
    asked = np.zeros(n, dtype=bool)
    while True:
        # any pair is either in the largest group or has a row outside, and all rows outside are queried
        held = np.bincount(lab, minlength=n)
        largest = held.argmax()
        open_ = np.flatnonzero(~asked & ((lab != largest) | (held[largest] == 1)))
        if not len(open_):
            return lab
        for k in open_[:: max(1, len(open_) // 16)][:16]:
            asked[k] = True
            own = value[begin[k] : begin[k + 1]]
            own = own[count[own] > 1]
            many = count[own]
            at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            hit = np.flatnonzero(alike(size[k], size, np.bincount(row[at], minlength=n)))
            lab = unite(lab, np.full(len(hit), k), hit)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of cells; rows (group, cell, known, node, shingles) come in order of group, cell and node."""
    cell, nodes, known, sets = None, [], [], []
    links: list[tuple[int, int]] = []

    def settle() -> None:
        if len(nodes) > 1:
            lab = link(sets, np.array(known))
            first = np.unique(known, return_index=True)[1]
            links.extend((nodes[k], nodes[lab[k]]) for k in first.tolist() if k != lab[k])

    def out() -> pa.RecordBatch:
        a, b = zip(*links) if links else ((), ())
        links.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for group, part, before, node, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
            if (group, part) != cell:
                settle()
                cell, nodes, known, sets = (group, part), [], [], []
            if not nodes or nodes[-1] != node:  # rows that are equal in every column come more than once
                nodes.append(node)
                known.append(before)
                sets.append(np.frombuffer(data.as_py(), dtype="<u8"))
        yield out()
    settle()
    yield out()
