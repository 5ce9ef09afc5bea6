"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that stands in a text with k edits or fewer shares at least m - q + 1 - k q of its q-grams with
it, on diagonals (text position less item position) that span k at most. Diagonals are cut into bands of 2 (k + 1) that
overlap by half, so one band holds them all: hits are counted per item and band, bands that reach the bound are kept, and
the region of each is aligned with the item inside a band of diagonals; an alignment within the budget is a match.

The commonest q-grams of an item are left out of the count, and as many are taken off its bound: what remains is still
certain, and far fewer hits are counted.

Texts and items are compared in lower case with runs of white space as one blank. The budget is RATE of an item's length,
less for items so short that the bound would vanish; items shorter than a q-gram are looked for as they are.

Defined results: null and empty texts and items match nothing; very long texts are read whole; texts match by themselves,
whatever other rows there are; rows of equal doc_id are rows of their own; equal items each match; extra columns are not
read by the search and kept by the filter; an empty benchmark leaves all rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_values, chunks, filter_text, materialize, small_batches, table, trim

Q = 6
RATE = 0.12
#: Part of the bound that may go to leaving out common q-grams.
SPARED = 0.4
#: Regions that are aligned together.
REGIONS = 512
#: Items are searched in slices of so many bytes, about, whose indexes take about 16 times that. The driver and each Python
#: worker hold one slice at a time, and texts are read once for all slices.
SLICE_BYTES = 2 << 20
#: Characters that are searched at once, about.
PIECE = 1 << 19
FILTER_BITS = 22
#: q-grams of a piece that are looked up at once.
BLOCK = 1 << 16
_END = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0x9E3779B97F4A7C15 * 0x9E3779B97F4A7C15 % (1 << 64))


def normal(data: bytes) -> np.ndarray:
    """Code points of a text in lower case, with one blank for each run of white space."""
    text = " ".join(data.decode("utf-8", "replace").lower().split())
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_codes(c: np.ndarray) -> np.ndarray:
    """A hash of each run of Q code points."""
    x = c.astype(np.uint64) * _BASE
    x ^= x >> np.uint64(31)
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    two = x[:-1] * _BASE + x[1:]
    n = len(c) - Q + 1
    six = (two[:n] * _BASE2 + two[2 : 2 + n]) * _BASE2 + two[4 : 4 + n]  # Q is 6
    return six ^ (six >> np.uint64(29))


class Index:
    """Items ready for search. codes: sorted distinct q-grams in use; item, place: where they occur, each from first on."""

    def __init__(self, items: list[tuple[object, bytes]]) -> None:
        texts = [(i, normal(t)) for i, t in items if t]
        self.short = [(i, t) for i, t in texts if 0 < len(t) < Q]
        texts = [(i, t) for i, t in texts if len(t) >= Q]
        self.ids, self.texts = [i for i, _ in texts], [t for _, t in texts]
        size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget = np.minimum((size * RATE).astype(np.int64), (size - Q) // Q)
        bound = size - Q + 1 - self.budget * Q
        codes = [gram_codes(t) for t in self.texts]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        spared = np.minimum((bound * SPARED).astype(np.int64), bound - 1)
        order = np.lexsort((place, -n[at], item))  # an item's q-grams, commonest first
        begin = np.searchsorted(item[order], np.arange(len(codes)))
        rank = np.arange(len(order)) - np.repeat(begin, [len(c) for c in codes])
        used = order[rank >= spared[item[order]]] if len(order) else order
        self.bound = bound - spared
        flat, item, place = flat[used], item[used], place[used]
        order = np.argsort(flat, kind="stable")
        self.codes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int32)
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.codes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def candidates(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of the bands of c that reach the bound."""
        where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(c) - Q + 1 if len(self.codes) else 0, BLOCK):  # block by block, so that codes stay in the cache
            codes = gram_codes(c[at : at + BLOCK + Q - 1])
            pos = np.flatnonzero(self.filter[(codes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            hit = np.minimum(np.searchsorted(self.codes, codes[pos]), len(self.codes) - 1)
            ok = self.codes[hit] == codes[pos]
            where.append(pos[ok] + at)
            what.append(hit[ok])
        pos, hit = np.concatenate(where), np.concatenate(what)
        if not len(pos):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = (self.first[hit + 1] - self.first[hit]).astype(np.int64)
        end = np.cumsum(n)
        at = np.repeat(self.first[hit] - end + n, n) + np.arange(end[-1] if len(end) else 0)
        item = self.item[at].astype(np.int64)
        width = self.budget[item] + 1
        band = (np.repeat(pos, n) - self.place[at] + (1 << 20) * width) // width  # never below zero
        key = np.sort((item << 40) | band)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, count = key[cut], np.diff(np.r_[cut, len(key)])
        # a band is two neighbouring halves: this one and the next
        after = np.r_[np.where(key[1:] == key[:-1] + 1, count[1:], 0), 0] if len(key) else count
        before = np.r_[0, np.where(key[1:] == key[:-1] + 1, count[:-1], 0)] if len(key) else count
        bound = self.bound[key >> 40]
        good = count + after >= bound
        lower = (before + count >= bound) & (before == 0)  # the half before is empty, and no key stands for it
        found = np.unique(np.concatenate([key[good], key[lower] - 1]))
        item = found >> 40
        return item, (found & ((1 << 40) - 1)) - (1 << 20)

    def search(self, c: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, stop, distance) of matches in a piece of the texts begins[j] to ends[j], each in its own text.

        A region that reaches over several texts is aligned in each that could hold its item.
        """
        item, band = self.candidates(c)
        out = []
        if not len(item):
            return out
        size = np.array([len(t) for t in self.texts], dtype=np.int64)[item]
        low = band * (self.budget[item] + 1) - self.budget[item]  # lowest diagonal of the region
        high = low + 4 * self.budget[item] + 3 + size
        first = np.searchsorted(ends, low, side="right")
        n = np.maximum(np.searchsorted(begins, high) - first, 0)
        row = np.repeat(np.arange(len(item)), n)
        home = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        room = np.minimum(ends[home], high[row]) - np.maximum(begins[home], low[row])
        fits = room >= (size - self.budget[item])[row]
        row, home = row[fits], home[fits]
        item, low = item[row], low[row]
        order = np.argsort([len(self.texts[k]) for k in item], kind="stable")[::-1]  # regions of like length go together
        for part in np.array_split(item[order], -(-len(order) // REGIONS)) if len(order) else []:
            own_low, text_of = low[order[: len(part)]], home[order[: len(part)]]
            order = order[len(part) :]
            budget, begin = self.budget[part], begins[text_of]
            distance, stop = align([self.texts[k] for k in part], c, own_low, int(4 * budget.max() + 3), budget, begin, ends[text_of])
            good = np.flatnonzero(distance <= budget)
            if len(good):
                back = [c[max(begin[g], stop[g] - len(self.texts[part[g]]) - budget[g]) : stop[g]][::-1] for g in good]
                for g, text in zip(good, back):
                    own = self.texts[part[g]][::-1]
                    _, n = align([own], text, np.array([-budget[g]]), int(2 * budget[g] + 1), budget[g : g + 1]) if distance[g] else (0, [len(own)])
                    out.append((int(text_of[g]), int(part[g]), int(stop[g] - n[0]), int(stop[g]), int(distance[g])))
        return out


def align(items: list[np.ndarray], c: np.ndarray, low: np.ndarray, width: int, budget: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each region: least edit distance of its item to a part of c on diagonals low to low + width - 1, and the part's end.

    The part lies within begin to end of its region, which are those of c where none are given.

    The part may start anywhere on these diagonals (row 0 is free) and end anywhere. Rows are item characters, columns
    diagonals; all regions go through the rows together, and one whose row is over its budget is left.
    """
    size, n = np.array([len(t) for t in items]), len(c)
    chars = np.zeros((len(items), int(size.max())), dtype=np.uint32)
    for k, t in enumerate(items):
        chars[k, : len(t)] = t
    far = np.int32(1 << 20)
    distance, stop = np.full(len(items), far, dtype=np.int64), np.zeros(len(items), dtype=np.int64)
    lane = np.arange(width, dtype=np.int32)
    longest = int(size.max())
    reach = longest + width  # of the text that rows look at
    window = low[:, None] + np.arange(reach)
    text = np.r_[c, [_END]][np.where((window >= 0) & (window < n), window, n)].astype(np.uint32)
    live = np.arange(len(items))
    begin = np.zeros((len(items), 1), dtype=np.int64) if begin is None else begin[:, None]
    end = np.full((len(items), 1), n, dtype=np.int64) if end is None else end[:, None]
    pos = low[:, None] + lane
    row = np.where((pos >= begin) & (pos <= end), np.int32(0), far)
    for i in range(longest):
        change = (text[:, i : i + width] != chars[:, i, None]).astype(np.int32)
        at = low[:, None] + (lane + i)
        change[(at < begin) | (at >= end)] = far
        new = row + change
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # item character without a partner
        row = np.minimum(np.minimum.accumulate(new - lane, axis=1) + lane, far)  # text characters without a partner
        row[(at + 1 < begin) | (at + 1 > end)] = far
        done = size[live] == i + 1
        if done.any():
            best = row[done].argmin(axis=1)
            distance[live[done]] = row[done][np.arange(len(best)), best]
            stop[live[done]] = low[done] + best + i + 1
        if done.any() or i % 16 == 15:
            stay = ~done & (row.min(axis=1) <= budget[live])
            if not stay.any():
                break
            if not stay.all():
                live, row, low, text, chars, begin, end = live[stay], row[stay], low[stay], text[stay], chars[stay], begin[stay], end[stay]
    return distance, stop


def pieces(texts: list[bytes | None], reach: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Code points of texts, many to a piece, and where each (text, start in piece, start in text) lies in it.

    A text longer than a piece is cut into pieces that overlap by reach.
    """
    held, spans, size = [], [], 0
    end = np.array([_END], dtype=np.uint32)
    for k, t in enumerate(texts):
        if not t:
            continue
        c = normal(t)
        step = max(PIECE, 2 * reach)
        for at in range(0, max(len(c) - reach, 1), step):
            part = c[at : at + step + reach]
            spans.append((k, size, at))
            held += [part, end]
            size += len(part) + 1
            if size >= PIECE:
                yield np.concatenate(held), spans
                held, spans, size = [], [], 0
    if spans:
        yield np.concatenate(held), spans


def matches(index: Index, texts: list[bytes | None]) -> list[tuple[int, object, int, int, int]]:
    """(text, item id, start, stop, distance) of the best match of each item in each text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    reach = max([2 * len(t) for t in index.texts], default=0) + 4
    for c, spans in pieces(texts, reach):
        begin = np.array([s for _, s, _ in spans])
        stops = np.r_[begin[1:] - 1, len(c) - 1]
        for j, item, start, stop, distance in index.search(c, begin, stops):
            k, s, at = spans[j]
            found = (distance, start - s + at, stop - s + at)
            key = (k, item)
            best[key] = min(best.get(key, found), found)
    out = [(k, index.ids[i], a, b, d) for (k, i), (d, a, b) in sorted(best.items())]
    for i, t in index.short:
        word = t.tobytes().decode("utf-32-le", "surrogatepass")
        for k, data in enumerate(texts):
            if data and (at := " ".join(data.decode("utf-8", "replace").lower().split()).find(word)) >= 0:
                out.append((k, i, at, at + len(word), 0))
    return out


def slices(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's items, SLICE_BYTES of them at a time; a longer item is a slice of its own."""
    data = benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("data"))
    total = data.agg(F.sum(F.length("data"))).first()[0] or 0
    n = -(-total // SLICE_BYTES)
    part = data.withColumn("slice", F.pmod(F.xxhash64("item_id", "data"), F.lit(max(n, 1))))
    part = materialize(part.repartition(n, "slice").sortWithinPartitions("slice"), "items") if n > 1 else part
    for k in range(n):
        rows = [(r["item_id"], bytes(r["data"])) for r in part.where(F.col("slice") == k).select("item_id", "data").collect()]
        if rows:
            yield Index(sorted(rows, key=lambda r: (str(r[0]), r[1])))


class Shared:
    """Indexes of all slices, broadcast one by one; a worker that goes through several holds one at a time."""

    def __init__(self, benchmark: DataFrame) -> None:
        context = benchmark.sparkSession.sparkContext
        self.slices = [context.broadcast(index) for index in slices(benchmark)]

    def __iter__(self) -> Iterator[Index]:
        for shared in self.slices:
            yield shared.value
            if len(self.slices) > 1:
                vars(shared).pop("_value", None)  # what a worker has loaded; it lies in a local file


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, stop, distance): each item in each row of docs where it matches best, in normal text."""
    schema = "doc_id long, item_id long, start long, stop long, distance int"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    small_batches(docs.sparkSession)
    shared = Shared(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([batch])):
                ids, texts = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "text"))
                texts = binary_values(texts)
                for index in shared:
                    got = matches(index, texts)
                    if got:
                        row, *rest = zip(*got)
                        found = [ids.take(pa.array(row, pa.int64())).cast(pa.int64()), *map(pa.array, rest, kinds)]
                        yield pa.RecordBatch.from_arrays(found, names=["doc_id", "item_id", "start", "stop", "distance"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item matches, with all their columns."""
    shared = Shared(benchmark)

    def make():
        def keep(texts: list[bytes | None]) -> np.ndarray:
            out = np.ones(len(texts), dtype=bool)
            for index in shared:
                out[[m[0] for m in matches(index, [t if ok else None for t, ok in zip(texts, out)])]] = False
            return out

        return keep

    return filter_text(docs, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
