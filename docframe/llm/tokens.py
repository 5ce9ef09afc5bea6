"""Token ids in a compressed binary format: Re-Pair grammars over blocks of documents.

File format. A dataset is a Parquet table with one row per block, so that Spark's writer and commit protocol place it in
any store: part, block (order), before (ids of the part before this block), doc_ids, n_tokens, starts (where each document
begins in the block's sequence) and payload, a binary: the magic "RPG2", then, as little-endian uint32, the counts of
terminals, rules and sequence symbols and four widths in bits; then four runs of numbers of these widths, each filled up to
whole bytes: differences of the ascending token ids that occur, two symbols for each rule, the rules' expansion lengths, and
the sequence. A symbol below the number of terminals stands for a token id; others are rules, which only use symbols that
come before them. No rule crosses the end of a document, so a document is decoded from its own slice of the sequence; the
expansion lengths lead to any position in it without opening what comes before.

Re-Pair: frequent pairs of adjacent symbols are replaced by new symbols, again and again, until no pair pays for its rule.
A pass takes all pairs over a bound, which falls from pass to pass; where they overlap, the more frequent one. A rule pays
from LEAST uses on. Where more rules would need another bit for every symbol, the grammar so far is noted, and the smallest
of those noted and the last one is taken. Passes end when one shortens the sequence by less than 1 in WORTH.

Defined results: null and empty texts are the end id alone; texts are encoded whole; documents are written in ascending
doc_id order, null first, equal ids by text; rows of equal doc_id are documents of their own; extra columns are not read;
an empty table gives an empty dataset.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, chunks, materialize, small_batches, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"RPG2"
#: Ids from which on a block is closed, after the document that reaches them.
BLOCK_IDS = 1 << 19
#: Uses from which a rule pays. The bound of the first pass is the largest count divided by STEP, then the last bound.
LEAST, STEP = 5, 6
#: Bits of the hash by which pairs are counted.
COUNT_BITS = 18
#: The last pass is the first one at LEAST that shortens the sequence by less than one symbol in so many.
WORTH = 300
_MIX = 0x9E3779B97F4A7C15
#: Words, and runs of letters, whose ids a Python worker remembers, over its tasks, before it starts anew.
WORDS = 300_000
#: Words are split at these too, the tokenizer does not: such texts go to it whole.
_ODD = "[\x1c-\x1f]"
#: Letters below U+0250 without marks that combine: their lower case is the tokenizer's, and normal form C leaves them.
_PLAIN = "^(?P<run>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<signs>[.,!?;:|%&$#*]*)$"
BLOCK_SCHEMA = "part int, block int, before long, doc_ids array<long>, n_tokens array<int>, starts array<int>, payload binary"


def numbered(known: dict[str, int], distinct: list[str]) -> tuple[np.ndarray, list[str]]:
    """The number of each of distinct texts, and those that were not known: they get the next numbers."""
    found = np.fromiter(map(known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
    fresh = found < 0
    new = list(compress(distinct, fresh.tolist()))
    numbers = range(len(known), len(known) + len(new))
    found[fresh] = numbers
    known.update(zip(new, numbers))
    return found, new


def _strings(column: pa.Array) -> list[str]:
    """A column as Python's strings, faster than one by one."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Memory:
    """Ids of distinct texts by their numbers, one after the other."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def add(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.flat = np.concatenate([self.flat, *ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct run of letters once.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words in order. It also parts
    letters from signs: a word of plain letters with signs behind is its letters, in lower case, and its signs. Words are
    split, told apart and cut column by column; only distinct ones become Python's.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lower-case runs of letters, which need no normal form and part at blanks alone; as each run
        # comes once, the model's own memory of words would only cost time
        letters = Tokenizer.from_file(path)
        letters.normalizer = normalizers.Sequence([])
        letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(letters.model, "_resize_cache"):
            letters.model._resize_cache(0)
        self.letters = getattr(letters, "encode_batch_fast", letters.encode_batch)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)  # ids of tokens that end a run of letters
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[k] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.words, self.runs = _Memory(), _Memory()

    def _one_by_one(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.batch(texts, add_special_tokens=False)] if texts else []

    def _learn_runs(self, runs: list[str]) -> None:
        ids, sizes = [], []
        for at in range(0, len(runs), 128):
            part = runs[at : at + 128]
            found = np.array(self.letters([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) == len(part):
                ids.append(found)
                sizes.append(np.diff(stops, prepend=0))
            else:  # not as the tokenizer's pattern has it
                each = self._one_by_one(part)
                ids += each
                sizes.append(np.array([len(e) for e in each], dtype=np.int64))
        if ids:
            self.runs.add(ids, sizes)

    def _learn(self, words: list[str]) -> None:
        given = pa.array(words, pa.string())
        cut = pc.extract_regex(given, _PLAIN)
        plain = cut.is_valid()
        is_plain = plain.to_numpy(zero_copy_only=False)
        runs = pc.utf8_lower(cut.filter(plain).field("run")).dictionary_encode()
        rest = pa.concat_arrays([given.filter(pc.invert(plain)), cut.filter(plain).field("signs")]).dictionary_encode()
        numbers, new = numbered(self.runs.number, _strings(runs.dictionary))
        self._learn_runs(new)
        # for these words: the runs, then what is tokenized by itself, then an empty text
        other, base = self._one_by_one(_strings(rest.dictionary)), len(self.runs.at) - 1
        flat = np.concatenate([self.runs.flat, *other])
        at = np.concatenate([self.runs.at, self.runs.at[-1] + np.cumsum(np.array([len(o) for o in other] + [0], dtype=np.int64))])
        codes = np.full((len(words), 2), base + len(other), dtype=np.int64)
        codes[is_plain, 0] = numbers[runs.indices.to_numpy()]
        codes[~is_plain, 0], codes[is_plain, 1] = np.split(rest.indices.to_numpy().astype(np.int64) + base, [len(words) - int(is_plain.sum())])
        self.words.add([gather(flat, at, codes.ravel())], [np.diff(at)[codes].sum(axis=1)])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, without an end id. A null text has none."""
        if len(self.words.number) > WORDS:
            self.words = _Memory()
        if len(self.runs.number) > WORDS:
            self.runs = _Memory()
        gc.disable()  # nothing here has cycles, and collections would go through millions of words
        try:
            return self._encode(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        numbers, new = numbered(self.words.number, _strings(words.dictionary))
        if new:
            self._learn(new)
        rows, known = numbers[words.indices.to_numpy()], self.words
        upto = np.r_[0, np.cumsum(known.at[rows + 1] - known.at[rows])]
        out = np.split(gather(known.flat, known.at, rows), upto[ends][:-1]) if len(ends) else []
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return out


_encoders: dict[str, Encoder] = {}
CACHES.append(_encoders)


def encoder_of(path: str) -> Encoder:
    """This process's encoder: workers outlive tasks, and so do the words they know."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gather(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """flat[at[r] : at[r + 1]] for each r of rows, one after the other."""
    start = at[rows]
    size = at[rows + 1] - start
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def _pairs(seq: np.ndarray, free: np.ndarray, turn: int, bound: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, cells, representative of each cell, count of each cell, bound).

    Pairs are counted in cells of a hash table, which differs from turn to turn. A cell stands for one pair; another one
    that shares the cell waits for a later turn.
    """
    size, mix = 1 << COUNT_BITS, _MIX * (2 * turn + 1) % (1 << 64)
    places = np.flatnonzero(free[:-1])
    # a hash of 32 bits; what overflows is dropped
    left, right = np.uint32(mix >> 32 | 1), np.uint32(mix & 0xFFFFFFFF | 1)
    cell = ((seq[:-1] * left + (seq[1:] ^ (seq[1:] >> np.uint32(7))) * right) >> np.uint32(32 - COUNT_BITS))[places].astype(np.int64)  # as bincount takes them
    count = np.bincount(cell, minlength=size)
    bound = max(LEAST, int(count.max(initial=0)) // STEP) if bound is None else bound
    often = count >= bound
    full = np.flatnonzero(often[cell])
    places, cell = places[full], (np.cumsum(often) - 1)[cell[full]]  # from here on, cells are the frequent ones
    pair = (seq[places].astype(np.uint64) << np.uint64(32)) | seq[places + 1]
    count = count[often]
    stands = np.zeros(len(count), dtype=np.uint64)
    stands[cell] = pair
    same = stands[cell] == pair
    if not same.all():
        places, cell = places[same], cell[same]
        count = np.bincount(cell, minlength=len(count))
        full = np.flatnonzero((count >= bound)[cell])
        places, cell = places[full], cell[full]
    return places, cell, stands, count, bound


def _disjoint(places: np.ndarray, cell: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose pair is the most frequent one of those it overlaps with; of a run of one pair, every second place."""
    rank = np.zeros(len(count), dtype=np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(1, len(count) + 1)
    own, around = rank[cell], np.zeros(n + 2, dtype=np.int32)
    around[places + 1] = own
    top = np.flatnonzero((own >= around[places]) & (own >= around[places + 2]))
    places, cell = places[top], cell[top]
    run = np.r_[True, np.diff(places) > 1][: len(places)]
    if run.all():
        return places, cell
    first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
    second = np.flatnonzero((np.arange(len(places)) - first) % 2 == 0)
    return places[second], cell[second]


def repair(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules, sequence, last) of a grammar for ids; last marks the symbols that end a document."""
    seen = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
    seen[ids] = True
    terminals = np.flatnonzero(seen).astype(np.uint32)
    number = np.zeros(len(seen), dtype=np.uint32)
    number[terminals] = np.arange(len(terminals), dtype=np.uint32)
    seq, free = number[ids], ~last
    symbols, rules, bound, turn = len(terminals), [], None, 0
    bits = max(1, (symbols - 1).bit_length())
    noted: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # size in bits, passes, sequence and ends of documents

    def note() -> None:
        n = sum(map(len, rules))
        noted.append((bits * len(seq) + n * (2 * bits + 8), len(rules), seq.copy(), free.copy()))

    while len(seq) > 1:
        turn += 1
        places, cell, stands, count, bound = _pairs(seq, free, turn, bound)
        places, cell = _disjoint(places, cell, count, len(seq))
        used = np.bincount(cell, minlength=len(count))
        kept = np.flatnonzero(used >= LEAST)
        room = (1 << bits) - symbols
        if not room and len(kept):
            note()
            bits, room = bits + 1, symbols
        if len(kept) > room:  # the best that need no other bit
            kept = np.sort(kept[np.argsort(-used[kept], kind="stable")[:room]])
        number = np.zeros(len(count), dtype=np.uint32)
        number[kept] = np.arange(symbols, symbols + len(kept), dtype=np.uint32)
        new = number[cell]
        places, new = places[new > 0], new[new > 0]
        rules.append(stands[kept])
        symbols += len(kept)
        seq[places], free[places] = new, free[places + 1]
        stay = np.ones(len(seq), dtype=bool)
        stay[places + 1] = False
        seq, free = seq[stay], free[stay]
        if bound == LEAST and len(places) * WORTH < len(seq):
            break
        bound = max(LEAST, bound // STEP)
    note()
    _, n, seq, free = min(noted, key=lambda x: x[0])
    codes = np.concatenate(rules[:n]) if n else np.zeros(0, np.uint64)
    pairs = np.stack([codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
    return terminals, pairs, seq, ~free


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for. Rules are resolved in waves, as many as the grammar is deep."""
    size = np.zeros(len(rules), dtype=np.int64)
    open_ = np.arange(len(rules))
    while len(open_):
        part = rules[open_].astype(np.int64)
        known = np.where(part < terminals, 1, size[np.maximum(part - terminals, 0)])
        ok = (known > 0).all(axis=1)
        size[open_[ok]] = known[ok].sum(axis=1)
        open_ = open_[~ok]
    return size


def bit_width(values: np.ndarray) -> int:
    return max(1, int(values.max(initial=0)).bit_length())


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bits one after the other, filled up to whole bytes."""
    bits = np.unpackbits(np.ascontiguousarray(values, dtype=">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :].ravel()).tobytes()


def unpack_bits(data: memoryview, at: int, first: int, n: int, width: int) -> np.ndarray:
    """n numbers of `width` bits from number `first` on, of those that start at byte `at`."""
    begin, end = first * width, (first + n) * width
    bits = np.unpackbits(np.frombuffer(data[at + begin // 8 : at + -(-end // 8)], dtype=np.uint8))[begin % 8 : begin % 8 + n * width]
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, 32 - width :] = bits.reshape(n, width)
    return np.packbits(out, axis=1).view(">u4").ravel().astype(np.uint32)


def pack(terminals: np.ndarray, rules: np.ndarray, seq: np.ndarray) -> bytes:
    runs = [np.diff(terminals, prepend=np.uint32(0)), rules.ravel(), expansion_lengths(rules, len(terminals)), seq]
    width = [bit_width(r) for r in runs]
    head = struct.pack("<4s7I", MAGIC, len(terminals), len(rules), len(seq), *width)
    return head + b"".join(pack_bits(r, w) for r, w in zip(runs, width))


class Grammar:
    """A block's payload, opened for decoding. opened counts the rules that slice() has opened."""

    def __init__(self, payload: bytes) -> None:
        magic, terminals, n_rules, self.n, *width = struct.unpack_from("<4s7I", payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self.data, at, runs = memoryview(payload), 32, []
        for n, w in zip((terminals, 2 * n_rules, n_rules), width):
            runs.append(unpack_bits(self.data, at, 0, n, w))
            at += -(-n * w // 8)
        self.terminals = np.cumsum(runs[0], dtype=np.uint32)
        self.rules = runs[1].reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(terminals, dtype=np.int64), runs[2].astype(np.int64)])  # of all symbols
        self.at, self.width, self.opened = at, width[3], 0
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def symbols(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Symbols start to stop of the sequence, without reading others."""
        return unpack_bits(self.data, self.at, start, (self.n if stop is None else stop) - start, self.width)

    def expand(self) -> np.ndarray:
        """All ids, from a table of what each symbol stands for."""
        if self.table is None:
            t = len(self.terminals)
            flat = np.concatenate([self.terminals, self._ids(np.arange(t, t + len(self.rules), dtype=np.uint32))])
            self.table = flat, np.r_[0, np.cumsum(self.lengths)]
        return gather(*self.table, self.symbols().astype(np.int64))

    def _open(self, s: np.ndarray) -> np.ndarray:
        """Symbols with rules replaced by their two symbols."""
        rule = s >= len(self.terminals)
        width = 1 + rule.astype(np.int64)
        out = np.repeat(s, width)
        left = (np.cumsum(width) - width)[rule]
        pair = self.rules[s[rule] - len(self.terminals)]
        out[left], out[left + 1] = pair[:, 0], pair[:, 1]
        return out

    def _ids(self, s: np.ndarray) -> np.ndarray:
        while len(s) and int(s.max()) >= len(self.terminals):
            s = self._open(s)
        return self.terminals[s]

    def slice(self, first: int, after: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of what symbols first to after of the sequence stand for.

        Rules are opened level by level, and what lies outside is dropped before it is opened.
        """
        s = self.symbols(first, after)
        while True:
            end = np.cumsum(self.lengths[s])
            a, b = int(np.searchsorted(end, start, side="right")), int(np.searchsorted(end, stop, side="left")) + 1
            base = int(end[a - 1]) if a else 0
            s, start, stop = s[a:b], start - base, stop - base
            rules = int((s >= len(self.terminals)).sum())
            if not rules:
                return self.terminals[s[start:stop]]
            self.opened += rules
            s = self._open(s)


def _write_blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        block, before, held, doc_ids, ids = 0, 0, 0, [], []

        def done() -> pa.RecordBatch:
            size = np.array([len(i) for i in ids], dtype=np.int64)
            last = np.zeros(int(size.sum()), dtype=bool)
            last[np.cumsum(size) - 1] = True
            terminals, rules, seq, last = repair(np.concatenate(ids), last)
            starts = np.r_[0, np.flatnonzero(last)[:-1] + 1]
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "doc_ids": doc_ids, "n_tokens": size.tolist(), "starts": starts.tolist(), "payload": pack(terminals, rules, seq)}], schema=_arrow)

        for batch in batches:
            for rows in chunks(iter([batch])):
                ids_of = encoder.encode(rows.column(rows.schema.get_field_index("text")))
                for d, i in zip(rows.column(rows.schema.get_field_index("doc_id")).to_pylist(), ids_of):
                    doc_ids.append(d)
                    ids.append(np.append(i, np.uint32(end_id)).astype(np.uint32))
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield done()
                        block, before, held, doc_ids, ids = block + 1, before + held, 0, [], []
        if ids:
            yield done()

    return run


_arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("payload", pa.binary())])


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of the token ids of docs, in ascending doc_id order by (part, block)."""
    small_batches(docs.sparkSession)
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(_write_blocks(path, end_id), BLOCK_SCHEMA)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Grammar(row["payload"]).expand()
            size = np.array(row["n_tokens"], dtype=np.int64)
            at = np.cumsum(size) - size
            crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at + row["before"] + row["base"]), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from decoded blocks."""
    totals = blocks.groupBy("part").agg(F.max(F.col("before") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    base, rows = 0, []
    for part, n in sorted(totals.collect()):  # one row for each written part, not for each document or block
        rows.append((part, base))
        base += n
    bases = blocks.sparkSession.createDataFrame(rows, "part int, base long")
    return blocks.join(F.broadcast(bases), "part").select("before", "base", "doc_ids", "n_tokens", "payload").mapInArrow(_read_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def written(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The dataset of docs in its file format, written to the shared folder and opened again."""
    return materialize(encode(docs, path or tokenizer_path()), "tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(written(table(spark, sf_dir, "documents")))
