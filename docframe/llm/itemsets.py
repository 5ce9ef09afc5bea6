"""Closed frequent itemsets of baskets, and the rules that take one item from them: a vertical tree search with diffsets.

Items stand in one order, rare ones first, and the sets that begin with an item are its prefix class. A class holds the
baskets of its first item, with what comes after it, and is searched by one task: each node keeps the difference to its
parent's tidset as bits, items whose tidsets are equal or contain the node's join the node, and an index by tidset hash drops
what a larger set with the same tidset subsumes. A second such index, over all classes, is an aggregate by support and two
hashes of the tidset. A class that is too large for a task is cut: its items are counted by Spark, and each (prefix, item)
is a class of its own, so no task holds a tidset that grows with the input.

Frequent items are at most least_share times the mean number of items in a basket, however large the input. Only they, and
the pairs of a cut class and its items, are broadcast, after a check of their number; more are joined by shuffle and salt.

Defined results: rows without basket or item don't count, a repeated item counts once in its basket, and a basket that only
has rare items counts as a basket. Ties of rules go to the smaller item. No baskets give no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove_since, small_batches, table, written

#: Entries (basket, item) of a class that one task holds, about.
MOST_ENTRIES = 2_000_000
#: A class of fewer baskets than this is never cut.
LEAST_CUT = 2_000
#: Rows of (prefix, item), of some tens of bytes each, that are broadcast at most.
MOST_BROADCAST = 100_000
#: Parts of a hot (prefix, item) where it is joined by shuffle.
SALT = 64

_ITEM = pa.struct([("n", pa.int64()), ("item", pa.int64())])
_FOUND = pa.schema([("items", pa.list_(_ITEM)), ("support", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("without", pa.list_(pa.int64()))])
_FOUND_DDL = "items array<struct<n:bigint,item:bigint>>, support long, h1 long, h2 long, without array<long>"


def with_known(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """lines (prefix, basket, item) whose (prefix, item) is in counts, with n and c."""
    known = counts.select("prefix", "item", "n", "c")
    if known.count() <= MOST_BROADCAST:
        return lines.join(F.broadcast(known), ["prefix", "item"])
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("basket"), F.lit(SALT)).cast("int")).join(salted, ["prefix", "item", "salt"]).drop("salt")


def counted(lines: DataFrame, least: int) -> DataFrame:
    """(prefix, item, n, c, h1, h2) for each (prefix, item) of at least `least` baskets: c of them, with two hashes of their set; n is the item's support among all."""
    found = lines.groupBy("prefix", "item").agg(
        F.max("n").alias("n"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("basket")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "basket")).alias("h2")
    )
    return found.where(F.col("c") >= least).withColumn("n", F.coalesce("n", "c"))


class _Class:
    """The search below one prefix and its last item."""

    def __init__(self, least: int, support: int, tids: list[np.ndarray], h: np.ndarray, size: int) -> None:
        self.least, self.support, self.missing = least, support, support - size
        self.h, self.size = h, size
        self.diff = np.stack([self._outside(t) for t in tids])
        self.index: dict[tuple[int, int, int], set[frozenset[int]]] = {}

    def _outside(self, tids: np.ndarray) -> np.ndarray:
        out = np.ones(self.size, bool)
        out[tids] = False
        return np.packbits(out)

    def _hash(self, bits: np.ndarray) -> tuple[int, int]:
        """Both hashes of the baskets whose bits are set, as one array."""
        own = np.unpackbits(bits, count=self.size).view(bool)
        return np.bitwise_xor.reduce(self.h[:, own], axis=1)

    def run(self) -> dict[tuple[int, int, int], set[frozenset[int]]]:
        """Sets of extensions by (support, hashes), none of them in another of the same tidset."""
        count = np.bitwise_count(self.diff).sum(axis=1, dtype=np.int64)
        order = np.argsort(count, kind="stable")[::-1]  # rare first
        whole = np.bitwise_xor.reduce(self.h, axis=1)
        nodes = [(frozenset([int(e)]), self.diff[e], int(self.size - count[e]), whole ^ self._hash(self.diff[e])) for e in order]
        always = frozenset(x for e, _, n, _ in nodes if n == self.support for x in e)
        self.grow(always, [x for x in nodes if x[2] != self.support])
        if always:
            self.keep(always, self.support, whole)
        return self.index

    def keep(self, items: frozenset[int], support: int, h: np.ndarray) -> None:
        same = self.index.setdefault((support, int(h[0]), int(h[1])), set())
        if not any(items <= s for s in same):
            same -= {s for s in same if s < items}
            same.add(items)

    def grow(self, prefix: frozenset[int], nodes: list[tuple[frozenset[int], np.ndarray, int, np.ndarray]]) -> None:
        """nodes: extensions of one parent with their diffsets to it, in ascending order of support."""
        gone = set()
        for i, (own, diff, support, h) in enumerate(nodes):
            if i in gone:
                continue
            items, rest = prefix | own, [j for j in range(i + 1, len(nodes)) if j not in gone]
            below = []
            if rest:
                less = np.stack([nodes[j][1] for j in rest]) & ~diff
                counts = np.bitwise_count(less).sum(axis=1, dtype=np.int64)
                for j, bits, lost in zip(rest, less, counts.tolist(), strict=True):
                    if lost == 0:  # the other's tidset holds this one
                        items |= nodes[j][0]
                        if nodes[j][2] == support:
                            gone.add(j)
                    elif support - lost >= self.least:
                        below.append((nodes[j][0], bits, support - lost, h ^ self._hash(bits)))
            if below:
                self.grow(items, sorted(below, key=lambda x: x[2]))
            self.keep(items, support, h)

    def without(self, items: list[int]) -> list[int]:
        """For each item the support of the others with the class's prefix and last item, from diffsets to it."""
        if len(items) == 1:
            return [self.support]
        left = [np.zeros_like(self.diff[0])]
        for e in items[:-1]:
            left.append(left[-1] | self.diff[e])
        out, right = [], np.zeros_like(self.diff[0])
        for k in range(len(items) - 1, -1, -1):
            out.append(self.size - int(np.bitwise_count(left[k] | right).sum(dtype=np.int64)))
            right = right | self.diff[items[k]]
        return out[::-1]


def searched(least: int) -> Callable[[pa.Table], pa.Table]:
    """A function from the baskets of one cell, its classes' rows, to the sets that are closed inside their class."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        prefix, number = cell["prefix"][0].as_py(), cell["cell"][0].as_py()
        lists = cell["items"].chunk(0)
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        n, item, c, own = (flat.field(k).to_numpy() for k in range(4))
        h = np.stack([cell["h1"].to_numpy(), cell["h2"].to_numpy()])
        order = np.lexsort((item, n))
        new = np.ones(len(order), bool)
        new[1:] = (item[order][1:] != item[order][:-1]) | (n[order][1:] != n[order][:-1])
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1  # numbers the items in their order
        first = order[new]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        starts = np.append(np.flatnonzero(new), len(order))
        out: dict[str, list] = {f: [] for f in _FOUND.names}
        for k in np.flatnonzero(own[first] == number).tolist():
            at = order[starts[k] : starts[k + 1]]
            at = at[at + 1 < ends[row[at] + 1]]  # places of the class's item with something after it
            if len(at) < least:
                continue
            length = ends[row[at] + 1] - at - 1
            tail = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(at + 1, length)
            tid, e = np.repeat(np.arange(len(at)), length), code[tail]
            by = np.argsort(e, kind="stable")
            kinds, begin, many = np.unique(e[by], return_index=True, return_counts=True)
            often = many >= least
            if not often.any():
                continue
            kinds, tids = kinds[often].tolist(), [tid[by[b : b + m]] for b, m in zip(begin[often], many[often], strict=True)]
            node = _Class(least, int(c[first[k]]), tids, h[:, row[at]], len(at))
            named = [{"n": int(n[first[x]]), "item": int(item[first[x]])} for x in [k, *kinds]]
            for (support, h1, h2), sets in node.run().items():
                for found in sets:
                    items = sorted(found)  # kinds are in the items' order
                    out["items"].append([*prefix, named[0], *[named[1 + x] for x in items]])
                    out["support"].append(support)
                    out["h1"].append(h1)
                    out["h2"].append(h2)
                    out["without"].append([None] * (len(prefix) + 1) + node.without(items))
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in _FOUND}, schema=_FOUND)

    return run


def _cells(rows: DataFrame, cut: float, cells: int) -> DataFrame:
    """A row for each basket and each cell in which it has a class: its items from the first of them on."""
    number = lambda x: F.when(x["c"] > cut, F.lit(-1)).otherwise(F.pmod(F.xxhash64(x["item"]), F.lit(cells)).cast("int"))
    dealt = rows.withColumn("items", F.transform("items", lambda x: F.struct(x["n"].alias("n"), x["item"].alias("item"), x["c"].alias("c"), number(x).alias("cell"))))
    numbers = F.transform(F.slice("items", 1, F.size("items") - 1), lambda x: x["cell"])
    met = dealt.withColumn("numbers", numbers).withColumn("cell", F.explode(F.filter(F.array_distinct("numbers"), lambda k: k >= 0)))
    h = [F.xxhash64("basket").alias("h1"), F.xxhash64(F.lit("second"), "basket").alias("h2")]
    return met.select("prefix", "cell", *h, F.expr("slice(items, cast(array_position(numbers, cell) AS int), size(items))").alias("items"))


def _cut(rows: DataFrame, cut: float) -> DataFrame:
    """Lines (prefix, basket, item, n) of the classes of more than `cut` baskets, one item longer than before."""
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("items") - 2), lambda k: F.get(F.col("items"), k)["c"] > cut))
    classes = rows.withColumn("at", at).withColumn("own", F.get(F.col("items"), F.col("at")))
    longer = F.concat("prefix", F.array(F.struct(F.col("own.n").alias("n"), F.col("own.item").alias("item"))))
    return classes.select(longer.alias("prefix"), "basket", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("x")).select("prefix", "basket", "x.item", "x.n")


def candidates(lines: DataFrame, least: int, most_entries: int = MOST_ENTRIES, least_cut: int = LEAST_CUT) -> tuple[DataFrame, DataFrame]:
    """Sets that are closed inside their class, all frequent (prefix, item) among them; and the baskets (basket, items) of two frequent items or more.

    lines: (prefix, basket, item, n), all distinct, with an empty prefix and n null. items are (n, item) in ascending order.
    """
    spark, parts, found, baskets = lines.sparkSession, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), [], None
    small_batches(spark)
    while True:
        counts = materialize(counted(lines, least), "counts")
        nothing = F.transform(F.concat("prefix", F.array(F.struct("n", "item"))), lambda _: F.lit(None).cast("long"))
        found.append(counts.select(F.concat("prefix", F.array(F.struct("n", "item"))).alias("items"), F.col("c").alias("support"), "h1", "h2", nothing.alias("without")))
        grouped = with_known(lines.drop("n"), counts).groupBy("prefix", "basket").agg(F.sort_array(F.collect_list(F.struct("n", "item", "c"))).alias("items"))
        rows = materialize(grouped.where("size(items) > 1"), "baskets")
        baskets = rows if baskets is None else baskets
        m = F.size("items").cast("double")
        entries, squares = rows.agg(F.sum(m), F.sum(m * m)).first()
        if not entries:
            break
        # a class is cut if its baskets, of the mean length that an item meets, are too many entries, or above an even share of a task
        cut = max(float(least_cut), min(most_entries * entries / squares, entries / parts))
        classes = counts.select("prefix").distinct().count()
        cells = math.ceil(max(2 * squares / most_entries, min(4 * parts, entries / least_cut), 1) / classes)
        found.append(materialize(_cells(rows, cut, cells).groupBy("prefix", "cell").applyInArrow(searched(least), _FOUND_DDL), "found"))
        if counts.where(F.col("c") > cut).isEmpty():
            break
        lines = materialize(_cut(rows, cut), "lines")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, baskets


def closed(found: DataFrame) -> DataFrame:
    """(items, support, without) of the sets that no larger set with the same tidset subsumes."""
    best = found.groupBy("support", "h1", "h2").agg(F.max_by(F.struct("items", "without"), F.size("items")).alias("x"))
    return best.select("x.items", "support", "x.without")


def _supports(wanted: DataFrame, baskets: DataFrame) -> DataFrame:
    """(rest, a): how many baskets hold all items of rest, a distinct list of two frequent items or more; by the baskets of its rarest item."""
    ids = lambda c: F.transform(c, lambda x: x["item"])
    # parts of a hot item stay apart: baskets are dealt by basket, and wanted sets are met there by an item and a salt
    lines = baskets.select("basket", ids("items").alias("ids"), F.explode(ids("items")).alias("item"), F.pmod(F.xxhash64("basket"), F.lit(SALT)).cast("int").alias("salt"))
    asked = wanted.select("rest", F.col("rest")[0]["item"].alias("item"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return lines.join(asked, ["item", "salt"]).where(F.size(F.array_except(ids("rest"), "ids")) == 0).groupBy("rest").agg(F.count("*").alias("a"))


def _one_less(sets: DataFrame) -> DataFrame:
    """A row for each item of each set: c, its support s, the rest, and a, the support of the rest where its class knew it."""
    each = sets.select("items", "support", F.posexplode("items").alias("k", "x"), "without")
    rest = F.filter("items", lambda y: y["item"] != F.col("x.item"))
    each = each.select("items", "support", F.col("x.item").alias("c"), F.col("x.n").alias("s"), rest.alias("rest"), F.get(F.col("without"), F.col("k")).alias("a"))
    return each.withColumn("a", F.when(F.size("rest") == 1, F.col("rest")[0]["n"]).otherwise(F.col("a")))


def rules(sets: DataFrame, found: DataFrame, baskets: DataFrame, total: int, confidence: int = 30) -> DataFrame:
    """(items, support, rules): rules (c, a, s) of each set, by ascending c, for which 100*support >= confidence*a and support*total > a*s."""
    each = materialize(_one_less(sets), "each")
    asked = each.where("a is null and size(rest) > 1").select("rest").distinct()
    known = asked.join(found.select(F.col("items").alias("rest"), F.col("support").alias("a")), "rest", "left")
    known = materialize(known, "known")
    unknown = known.where("a is null").select("rest")
    answers = known.where("a is not null")
    if not unknown.isEmpty():  # not closed inside their class
        answers = answers.unionByName(_supports(unknown, baskets))
    each = each.join(answers.withColumnRenamed("a", "b"), "rest", "left").withColumn("a", F.coalesce("a", "b"))
    holds = (F.size("rest") > 0) & (100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * total > F.col("a") * F.col("s"))
    return each.groupBy("items", "support").agg(F.sort_array(F.collect_list(F.when(holds, F.struct("c", "a", "s")))).alias("rules"))


def closed_itemsets(rows: DataFrame, basket: str, item: str, least: int = 12, least_share: int = 10_000, most_entries: int = MOST_ENTRIES, least_cut: int = LEAST_CUT) -> DataFrame:
    """(items array<long> ascending, support, rules array<(c, a, s)>): sets in `least` baskets or more, and in one of least_share at least."""
    given = rows.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item")).where("basket is not null and item is not null")
    total = given.select("basket").distinct().count()
    least = max(least, -(-total // least_share))
    # rows of an item are as many as its baskets at least, so this leaves no frequent item out
    often = given.groupBy("item").count().where(F.col("count") >= least).select("item")
    empty = F.array().cast("array<struct<n:bigint,item:bigint>>")
    few = given.join(F.broadcast(often) if often.count() <= MOST_BROADCAST else often, "item", "left_semi").distinct()
    lines = materialize(few.select(empty.alias("prefix"), "basket", "item", F.lit(None).cast("long").alias("n")), "lines")
    found, baskets = candidates(lines, least, most_entries, least_cut)
    found = materialize(found, "candidates")
    result = rules(materialize(closed(found), "closed"), found, baskets, total)
    return result.select(F.array_sort(F.transform("items", lambda x: x["item"])).alias("items"), "support", "rules")


def digest(sets: DataFrame) -> DataFrame:
    """The contract's columns: items as text, how many items and rules, the best rule's item, and a hash of the rules."""
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    joined: Column = F.array_join(F.col("items").cast("array<string>"), ",")
    return sets.select(joined.alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(text, 256).alias("rules_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "sale_lines").where("flag is null or flag <> 'returned'")
    begun = len(written())
    out = materialize(digest(closed_itemsets(kept, "sale_id", "item_id")), "itemsets")
    remove_since(spark, begun, keep=1)
    return out


#: All frequent sets by a recursive join of pairs, then those that no larger one of the same baskets holds.
SQL = """
WITH RECURSIVE lines AS (
  SELECT DISTINCT sale_id, item_id FROM sale_lines
  WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
b AS (SELECT count(DISTINCT sale_id) AS total FROM lines),
ones AS (
  SELECT item_id, list(sale_id ORDER BY sale_id) AS tids FROM lines GROUP BY item_id
  HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT total FROM b)),
often AS (SELECT l.sale_id, l.item_id FROM lines l JOIN ones o ON l.item_id = o.item_id),
pairs AS (
  SELECT x.item_id AS i, y.item_id AS j FROM often x JOIN often y ON x.sale_id = y.sale_id AND x.item_id < y.item_id
  GROUP BY ALL HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT total FROM b)),
sets AS (
  SELECT [item_id] AS items, tids FROM ones
  UNION ALL
  SELECT list_append(s.items, p.j), list_sort(list_intersect(s.tids, o.tids)) FROM sets s
  JOIN pairs p ON p.i = s.items[-1] JOIN ones o ON o.item_id = p.j
  WHERE len(list_intersect(s.tids, o.tids)) >= 12 AND len(list_intersect(s.tids, o.tids)) * 10000 >= (SELECT total FROM b)),
marked AS (SELECT items, tids, len(tids) AS support, max(len(items)) OVER (PARTITION BY tids) AS most FROM sets),
closed AS (SELECT items, support FROM marked WHERE len(items) = most),
each AS (SELECT items, support, unnest(items) AS c FROM closed WHERE len(items) > 1),
known AS (
  SELECT e.items, e.c, r.support AS a, o.support AS s FROM each e
  JOIN marked r ON r.items = list_filter(e.items, lambda x: x <> e.c) JOIN marked o ON o.items = [e.c]
  WHERE 100 * e.support >= 30 * r.support AND e.support * (SELECT total FROM b) > r.support * o.support),
rules AS (
  SELECT items, count(*) AS n, arg_min(c, (a, c)) AS best, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS text
  FROM known GROUP BY items)
SELECT array_to_string(c.items, ',') AS items, len(c.items) AS n_items, c.support, coalesce(r.n, 0) AS n_rules, r.best AS best_item,
  sha256(coalesce(r.text, '')) AS rules_sha256
FROM closed c LEFT JOIN rules r ON r.items = c.items
"""
