"""Closed frequent itemsets of baskets by cumulative intersection, and their rules.

Items are ranked by support, rarest first. Baskets, cut to frequent items, are merged when alike and
dealt to item-conditional shards: the shard of an item gets every basket that holds it, cut to the
items above it, so the commonest items have the smallest shards. A shard with more than ``shard_rows``
different cut baskets is split again by its next item, as often as needed; each shard first drops
items that are rare within it, so a split always ends. In a shard, baskets are intersected
one after the other with a prefix tree that holds all intersections so far and their weights;
items that the rest of the baskets cannot lift to the least support leave the tree.

What a shard finds is closed among the items above its prefix. The closed set that owns it has the
same support and differs by items below only, so the merge is an equi-join: every set hands out the
smaller sets that it would own, and those leave. No pairs of sets are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_batches
from .common import written

#: Different cut baskets that one task intersects.
SHARD_ROWS = 4096


class Intersections:
    """A prefix tree of all intersections of the baskets added so far; a node is [weight or 0, {item: node}]."""

    def __init__(self, least: int, remaining: dict[int, int]):
        self.least, self.remaining, self.root = least, remaining, [0, {}]
        self.size, self.pruned_at = 0, 256

    def add(self, basket: list[int], weight: int) -> None:
        """Every set of the tree meets the basket; a set's weight is the largest among those that meet in it, and the basket's."""
        for item in basket:
            self.remaining[item] -= weight
        met, items = [0, {}], set(basket)
        todo = [(self.root, met)]
        while todo:
            node, into = todo.pop()
            into[0] = max(into[0], node[0])
            for item, child in node[1].items():
                todo.append((child, into[1].setdefault(item, [0, {}]) if item in items else into))
        own = met
        for item in basket:
            own = own[1].setdefault(item, [0, {}])
        todo = [(met, self.root, own is met)]
        while todo:
            node, into, whole = todo.pop()
            if node[0] or whole:
                into[0] = max(into[0], node[0] + weight)
            for item, child in node[1].items():
                if item not in into[1]:
                    into[1][item] = [0, {}]
                    self.size += 1
                todo.append((child, into[1][item], child is own))
        if self.size >= self.pruned_at:
            self._prune()
            self.pruned_at = max(256, 2 * self.size)

    def _prune(self) -> None:
        """Sets lose items with which they can't reach the least support any more; what is left of them merges."""
        kept, todo, size = [0, {}], [], 0
        todo.append((self.root, kept))
        most = {}

        def heaviest(node) -> int:  # of a node and what is below it, without recursion
            stack = [(node, False)]
            while stack:
                x, seen = stack.pop()
                if seen:
                    most[id(x)] = max([x[0], *(most[id(c)] for c in x[1].values())])
                else:
                    stack.append((x, True))
                    stack.extend((c, False) for c in x[1].values())
            return most[id(node)]

        heaviest(self.root)
        while todo:
            node, into = todo.pop()
            into[0] = max(into[0], node[0])
            for item, child in node[1].items():
                if most[id(child)] + self.remaining[item] < self.least:
                    todo.append((child, into))
                else:
                    if item not in into[1]:
                        into[1][item] = [0, {}]
                        size += 1
                    todo.append((child, into[1][item]))
        self.root, self.size = kept, size

    def sets(self) -> Iterator[tuple[tuple[int, ...], int]]:
        todo = [((), self.root)]
        while todo:
            items, node = todo.pop()
            if node[0] >= self.least:
                yield items, node[0]
            todo.extend(((*items, item), child) for item, child in node[1].items())


def intersect(baskets: list[list[int]], weights: list[int], least: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets of weight least or more that are the intersection of all baskets that hold them; each basket ascends."""
    remaining: dict[int, int] = {}
    for basket, w in zip(baskets, weights):
        for item in basket:
            remaining[item] = remaining.get(item, 0) + w
    tree = Intersections(least, remaining)
    for k in sorted(range(len(baskets)), key=lambda k: (len(baskets[k]), baskets[k])):  # small baskets first keep the tree small
        tree.add(baskets[k], weights[k])
    return list(tree.sets())


def _mine(least: int):
    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, items, supports = [], [], []
            for prefix, baskets in zip(batch.column(0).to_pylist(), batch.column(1)):
                rests, weights = (baskets.values.field(k).to_pylist() for k in (0, 1))
                for own, weight in intersect(rests, weights, least):
                    prefixes.append(prefix)
                    items.append([*prefix, *own])
                    supports.append(weight)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(prefixes, lists), pa.array(items, lists), pa.array(supports, pa.int64())], names=["prefix", "items", "support"])

    return mined


def supports_of(sets: list[list[int]], supports: list[int], asked: list[list[int]]) -> list[int]:
    """The support of each asked set: the largest among sets that hold it, by an AND of the bits of its items over sets that descend."""
    supports = np.array(supports, np.int64)
    order = np.argsort(-supports, kind="stable")
    holders: dict[int, list[int]] = {}
    for k, at in enumerate(order.tolist()):
        for item in sets[at]:
            holders.setdefault(item, []).append(k)
    bits = {}
    for item, places in holders.items():
        row = np.zeros(len(sets), bool)
        row[places] = True
        bits[item] = np.packbits(row, bitorder="little")
    out = []
    for items in asked:
        both = np.bitwise_and.reduce([bits[i] for i in items])
        byte = int(np.flatnonzero(both)[0])
        low = int(both[byte])
        out.append(int(supports[order[byte * 8 + (low & -low).bit_length() - 1]]))
    return out


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked, a = [], []
        for sets, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            asked += wanted
            a += supports_of(*(sets.values.field(k).to_pylist() for k in (0, 1)), wanted)
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.list_(pa.int32())), pa.array(a, pa.int64())], names=["asked", "a"])


class Baskets:
    """What all steps share: distinct (basket, item), the number of baskets, ranked frequent items, merged baskets."""

    def __init__(self, lines: DataFrame, basket: str, item: str, least: int, per: int):
        pairs = lines.select(F.col(f"`{basket}`").alias("basket"), F.col(f"`{item}`").cast("long").alias("item")).where("basket is not null and item is not null")
        pairs = written(pairs.distinct(), "pairs")
        self.number = pairs.select("basket").distinct().count()
        self.least = max(least, -(-self.number // per), 1)
        frequent = pairs.groupBy("item").agg(F.count("*").alias("s")).where(F.col("s") >= self.least)
        # One row for each frequent item: at most per times the mean number of items of a basket, however many baskets there are.
        self.items = written(frequent.withColumn("rank", F.row_number().over(Window.orderBy("s", "item")).cast("int")), "items")
        cut = pairs.join(self.items.select("item", "rank"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("rank")).alias("rest"))
        self.merged = cut.groupBy("rest").agg(F.count("*").alias("weight"))


def _shards(baskets: Baskets, shard_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(prefix, items, support) found in whole shards; (items, support) of the prefixes of split ones; the number of splits."""
    now = written(baskets.merged.select(F.array().cast("array<int>").alias("prefix"), "rest", "weight"), "shards")
    leaves, prefixes, depth = None, None, 0
    while True:
        deal = now.select("*", F.explode("rest").alias("x")).select(
            F.concat("prefix", F.array("x")).alias("prefix"), F.filter("rest", lambda y: y > F.col("x")).alias("rest"), "weight", "x"
        )
        deal = written(deal.groupBy("prefix", "rest").agg(F.sum("weight").alias("weight")), "shards")
        depth += 1
        held = deal.groupBy("prefix").agg(F.sum("weight").alias("support")).where(F.col("support") >= baskets.least)
        often = deal.select("prefix", "weight", F.explode("rest").alias("x")).groupBy("prefix", "x").agg(F.sum("weight").alias("w")).where(F.col("w") >= baskets.least)
        often = often.groupBy("prefix").agg(F.collect_list("x").alias("often"))
        known = written(held.join(often, "prefix", "left").select("prefix", "support", F.coalesce("often", F.array().cast("array<int>")).alias("often")), "known")
        cut = deal.join(known, "prefix").select("prefix", F.array_intersect("rest", "often").alias("rest"), "weight")
        cut = written(cut.groupBy("prefix", "rest").agg(F.sum("weight").alias("weight")), "shards")
        sizes = written(cut.groupBy("prefix").agg(F.count("*").alias("n")), "sizes")
        large = sizes.where(F.col("n") > shard_rows).select("prefix")
        whole = cut.join(large, "prefix", "left_anti")
        leaves = whole if leaves is None else leaves.unionByName(whole)
        if not large.limit(1).count():
            break
        split = known.join(large, "prefix", "left_semi").select(F.col("prefix").alias("items"), "support")
        prefixes = split if prefixes is None else prefixes.unionByName(split)
        now = cut.join(large, "prefix", "left_semi")
    dealt = leaves.groupBy("prefix").agg(F.collect_list(F.struct("rest", "weight")).alias("baskets"))  # shard_rows of them at most
    found = written(map_batches(dealt, _mine(baskets.least), "prefix array<int>, items array<int>, support long"), "found")
    if prefixes is None:
        prefixes = found.where("false").select("items", "support")
    return found, written(prefixes, "prefixes"), depth


def closed_itemsets(lines: DataFrame, basket: str = "sale_id", item: str = "item_id", least: int = 8, per: int = 2000, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Closed itemsets with a support of at least ``least`` and of at least a basket in ``per``, with their rules.

    Columns: ids (array<long>, ascending), n_items, support, rules (array of (c, a, s) by ascending c), baskets.
    A rule says that the set without c (support a) is joined by c (support s); it is kept if
    100 * support >= 10 * a and support * baskets > a * s. Rows with a null basket or item are left
    out, repeated rows count once, other columns are ignored, an empty table gives no rows.
    """
    baskets = Baskets(lines, basket, item, least, per)
    found, prefixes, depth = _shards(baskets, shard_rows)
    sets = found.select("items", "support").unionByName(prefixes)
    owned = []
    for d in range(depth):  # a set owns what its first d items and its last ones make, if the support is the same
        ends = F.sequence(F.lit(d + 1), F.size("items"))
        tails = F.transform(ends, lambda e: F.concat(F.slice("items", 1, d), F.slice("items", e + 1, F.greatest(F.size("items") - e, F.lit(0)))))
        owned.append(F.when(F.size("items") > d, tails))
    owned = sets.select(F.explode(F.flatten(F.array_compact(F.array(*owned)))).alias("items"), "support")
    closed = written(sets.join(owned, ["items", "support"], "left_anti"), "closed")

    parts = closed.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("c"))
    parts = parts.withColumn("asked", F.array_remove("items", F.col("c")))
    asked = parts.select("asked").distinct()
    of_prefixes = asked.join(prefixes, asked["asked"] == prefixes["items"]).select("asked", F.col("support").alias("a"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("asked"))), lambda k: F.slice("asked", 1, k))
    sent = asked.select("asked", F.explode(heads).alias("prefix")).join(found.select("prefix").distinct(), "prefix")
    of_shards = found.groupBy("prefix").agg(F.collect_list(F.struct("items", "support")).alias("sets"))
    met = of_shards.join(sent.groupBy("prefix").agg(F.collect_list("asked").alias("asked")), "prefix").select("sets", "asked")
    answered = map_batches(met, _answer, "asked array<int>, a long")
    a = answered.unionByName(of_prefixes)
    ranks = baskets.items.select(F.col("rank").alias("c"), F.col("item").alias("id"), "s")
    rules = parts.join(a, "asked").join(ranks, "c")
    kept = (F.lit(100) * F.col("support") >= F.lit(10) * F.col("a")) & (F.col("support") * F.lit(baskets.number) > F.col("a") * F.col("s"))
    rules = rules.where(kept).groupBy("items").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("c"), "a", "s"))).alias("rules"))
    ids = closed.select("items", F.explode("items").alias("c")).join(ranks, "c").groupBy("items").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    none = F.array().cast("array<struct<c:long,a:long,s:long>>")
    return (
        closed.join(ids, "items").join(rules, "items", "left")
        .select("ids", F.size("ids").cast("long").alias("n_items"), "support", F.coalesce("rules", none).alias("rules"), F.lit(baskets.number).cast("long").alias("baskets"))
    )


def digest(sets: DataFrame) -> DataFrame:
    """items, n_items, support, n_rules, best_item, rules_sha256 of closed_itemsets."""
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    return sets.select(
        F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("items"),
        "n_items",
        "support",
        F.size("rules").cast("long").alias("n_rules"),
        best.alias("best_item"),
        F.sha2(text.cast("binary"), 256).alias("rules_sha256"),
    )


#: Level by level: occurrences of frequent sets, each lengthened by larger items of its basket while the longer set stays frequent.
ORACLE_SQL = """
WITH RECURSIVE pairs AS MATERIALIZED (
  SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag <> 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL
), b AS MATERIALIZED (SELECT count(DISTINCT sale_id) AS b FROM pairs), ones AS MATERIALIZED (
  SELECT item_id, count(*) AS s FROM pairs GROUP BY 1 HAVING count(*) >= 8 AND count(*) * 2000 >= (SELECT b FROM b)
), own AS MATERIALIZED (SELECT sale_id, item_id FROM pairs JOIN ones USING (item_id)
), occ AS (
  SELECT [item_id] AS items, sale_id FROM own
  UNION ALL
  SELECT items, sale_id FROM (
    SELECT list_append(o.items, p.item_id) AS items, o.sale_id, count(*) OVER (PARTITION BY list_append(o.items, p.item_id)) AS n
    FROM occ o JOIN own p ON p.sale_id = o.sale_id AND p.item_id > o.items[-1]
  ) WHERE n >= 8 AND n * 2000 >= (SELECT b FROM b)
), sets AS MATERIALIZED (SELECT items, count(*) AS support FROM occ GROUP BY 1
), less AS MATERIALIZED (
  SELECT s.items, s.support, c, list_filter(s.items, lambda x: x <> c) AS rest FROM sets s, unnest(s.items) AS u(c) WHERE len(s.items) > 1
), closed AS MATERIALIZED (
  SELECT items, support FROM sets WHERE NOT EXISTS (SELECT 1 FROM less l WHERE l.rest = sets.items AND l.support = sets.support)
), rules AS (
  SELECT l.items, l.c, a.support AS a, o.s FROM less l JOIN closed USING (items) JOIN sets a ON a.items = l.rest JOIN ones o ON o.item_id = l.c
  WHERE 100 * l.support >= 10 * a.support AND l.support * (SELECT b FROM b) > a.support * o.s
), told AS (
  SELECT items, count(*) AS n_rules, arg_min(c, {'a': a, 'c': c}) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS t FROM rules GROUP BY 1
)
SELECT array_to_string(c.items, ',') AS items, len(c.items)::BIGINT AS n_items, c.support, coalesce(n_rules, 0)::BIGINT AS n_rules, best_item, sha256(coalesce(t, '')) AS rules_sha256
FROM closed c LEFT JOIN told USING (items)
"""
