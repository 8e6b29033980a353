"""Mixing sources to target weights by fitting budgets over exact document lengths.

Every source has a budget of words. As many whole copies of the source as fit are taken; what is
left of the budget is a subset-sum problem over the source's documents. Its histogram by exact
length is all that the fit needs: a proportional share of each length is taken first, then a
bounded-knapsack dynamic programme over lengths spends what remains. It yields a count for each
(source, length), and a seeded hash decides which documents of that length these are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import WORD, free_names, written

#: Words that the dynamic programme spends at most: so many, or sixteen documents of a source's mean length up to MOST_SUMS.
KNAPSACK_WORDS, MOST_SUMS = 1 << 16, 1 << 24
#: Sums and steps (sums times pieces) up to which the documents of a source are searched as a whole if the share missed its target,
#: and sums that differ up to which they are searched whatever the sums are: of few documents, however long.
EXACT_SUMS, EXACT_STEPS, FEW_SUMS = 1 << 25, 1 << 32, 1 << 22
#: Copies of one row that a task makes at a time.
LOT = 1_000
#: Documents of one source and length that one hash range should hold.
RANGE_DOCUMENTS = 200


def budgets(sizes: dict, total: float, weights: tuple[float, ...] = (5, 2, 1), repeats: float = 2) -> dict:
    """The target of each source: shares of total by weight, stopped at ``repeats`` times the source's size.

    Sources go by code point, null last, and take the weights in turn. What a stopped source
    leaves is shared among the others by weight, until none is above its stop.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(total)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        stopped = [s for s in order if s in open_ and share * weight[s] > repeats * sizes[s]]
        if not stopped:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in stopped:
            target[s] = float(repeats * sizes[s])
            rest -= target[s]
            open_.remove(s)
    return target


def _pieces(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """(place, documents): each length's documents in lots of 1, 2, 4, ... and the rest, which add up to any count."""
    out = []
    for k, (length, left) in enumerate(zip(lengths.tolist(), counts.tolist())):
        lot = 1
        while length > 0 and left > 0:
            out.append((k, min(lot, left)))
            left -= lot
            lot *= 2
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many documents of each length to take so that the words sum up as near to goal as they can, below it on ties.

    Bounded knapsack with reachability by words: each sum keeps the lot of documents that first
    reached it, 5 bytes a sum however many lengths there are, and the choice is read back from these.
    """
    span = goal + min(goal, int(lengths.max(initial=0)))  # sums beyond the goal are candidates too
    reached, first = np.zeros(span + 1, bool), np.full(span + 1, -1, np.int32)
    reached[0] = True
    pieces = _pieces(lengths, counts)
    for p, (k, n) in enumerate(pieces):
        words = n * int(lengths[k])
        if words > span:
            continue
        new = reached[: span + 1 - words] & ~reached[words:]
        first[words:][new] = p
        reached[words:] |= new
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    taken, at = np.zeros(len(lengths), np.int64), int(sums[np.abs(sums - goal).argmin()])
    while at:
        k, n = pieces[first[at]]
        taken[k] += n
        at -= n * int(lengths[k])
    return taken


def few_long(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """knapsack() where two documents of any lengths left are beyond the goal: none, one, or the two shortest come nearest."""
    taken = np.zeros(len(lengths), np.int64)
    there = np.flatnonzero((counts > 0) & (lengths > 0))
    if not len(there):
        return taken
    by_length = there[np.argsort(lengths[there], kind="stable")]
    one = min(by_length.tolist(), key=lambda k: (abs(int(lengths[k]) - goal), int(lengths[k])))
    short = by_length[0]
    two = [short, short] if counts[short] > 1 else [short, by_length[1]] if len(by_length) > 1 else []
    options = [[], [one], two]
    best = min(options, key=lambda x: (abs(sum(int(lengths[k]) for k in x) - goal), sum(int(lengths[k]) for k in x)))
    for k in best:
        taken[k] += 1
    return taken


def sparse_knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int, most: int) -> np.ndarray | None:
    """knapsack() over the set of sums that differ, whatever their size; None if there are more than ``most`` of them over all pieces."""
    span = goal + min(goal, int(lengths.max(initial=0)))
    pieces, sums, held = _pieces(lengths, counts), [np.zeros(1, np.int64)], 1
    for k, n in pieces:
        now = sums[-1]
        more = now + n * int(lengths[k])
        sums.append(np.union1d(now, more[more <= span]))
        held += len(sums[-1])
        if held > most:
            return None
    last = sums[-1]
    taken, at = np.zeros(len(lengths), np.int64), int(last[np.abs(last - goal).argmin()])
    for (k, n), before in zip(reversed(pieces), reversed(sums[:-1])):
        if (place := np.searchsorted(before, at)) == len(before) or before[place] != at:  # not reached without this piece
            taken[k] += n
            at -= n * int(lengths[k])
    return taken


def fit_source(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole copies of all documents, and how many documents of each length are taken once more."""
    size = int((lengths * counts).sum())
    if size <= 0 or target <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    copies = int(target // size)
    budget = int(round(target)) - copies * size
    if budget <= 0:
        return copies, np.zeros(len(lengths), np.int64)
    goal = budget
    # A proportional share, short of the budget by about what the programme spends.
    cap = int(min(max(KNAPSACK_WORDS, 16 * size // int(counts.sum())), MOST_SUMS))  # room for some documents of this source
    spare = min(cap // 2, budget)
    share = np.floor(counts * ((budget - spare) / size)).astype(np.int64)
    budget -= int((share * lengths).sum())
    left = counts - share
    if budget > cap:  # rounding down has left more: take whole documents, the longest first
        for k in np.argsort(-lengths, kind="stable"):
            if 0 < lengths[k] and (n := min(int(left[k]), (budget - cap // 2) // int(lengths[k]))) > 0:
                share[k], left[k], budget = share[k] + n, left[k] - n, budget - n * int(lengths[k])
            if budget <= cap:
                break
    if budget > 0:
        order = np.argsort(-lengths, kind="stable")
        more = np.zeros(len(lengths), np.int64)
        # Above the cap every document left is longer than the budget less cap // 2, so two are beyond it.
        more[order] = (knapsack if budget <= cap else few_long)(lengths[order], left[order], budget)
        share += more
    if int((share * lengths).sum()) != goal:  # few documents, or long ones: others than those of the share may come nearer
        sums = goal + min(goal, int(lengths.max()))
        found = sparse_knapsack(lengths, counts, goal, FEW_SUMS)
        if found is None and sums <= EXACT_SUMS and sums * len(_pieces(lengths, counts)) <= EXACT_STEPS:
            found = knapsack(lengths, counts, goal)
        share = share if found is None else found
    return copies, share


def word_count(column: str = "text"):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, source, key, size, source_size, target and copies (0 to repeats) for every row of docs (doc_id, text, source).

    key identifies rows that are alike in these three columns. A null or wordless text has size 0
    and is taken as often as its whole source is. A null source is a source of its own. Repeated
    rows are documents of their own; ties of the seeded hash fall between rows that are alike.
    Reruns agree. An empty table gives none; other columns are ignored.

    Only the sources' sizes reach the driver (a row for each source). The fit of a source runs in
    one task over its histogram, a row for each distinct length.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text", "source")
    rows = written(docs.select("doc_id", "source", key.alias("key"), word_count().alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    histogram = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = {r["source"]: r["words"] for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    target = budgets(totals, total_share * sum(totals.values()), weights, repeats)
    schema = "source string, source_size long, target double"
    sources = spark.createDataFrame([(s, totals[s], target[s]) for s in totals], schema)
    ship_package(spark)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        copies, more = fit_source(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), float(group["target"].iloc[0]))
        out = group[["source", "size", "n", "source_size", "target"]].copy()
        out["copies"], out["more"] = copies, more
        return out

    same_source = F.col("h.source").eqNullSafe(F.col("s.source"))
    grouped = histogram.alias("h").join(F.broadcast(sources).alias("s"), same_source).select("h.source", "h.size", "h.n", "s.source_size", "s.target")
    fitted = written(
        grouped.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, copies int, more long"), "fit"
    )
    # Which documents of a length: those lowest by a seeded hash. Hash ranges are counted first, so that only in the range with the cut rows are ranked, and there rows that are alike count as one.
    draw = F.xxhash64("key", F.lit(seed)) / F.lit(2.0**64) + 0.5
    ranges = F.ceil(F.col("n") / RANGE_DOCUMENTS)
    joined = rows.alias("r").join(fitted.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.size") == F.col("f.size")))
    drawn = joined.select("r.doc_id", "r.source", "r.key", "r.size", "r.row", "f.n", "f.source_size", "f.target", "f.copies", "f.more", draw.alias("draw"))
    drawn = drawn.withColumn("range", F.floor(F.col("draw") * ranges).cast("long"))
    cut = F.col("more").between(F.lit(1), F.col("n") - 1)
    keys = written(drawn.where(cut).groupBy("source", "size", "range", "more", "draw", "key").agg(F.count("*").alias("alike")), "keys")
    before = lambda window: F.coalesce(F.sum("here").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = lambda wanted, window: F.least(F.col("here"), F.greatest(F.lit(0), F.col(wanted) - before(window)))
    counted = keys.groupBy("source", "size", "range", "more").agg(F.sum("alike").alias("here")).withColumn("take", take("more", Window.partitionBy("source", "size").orderBy("range")))
    counted = counted.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("range").alias("c_range"), "here", "take")
    on = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("range") == F.col("c_range"))
    placed = keys.join(counted, on)
    whole = placed.where("take = here or take = 0").withColumn("own", F.when(F.col("take") > 0, F.col("alike")).otherwise(F.lit(0).cast("long")))
    ranked = placed.where("take > 0 and take < here").withColumn("here", F.col("alike")).withColumn("own", take("take", Window.partitionBy("source", "size", "range").orderBy("draw", "key")))
    owned = whole.select("key", "size", "source", "alike", "own").unionByName(ranked.select("key", "size", "source", "alike", "own"))
    owned = owned.select(F.col("key").alias("o_key"), F.col("size").alias("o_size"), F.col("source").alias("o_source"), "alike", "own")
    dealt = drawn.where(cut).join(owned, (F.col("key") == F.col("o_key")) & (F.col("size") == F.col("o_size")) & F.col("source").eqNullSafe(F.col("o_source")))
    settled = dealt.where("own = 0 or own = alike").withColumn("extra", (F.col("own") > 0).cast("int"))
    # The rows of the one key that the cut goes through are alike: any of them are taken, lot by lot, so that no task has them all.
    lot = F.pmod(F.xxhash64("row"), F.ceil(F.sqrt("alike")))
    split = dealt.where("own > 0 and own < alike").withColumn("lot", lot)
    lots = split.groupBy("o_key", "o_size", "o_source", "lot", "own").agg(F.count("*").alias("here"))
    lots = lots.withColumn("of_lot", take("own", Window.partitionBy("o_key", "o_size", "o_source").orderBy("lot")))
    lots = lots.select(F.col("o_key").alias("l_key"), F.col("o_size").alias("l_size"), F.col("o_source").alias("l_source"), F.col("lot").alias("l_lot"), "of_lot")
    parted = split.join(lots, (F.col("key") == F.col("l_key")) & (F.col("size") == F.col("l_size")) & F.col("source").eqNullSafe(F.col("l_source")) & (F.col("lot") == F.col("l_lot")))
    parted = parted.withColumn("extra", (F.row_number().over(Window.partitionBy("key", "size", "source", "lot").orderBy("row")) <= F.col("of_lot")).cast("int"))
    simple = drawn.where(~cut).withColumn("extra", (F.col("more") >= F.col("n")).cast("int"))
    columns = ["doc_id", "source", "key", "size", "source_size", "target", (F.col("copies") + F.col("extra")).alias("copies")]
    return simple.select(*columns).unionByName(settled.select(*columns)).unionByName(parted.select(*columns))


def _orderable(docs: DataFrame) -> bool:
    return "map<" not in docs.schema.simpleString() and "variant" not in docs.schema.simpleString()


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as plan_mix takes it: never, once or repeatedly.

    Rows that are alike in doc_id, text and source are taken evenly; the copies that can't be dealt
    evenly are of the least of them (of any, where a column has no order). Nulls, empty texts and
    empty tables are as in plan_mix; all columns are kept.
    """
    plan = plan_mix(docs, **options)
    # Rows that are alike in these columns share a key, and as many copies of them are taken in all as the plan has.
    key, all_, rest, lots, row, repeat = free_names(docs, "_key", "_all", "_rest", "_lots", "_row", "_repeat")
    wanted = plan.groupBy("key").agg(F.sum("copies").alias(all_), F.count("*").alias(rest)).where(F.col(all_) > 0)
    wanted = wanted.select(F.col("key").alias(key), F.floor(F.col(all_) / F.col(rest)).alias(all_), (F.col(all_) % F.col(rest)).alias(rest))
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text", "source")).join(wanted, key)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(all_)))
    even = rows.where(F.col(all_) > 0).withColumn(repeat, again).select(*docs.columns)
    # What is left over goes to one row of each key, and is multiplied in lots that are dealt to all tasks.
    part = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = rows.where(F.col(rest) > 0).groupBy(key, rest).agg((F.min(part) if _orderable(docs) else F.first(part)).alias(row))
    few = one.where(F.col(rest) <= LOT).select(row, rest)
    many = one.where(F.col(rest) > LOT).withColumn(lots, F.explode(F.sequence(F.lit(0).cast("long"), F.col(rest) - 1, F.lit(LOT).cast("long"))))
    many = many.repartition(key, lots).select(row, F.least(F.lit(LOT).cast("long"), F.col(rest) - F.col(lots)).alias(rest))
    left = few.unionByName(many).withColumn(repeat, F.explode(F.sequence(F.lit(1).cast("long"), F.col(rest))))
    return even.unionByName(left.select(F.col(f"{row}.*")))


#: DuckDB SQL for sizes and targets: sources are stopped in the order of their stop by weight until the level of the rest is under the next one's.
TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS stop FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY stop / w, source NULLS LAST) AS k, (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS total,
    coalesce(sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM o
), level AS (
  SELECT arg_min((total - stopped) / open, k) AS x FROM r WHERE (total - stopped) / open <= stop / w
)
SELECT doc_id, d.source, size, source_size, round(least(stop, x * w), 3) AS target FROM d JOIN o ON o.source IS NOT DISTINCT FROM d.source, level
"""
