"""Ranking, sampling, splitting and de-duplication as window expressions.

Orders are total: ties are settled by an id, so reruns agree. Global orders are avoided where a
count table will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored


def joined(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df.join(other, keys, how) for inner and left joins in which a null key meets a null key."""
    renamed = other.select(*(F.col(k).alias(f"_other_{k}") if k in keys else F.col(k) for k in other.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return df.join(renamed, on, how).drop(*(f"_other_{k}" for k in keys))


def hash_ranked(df: DataFrame, group: list[str], identity: str, rank: str = "rank", size: str = "group_size") -> DataFrame:
    """df with each row's rank in its group by the hash of identity (ties by identity), from 1, and the group's size.

    A group of n rows is counted in sqrt(n) ranges of the hash, the counts are added up over the ranges, and rows are ranked
    within their range: no task holds a group. identity tells rows apart; null is a group like others.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias(size))
    rows = joined(df, sizes, group).withColumn("_h", T.stable_sha1(identity))
    part = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = rows.withColumn("_range", F.floor(part * F.ceil(F.sqrt(size))).cast("long"))
    counts = rows.groupBy(*group, "_range").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_here")
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy("_h", identity))
    return joined(rows, counts, [*group, "_range"]).withColumn(rank, F.col("_before") + within).drop("_h", "_range", "_before")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in the given order, with their rank. Spark limits groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def risk_coverage(df: DataFrame, rates: tuple[float, ...] = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.75, 1.00)) -> DataFrame:
    """For each review rate: rows reviewed (highest risk first, ties by id; one at least), error capture (null without errors), accuracy of the rest (null without one) and the last risk reviewed.

    Rows are ranked by a two-level count instead of one global window: errors and rows are counted
    for each distinct risk, cumulated over that table, and only the risk value at each cut is
    ranked by id.
    """
    by_risk = df.groupBy("risk_score").agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("errors"))
    # Buckets of risk bound the window: cumulate inside a bucket, then over the buckets' totals.
    b = by_risk.withColumn("bucket", F.floor(F.col("risk_score") * 1000))
    totals = b.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("errors").alias("be"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", F.coalesce(F.sum("bn").over(later), F.lit(0)).alias("n0"), F.coalesce(F.sum("be").over(later), F.lit(0)).alias("e0"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("risk_score")).rowsBetween(Window.unboundedPreceding, -1)
    cum = b.join(F.broadcast(totals), "bucket")  # at most 1001 rows
    cum = cum.select("risk_score", "n", "errors", (F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), (F.col("e0") + F.coalesce(F.sum("errors").over(inside), F.lit(0))).alias("errors_before"))
    whole = df.agg(F.count("*").alias("total"), F.sum((~F.col("correct")).cast("long")).alias("all_errors"))
    cuts = whole.select("total", "all_errors", F.explode(F.array(*(F.lit(r) for r in rates))).alias("review_rate")).where("total > 0").withColumn("k", F.least(F.col("total"), F.greatest(F.lit(1), F.bround(F.col("review_rate") * F.col("total"), 0).cast("long"))))
    cuts = F.broadcast(cuts)  # a row for each rate
    at = cum.join(cuts, (F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("n")))
    ranked = df.join(F.broadcast(at.select("risk_score").distinct()), "risk_score").withColumn("r", F.row_number().over(Window.partitionBy("risk_score").orderBy("id")))
    part = at.join(ranked.select("risk_score", "r", "correct"), "risk_score").where(F.col("r") <= F.col("k") - F.col("before"))
    captured = part.groupBy("review_rate").agg(F.sum((~F.col("correct")).cast("long")).alias("extra"))
    out = at.join(captured, "review_rate", "left").withColumn("captured", F.col("errors_before") + F.coalesce("extra", F.lit(0)))
    kept = F.col("total") - F.col("k")
    return out.select(
        "review_rate",
        F.col("k").cast("long").alias("reviewed"),
        F.col("captured").cast("long").alias("errors_captured"),
        F.try_divide(F.col("captured").cast("double"), F.col("all_errors")).alias("error_capture"),
        F.when(kept > 0, (kept - (F.col("all_errors") - F.col("captured"))) / kept).alias("auto_accept_accuracy"),
        F.col("risk_score").alias("risk_threshold"),
    )


def deduplicate(df: DataFrame, keys: list[str], ordinal: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in the order of ordinal, and the removed rows with the one that stayed in ``kept_by``. Null is a key like others.

    The first ordinal of a key is aggregated before the shuffle, so a key that a third of the rows share costs one row a task.
    """
    first = df.groupBy(*keys).agg(F.min(ordinal).alias("kept_by"))
    marked = joined(df, first, keys)
    return marked.where(F.col(ordinal) == F.col("kept_by")).drop("kept_by"), marked.where(F.col(ordinal) > F.col("kept_by"))


def deduplicate_either(df: DataFrame, first: list, second: list, ordinal: str, names: tuple[str, str] = ("duplicate_id", "duplicate_content")) -> tuple[DataFrame, DataFrame]:
    """Rows that share neither key with an earlier row that stays, and the others with ``reasons`` (names of the keys that they share with one).

    first and second are lists of columns or names, ordinal tells rows apart and orders them; nulls are values like
    others. What one pass in order would do is done in rounds: a row stays if it is the first one open in both its groups, rows that
    share a key with it go, and the rest stay open. Firsts are aggregated before the shuffle, and every round settles at least the chains' heads.
    """
    part = lambda c: F.col(c) if isinstance(c, str) else c
    key = lambda parts: F.sha2(F.to_json(F.struct(*(F.coalesce(F.concat(F.lit("="), part(c).cast("string")), F.lit("-")).alias(f"k{i}") for i, c in enumerate(parts)))).cast("binary"), 256)
    rows = stored(df.select(F.col(ordinal).alias("o"), key(first).alias("a"), key(second).alias("b")), "rows")
    open_, stay = rows, None
    while True:
        heads = open_.join(open_.groupBy("a").agg(F.min("o").alias("x")), "a").join(open_.groupBy("b").agg(F.min("o").alias("y")), "b")
        new = stored(heads.where("o = x and o = y").select("o", "a", "b"), "kept")
        stay = new if stay is None else stay.unionByName(new)
        open_ = stored(open_.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti").select("o", "a", "b"), "open")
        if not open_.limit(1).count():
            break
    told = rows.join(stay.select("a", F.col("o").alias("by_a")), "a", "left").join(stay.select("b", F.col("o").alias("by_b")), "b", "left")
    early = lambda c: F.coalesce(F.col(c) < F.col("o"), F.lit(False))
    reasons = F.array_compact(F.array(*(F.when(early(c), n) for c, n in zip(("by_a", "by_b"), names))))
    told = told.select(F.col("o").alias("_o"), reasons.alias("reasons"))
    marked = df.join(told, F.col(ordinal) == F.col("_o")).drop("_o")
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def duplicate_counts(df: DataFrame, keys: dict[str, list]) -> DataFrame:
    """name, rows, distinct keys and duplicates of each set of key expressions."""
    out = None
    for name, columns in keys.items():
        counts = df.groupBy(*columns).agg(F.count("*").alias("c")).agg(F.lit(name).alias("name"), F.sum("c").alias("rows"), F.count("*").alias("distinct_keys"), F.sum(F.col("c") - 1).alias("duplicates"))
        out = counts if out is None else out.unionByName(counts)
    return out


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with how many and how often."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def hash_splits(df: DataFrame, parts: list, modulus: int = 100, train: int = 70, dev: int = 85) -> DataFrame:
    """Adds split by the SHA-1 of the given columns: no shuffle, the same on every run."""
    return df.withColumn("split", T.hash_split(T.stable_sha1(*parts), modulus, train, dev))


def group_splits(df: DataFrame, group: str, stratum: str, train: float = 0.70, dev: float = 0.15) -> DataFrame:
    """group, stratum and split: whole groups go to one split, in shares of each stratum's groups, by hash order.

    A group's stratum is its most frequent one, the lowest on ties.
    """
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("c"))
    dominant = counts.groupBy(group).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(stratum).alias("s"))).alias("m")).select(group, F.col("m.s").alias("stratum"))
    placed = hash_ranked(dominant, ["stratum"], group, "k", "n").withColumn("k", F.col("k") - 1)
    cut1, cut2 = F.floor(F.col("n") * train + 0.5), F.floor(F.col("n") * (train + dev) + 0.5)
    return placed.select(group, "stratum", F.when(F.col("k") < cut1, "train").when(F.col("k") < cut2, "dev").otherwise("test").alias("split"))


def largest_remainder(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """stratum, n, take: total shared among strata in proportion, the rest by the largest remainders (ties by name)."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over a row for each stratum
    exact = F.col("n") * F.lit(total) / F.sum("n").over(whole)
    shares = counts.withColumn("floor", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    rank = F.row_number().over(Window.orderBy(F.round(F.col("rest"), 9).desc(), F.col(stratum)))
    left = F.lit(total) - F.sum("floor").over(whole)
    return shares.select(stratum, "n", (F.col("floor") + (rank <= left).cast("long")).cast("long").alias("take"))


def stratified_draw(df: DataFrame, stratum: str, identity: str, total: int) -> DataFrame:
    """Exactly total rows (all if there are fewer), strata in proportion, within a stratum by the hash of the identity."""
    takes = F.broadcast(largest_remainder(df, stratum, total))  # a row for each stratum
    ranked = hash_ranked(df, [stratum], identity).drop("group_size")
    return joined(ranked, takes, [stratum]).where(F.col("rank") <= F.col("take")).drop("n", "take")


def round_robin(df: DataFrame, label: str, identity: str, n: int) -> DataFrame:
    """n rows, labels in turn, within a label by the hash of the identity."""
    w = Window.partitionBy(label).orderBy(T.stable_sha1(identity), identity)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", label).limit(n)


def best_and_worst(df: DataFrame, parent: str, score: str, ordinal: str, columns: list[str]) -> DataFrame:
    """For each parent with two rows or more: the columns of the highest and the lowest scored one (ties by the lowest ordinal)."""
    take = [F.col(c) for c in columns]
    best = F.max_by(F.struct(*take), F.struct(F.col(score), -F.col(ordinal))).alias("best")
    worst = F.min_by(F.struct(*take), F.struct(F.col(score), F.col(ordinal))).alias("worst")
    return df.groupBy(parent).agg(F.count("*").alias("replies"), best, worst).where("replies >= 2")
