"""Tie policies beyond one split: a policy of one dataset laid over a base policy, and one policy for several seeds.

Rows are reduced once to the levels at which candidates differ; every candidate is judged on that
small table. An overlay changes the rows of its dataset only, so its metrics over all rows are those of the other datasets, which
are summed once, and its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schemas import PAIRWISE
from .policy import RESCUE_CONFIDENCES, RESCUE_MARGINS, RESCUE_TIES, _gold_at

# The candidates of an overlay, and what a dataset needs for one.
OVERLAY_TIES = (0.05, 0.08, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45)
OVERLAY_MARGINS = (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
OVERLAY_BASE_MARGINS = (None, 0.25, 0.50, 1.00)
OVERLAY_ROWS, OVERLAY_TIES_LEAST = 40, 8

def _p(k: int) -> Column:
    return F.get("probs", F.lit(k))


def _level(cuts, ok) -> Column:
    return reduce(lambda a, b: a + b, (ok(F.lit(c)).cast("int") for c in cuts), F.lit(0))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin and sums of rows (g, pred, bin, n, c): n, hits, c and for each label both, gold and said."""
    hit = F.when(F.col("pred") == F.col("g"), F.col("n")).otherwise(0)
    sums = [F.sum("n").alias("n"), F.sum(hit).alias("hits"), F.sum("c").alias("c")]
    for k in range(3):
        sums += [F.sum(F.when(F.col("g") == k, hit).otherwise(0)).alias(f"both{k}"), F.sum(F.when(F.col("g") == k, F.col("n")).otherwise(0)).alias(f"gold{k}"), F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0)).alias(f"said{k}")]
    return rows.groupBy(*keys, "bin").agg(*sums)


_FIELDS = ("n", "hits", "c", *(f"{a}{k}" for k in range(3) for a in ("both", "gold", "said")))


def _metrics(binned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, accuracy, macro_f1, ece and tie_recall (four places) of sums by bin; a bin may come in several rows."""
    one = binned.groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in _FIELDS))
    n = F.sum("n")
    total = one.groupBy(*keys).agg(n.alias("n"), (F.sum("hits") / n).alias("accuracy"), (F.sum(F.abs(F.col("hits") - F.col("c"))) / n).alias("ece"), *(F.sum(c).alias(c) for c in _FIELDS[3:]))
    f1 = F.array_compact(F.array(*(F.try_divide(2.0 * F.col(f"both{k}"), F.col(f"gold{k}") + F.col(f"said{k}")) for k in range(3))))
    macro = F.aggregate(f1, F.lit(0.0), lambda a, b: a + b) / F.size(f1)
    recall = F.try_divide(F.col("both2").cast("double"), F.col("gold2"))
    return total.select(*keys, "n", F.round("accuracy", 4).alias("accuracy"), F.round(macro, 4).alias("macro_f1"), F.round(F.round("ece", 9), 4).alias("ece"), F.round(recall, 4).alias("tie_recall"))


def overlay_tie_search(df: DataFrame, dataset: str = "dataset", rows: int = OVERLAY_ROWS, ties: int = OVERLAY_TIES_LEAST) -> DataFrame:
    """dataset, min_tie, max_margin, max_base_margin and the metrics over all rows of every overlay, for datasets with enough rows and gold ties.

    df has gold, predicted and confidence as a base policy left them, probs and, where it is to be
    used, base_margin. An overlay turns rows of its dataset into ties; rows of a null dataset have none.
    """
    margins = OVERLAY_BASE_MARGINS if "base_margin" in df.columns else (None,)
    finite = [c for c in margins if c is not None]
    base = F.array_position(F.array(*(F.lit(x) for x in PAIRWISE)), F.col("predicted")).cast("int") - 1
    tl, ml = _level(OVERLAY_TIES, lambda c: _p(2) >= c), _level(OVERLAY_MARGINS, lambda c: F.abs(_p(0) - _p(1)) > c)
    bl = _level(finite, lambda c: F.coalesce(F.col("base_margin") > c, F.lit(True))) if finite else F.lit(0)
    cells = df.select(F.col(dataset).alias("dataset"), _gold_at(PAIRWISE).alias("g"), base.alias("pred"), tl.alias("tl"), ml.alias("ml"), bl.alias("bl"), S.bin_of(F.col("confidence")).alias("bin"), S.bin_of(_p(2)).alias("tie_bin"), F.col("confidence").alias("c"), _p(2).alias("t"))
    cells = cells.groupBy("dataset", "g", "pred", "tl", "ml", "bl", "bin", "tie_bin").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    able = cells.groupBy("dataset").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") == 2, F.col("n")).otherwise(0)).alias("ties")).where((F.col("n") >= rows) & (F.col("ties") >= ties) & F.col("dataset").isNotNull()).select("dataset")
    grid = [(t, m, x, i, j, len(finite) if x is None else finite.index(x)) for i, t in enumerate(OVERLAY_TIES, 1) for j, m in enumerate(OVERLAY_MARGINS) for x in margins]
    grid_frame = F.broadcast(df.sparkSession.createDataFrame(grid, "min_tie double, max_margin double, max_base_margin double, i int, j int, k int"))
    met = cells.join(able, "dataset").crossJoin(grid_frame)  # a table of levels with a fixed list of candidates
    tied = (F.col("tl") >= F.col("i")) & (F.col("ml") <= F.col("j")) & (F.col("bl") <= F.col("k"))
    # All three from the columns as they were: one select, so that none sees another's new value.
    met = met.select("dataset", "min_tie", "max_margin", "max_base_margin", "g", "n", F.when(tied, 2).otherwise(F.col("pred")).alias("pred"), F.when(tied, F.col("tie_bin")).otherwise(F.col("bin")).alias("bin"), F.when(tied, F.col("t")).otherwise(F.col("c")).alias("c"))
    keys = ["dataset", "min_tie", "max_margin", "max_base_margin"]
    own = _sums(met, keys)
    # What the other datasets add: all less one's own, ten bins for each dataset.
    each = _sums(cells.select("dataset", "g", "pred", "bin", "n", "c"), ["dataset"])
    whole = each.groupBy("bin").agg(*(F.sum(c).alias(c) for c in _FIELDS))
    less = each.select("dataset", "bin", *((-F.col(c)).alias(c) for c in _FIELDS)).join(able, "dataset")
    rest = whole.crossJoin(able).select("dataset", "bin", *_FIELDS).unionByName(less)
    rest = rest.crossJoin(grid_frame).select(*keys, "bin", *_FIELDS)
    return _metrics(own.unionByName(rest), keys)


def best_overlay(search: DataFrame, macro_floor: float, accuracy_floor: float, ece_ceiling: float, baseline_tie: float) -> DataFrame:
    """The overlay within the floors and with a tie recall above the baseline that has the highest tie recall, then f1, accuracy, least ece, objective; no row without one."""
    recall = F.coalesce("tie_recall", F.lit(0.0))
    rows = search.withColumn("objective", F.round(F.col("macro_f1") + 0.20 * F.col("accuracy") + 0.30 * recall - 0.05 * F.col("ece"), 6))
    ok = (recall > baseline_tie) & (F.col("macro_f1") >= macro_floor) & (F.col("accuracy") >= accuracy_floor) & (F.col("ece") <= ece_ceiling)
    order = [F.desc(recall), F.desc("macro_f1"), F.desc("accuracy"), "ece", F.desc("objective"), "dataset", "min_tie", "max_margin", F.asc_nulls_first("max_base_margin")]
    return rows.where(ok).orderBy(*order).limit(1)


def rescued(df: DataFrame, min_tie: float, max_margin: float, max_confidence: float, dataset: str | None = None) -> DataFrame:
    """df with predicted, confidence, risk_score, correct and bin rewritten: confident in no answer, close, and likely enough a tie."""
    hit = (F.col("predicted") != "Tie") & (_p(2) >= min_tie) & (F.abs(_p(0) - _p(1)) <= max_margin) & (F.col("confidence") <= max_confidence)
    hit = F.coalesce(hit & (F.col("dataset") == dataset) if dataset is not None else hit, F.lit(False))
    out = df.withColumn("_hit", hit).withColumn("predicted", F.when(F.col("_hit"), "Tie").otherwise(F.col("predicted"))).withColumn("confidence", F.when(F.col("_hit"), _p(2)).otherwise(F.col("confidence"))).drop("_hit")
    return out.withColumn("risk_score", 1 - F.col("confidence")).withColumn("correct", F.col("gold") == F.col("predicted")).withColumn("bin", S.bin_of(F.col("confidence")))


def seed_policy_search(df: DataFrame, dataset: str | None = None, accuracy_floor: float = 0.0, f1_floor: float = 0.0, ece_ceiling: float = 1.0, recall_floor: float = 0.0, slack: float = 1e-9) -> DataFrame:
    """One rescue policy for all seeds: min_tie, max_margin, max_confidence, mean metrics of dev and test over the seeds, the worst dev accuracy of a seed, eligible and chosen.

    df has seed, split, gold, predicted, confidence and probs. Eligible are candidates whose dev
    means keep the floors (tie recall above recall_floor); chosen is the one of highest tie recall, then accuracy, least ece, f1. A missing tie recall is left out of a mean.
    """
    base = F.array_position(F.array(*(F.lit(x) for x in PAIRWISE)), F.col("predicted")).cast("int") - 1
    open_ = (F.col("predicted") != "Tie") & (F.col("dataset") == dataset if dataset is not None else F.lit(True))
    tl = F.when(open_, _level(RESCUE_TIES, lambda c: _p(2) >= c)).otherwise(0)
    cells = df.where(F.col("split").isin("dev", "test")).select(
        "seed", "split", _gold_at(PAIRWISE).alias("g"), base.alias("pred"), tl.alias("tl"), _level(RESCUE_MARGINS, lambda c: F.abs(_p(0) - _p(1)) > c).alias("ml"), _level(RESCUE_CONFIDENCES, lambda c: F.col("confidence") > c).alias("cl"),
        S.bin_of(F.col("confidence")).alias("bin"), S.bin_of(_p(2)).alias("tie_bin"), F.col("confidence").alias("c"), _p(2).alias("t"),
    )
    cells = cells.groupBy("seed", "split", "g", "pred", "tl", "ml", "cl", "bin", "tie_bin").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    grid = [(a, b, c, i, j, k) for i, a in enumerate(RESCUE_TIES, 1) for j, b in enumerate(RESCUE_MARGINS) for k, c in enumerate(RESCUE_CONFIDENCES)]
    met = cells.crossJoin(F.broadcast(df.sparkSession.createDataFrame(grid, "min_tie double, max_margin double, max_confidence double, i int, j int, k int")))
    tied = (F.col("tl") >= F.col("i")) & (F.col("ml") <= F.col("j")) & (F.col("cl") <= F.col("k"))
    policy = ["min_tie", "max_margin", "max_confidence"]
    met = met.select("seed", "split", *policy, "g", "n", F.when(tied, 2).otherwise(F.col("pred")).alias("pred"), F.when(tied, F.col("tie_bin")).otherwise(F.col("bin")).alias("bin"), F.when(tied, F.col("t")).otherwise(F.col("c")).alias("c"))
    seeds = _metrics(_sums(met, ["seed", "split", *policy]), ["seed", "split", *policy])
    names = ("accuracy", "macro_f1", "ece", "tie_recall")
    of = lambda split, c: F.when(F.col("split") == split, F.col(c))
    mean = [F.coalesce(F.avg(of(s, c)), F.lit(0.0)).alias(f"{s}_{c}") for s in ("dev", "test") for c in names]
    out = seeds.groupBy(*policy).agg(*mean, F.min(of("dev", "accuracy")).alias("worst_dev_accuracy"))
    eligible = (F.col("dev_accuracy") + slack >= accuracy_floor) & (F.col("dev_macro_f1") + slack >= f1_floor) & (F.col("dev_ece") <= ece_ceiling) & (F.col("dev_tie_recall") > recall_floor)
    out = out.withColumn("eligible", eligible)
    # Candidates are a fixed list, so the best of them is one value.
    nine = lambda c: F.round(c, 9)
    rank = F.struct(nine(F.col("dev_tie_recall")).alias("a"), nine(F.col("dev_accuracy")).alias("b"), nine(-F.col("dev_ece")).alias("c"), nine(F.col("dev_macro_f1")).alias("d"), (-F.col("min_tie")).alias("e"), (-F.col("max_margin")).alias("f"), (-F.col("max_confidence")).alias("g"))
    best = out.where("eligible").agg(F.max(rank).alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col("eligible") & (rank == F.col("best")), F.lit(False))).drop("best")
