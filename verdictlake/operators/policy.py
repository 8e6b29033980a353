"""Decision policies chosen on a development split, from tables of counts.

Rows are reduced to one small table by a single aggregation, over the levels at which candidates
can differ; every candidate is then evaluated on that table. The cost of a grid doesn't grow with
the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schemas import PAIRWISE

# The candidates of each search.
TEMPERATURES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)
TIE_PROBABILITIES = (0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.22, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
AB_MARGINS = (0.02, 0.05, 0.08, 0.12, 0.16, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50, 0.75, 1.00)
BASE_MARGINS = (None, 0.05, 0.10, 0.25, 0.50, 1.00)
DATASET_TIE_PROBABILITIES = (0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30, 0.35)
DATASET_AB_MARGINS = (0.02, 0.05, 0.08, 0.12, 0.16, 0.20, 0.25, 0.30, 0.40, 0.50)
DATASET_ROWS, DATASET_TIES = 20, 3
REVIEW_ERROR_RECALL = 0.80


def _gold_at(labels) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("gold")).cast("int") - 1


def temperature_search(df: DataFrame, by: list[str] | None = None, candidates=TEMPERATURES, labels=PAIRWISE) -> DataFrame:
    """by, temperature, nll, ece, brier and objective = nll + ece + brier / 4 of every candidate; the least is the best."""
    by = by or []
    gold = _gold_at(labels)
    spread = df.select(*by, gold.alias("g"), "probs", F.explode(F.array(*(F.lit(t) for t in candidates))).alias("temperature"))
    scaled = spread.withColumn("p", S.temperature(F.col("probs"), F.col("temperature")))
    scaled = scaled.withColumn("conf", F.array_max("p")).withColumn("bin", S.bin_of(F.col("conf")))
    parts = scaled.groupBy(*by, "temperature", "bin").agg(
        F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum((S.argmax(F.col("p")) == F.col("g")).cast("long")).alias("hits"), F.sum(-F.ln(F.get("p", F.col("g")) + 1e-12)).alias("nll"), F.sum(S.brier(F.col("p"), F.col("g"))).alias("brier")
    )
    n = F.sum("n")
    out = parts.groupBy(*by, "temperature").agg((F.sum("nll") / n).alias("nll"), (F.sum(F.abs(F.col("hits") - F.col("conf"))) / n).alias("ece"), (F.sum("brier") / n).alias("brier"))
    return out.withColumn("objective", F.col("nll") + F.col("ece") + 0.25 * F.col("brier"))


def best_temperature(search: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The candidate with the least objective, the lowest temperature on ties."""
    best = F.min_by("temperature", F.struct("objective", "temperature")).alias("temperature")
    return search.groupBy(*by).agg(best, F.min("objective").alias("objective")) if by else search.agg(best, F.min("objective").alias("objective"))


def tie_policy_search(df: DataFrame, by: list[str] | None = None, tie_probabilities=TIE_PROBABILITIES, margins=AB_MARGINS, base_margins=BASE_MARGINS) -> DataFrame:
    """by, min_tie (null: no policy), max_margin, max_base_margin, n, gold_ties, accuracy, macro_f1, ece and tie_recall of every candidate.

    A candidate turns a row into a tie if its tie probability is at least min_tie, the two other
    probabilities differ by max_margin at most, and the column base_margin (where df has it) is
    max_base_margin at most (null: any). Rows are reduced to the levels of all three.
    """
    by = by or []
    has_base = "base_margin" in df.columns
    base_margins = tuple(base_margins) if has_base else (None,)
    finite = [c for c in base_margins if c is not None]
    p = [F.get("probs", F.lit(k)) for k in range(3)]
    level = lambda value, cuts, ok: reduce(lambda a, b: a + b, (ok(value, F.lit(c)).cast("int") for c in cuts), F.lit(0))
    tie_level = level(p[2], tie_probabilities, lambda v, c: v >= c)
    margin_level = level(F.abs(p[0] - p[1]), margins, lambda v, c: v > c)  # margins that are too small for the row
    base_level = level(F.col("base_margin"), finite, lambda v, c: v > c) if has_base else F.lit(0)
    base = S.argmax(F.col("probs"))
    conf = F.array_max("probs")
    cells = df.select(*by, _gold_at(PAIRWISE).alias("g"), base.alias("base"), tie_level.alias("tl"), margin_level.alias("ml"), base_level.alias("bl"), S.bin_of(conf).alias("base_bin"), S.bin_of(p[2]).alias("tie_bin"), conf.alias("conf"), p[2].alias("tie"))
    cells = cells.groupBy(*by, "g", "base", "tl", "ml", "bl", "base_bin", "tie_bin").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("tie").alias("tie"))
    grid = [(None, None, None, 0, 0, 0)]
    for i, t in enumerate(tie_probabilities, 1):
        for j, m in enumerate(margins):
            grid += [(t, m, x, i, j, len(finite) if x is None else finite.index(x)) for x in base_margins]
    grid_frame = df.sparkSession.createDataFrame(grid, "min_tie double, max_margin double, max_base_margin double, i int, j int, k int")
    met = cells.crossJoin(F.broadcast(grid_frame))  # a table of levels with a fixed list of candidates
    tied = F.col("min_tie").isNotNull() & (F.col("tl") >= F.col("i")) & (F.col("ml") <= F.col("j")) & (F.col("bl") <= F.col("k"))
    met = met.withColumn("pred", F.when(tied, 2).otherwise(F.col("base"))).withColumn("bin", F.when(tied, F.col("tie_bin")).otherwise(F.col("base_bin"))).withColumn("c", F.when(tied, F.col("tie")).otherwise(F.col("conf")))
    keys = [*by, "min_tie", "max_margin", "max_base_margin"]
    hit = F.when(F.col("pred") == F.col("g"), F.col("n")).otherwise(0)
    sums = [F.sum("n").alias("n"), F.sum(hit).alias("hits"), F.sum("c").alias("c")]
    for k in range(3):
        sums += [F.sum(F.when(F.col("g") == k, hit).otherwise(0)).alias(f"both{k}"), F.sum(F.when(F.col("g") == k, F.col("n")).otherwise(0)).alias(f"gold{k}"), F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0)).alias(f"pred{k}")]
    binned = met.groupBy(*keys, "bin").agg(*sums)
    n = F.sum("n")
    total = binned.groupBy(*keys).agg(n.alias("n"), (F.sum("hits") / n).alias("accuracy"), (F.sum(F.abs(F.col("hits") - F.col("c"))) / n).alias("ece"), *(F.sum(f"{a}{k}").alias(f"{a}{k}") for k in range(3) for a in ("both", "gold", "pred")))
    f1 = [F.when(F.col(f"gold{k}") + F.col(f"pred{k}") > 0, 2.0 * F.col(f"both{k}") / (F.col(f"gold{k}") + F.col(f"pred{k}"))) for k in range(3)]
    macro = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0.0)) for x in f1)) / reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in f1))
    recall = F.try_divide(F.col("both2").cast("double"), F.col("gold2"))
    # Metrics have four places, as everywhere in reports and in the comparisons that choose among candidates.
    out = total.select(*keys, "n", F.col("gold2").alias("gold_ties"), F.round("accuracy", 4).alias("accuracy"), F.round(macro, 4).alias("macro_f1"), F.round(F.round("ece", 9), 4).alias("ece"), F.round(recall, 4).alias("tie_recall"))
    return out


def tie_objective(recall_weight: float = 0.10) -> Column:
    recall = F.coalesce("tie_recall", F.lit(0.0))
    return F.round(F.col("macro_f1") + 0.25 * F.col("accuracy") + recall_weight * recall - 0.05 * F.col("ece"), 6)


def _chosen(search: DataFrame, by: list[str], f1_slack: float, accuracy_slack: float, ece_slack: float, recall_weight: float) -> DataFrame:
    """search with objective, ok (within the slacks of no policy, and a higher tie recall) and place (1: chosen)."""
    base = search.where("min_tie is null").select(*by, F.col("macro_f1").alias("f0"), F.col("accuracy").alias("a0"), F.col("ece").alias("e0"), F.coalesce("tie_recall", F.lit(0.0)).alias("t0"))
    rows = search.join(F.broadcast(base), by) if by else search.crossJoin(F.broadcast(base))  # a row, or one for each dataset
    recall = F.coalesce(F.col("tie_recall"), F.lit(0.0))
    slack = lambda x: F.round(x, 9)
    ok = F.col("min_tie").isNotNull() & (slack(F.col("macro_f1") - F.col("f0")) >= -f1_slack) & (slack(F.col("accuracy") - F.col("a0")) >= -accuracy_slack) & (slack(F.col("ece") - F.col("e0")) <= ece_slack) & (recall > F.col("t0"))
    rows = rows.withColumn("ok", ok).withColumn("objective", tie_objective(recall_weight))
    by_ok = lambda x: F.when(F.col("ok"), x)
    order = [F.desc("ok"), F.desc(by_ok(recall)), F.desc(by_ok(F.col("macro_f1"))), F.desc(by_ok(F.col("accuracy"))), F.asc(by_ok(F.col("ece"))), F.desc("objective"), F.asc_nulls_first("min_tie"), F.asc_nulls_first("max_margin"), F.asc_nulls_first("max_base_margin")]
    # The window holds the candidates of a search, a fixed number for each dataset.
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).drop("f0", "a0", "e0", "t0")


def best_tie_policy(search: DataFrame, f1_slack: float = 0.005, accuracy_slack: float = 0.010, ece_slack: float = 0.020) -> DataFrame:
    """Among candidates within the slacks of no policy: the highest tie recall above its own, then f1, accuracy, ece, objective; without one the best objective."""
    return _chosen(search, [], f1_slack, accuracy_slack, ece_slack, 0.10).where("place = 1").drop("ok", "place")


def dataset_tie_policies(df: DataFrame, dataset: str = "dataset", rows: int = DATASET_ROWS, ties: int = DATASET_TIES) -> DataFrame:
    """A policy for each dataset with enough rows and gold ties for which one raises tie recall within the slacks 0.010 (f1), 0.020 (accuracy) and 0.010 (ece)."""
    search = tie_policy_search(df, [dataset], DATASET_TIE_PROBABILITIES, DATASET_AB_MARGINS).where((F.col("n") >= rows) & (F.col("gold_ties") >= ties))
    return _chosen(search, [dataset], 0.010, 0.020, 0.010, 0.20).where("place = 1 and ok").drop("ok", "place")


def with_dataset_policies(df: DataFrame, policies: DataFrame, dataset: str = "dataset") -> DataFrame:
    """predicted, confidence, risk_score and correct rewritten by the policy of each row's dataset; datasets without one stay."""
    p = [F.get("probs", F.lit(k)) for k in range(3)]
    own = F.broadcast(policies.select(dataset, "min_tie", "max_margin", "max_base_margin"))  # a row for each dataset
    base = F.col("max_base_margin").isNull() | (F.col("base_margin") <= F.col("max_base_margin")) if "base_margin" in df.columns else F.lit(True)
    tied = F.coalesce((p[2] >= F.col("min_tie")) & (F.abs(p[0] - p[1]) <= F.col("max_margin")) & base, F.lit(False))
    out = df.join(own, dataset, "left").withColumn("_tied", tied)
    out = out.withColumn("predicted", F.when(F.col("_tied"), "Tie").otherwise(F.col("predicted"))).withColumn("confidence", F.when(F.col("_tied"), p[2]).otherwise(F.col("confidence")))
    return out.withColumn("risk_score", 1 - F.col("confidence")).withColumn("correct", F.col("gold") == F.col("predicted")).withColumn("bin", S.bin_of(F.col("confidence"))).select(*df.columns)


def apply_tie_policy(df: DataFrame, min_tie: float | None, max_margin: float | None) -> DataFrame:
    """predicted rewritten by a policy; confidence and risk_score follow the prediction."""
    if min_tie is None:
        return df
    p = [F.get("probs", F.lit(k)) for k in range(3)]
    tied = (p[2] >= min_tie) & (F.abs(p[0] - p[1]) <= max_margin)
    confidence = F.when(tied, p[2]).otherwise(F.col("confidence"))
    return df.withColumn("predicted", F.when(tied, "Tie").otherwise(F.col("predicted"))).withColumn("confidence", confidence).withColumn("risk_score", 1 - F.col("confidence"))


def review_threshold(df: DataFrame, recall: float = REVIEW_ERROR_RECALL) -> DataFrame:
    """One row: the risk threshold with the smallest review rate that reaches the recall of errors, and what it does.

    Counts for each distinct risk are cumulated from the highest on, first within and then across thousandths of risk.
    """
    counts = df.groupBy("risk_score").agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("e")).withColumn("bucket", F.floor(F.col("risk_score") * 1000))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("e").alias("be"))
    totals = totals.select("bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("be").over(above), F.lit(0)).alias("e0"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("risk_score"))
    cum = counts.join(F.broadcast(totals), "bucket").select("risk_score", (F.col("n0") + F.sum("n").over(inside)).alias("reviewed"), (F.col("e0") + F.sum("e").over(inside)).alias("captured"))
    whole = df.agg(F.count("*").alias("total"), F.sum((~F.col("correct")).cast("long")).alias("errors"))
    rows = cum.crossJoin(F.broadcast(whole))  # one row
    ok = rows.where((F.col("errors") > 0) & (F.col("captured") >= recall * F.col("errors")))
    return ok.agg(F.min_by(F.struct("risk_score", "reviewed", "captured", "total", "errors"), "reviewed").alias("b")).select(
        F.col("b.risk_score").alias("threshold"), F.col("b.reviewed").alias("reviewed"), (F.col("b.captured") / F.col("b.errors")).alias("error_recall"), (F.col("b.reviewed") / F.col("b.total")).alias("review_rate")
    )


def conformal(dev: DataFrame, test: DataFrame, alpha: float = 0.1, labels=PAIRWISE) -> DataFrame:
    """Split conformal sets of test rows by the quantile of 1 - p(gold) over dev: n, mean set size and coverage, one row."""
    gold = _gold_at(labels)
    scores = dev.select((1 - F.get("probs", gold)).alias("s"))
    n = scores.count()
    rank = min(n, -(-(n + 1) * (1 - alpha) // 1)) if n else 0
    q = scores.agg(F.expr(f"percentile_disc({max(1e-12, (rank - 0.5) / n) if n else 1.0}) within group (order by s)").alias("q"))
    sets = test.crossJoin(F.broadcast(q)).select(gold.alias("g"), F.transform("probs", lambda p: 1 - p).alias("s"), "q")  # one row
    size = F.greatest(F.lit(1), F.size(F.filter("s", lambda x: x <= F.col("q"))))
    return sets.agg(F.count("*").alias("n"), F.avg(size.cast("double")).alias("mean_set_size"), F.avg((F.get("s", F.col("g")) <= F.col("q")).cast("double")).alias("coverage"))


UNSUPPORTED_THRESHOLDS = tuple(round(0.10 + 0.05 * k, 2) for k in range(17))
RESCUE_TIES, RESCUE_MARGINS, RESCUE_CONFIDENCES = (0.20, 0.25, 0.30, 0.35, 0.40), (0.05, 0.10, 0.15, 0.20), (0.45, 0.50, 0.55, 0.60)


def binary_threshold_search(df: DataFrame, score: str, gold: str, thresholds=UNSUPPORTED_THRESHOLDS, by: list[str] | None = None) -> DataFrame:
    """by, threshold, n, accuracy and macro_f1 of calling a row positive from each threshold of a probability on.

    Rows are reduced to the number of thresholds that they reach.
    """
    by = by or []
    level = reduce(lambda a, b: a + b, ((F.col(score) >= t).cast("int") for t in thresholds))
    cells = df.groupBy(*by, F.col(gold).cast("int").alias("g"), level.alias("level")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(float(t), i) for i, t in enumerate(sorted(thresholds), 1)], "threshold double, i int")
    met = cells.crossJoin(F.broadcast(grid)).withColumn("p", (F.col("level") >= F.col("i")).cast("int"))  # a table of levels with a fixed list
    at = lambda g, p: F.sum(F.when((F.col("g") == g) & (F.col("p") == p), F.col("n")).otherwise(0))
    t = met.groupBy(*by, "threshold").agg(at(1, 1).alias("tp"), at(0, 1).alias("fp"), at(1, 0).alias("fn"), at(0, 0).alias("tn"))
    f = lambda a, b, c: F.coalesce(F.try_divide(2.0 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(c)), F.lit(0.0))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return t.select(*by, "threshold", n.alias("n"), ((F.col("tp") + F.col("tn")) / n).alias("accuracy"), ((f("tp", "fp", "fn") + f("tn", "fn", "fp")) / 2).alias("macro_f1"))


def tie_rescue_search(df: DataFrame, ties=RESCUE_TIES, margins=RESCUE_MARGINS, confidences=RESCUE_CONFIDENCES) -> DataFrame:
    """For each triple: rows turned into ties (tie probability and closeness as given, confidence at most), how many are ties, accuracy and tie recall after.

    Rows are reduced to their levels in the three lists.
    """
    p = [F.get("probs", F.lit(k)) for k in range(3)]
    count = lambda cuts, ok: reduce(lambda a, b: a + b, (ok(F.lit(c)).cast("int") for c in cuts))
    cells = df.where("predicted <> 'Tie'").groupBy(
        (F.col("gold") == "Tie").alias("tie"), "correct", count(ties, lambda c: p[2] >= c).alias("tl"), count(margins, lambda c: F.abs(p[0] - p[1]) > c).alias("ml"), count(confidences, lambda c: F.col("confidence") > c).alias("cl")
    ).agg(F.count("*").alias("n"))
    grid = [(float(a), float(b), float(c), i, j, k) for i, a in enumerate(ties, 1) for j, b in enumerate(margins) for k, c in enumerate(confidences)]
    frame = df.sparkSession.createDataFrame(grid, "min_tie double, max_margin double, max_confidence double, i int, j int, k int")
    whole = df.agg(F.count("*").alias("rows"), F.sum(F.col("correct").cast("long")).alias("hits"), F.sum((F.col("gold") == "Tie").cast("long")).alias("gold_ties"), F.sum(((F.col("gold") == "Tie") & F.col("correct")).cast("long")).alias("tie_hits"))
    hit = (F.col("tl") >= F.col("i")) & (F.col("ml") <= F.col("j")) & (F.col("cl") <= F.col("k"))
    met = frame.join(F.broadcast(cells.alias("c")), hit, "left")  # at most 2 x 2 x 6 x 5 x 5 rows of levels
    one = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = met.groupBy("min_tie", "max_margin", "max_confidence").agg(one(F.col("n").isNotNull()).alias("rescued"), one(F.col("tie")).alias("rescued_ties"), one(F.col("correct")).alias("lost"))
    out = sums.crossJoin(F.broadcast(whole))  # one row
    return out.select(
        "min_tie", "max_margin", "max_confidence", "rescued", "rescued_ties",
        ((F.col("hits") + F.col("rescued_ties") - F.col("lost")) / F.col("rows")).alias("accuracy"),
        F.try_divide((F.col("tie_hits") + F.col("rescued_ties")).cast("double"), F.col("gold_ties")).alias("tie_recall"),
    )
