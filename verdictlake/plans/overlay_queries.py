"""Registered queries of overlays and of policies over seeds; their twins judge every candidate on every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, overlays, policy
from .metric_queries import rounded
from .views import predictions, table, with_views

Q, SQL = {}, {}
BASE_TIE, BASE_MARGIN = 0.35, 0.20
_list = lambda v: "[" + ", ".join("NULL" if x is None else str(x) for x in v) + "]::DOUBLE[]"


def _metrics_sql(rows: str, keys: str) -> str:
    """Metrics at four places of rows (keys, gold, said, conf)."""
    counts = ", ".join(f"sum((gold = '{x}' AND said = '{x}')::INTEGER) AS b{k}, sum((gold = '{x}')::INTEGER) AS g{k}, sum((said = '{x}')::INTEGER) AS s{k}" for k, x in enumerate(("A>B", "B>A", "Tie")))
    sums = ", ".join(f"sum({a}{k}) AS {a}{k}" for k in range(3) for a in "bgs")
    f1 = " + ".join(f"coalesce(2.0 * b{k} / nullif(g{k} + s{k}, 0), 0)" for k in range(3))
    there = " + ".join(f"(g{k} + s{k} > 0)::INTEGER" for k in range(3))
    return f"""SELECT {keys}, n, round(hits / n, 4) AS accuracy, round(({f1}) / ({there}), 4) AS macro_f1, round(round(gap / n, 9), 4) AS ece, round(b2 / nullif(g2, 0), 4) AS tie_recall FROM (
  SELECT {keys}, sum(c)::BIGINT AS n, sum(hits) AS hits, sum(abs(hits - conf)) AS gap, {sums} FROM (
    SELECT {keys}, least(9, floor(conf * 10)) AS bin, count(*) AS c, sum((gold = said)::INTEGER) AS hits, sum(conf) AS conf, {counts} FROM ({rows}) GROUP BY {keys}, bin) GROUP BY {keys})"""


_KEYS = "dataset, min_tie, max_margin, max_base_margin"
_OVERLAY_SQL = _metrics_sql(
    f"""SELECT d.dataset, min_tie, max_margin, max_base_margin, p.gold, CASE WHEN tied THEN 'Tie' ELSE p.predicted END AS said, CASE WHEN tied THEN pt ELSE confidence END AS conf FROM (
  SELECT d.dataset, t AS min_tie, m AS max_margin, x AS max_base_margin, p.gold, p.predicted, p.pt, p.confidence,
    (pt >= {BASE_TIE} AND abs(pa - pb) <= {BASE_MARGIN}) OR (p.dataset = d.dataset AND pt >= t AND abs(pa - pb) <= m AND (x IS NULL OR base_margin <= x)) AS tied
  FROM pred p, (SELECT dataset FROM pred WHERE split = 'dev' GROUP BY dataset HAVING count(*) >= 40 AND count(*) FILTER (gold = 'Tie') >= 8) d,
    unnest({_list(overlays.OVERLAY_TIES)}) a(t), unnest({_list(overlays.OVERLAY_MARGINS)}) b(m), unnest({_list(overlays.OVERLAY_BASE_MARGINS)}) c(x) WHERE p.split = 'dev') AS p, LATERAL (SELECT p.dataset) AS d(dataset)""",
    _KEYS,
)
SQL["overlay_tie_search"] = with_views(_OVERLAY_SQL, "pred")
SQL["overlay_tie_best"] = with_views(
    f"""SELECT *, round(macro_f1 + 0.20 * accuracy + 0.30 * coalesce(tie_recall, 0) - 0.05 * ece, 6) AS objective FROM ({_OVERLAY_SQL})
WHERE tie_recall > 0.10 AND macro_f1 >= 0.40 AND accuracy >= 0.50 AND ece <= 0.50 ORDER BY tie_recall DESC, macro_f1 DESC, accuracy DESC, ece, objective DESC, dataset, min_tie, max_margin, max_base_margin NULLS FIRST LIMIT 1""",
    "pred",
)


def overlay_tie_search(spark, sf_dir) -> DataFrame:
    dev = predictions(spark, sf_dir).where("split = 'dev'")
    return overlays.overlay_tie_search(policy.apply_tie_policy(dev, BASE_TIE, BASE_MARGIN))


def overlay_tie_best(spark, sf_dir) -> DataFrame:
    return overlays.best_overlay(overlay_tie_search(spark, sf_dir), 0.40, 0.50, 0.50, 0.10)


def seeded_predictions(spark, sf_dir) -> DataFrame:
    """Three prediction sets of the same rows: weights of the three labels shift with the seed."""
    o = table(spark, sf_dir, "orders")
    status, key, cust = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")

    def of(seed: int) -> DataFrame:
        a = (1 + (cust + seed) % 7 + F.when(status == "O", 4).otherwise(0)).cast("double")
        b = (1 + (key + 2 * seed) % 5 + F.when(status == "F", 4).otherwise(0)).cast("double")
        t = (1 + (key + cust + seed) % 3 + F.when(status == "P", 2).otherwise(0)).cast("double")
        total = a + b + t
        split = F.when(key % 100 < 70, "train").when(key % 100 < 85, "dev").otherwise("test")
        gold = F.when(status == "O", "A>B").when(status == "F", "B>A").otherwise("Tie")
        return o.select(F.lit(seed).alias("seed"), key.alias("id"), split.alias("split"), gold.alias("gold"), F.array(a / total, b / total, t / total).alias("probs"))

    return metrics.with_derived(reduce(DataFrame.unionByName, map(of, range(3))))


_SEEDS = """SELECT *, CASE WHEN pa >= pb AND pa >= pt THEN 'A>B' WHEN pb >= pt THEN 'B>A' ELSE 'Tie' END AS predicted, greatest(pa, pb, pt) AS confidence FROM (
  SELECT seed, split, gold, wa / (wa + wb + wt) AS pa, wb / (wa + wb + wt) AS pb, wt / (wa + wb + wt) AS pt FROM (
    SELECT seed, CASE WHEN o_orderkey % 100 < 70 THEN 'train' WHEN o_orderkey % 100 < 85 THEN 'dev' ELSE 'test' END AS split, CASE o_orderstatus WHEN 'O' THEN 'A>B' WHEN 'F' THEN 'B>A' ELSE 'Tie' END AS gold,
      (1 + (o_custkey + seed) % 7 + CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 0 END)::DOUBLE AS wa, (1 + (o_orderkey + 2 * seed) % 5 + CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END)::DOUBLE AS wb,
      (1 + (o_orderkey + o_custkey + seed) % 3 + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END)::DOUBLE AS wt FROM orders, range(3) s(seed)))"""
_SEED_KEYS = "seed, split, min_tie, max_margin, max_confidence"
_SEED_SQL = _metrics_sql(
    f"""SELECT {_SEED_KEYS}, gold, CASE WHEN tied THEN 'Tie' ELSE predicted END AS said, CASE WHEN tied THEN pt ELSE confidence END AS conf FROM (
  SELECT *, predicted <> 'Tie' AND pt >= min_tie AND abs(pa - pb) <= max_margin AND confidence <= max_confidence AS tied
  FROM ({_SEEDS}), unnest({_list(policy.RESCUE_TIES)}) a(min_tie), unnest({_list(policy.RESCUE_MARGINS)}) b(max_margin), unnest({_list(policy.RESCUE_CONFIDENCES)}) c(max_confidence) WHERE split <> 'train')""",
    _SEED_KEYS,
)
_MEANS = ", ".join(f"coalesce(avg({c}) FILTER (split = '{s}'), 0) AS {s}_{c}" for s in ("dev", "test") for c in ("accuracy", "macro_f1", "ece", "tie_recall"))
SQL["seed_policy"] = f"""SELECT min_tie, max_margin, max_confidence, {', '.join(f'round({s}_{c}, 6) AS {s}_{c}' for s in ('dev', 'test') for c in ('accuracy', 'macro_f1', 'ece', 'tie_recall'))}, worst_dev_accuracy, eligible,
  eligible AND row_number() OVER (ORDER BY eligible DESC, round(dev_tie_recall, 9) DESC, round(dev_accuracy, 9) DESC, round(dev_ece, 9), round(dev_macro_f1, 9) DESC, min_tie, max_margin, max_confidence) = 1 AS chosen
FROM (SELECT *, dev_accuracy + 1e-9 >= 0.60 AND dev_macro_f1 + 1e-9 >= 0.40 AND dev_ece <= 0.30 AND dev_tie_recall > 0.05 AS eligible FROM (
  SELECT min_tie, max_margin, max_confidence, {_MEANS}, min(accuracy) FILTER (split = 'dev') AS worst_dev_accuracy FROM ({_SEED_SQL}) GROUP BY ALL))"""


def seed_policy(spark, sf_dir) -> DataFrame:
    return rounded(overlays.seed_policy_search(seeded_predictions(spark, sf_dir), accuracy_floor=0.60, f1_floor=0.40, ece_ceiling=0.30, recall_floor=0.05))


Q |= {"overlay_tie_search": overlay_tie_search, "overlay_tie_best": overlay_tie_best, "seed_policy": seed_policy}
