"""Registered queries that fit: heads over all predictions, and the calibration methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, heads, metrics
from .metric_queries import rounded
from .views import predictions, with_views

Q, SQL = {}, {}
DATASETS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, "pred")
        return f

    return register


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a base judge as features: its three probabilities, its margin, the dataset."""
    p = predictions(spark, sf_dir).select("id", "dataset", "split", "gold", "probs", "base_margin")
    own = [F.get("probs", F.lit(k)) for k in range(3)] + [F.col("base_margin")] + [(F.col("dataset") == d).cast("double") for d in DATASETS]
    return p.select("id", "dataset", "split", "gold", "base_margin", F.array(*own).alias("x"))


@query("head_training")
def head_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 96 settings of the pairwise head with their metrics on dev, and which one was taken."""
    return heads.train(features(spark, sf_dir))[1]


@query("head_scores")
def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by split of a head of eight settings after calibration, tie policy and review threshold."""
    frame = features(spark, sf_dir)
    head, _ = heads.train(frame, settings=[s for s in heads.grid() if s.batch == 64 and s.epochs == 80 and s.learning_rate >= 0.04])
    done = head.apply(frame)
    flags = done.groupBy("split").agg(F.avg(F.col("review_flag").cast("double")).alias("review_rate"), F.avg("final_score").alias("mean_score"))
    return rounded(metrics.metric_bundle(done, ["split"]).join(flags, "split"))


_DEV = """, dev AS MATERIALIZED (
  SELECT k, [pa, pb, pt][k + 1] AS p, (gold = ['A>B', 'B>A', 'Tie'][k + 1])::INTEGER AS y FROM pred, range(3) t(k) WHERE split = 'dev'
)"""


@query(
    "platt_fit",
    _DEV
    + """, moved AS (
  SELECT 0 AS r, k, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, false AS done FROM range(3) t(k)
  UNION ALL
  SELECT r + 1, k, a - da, b - db, abs(da) < 1e-6 AND abs(db) < 1e-6 FROM (
    SELECT r, k, a, b, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM (
      SELECT r, k, a, b, sum((q - y) * s) AS ga, sum(q - y) AS gb, sum(q * (1 - q) * s * s) + 1e-6 AS haa, sum(q * (1 - q) * s) AS hab, sum(q * (1 - q)) + 1e-6 AS hbb
      FROM (SELECT m.r, m.k, m.a, m.b, d.y, ln(d.p) AS s, 1 / (1 + exp(-(m.a * ln(d.p) + m.b))) AS q FROM moved m JOIN dev d ON d.k = m.k WHERE NOT m.done AND m.r < 50) GROUP BY r, k, a, b
    )
  )
)
SELECT k::INTEGER AS k, round(a, 6) AS a, round(b, 6) AS b, r::INTEGER AS rounds FROM moved QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC) = 1""",
)
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.platt(predictions(spark, sf_dir).where("split = 'dev'")))


@query(
    "isotonic_fit",
    _DEV
    + """, merged AS (SELECT k, p, sum(y) AS h, count(*) AS n FROM dev GROUP BY k, p
), c AS MATERIALIZED (
  SELECT k, p, n, row_number() OVER w AS i, sum(h) OVER w AS hh, sum(n) OVER w AS nn FROM merged WINDOW w AS (PARTITION BY k ORDER BY p)
  UNION ALL SELECT k, NULL, 0, 0, 0, 0 FROM range(3) t(k)
), low AS MATERIALIZED (
  SELECT a.k, a.i AS j, m.i AS m, (m.hh - a.hh) / (m.nn - a.nn)::DOUBLE AS v FROM c a JOIN c m ON m.k = a.k AND m.i > a.i
), least AS (
  SELECT k, j, m AS i, min(v) OVER (PARTITION BY k, j ORDER BY m DESC) AS v FROM low
), fitted AS (SELECT l.k, l.i, max(l.v) AS v FROM least l GROUP BY l.k, l.i)
SELECT f.k::INTEGER AS k, round(min(c.p), 6) AS low, round(max(c.p), 6) AS high, round(min(v), 6) AS value, sum(c.n)::BIGINT AS n
FROM fitted f JOIN c ON c.k = f.k AND c.i = f.i GROUP BY f.k, round(v, 9)""",
)
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.isotonic(predictions(spark, sf_dir).where("split = 'dev'")))


@query("calibration_comparison")
def calibration_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calibration method, fitted on dev, on dev and test."""
    return rounded(calibration.comparison(predictions(spark, sf_dir)))
