"""Registered queries over labels, builders, comparisons and further policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S
from ..operators import build, compare, metrics, policy
from .metric_queries import rounded
from .views import predictions, samples, table, with_views
from .views import normalised as norm

Q, SQL = {}, {}


def query(name: str, sql: str | None, *views: str):
    def register(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return register


@query(
    "label_mappings",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'A>B' WHEN 'view' THEN 'B>A' ELSE 'Tie' END AS winner, CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN 0 END AS flag,
  CASE WHEN f0 AND f1 THEN 'supported' WHEN NOT f0 AND NOT f1 THEN 'unsupported' ELSE 'ambiguous' END AS factuality,
  CASE WHEN m >= 0.75 THEN 'supported' WHEN m <= 0.4 THEN 'unsupported' ELSE 'ambiguous' END AS by_score
FROM (SELECT *, user_id % 2 = 0 AS f0, event_id % 3 = 0 AS f1, CASE WHEN event_id % 4 = 0 THEN least(1, value / 100) ELSE (least(1, value / 100) + (event_id % 2)) / 2 END AS m FROM events)""",
)
def label_mappings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.select(
        "event_id",
        F.when(F.col("event_type") == "click", " Model_A ").when(F.col("event_type") == "view", "B").otherwise("Draw").alias("w"),
        F.when(F.col("user_id") % 3 == 0, "Yes").when(F.col("user_id") % 3 == 1, "0").otherwise("?").alias("b"),
        (F.col("user_id") % 2 == 0).cast("int").alias("f0"),
        F.when(F.col("event_id") % 3 == 0, 1).alias("f1"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("s0"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 2).alias("s1"),
    )
    return e.select("event_id", L.winner("w").alias("winner"), L.binary("b").alias("flag"), L.factuality_of_binaries("f0", "f1").alias("factuality"), L.factuality_of_scores("s0", "s1").alias("by_score"))


@query(
    "row_scores",
    "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN -(event_id % 7) WHEN event_id % 3 = 1 THEN value ELSE (user_id % 5 + event_id % 4) / 2 END, 6) + 0.0 AS score FROM events",
)
def row_scores(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, (k % 7).cast("string")).alias("rank"), F.when(k % 3 == 1, F.col("value").cast("string")).otherwise("n/a").alias("score"), (F.col("user_id") % 5).cast("string").alias("quality"), (k % 4).cast("string").alias("helpfulness"))
    return rounded(e.select("event_id", L.row_score("rank", ["score"], ["quality", "helpfulness"]).alias("score")))


@query(
    "direct_score_parse",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 4.0 WHEN 1 THEN 3.5 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 END::DOUBLE AS score FROM events",
)
def direct_score_parse(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, '{"score": 4}').when(k == 1, "Overall: 3.5 of 5").when(k == 2, "so [RESULT] 2").when(k == 3, "Relevance: 4, clarity = 2").otherwise("score: 17")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", L.direct_score("raw").alias("score"))


@query(
    "licence_gate",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'non_commercial' WHEN 2 THEN 'missing' ELSE 'unknown' END AS reason FROM documents",
)
def licence_gate(spark, sf_dir):
    k = F.col("doc_id") % 4
    licence = F.when(k == 0, "MIT").when(k == 1, "cc-by-nc-4.0").when(k == 3, "proprietary")
    return table(spark, sf_dir, "documents").select("doc_id", L.licence_reason(licence).alias("reason"))


@query(
    "judge_prompts",
    f"SELECT id, md5('Question:' || chr(10) || {norm('prompt')} || chr(10) || chr(10) || 'Answer A:' || chr(10) || {norm('answer_a')} || chr(10) || chr(10) || 'Answer B:' || chr(10) || {norm('answer_b')} || chr(10) || chr(10) || 'Reply with [RESULT] A, B or Tie.') AS prompt FROM samples",
    "samples",
)
def judge_prompts(spark, sf_dir):
    return samples(spark, sf_dir).select("id", F.md5(L.pairwise_prompt("prompt", "answer_a", "answer_b").cast("binary")).alias("prompt"))


@query(
    "perturbations",
    """SELECT id::VARCHAR || '__' || k AS id, id AS parent_id, k AS bias_type, CASE WHEN k = 'position' THEN CASE human_label WHEN 'A>B' THEN 'B>A' WHEN 'B>A' THEN 'A>B' ELSE human_label END ELSE human_label END AS human_label,
  md5(coalesce(CASE WHEN k = 'position' THEN answer_a ELSE answer_b END, '')) AS answer_b, length(CASE WHEN k = 'rubric_sensitivity' THEN prompt || ' Judge by correctness alone.' ELSE prompt END)::INTEGER AS prompt_chars
FROM samples, (SELECT unnest(['position', 'length', 'format', 'rubric_sensitivity']) AS k)""",
    "samples",
)
def perturbations(spark, sf_dir):
    p = build.perturb(samples(spark, sf_dir))
    return p.select("id", "parent_id", "bias_type", "human_label", F.md5(F.coalesce("answer_b", F.lit("")).cast("binary")).alias("answer_b"), F.length("prompt").alias("prompt_chars"))


_SWAP = "CASE {} WHEN 'A>B' THEN 'B>A' WHEN 'B>A' THEN 'A>B' ELSE {} END"


@query(
    "swap_consistency",
    f"""SELECT CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset, count(*) AS n, round(avg((predicted = {_SWAP.format('q', 'q')})::INTEGER), 6) AS consistent, round(avg((predicted = 'A>B' AND q = 'A>B')::INTEGER), 6) AS always_first
FROM (SELECT *, CASE WHEN id % 3 = 0 THEN predicted ELSE {_SWAP.format('predicted', 'predicted')} END AS q FROM pred) GROUP BY ROLLUP (dataset)""",
    "pred",
)
def swap_consistency(spark, sf_dir):
    """A second run with exchanged answers in which every third verdict follows the position."""
    p = predictions(spark, sf_dir)
    second = p.withColumn("predicted", F.when(F.col("id") % 3 == 0, F.col("predicted")).otherwise(S.invert(F.col("predicted"))))
    return rounded(compare.swap_consistency(p, second))


@query(
    "review_capture",
    """SELECT split, count(*) AS n, round(avg((risk_score >= 0.5)::INTEGER), 6) AS review_rate, round(count(*) FILTER (NOT correct AND risk_score >= 0.5) / nullif(count(*) FILTER (NOT correct), 0), 6) AS capture_rate,
  round(count(*) FILTER (correct AND risk_score < 0.5) / nullif(count(*) FILTER (risk_score < 0.5), 0), 6) AS auto_accuracy FROM pred GROUP BY split""",
    "pred",
)
def review_capture(spark, sf_dir):
    return rounded(compare.review_capture(predictions(spark, sf_dir), ["split"], 0.5))


@query(
    "error_taxonomy",
    "SELECT dataset, gold, predicted, n, round(n / total, 6) AS share FROM (SELECT dataset, gold, predicted, count(*) AS n, sum(count(*)) OVER (PARTITION BY dataset, gold) AS total FROM pred GROUP BY dataset, gold, predicted) WHERE gold <> predicted",
    "pred",
)
def error_taxonomy(spark, sf_dir):
    return rounded(compare.error_taxonomy(predictions(spark, sf_dir), ["dataset"]))


@query(
    "metric_deltas",
    "SELECT dataset, n, round(accuracy, 6) AS accuracy, round(accuracy - (SELECT avg(correct::INTEGER) FROM pred WHERE dataset = '1-URGENT'), 6) AS accuracy_delta FROM (SELECT dataset, count(*) AS n, avg(correct::INTEGER) AS accuracy FROM pred GROUP BY dataset)",
    "pred",
)
def metric_deltas(spark, sf_dir):
    m = metrics.metric_bundle(predictions(spark, sf_dir), ["dataset"]).select("dataset", "n", "accuracy")
    return rounded(compare.deltas(m, "dataset", "1-URGENT", ["accuracy"]))


@query(
    "binary_threshold_search",
    """SELECT threshold, (tp + fp + fn + tn)::BIGINT AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1
FROM (SELECT t AS threshold, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn
  FROM (SELECT t, gold = 'B>A' AS g, pb >= t AS p FROM pred, (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS t) WHERE split = 'dev') GROUP BY t)""",
    "pred",
)
def binary_threshold_search(spark, sf_dir):
    p = predictions(spark, sf_dir).where("split = 'dev'").select((F.col("gold") == "B>A").alias("g"), F.get("probs", F.lit(1)).alias("s"))
    return rounded(policy.binary_threshold_search(p, "s", "g"))


@query(
    "tie_rescue_search",
    """SELECT a AS min_tie, b AS max_margin, c AS max_confidence, count(*) FILTER (r) AS rescued, count(*) FILTER (r AND gold = 'Tie') AS rescued_ties, round(avg((CASE WHEN r THEN gold = 'Tie' ELSE correct END)::INTEGER), 6) AS accuracy,
  round(count(*) FILTER (gold = 'Tie' AND (r OR correct)) / nullif(count(*) FILTER (gold = 'Tie'), 0), 6) AS tie_recall
FROM (SELECT *, predicted <> 'Tie' AND pt >= a AND abs(pa - pb) <= b AND confidence <= c AS r FROM pred, (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4])::DOUBLE AS a), (SELECT unnest([0.05, 0.1, 0.15, 0.2])::DOUBLE AS b), (SELECT unnest([0.45, 0.5, 0.55, 0.6])::DOUBLE AS c) WHERE split = 'dev') GROUP BY a, b, c""",
    "pred",
)
def tie_rescue_search(spark, sf_dir):
    return rounded(policy.tie_rescue_search(predictions(spark, sf_dir).where("split = 'dev'")))


@query(
    "metrics_unpivoted",
    "SELECT dataset, unnest(['accuracy', 'tie_rate']) AS metric, round(unnest([a, t]), 6) AS value FROM (SELECT dataset, avg(correct::INTEGER) AS a, avg((predicted = 'Tie')::INTEGER) AS t FROM pred GROUP BY dataset)",
    "pred",
)
def metrics_unpivoted(spark, sf_dir):
    s = metrics.summary_by_sets(predictions(spark, sf_dir), ["dataset"]).where("section = 'dataset'").withColumnRenamed("key", "dataset")
    return rounded(compare.unpivot_metrics(s, ["dataset"], ["accuracy", "tie_rate"]))


@query("first_per_label", "SELECT gold, id, rank FROM (SELECT gold, id, row_number() OVER (PARTITION BY gold ORDER BY id)::INTEGER AS rank FROM pred) WHERE rank <= 20", "pred")
def first_per_label(spark, sf_dir):
    return build.first_per_label(predictions(spark, sf_dir), "gold", "id", 20).select("gold", "id", "rank")
