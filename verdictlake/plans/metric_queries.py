"""Registered queries over predictions: metrics, calibration, policies, ranking. Each has its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, policy, ranking
from .views import predictions, with_views

Q, SQL = {}, {}


def query(name: str, sql: str | None, *views: str):
    def register(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *(views or ("pred",)))
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at six places: sums in another order differ in the last bits."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _bundle_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    match = "USING (" + by + ")" if by else "ON true"
    f1 = " + ".join(f"coalesce(2.0 * b{k} / nullif(g{k} + p{k}, 0), 0)" for k in range(3))
    present = " + ".join(f"(g{k} + p{k} > 0)::INTEGER" for k in range(3))
    counts = ", ".join(f"count(*) FILTER (gold = '{x}' AND predicted = '{x}') AS b{k}, count(*) FILTER (gold = '{x}') AS g{k}, count(*) FILTER (predicted = '{x}') AS p{k}" for k, x in enumerate(("A>B", "B>A", "Tie")))
    return f"""SELECT {keys}n, round(accuracy, 6) AS accuracy, round(({f1}) / ({present}), 6) AS macro_f1, round(ece, 6) AS ece, round(brier, 6) AS brier, round(nll, 6) AS nll, round(b2::DOUBLE / nullif(g2, 0), 6) AS tie_recall
FROM (SELECT {keys}count(*) AS n, avg(correct::INTEGER) AS accuracy, avg(-ln(pgold + 1e-12)) AS nll,
    avg(pow(pa - (gold = 'A>B')::INTEGER, 2) + pow(pb - (gold = 'B>A')::INTEGER, 2) + pow(pt - (gold = 'Tie')::INTEGER, 2)) AS brier, {counts} FROM pred {group}) m
JOIN (SELECT {keys}sum(abs(hits - conf)) / sum(c) AS ece FROM (SELECT {keys}bin, sum(correct::INTEGER) AS hits, sum(confidence) AS conf, count(*) AS c FROM pred GROUP BY {keys}bin) {group}) e {match}"""


@query("metrics_by_dataset", _bundle_sql("dataset"))
def metrics_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metric_bundle(predictions(spark, sf_dir), ["dataset"]))


@query("metrics_by_split", _bundle_sql("split"))
def metrics_by_split(spark, sf_dir):
    return rounded(metrics.metric_bundle(predictions(spark, sf_dir), ["split"]))


@query("metrics_by_dataset_split", _bundle_sql("dataset, split"))
def metrics_by_dataset_split(spark, sf_dir):
    return rounded(metrics.metric_bundle(predictions(spark, sf_dir), ["dataset", "split"]))


@query("metrics_overall", _bundle_sql(""))
def metrics_overall(spark, sf_dir):
    return rounded(metrics.metric_bundle(predictions(spark, sf_dir), []))


@query(
    "confusion_matrix",
    "SELECT gold, count(*) FILTER (predicted = 'A>B') AS pred_0, count(*) FILTER (predicted = 'B>A') AS pred_1, count(*) FILTER (predicted = 'Tie') AS pred_2 FROM pred GROUP BY gold",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query(
    "reliability_bins",
    """SELECT b::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS accuracy, round(coalesce(c, 0), 6) AS confidence, round(coalesce(abs(a - c), 0), 6) AS gap
FROM range(10) t(b) LEFT JOIN (SELECT bin, count(*) AS n, avg(correct::INTEGER) AS a, avg(confidence) AS c FROM pred GROUP BY bin) p ON p.bin = t.b""",
)
def reliability_bins(spark, sf_dir):
    return rounded(metrics.reliability_bins(predictions(spark, sf_dir)))


@query(
    "calibration_metrics",
    """SELECT sum(n)::BIGINT AS n, round(sum(h) / sum(n), 6) AS accuracy, round(sum(abs(h - c)) / sum(n), 6) AS ece, round(max(abs(h - c) / n), 6) AS mce
FROM (SELECT bin, count(*) AS n, sum(correct::INTEGER) AS h, sum(confidence) AS c FROM pred GROUP BY bin)""",
)
def calibration_metrics(spark, sf_dir):
    return rounded(metrics.calibration_metrics(predictions(spark, sf_dir)))


@query("dataset_accuracy_gaps", "SELECT dataset, count(*) AS n, round(avg(correct::INTEGER) - (SELECT avg(correct::INTEGER) FROM pred), 6) AS gap FROM pred GROUP BY dataset")
def dataset_accuracy_gaps(spark, sf_dir):
    return rounded(metrics.accuracy_gaps(predictions(spark, sf_dir)))


@query(
    "summary_by_sets",
    """SELECT CASE WHEN grouping(dataset) = 0 THEN 'dataset' WHEN grouping(split) = 0 THEN 'split' WHEN grouping(gold) = 0 THEN 'gold' ELSE 'overall' END AS section,
  coalesce(dataset, split, gold, 'all') AS key, count(*) AS n, round(avg(correct::INTEGER), 6) AS accuracy, round(avg((predicted = 'Tie')::INTEGER), 6) AS tie_rate
FROM pred GROUP BY GROUPING SETS ((), (dataset), (split), (gold))""",
)
def summary_by_sets(spark, sf_dir):
    return rounded(metrics.summary_by_sets(predictions(spark, sf_dir), ["dataset", "split", "gold"]))


@query(
    "kappa_by_dataset",
    """SELECT dataset, sum(c)::BIGINT AS n, round(any_value(agree) / sum(c), 6) AS agreement, round((any_value(agree) / sum(c) - any_value(chance)) / (1 - any_value(chance)), 6) AS kappa
FROM (SELECT dataset, count(*) AS c, sum(correct::INTEGER)::DOUBLE AS agree FROM pred GROUP BY dataset) n
JOIN (SELECT dataset, sum(x.c * y.c)::DOUBLE / any_value(t.c * t.c) AS chance FROM (SELECT dataset, gold AS l, count(*) AS c FROM pred GROUP BY ALL) x
  JOIN (SELECT dataset, predicted AS l, count(*) AS c FROM pred GROUP BY ALL) y USING (dataset, l) JOIN (SELECT dataset, count(*) AS c FROM pred GROUP BY ALL) t USING (dataset) GROUP BY dataset) p USING (dataset)
GROUP BY dataset""",
)
def kappa_by_dataset(spark, sf_dir):
    return rounded(metrics.kappa(predictions(spark, sf_dir), "gold", "predicted", ["dataset"]))


@query(
    "seed_summary",
    "SELECT dataset, count(*) AS n, round(avg(confidence), 6) AS mean, round(coalesce(stddev_samp(confidence), 0), 6) AS std, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max FROM pred GROUP BY dataset",
)
def seed_summary(spark, sf_dir):
    return rounded(metrics.seed_summary(predictions(spark, sf_dir), ["dataset"], "confidence"))


@query(
    "paired_discordance",
    "SELECT count(*) AS n, count(*) FILTER (correct AND NOT other) AS only_a, count(*) FILTER (NOT correct AND other) AS only_b FROM (SELECT correct, gold = CASE WHEN pb >= pt THEN 'B>A' ELSE 'Tie' END AS other FROM pred)",
)
def paired_discordance(spark, sf_dir):
    """The judge against a second system that never prefers the first answer."""
    p = predictions(spark, sf_dir).withColumn("other", F.col("gold") == F.when(F.get("probs", F.lit(1)) >= F.get("probs", F.lit(2)), "B>A").otherwise("Tie"))
    return metrics.discordant(p, "correct", "other")


@query("metric_intervals", None)
def metric_intervals(spark, sf_dir):
    """Resampling isn't expressed in SQL; tests hold the intervals against numpy's."""
    return rounded(metrics.bootstrap_metrics(predictions(spark, sf_dir).where("split <> 'train'"), ["split"]))


@query("paired_intervals", None)
def paired_intervals(spark, sf_dir):
    """The judge against a second system that never prefers the first answer, on test rows of each dataset."""
    p = predictions(spark, sf_dir).where("split = 'test'")
    other = F.when(F.get("probs", F.lit(1)) >= F.get("probs", F.lit(2)), "B>A").otherwise("Tie")
    return rounded(metrics.bootstrap_deltas(p.withColumn("other", other), "other", ["dataset"]))


RATES = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.75, 1.00)


@query(
    "risk_coverage",
    f"""SELECT r AS review_rate, k AS reviewed, captured AS errors_captured, round(captured / nullif(errors, 0), 6) AS error_capture,
  round(CASE WHEN total > k THEN (total - k - (errors - captured)) / (total - k) END, 6) AS auto_accept_accuracy, round(risk_score, 6) AS risk_threshold
FROM (SELECT r, least(total, greatest(1, round_even(r * total, 0)))::BIGINT AS k, total, errors FROM (SELECT unnest([{', '.join(map(str, RATES))}])::DOUBLE AS r), (SELECT count(*) AS total, count(*) FILTER (NOT correct) AS errors FROM pred)) c
JOIN (SELECT i, risk_score, sum((NOT correct)::INTEGER) OVER (ORDER BY i)::BIGINT AS captured FROM (SELECT correct, risk_score, row_number() OVER (ORDER BY risk_score DESC, id) AS i FROM pred)) s ON s.i = c.k""",
)
def risk_coverage(spark, sf_dir):
    return rounded(ranking.risk_coverage(predictions(spark, sf_dir), RATES))


@query(
    "low_confidence_topk",
    "SELECT dataset, id, round(confidence, 6) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY confidence, id)::INTEGER AS rank FROM pred WHERE NOT correct) WHERE rank <= 25",
)
def low_confidence_topk(spark, sf_dir):
    wrong = predictions(spark, sf_dir).where("not correct")
    return rounded(ranking.top_per_group(wrong, ["dataset"], [F.col("confidence"), F.col("id")], 25).select("dataset", "id", "confidence", "rank"))


@query(
    "hard_cases",
    """SELECT dataset, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN NOT correct THEN 0 ELSE 1 END, CASE WHEN abs(pa - pb) < 0.1 THEN 0 ELSE 1 END, confidence, id)::INTEGER AS rank FROM pred WHERE split = 'test') WHERE rank <= 40""",
)
def hard_cases(spark, sf_dir):
    p = predictions(spark, sf_dir).where("split = 'test'")
    close = F.abs(F.get("probs", F.lit(0)) - F.get("probs", F.lit(1))) < 0.1
    order = [F.when(~F.col("correct"), 0).otherwise(1), F.when(close, 0).otherwise(1), F.col("confidence"), F.col("id")]
    return ranking.top_per_group(p, ["dataset"], order, 40).select("dataset", "id", "rank")


def _temperature_sql(by: str, where: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}temperature, round(sum(nll) / sum(n), 6) AS nll, round(sum(abs(h - c)) / sum(n), 6) AS ece, round(sum(brier) / sum(n), 6) AS brier, round(sum(nll) / sum(n) + sum(abs(h - c)) / sum(n) + 0.25 * sum(brier) / sum(n), 6) AS objective
FROM (SELECT {keys}temperature, least(9, floor(conf * 10)) AS b, count(*) AS n, sum(conf) AS c, sum((CASE WHEN qa >= qb AND qa >= qt THEN 'A>B' WHEN qb >= qt THEN 'B>A' ELSE 'Tie' END = gold)::INTEGER) AS h,
    sum(-ln(CASE gold WHEN 'A>B' THEN qa WHEN 'B>A' THEN qb ELSE qt END + 1e-12)) AS nll, sum(pow(qa - (gold = 'A>B')::INTEGER, 2) + pow(qb - (gold = 'B>A')::INTEGER, 2) + pow(qt - (gold = 'Tie')::INTEGER, 2)) AS brier
  FROM (SELECT *, greatest(qa, qb, qt) AS conf FROM (SELECT dataset, gold, temperature, exp(ln(pa) / temperature) / z AS qa, exp(ln(pb) / temperature) / z AS qb, exp(ln(pt) / temperature) / z AS qt
    FROM (SELECT *, exp(ln(pa) / temperature) + exp(ln(pb) / temperature) + exp(ln(pt) / temperature) AS z FROM pred, (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0])::DOUBLE AS temperature) WHERE {where}))) GROUP BY ALL)
GROUP BY {keys}temperature"""


@query("temperature_search", _temperature_sql("", "split = 'dev'"))
def temperature_search(spark, sf_dir):
    return rounded(policy.temperature_search(predictions(spark, sf_dir).where("split = 'dev'")))


@query("temperature_by_dataset", f"SELECT dataset, arg_min(temperature, objective) AS temperature, min(objective) AS objective FROM ({_temperature_sql('dataset', chr(115) + 'plit = ' + chr(39) + 'dev' + chr(39))}) GROUP BY dataset")
def temperature_by_dataset(spark, sf_dir):
    return rounded(policy.best_temperature(policy.temperature_search(predictions(spark, sf_dir).where("split = 'dev'"), ["dataset"]), ["dataset"]))


def _list(values) -> str:
    return "unnest([" + ", ".join("NULL" if v is None else str(v) for v in values) + "])::DOUBLE"


def _grid_sql(ties, margins) -> str:
    return f"""SELECT NULL::DOUBLE AS min_tie, NULL::DOUBLE AS max_margin, NULL::DOUBLE AS max_base_margin UNION ALL
  SELECT a, b, c FROM (SELECT {_list(ties)} AS a), (SELECT {_list(margins)} AS b), (SELECT {_list(policy.BASE_MARGINS)} AS c)"""


def _tie_sql(by: str, ties=policy.TIE_PROBABILITIES, margins=policy.AB_MARGINS) -> str:
    keys = f"{by}, " if by else ""
    counts = ", ".join(f"count(*) FILTER (gold = '{x}' AND q = '{x}') AS b{k}, count(*) FILTER (gold = '{x}') AS g{k}, count(*) FILTER (q = '{x}') AS p{k}" for k, x in enumerate(("A>B", "B>A", "Tie")))
    f1 = " + ".join(f"coalesce(2.0 * sum(b{k}) / nullif(sum(g{k}) + sum(p{k}), 0), 0)" for k in range(3))
    present = " + ".join(f"(sum(g{k}) + sum(p{k}) > 0)::INTEGER" for k in range(3))
    return f"""SELECT {keys}min_tie, max_margin, max_base_margin, sum(n)::BIGINT AS n, sum(g2)::BIGINT AS gold_ties, round(sum(h) / sum(n), 4) AS accuracy, round(({f1}) / ({present}), 4) AS macro_f1, round(round(sum(abs(h - c)) / sum(n), 9), 4) AS ece, round(sum(b2)::DOUBLE / nullif(sum(g2), 0), 4) AS tie_recall
FROM (SELECT {keys}min_tie, max_margin, max_base_margin, least(9, floor(cc * 10)) AS b, count(*) AS n, sum(cc) AS c, count(*) FILTER (gold = q) AS h, {counts}
  FROM (SELECT *, CASE WHEN tied THEN 'Tie' ELSE predicted END AS q, CASE WHEN tied THEN pt ELSE confidence END AS cc
    FROM (SELECT *, coalesce(pt >= min_tie AND abs(pa - pb) <= max_margin AND (max_base_margin IS NULL OR base_margin <= max_base_margin), false) AS tied FROM pred, ({_grid_sql(ties, margins)}) WHERE split = 'dev')) GROUP BY ALL)
GROUP BY {keys}min_tie, max_margin, max_base_margin"""


def _chosen_sql(search: str, by: str, f1: float, accuracy: float, ece: float, recall: float) -> str:
    keys, match = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by or '1'} ORDER BY ok DESC, CASE WHEN ok THEN tie_recall END DESC NULLS LAST, CASE WHEN ok THEN macro_f1 END DESC NULLS LAST, CASE WHEN ok THEN accuracy END DESC NULLS LAST,
    CASE WHEN ok THEN ece END NULLS FIRST, objective DESC, min_tie NULLS FIRST, max_margin NULLS FIRST, max_base_margin NULLS FIRST) AS place
  FROM (SELECT s.*, round(macro_f1 + 0.25 * accuracy + {recall} * coalesce(tie_recall, 0) - 0.05 * ece, 6) AS objective,
      min_tie IS NOT NULL AND round(macro_f1 - f0, 9) >= -{f1} AND round(accuracy - a0, 9) >= -{accuracy} AND round(ece - e0, 9) <= {ece} AND coalesce(tie_recall, 0) > t0 AS ok
    FROM ({search}) s JOIN (SELECT {keys}macro_f1 AS f0, accuracy AS a0, ece AS e0, coalesce(tie_recall, 0) AS t0 FROM ({search}) WHERE min_tie IS NULL) z {match})) WHERE place = 1"""


_SEARCH = "min_tie, max_margin, max_base_margin, n, gold_ties, accuracy, macro_f1, ece, tie_recall"


@query("tie_policy_search", f"SELECT {_SEARCH}, round(macro_f1 + 0.25 * accuracy + 0.1 * coalesce(tie_recall, 0) - 0.05 * ece, 6) AS objective FROM ({_tie_sql('')})")
def tie_policy_search(spark, sf_dir):
    return policy.tie_policy_search(predictions(spark, sf_dir).where("split = 'dev'")).withColumn("objective", policy.tie_objective())


_BY_DATASET = _tie_sql("dataset", policy.DATASET_TIE_PROBABILITIES, policy.DATASET_AB_MARGINS)


@query("tie_policy_by_dataset", f"SELECT dataset, {_SEARCH}, objective FROM ({_chosen_sql(f'SELECT * FROM ({_BY_DATASET}) WHERE n >= 20 AND gold_ties >= 3', 'dataset', 0.01, 0.02, 0.01, 0.2)}) WHERE ok")
def tie_policy_by_dataset(spark, sf_dir):
    return policy.dataset_tie_policies(predictions(spark, sf_dir).where("split = 'dev'"))


@query("tie_policy_best", f"SELECT {_SEARCH}, objective FROM ({_chosen_sql(_tie_sql(''), '', 0.005, 0.01, 0.02, 0.1)})")
def tie_policy_best(spark, sf_dir):
    return policy.best_tie_policy(policy.tie_policy_search(predictions(spark, sf_dir).where("split = 'dev'")))


@query(
    "review_threshold",
    """SELECT round(threshold, 6) AS threshold, reviewed, round(captured / errors, 6) AS error_recall, round(reviewed / total, 6) AS review_rate
FROM (SELECT risk_score AS threshold, sum(sum(1)) OVER w::BIGINT AS reviewed, sum(sum((NOT correct)::INTEGER)) OVER w AS captured FROM pred WHERE split = 'dev' GROUP BY risk_score WINDOW w AS (ORDER BY risk_score DESC)),
  (SELECT count(*) AS total, count(*) FILTER (NOT correct) AS errors FROM pred WHERE split = 'dev')
WHERE captured >= 0.8 * errors ORDER BY reviewed LIMIT 1""",
)
def review_threshold(spark, sf_dir):
    return rounded(policy.review_threshold(predictions(spark, sf_dir).where("split = 'dev'")))


@query(
    "conformal_sets",
    """SELECT count(*) AS n, round(avg(greatest(1, (1 - pa <= q)::INTEGER + (1 - pb <= q)::INTEGER + (1 - pt <= q)::INTEGER)), 6) AS mean_set_size, round(avg((1 - pgold <= q)::INTEGER), 6) AS coverage
FROM pred, (SELECT s AS q FROM (SELECT 1 - pgold AS s, row_number() OVER (ORDER BY 1 - pgold) AS i, count(*) OVER () AS c FROM pred WHERE split = 'dev') WHERE i = least(c, ceil((c + 1) * 0.9))) WHERE split = 'test'""",
)
def conformal_sets(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(policy.conformal(p.where("split = 'dev'"), p.where("split = 'test'"), alpha=0.1))


@query(
    "group_splits",
    """SELECT customer, stratum, CASE WHEN k < floor(n * 0.7 + 0.5) THEN 'train' WHEN k < floor(n * 0.85 + 0.5) THEN 'dev' ELSE 'test' END AS split
FROM (SELECT customer, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha1(customer::VARCHAR), customer) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n
  FROM (SELECT customer, gold AS stratum FROM (SELECT customer, gold, row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, gold) AS i FROM pred GROUP BY customer, gold) WHERE i = 1))""",
)
def group_splits(spark, sf_dir):
    return ranking.group_splits(predictions(spark, sf_dir), "customer", "gold")


@query(
    "stratified_draw",
    """SELECT id, dataset, rank FROM (SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sha1(id::VARCHAR), id)::INTEGER AS rank FROM pred) JOIN (
  SELECT dataset, fl + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, dataset) <= 1000 - sum(fl) OVER () THEN 1 ELSE 0 END AS take
  FROM (SELECT dataset, floor(x) AS fl, x - floor(x) AS rest FROM (SELECT dataset, count(*) * 1000 / (SELECT count(*) FROM pred) AS x FROM pred GROUP BY dataset))) USING (dataset) WHERE rank <= take""",
)
def stratified_draw(spark, sf_dir):
    return ranking.stratified_draw(predictions(spark, sf_dir), "dataset", "id", 1000).select("id", "dataset", "rank")


@query("round_robin", "SELECT id, gold, turn FROM (SELECT id, gold, row_number() OVER (PARTITION BY gold ORDER BY sha1(id::VARCHAR), id)::INTEGER AS turn FROM pred) ORDER BY turn, gold LIMIT 500")
def round_robin(spark, sf_dir):
    return ranking.round_robin(predictions(spark, sf_dir), "gold", "id", 500).select("id", "gold", "turn")
