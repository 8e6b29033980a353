"""Registered queries over reports: gates, audits, tables, verdict parsing, backends, evidence summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import backends, metrics, profiles, reports
from .metric_queries import _bundle_sql, rounded
from .metric_queries import SQL as METRIC_SQL
from .sample_queries import SQL as SAMPLE_SQL
from .sample_queries import PHONE_SQL, evidence_support
from .views import normalised as norm
from .views import predictions, samples, table, with_views

Q, SQL = {}, {}


def query(name: str, sql: str | None, *views: str):
    def register(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return register


#: What judges write; a verdict text is two of them, by order key.
PHRASES = (
    "Response A is better than Response B.", "Therefore, after all, response B is the stronger.", "Both responses are equally good.", "It is a tie.", "Neither response is clearly better.",
    "Both responses were identical in content.", "Both responses correctly name it.", "Both responses provide a complete answer.", "Response A seems the best.", "Response B appears more detailed.",
    "Response A provides a more thorough answer.", "Response B correctly identifies the cause.", "Response A includes a clear table.", "Response B is accurate.", "Response A at least attempts it.",
    "Overall, response B.", "I would choose response A", "Response B more effectively argues.", "Response A fails to answer.", "Response B is incomplete.", "Response A contains several errors.",
    "Response B seems misleading.", "[RESULT] B", "feedback [result] tie", "so: A>B", "b>a it is", "No opinion at all.", "The answer a is better.", "Response a lacks detail, response b does not.", "Two responses seem comparable",
)


def _said(patterns) -> str:
    return "(" + " OR ".join("regexp_matches(low, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


@query(
    "verdict_parse",
    f"""SELECT id, coalesce(CASE mark WHEN 'A' THEN 'A>B' WHEN 'B' THEN 'B>A' WHEN 'TIE' THEN 'Tie' END, CASE WHEN ca AND NOT cb THEN 'A>B' WHEN cb AND NOT ca THEN 'B>A'
    WHEN t::INTEGER + a::INTEGER + b::INTEGER = 1 THEN CASE WHEN t THEN 'Tie' WHEN a THEN 'A>B' ELSE 'B>A' END END, CASE WHEN lower(token) = 'tie' THEN 'Tie' WHEN token <> '' THEN token END) AS label
FROM (SELECT id, upper(regexp_extract(x, '(?i)\\[RESULT\\]\\s*(A|B|Tie)\\b', 1)) AS mark, regexp_extract(x, '(?i)\\b(A>B|B>A|Tie)\\b', 1) AS token,
  {_said(S.of_side(S.CONCLUSION_PATTERNS, 'a'))} AS ca, {_said(S.of_side(S.CONCLUSION_PATTERNS, 'b'))} AS cb, {_said(S.TIE_PATTERNS)} AS t,
  {_said(S.of_side(S.POSITIVE_PATTERNS, 'a') + S.of_side(S.NEGATIVE_PATTERNS, 'b'))} AS a, {_said(S.of_side(S.POSITIVE_PATTERNS, 'b') + S.of_side(S.NEGATIVE_PATTERNS, 'a'))} AS b
  FROM (SELECT id, x, lower(x) AS low FROM (SELECT o_orderkey AS id, p[1 + o_orderkey % {len(PHRASES)}] || ' ' || p[1 + (o_orderkey // {len(PHRASES)}) % {len(PHRASES)}] AS x FROM orders, (SELECT [{', '.join("'" + p + "'" for p in PHRASES)}] AS p))))""",
)
def verdict_parse(spark, sf_dir):
    """Verdict texts of all patterns and their pairs, read by the parser."""
    k, n = F.col("o_orderkey"), len(PHRASES)
    said = F.array(*(F.lit(p) for p in PHRASES))
    raw = F.concat_ws(" ", F.get(said, (k % n).cast("int")), F.get(said, (F.floor(k / n) % n).cast("int")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), raw.alias("raw")).select("id", S.parse_label("raw").alias("label"))


_HEADS = "SELECT CASE split WHEN 'dev' THEN 'pairwise' ELSE 'factuality' END AS head, accuracy, macro_f1, ece FROM (" + METRIC_SQL["metrics_by_split"] + ") WHERE split <> 'train'"


@query(
    "training_gate",
    f"""SELECT unnest(['pairwise_accuracy_min_0.400', 'pairwise_macro_f1_min_0.350', 'factuality_accuracy_min_0.700', 'factuality_macro_f1_min_0.695', 'factuality_ece_max_0.200', 'all']) AS "check", unnest([a, b, c, d, e, a AND b AND c AND d AND e]) AS passed
FROM (SELECT bool_or(head = 'pairwise' AND accuracy >= 0.4) AS a, bool_or(head = 'pairwise' AND macro_f1 >= 0.35) AS b, bool_or(head = 'factuality' AND accuracy >= 0.7) AS c, bool_or(head = 'factuality' AND macro_f1 >= 0.695) AS d, bool_or(head = 'factuality' AND ece <= 0.2) AS e FROM ({_HEADS}))""",
)
def training_gate(spark, sf_dir):
    """Dev rows stand for one head, test rows for the other."""
    m = rounded(metrics.metric_bundle(predictions(spark, sf_dir).where("split <> 'train'"), ["split"]))
    return reports.gate(m.withColumn("head", F.when(F.col("split") == "dev", "pairwise").otherwise("factuality")), "head")


def _point(d: str, m: str) -> str:
    return f"max(CASE WHEN dataset = '{d}' THEN {m} END)"


@query(
    "submission_gate",
    f"""SELECT unnest(['accuracy_point_macro_f1_above_baseline', 'accuracy_point_accuracy_above_baseline', 'accuracy_point_ece_below_baseline', 'tie_point_macro_f1_above_baseline', 'tie_point_tie_recall_above_baseline', 'tie_point_ece_below_baseline', 'all']) AS "check",
  unnest([a, b, c, d, e, f, a AND b AND c AND d AND e AND f]) AS passed
FROM (SELECT {_point('2-HIGH', 'macro_f1')} > {_point('1-URGENT', 'macro_f1')} AS a, {_point('2-HIGH', 'accuracy')} > {_point('1-URGENT', 'accuracy')} AS b, {_point('2-HIGH', 'ece')} < {_point('1-URGENT', 'ece')} AS c,
  {_point('3-MEDIUM', 'macro_f1')} > {_point('1-URGENT', 'macro_f1')} AS d, {_point('3-MEDIUM', 'tie_recall')} > {_point('1-URGENT', 'tie_recall')} AS e, {_point('3-MEDIUM', 'ece')} < {_point('1-URGENT', 'ece')} AS f FROM ({METRIC_SQL['metrics_by_dataset']}))""",
)
def submission_gate(spark, sf_dir):
    m = rounded(metrics.metric_bundle(predictions(spark, sf_dir), ["dataset"]))
    return reports.submission_gate(m, "dataset", "1-URGENT", "2-HIGH", "3-MEDIUM")


@query(
    "core_audit",
    f"""SELECT c AS "check", n AS count, CASE WHEN n = 0 THEN 'pass' ELSE s END AS status FROM (
SELECT unnest(['null_labels', 'empty_answer_b', 'short_answers', 'phone_like', 'repeated_prompts', 'prompts_in_splits', 'repeated_contents']) AS c, unnest(['fail', 'fail', 'review', 'review', 'review', 'fail', 'fail']) AS s,
  unnest([(SELECT count(*) FILTER (human_label IS NULL) FROM samples), (SELECT count(*) FILTER (trim(coalesce(answer_b, '')) = '') FROM samples), (SELECT count(*) FILTER (length(trim(coalesce(answer_a, ''))) < 10) FROM samples),
    (SELECT count(*) FILTER (regexp_matches(coalesce(answer_a, ''), '{PHONE_SQL}')) FROM samples), (SELECT count(*) FROM (SELECT 1 FROM samples GROUP BY dataset, prompt HAVING count(*) > 1)),
    (SELECT count(*) FROM (SELECT 1 FROM samples GROUP BY dataset, prompt HAVING count(DISTINCT id % 3) > 1)),
    (SELECT count(*) - count(DISTINCT (dataset, {norm('prompt')}, {norm('answer_a')}, {norm('answer_b')})) FROM samples)]) AS n)""",
    "samples",
)
def core_audit(spark, sf_dir):
    return reports.core_audit(samples(spark, sf_dir).withColumn("split", F.col("id") % 3))


@query(
    "selection_reasons",
    """SELECT id, array_to_string(list_filter([CASE WHEN gold <> predicted THEN 'calibrated_error' END, CASE WHEN confidence <= 0.5 THEN 'low_confidence' END, CASE WHEN b <> predicted THEN 'base_calibrated_disagreement' END,
  CASE WHEN gold = 'Tie' OR predicted = 'Tie' OR b = 'Tie' THEN 'tie_case' END], lambda x: x IS NOT NULL), ';') AS reasons FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'Tie' WHEN 1 THEN 'A>B' ELSE predicted END AS b FROM pred)""",
    "pred",
)
def selection_reasons(spark, sf_dir):
    k = F.col("id") % 4
    p = predictions(spark, sf_dir).withColumn("base_predicted", F.when(k == 0, "Tie").when(k == 1, "A>B").otherwise(F.col("predicted")))
    return p.select("id", F.array_join(reports.selection_reasons(), ";").alias("reasons"))


@query(
    "tie_recall_table",
    "SELECT dataset, split, count(*) FILTER (gold = 'Tie') AS gold_tie, count(*) FILTER (predicted = 'Tie') AS pred_tie, round(count(*) FILTER (gold = 'Tie' AND predicted = 'Tie') / nullif(count(*) FILTER (gold = 'Tie'), 0), 6) AS tie_recall, round(avg(correct::INTEGER), 6) AS accuracy FROM pred WHERE split <> 'train' GROUP BY dataset, split",
    "pred",
)
def tie_recall_table(spark, sf_dir):
    return rounded(reports.tie_recall_table(predictions(spark, sf_dir).where("split <> 'train'"), ["dataset", "split"]))


@query(
    "margin_candidates",
    """SELECT i::BIGINT AS place, round(v, 6) AS margin FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT abs(pa - pb) AS v FROM pred WHERE split = 'dev'))
WHERE i IN (SELECT round_even((n - 1) * k / 20.0, 0) FROM (SELECT unnest(range(21)) AS k), (SELECT count(*) AS n FROM pred WHERE split = 'dev'))""",
    "pred",
)
def margin_candidates(spark, sf_dir):
    p = predictions(spark, sf_dir).where("split = 'dev'")
    return rounded(reports.margin_candidates(p, F.abs(F.get("probs", F.lit(0)) - F.get("probs", F.lit(1)))))


@query("subset_metadata", "SELECT \"column\", value, count(*) AS n FROM (SELECT unnest(['dataset', 'human_label', 'bias_type']) AS \"column\", unnest([dataset, human_label, bias_type]) AS value FROM samples) GROUP BY ALL", "samples")
def subset_metadata(spark, sf_dir):
    return reports.subset_metadata(samples(spark, sf_dir), ["dataset", "human_label", "bias_type"])


@query(
    "means_pass",
    "SELECT dataset, round(a, 6) AS accuracy, round(c, 6) AS confidence, round(r, 6) AS risk_score, a >= 0.6 AND c >= 0.4 AND r <= 0.55 AS passed FROM (SELECT dataset, avg(correct::INTEGER) AS a, avg(confidence) AS c, avg(risk_score) AS r FROM pred GROUP BY dataset)",
    "pred",
)
def means_pass(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("accuracy", F.col("correct").cast("double"))
    return rounded(reports.means_pass(p, ["dataset"], {"accuracy": 0.6, "confidence": 0.4}, {"risk_score": 0.55}))


@query("source_provenance", "SELECT source, m.n AS listed, coalesce(d.n, 0) AS accepted FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) m LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) GROUP BY source) d USING (source)")
def source_provenance(spark, sf_dir):
    docs, good = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    manifest = docs.groupBy("source").agg(F.count("*").alias("listed"))
    return reports.source_provenance(docs.join(good, "doc_id", "left_semi"), manifest)


_SUPPORT_A = SAMPLE_SQL["evidence_support"]
_SUPPORT_B = _SUPPORT_A.replace(norm("answer_a"), norm("answer_b"))


@query(
    "pairwise_contradiction",
    f"""SELECT id, CASE WHEN l = 'A>B' AND m < -0.05 OR l = 'B>A' AND m > 0.05 THEN 1.0 WHEN l = 'Tie' AND abs(m) > 0.35 THEN 0.5 ELSE 0.0 END::DOUBLE AS contradiction,
  CASE WHEN l = 'A>B' AND m < -0.05 OR l = 'B>A' AND m > 0.05 THEN 'pairwise_support_contradiction' WHEN l = 'Tie' AND abs(m) > 0.35 THEN 'pairwise_support_tie_imbalance' END AS reason
FROM (SELECT a.id, round(a.support - b.support, 6) AS m, CASE a.id % 4 WHEN 0 THEN 'Tie' WHEN 1 THEN 'B>A' ELSE 'A>B' END AS l FROM ({_SUPPORT_A}) a JOIN ({_SUPPORT_B}) b USING (id))""",
)
def pairwise_contradiction(spark, sf_dir):
    from ..functions import text as T

    s = samples(spark, sf_dir)
    a, b = (F.round(T.support(F.col(x), F.col("context")), 6) for x in ("answer_a", "answer_b"))
    rows = s.select("id", "human_label", F.round(a - b, 6).alias("m"))
    return rows.select("id", profiles.pairwise_contradiction(F.col("human_label"), F.col("m"), F.lit(0.0)).alias("c")).select("id", "c.contradiction", "c.reason")


@query(
    "evidence_summary",
    f"""SELECT section, key, count(*) AS n, round(count(*) FILTER (label = 'supported') / nullif(count(*) FILTER (label IN ('supported', 'unsupported', 'ambiguous')), 0), 6) AS supported_rate, round(avg((risk >= 0.6)::INTEGER), 6) AS review_rate,
  round(avg(risk), 6) AS avg_evidence_risk, round(avg(support), 6) AS avg_claim_support
FROM (SELECT *, unnest(sections) AS section, unnest([coalesce(x, 'none') for x in keys]) AS key FROM (
  SELECT *, list_concat(['overall', 'dataset', 'form', 'label'], list_transform(reasons, lambda r: 'reason')) AS sections, list_concat(['all', dataset, form, label], reasons) AS keys FROM (
    SELECT 'd' || (id % 3)::VARCHAR AS dataset, CASE WHEN id % 2 = 0 THEN 'single_answer' ELSE 'pairwise' END AS form, CASE id % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'Tie' END AS label,
      support, round(1 - support, 6) AS risk, list_filter([CASE WHEN support < 0.35 THEN 'low_context_support' END, CASE WHEN numeric_gap > 0 THEN 'numeric_evidence_gap' END], lambda x: x IS NOT NULL) AS reasons FROM ({_SUPPORT_A}))))
GROUP BY section, key""",
)
def evidence_summary(spark, sf_dir):
    k = F.col("id")
    p = evidence_support(spark, sf_dir).select(
        F.concat(F.lit("d"), (k % 3).cast("string")).alias("dataset"),
        F.when(k % 2 == 0, "single_answer").otherwise("pairwise").alias("form"),
        F.when(k % 5 == 0, "supported").when(k % 5 == 1, "unsupported").when(k % 5 == 2, "ambiguous").when(k % 5 == 3, "Tie").alias("label"),
        F.col("support").alias("claim_support_rate"),
        F.round(1 - F.col("support"), 6).alias("evidence_risk"),
        F.array_compact(F.array(F.when(F.col("support") < 0.35, "low_context_support"), F.when(F.col("numeric_gap") > 0, "numeric_evidence_gap"))).alias("reasons"),
    )
    return rounded(profiles.evidence_summary(p.withColumn("review_required", F.col("evidence_risk") >= 0.6)))


@query("mock_backend", "SELECT 'A>B' AS label, 'mock' AS backend, 'ok' AS parse_status, count(*) AS n, 1.0::DOUBLE AS score_a FROM samples", "samples")
def mock_backend(spark, sf_dir):
    j = backends.evaluate(samples(spark, sf_dir), backends.make_backend("mock", "mock"))
    return j.groupBy("label", "backend", "parse_status").agg(F.count("*").alias("n"), F.avg("score_a").alias("score_a"))


@query("fallback_backend", f"SELECT id, label, 'heuristic' AS backend, 'evaluator' AS fallback_from FROM ({SAMPLE_SQL['heuristic_pairwise_judge']})")
def fallback_backend(spark, sf_dir):
    """A backend without a model: every sample goes to the heuristic judge."""
    return backends.evaluate(samples(spark, sf_dir), backends.make_backend("evaluator")).select("id", "label", "backend", "fallback_from")
