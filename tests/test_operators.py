import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.functions import scores as S
from verdictlake.functions import text as T
from verdictlake.operators import fit, joins, metrics, policy, profiles, ranking, validation
from verdictlake.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_text_scalars(spark):
    r = one(
        spark,
        a=T.normalize(F.lit("  x \n\t y ")),
        b=T.language(F.lit("这是一个测试"), F.lit("x")),
        c=T.cut_with_ellipsis(F.lit("abcdefgh"), 5),
        d=T.redact_phones(F.lit("call 555-123-4567 now")),
        e=T.numbers(F.lit("1,000 and 2.5 and 1,000")),
        f=T.dates(F.lit("In 1999, on March 3, 2001 or 4/5/2020; not 2500")),
        g=T.entities(F.lit("the NASA probe Cassini reached B612 internationally")),
        h=T.sentences(F.lit("One. Two! Three")),
        i=T.bullet_count(F.lit("1. a\n2. b")),
        j=T.has_negation(F.lit("It is NOT so")),
        k=T.comparative_groups(F.lit("more of the least")),
        m=T.strip_prefix(F.lit("Human:  hi"), "human:"),
        o=T.alias_entities(F.lit("World Health Organization and Cassini-Huygens probes")),
        n=T.join_parts(F.array(F.lit("a" * 30), F.lit("b" * 30)), 40),
    )
    assert (r.a, r.b, r.c, r.d) == ("x y", "zh", "abcd…", "call [PHONE] now")
    assert set(r.e) == {"1000", "2.5"} and set(r.f) == {"1999", "2001", "2020", "march 3, 2001", "4/5/2020"}
    assert set(r.g) == {"nasa", "cassini", "b612", "internationally"}
    assert r.h == ["One.", "Two!", "Three"] and r.i == 1 and r.j and set(r.k) == {"increase", "minimum"} and r.m == "hi"
    assert {"who", "cassinihuygens", "organization"} <= set(r.o)
    assert r.n.endswith(" ... [TRUNCATED]") and len(r.n) <= 40


def test_scores(spark):
    p = F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    r = one(spark, a=S.argmax(p), b=S.temperature(p, F.lit(2.0)), c=S.brier(p, F.lit(0)), d=S.majority(F.lit("x"), F.lit("y"), F.lit("x")), e=S.majority(F.lit("x"), F.lit("y"), F.lit("z")), f=S.parse_label(F.lit("ok [RESULT] b")), g=S.parse_label(F.lit("It is a tie")), h=S.parse_label(F.lit("?")), i=S.bin_of(F.lit(1.0)), j=S.clip01(F.lit(float("nan"))))
    want = np.sqrt([0.4, 0.4, 0.2])
    assert r.a == 0 and np.allclose(r.b, want / want.sum()) and abs(r.c - (0.36 + 0.16 + 0.04)) < 1e-12
    assert (r.d, r.e, r.f, r.g, r.h, r.i, r.j) == ("x", "Tie", "B>A", "Tie", None, 9, 0.0)


def predictions(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    names = ["A>B", "B>A", "Tie"]
    rows = []
    for i in range(n):
        gold = int(rng.integers(3))
        p = rng.dirichlet(np.array([1.0, 1.0, 1.0]) + 2.5 * (np.arange(3) == gold))
        rows.append((i, f"d{i % 3}", names[gold], [float(x) for x in p]))
    return metrics.with_derived(spark.createDataFrame(rows, "id long, dataset string, gold string, probs array<double>")), rows


def test_bundle_against_numpy(spark):
    df, rows = predictions(spark)
    names = ["A>B", "B>A", "Tie"]
    y, p = np.array([names.index(r[2]) for r in rows]), np.array([r[3] for r in rows])
    pred, conf = p.argmax(1), p.max(1)
    r = metrics.metric_bundle(df, []).first()
    bins = np.minimum(9, (conf * 10).astype(int))
    ece = sum(abs((pred == y)[bins == b].sum() - conf[bins == b].sum()) for b in range(10)) / len(y)
    f1 = np.mean([2 * ((y == k) & (pred == k)).sum() / ((y == k).sum() + (pred == k).sum()) for k in range(3)])
    assert np.allclose([r.accuracy, r.ece, r.macro_f1, r.brier, r.tie_recall], [(pred == y).mean(), ece, f1, ((p - np.eye(3)[y]) ** 2).sum(1).mean(), (pred == y)[y == 2].mean()])
    assert metrics.metric_bundle(df.limit(0), ["dataset"]).count() == 0


def test_mcnemar():
    assert metrics.mcnemar_p(0, 0) == 1.0 and abs(metrics.mcnemar_p(1, 9) - 0.021484375) < 1e-12 and metrics.mcnemar_p(150, 250) < 1e-5


def test_review_threshold_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9, False), (2, 0.8, True), (3, 0.7, False), (4, 0.6, True), (5, 0.5, False), (6, 0.4, False), (7, 0.3, False)], "id long, risk_score double, correct boolean")
    r = policy.review_threshold(df).first()
    assert (r.threshold, r.reviewed, r.error_recall) == (0.4, 6, 0.8)


def test_conformal_covers(spark):
    df, _ = predictions(spark, 1500, seed=2)
    r = policy.conformal(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.1).first()
    assert r.coverage > 0.86 and 1 <= r.mean_set_size <= 3


def test_dedup_and_splits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "i long, t string")
    kept, removed = ranking.deduplicate(df, ["t"], "i")
    assert sorted(r.i for r in kept.collect()) == [1, 2] and sorted((r.i, r.kept_by) for r in removed.collect()) == [(3, 1), (4, 1)]
    takes = {r.t: r["take"] for r in ranking.largest_remainder(df, "t", 3).collect()}
    assert takes == {"a": 2, "b": 1}


def test_repair_and_coverage(spark):
    need = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    first = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "id string, v int, ok boolean")
    again = spark.createDataFrame([("b", 5, True), ("a", 9, False)], "id string, v int, ok boolean")
    out = {r.id: (r.v, r.resolution) for r in joins.repair_merge(need, first, again, "ok", columns=("v",)).collect()}
    assert out == {"a": (1, "original"), "b": (5, "retry"), "c": (None, "unresolved")}
    assert [r.id for r in joins.uncovered(need, first).collect()] == ["c"]
    assert joins.latest(spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "id string, o int, v int"), "id", "o").first().v == 2


def test_evidence(spark):
    df = spark.createDataFrame(
        [(1, "The tower is 300 meters tall.", "The tower is 300 meters tall and was built in 1889."), (2, "The tower is 450 meters tall.", "The tower is 300 meters tall."), (3, "It is not open.", "It is open today to visitors."), (4, "", "x"), (5, "abc", None)],
        "id long, answer_a string, context string",
    )
    r = {x.id: x for x in profiles.evidence_profile(df).collect()}
    assert r[1].context_support == pytest.approx(1.0) and r[1].evidence_risk == 0 and r[1].reasons == []
    assert r[2].numeric_evidence_gap == 1.0 and "numeric_evidence_gap" in r[2].reasons and r[2].evidence_risk >= 0.9
    assert r[2].entity_alias_gap == 0.0 and 0 <= r[2].anchored_severity <= 1 and r[1].anchored_severity == 0.0
    assert r[3].negation_mismatch == 1.0 and r[4].low_support_sentence_ratio == 0.0 and r[5].low_support_sentence_ratio == 1.0


def test_bias_cases(spark):
    df = spark.createDataFrame(
        [(1, "a long long answer", "short", "B>A", "none", "A>B"), (2, "same", "same", "A>B", "position", "B>A"), (3, "a long long answer", "short", "A>B", "format", None)],
        "id long, answer_a string, answer_b string, human_label string, bias_type string, predicted string",
    )
    r = {x.id: x for x in profiles.bias_profile(df).collect()}
    assert (r[1].length_risk, r[1].reasons) == (1.0, ["prediction_favors_longer_answer_against_gold"])
    assert r[2].position_risk == 1.0 and r[2].review_required
    assert (r[3].length_risk, r[3].format_risk, r[3].review_required) == (0.25, 0.35 if r[3].predicted else r[3].format_risk, False)


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "x")], "i long, t string")
    r = validation.completeness(df, ["t"]).first()
    assert (r.n, r.null_count, r.empty_count, r.whitespace_count, r.present) == (4, 1, 1, 1, 1)
    counts = {x.rule: x.rows for x in validation.rule_counts(df, [("blank", "error", F.coalesce(F.trim("t"), F.lit("")) == "")]).collect()}
    assert counts == {"blank": 3}


def test_sources_and_sinks(spark, tmp_path):
    wrapped = {"dataset_info": {"n": 2}, "samples": [{"id": "1", "dataset": "d", "prompt": "p   q", "metadata": {"k": "v"}}, {"id": "2", "dataset": "d", "prompt": None, "metadata": {}}]}
    (tmp_path / "w.json").write_text(json.dumps(wrapped, ensure_ascii=False, indent=1), encoding="utf-8")
    flat = readers.read_samples(spark, str(tmp_path / "w.json"))
    rows = {r.id: r for r in flat.collect()}
    assert rows["1"].prompt == "p   q" and rows["1"].metadata["k"] == "v" and rows["2"].answer_b is None
    nested = readers.to_canonical(flat.withColumn("answer_b", F.lit("")).withColumn("human_label", F.lit("supported")))
    assert readers.is_canonical(nested) and nested.first().repairs == ["answer_b_empty_to_null"]
    back = readers.to_flat(nested)
    assert back.columns == flat.columns and {r.id for r in back.collect()} == {"1", "2"} and back.first().metadata["task_form"] == "single_answer"
    writers.write_jsonl(flat, str(tmp_path / "o.jsonl"))
    assert readers.read_any(spark, str(tmp_path / "o.jsonl")).count() == 2
    writers.write_csv(flat.select("id", "metadata"), str(tmp_path / "o.csv"))
    assert {r.id for r in readers.read_any(spark, str(tmp_path / "o.csv")).collect()} == {"1", "2"}
    assert writers.markdown(flat.select("id").orderBy("id")).splitlines()[2] == "| 1 |"
    assert readers.line_count(spark, str(tmp_path / "o.jsonl")).first().lines == 2
    assert len(readers.checksums(spark, str(tmp_path / "w.json")).first().sha256) == 64


def test_streams(spark, small, tmp_path):
    from verdictlake.streaming import running

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running.file_stream(spark, str(tmp_path / "in"), events.schema)
    q = running.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    for _ in range(2):  # a second run finds nothing new
        running.score_stream(stream, lambda b: b.select("event_id", F.lit(1).alias("score")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    samples = spark.range(10).withColumnRenamed("id", "id")
    scored = running.retry_rounds(samples, [lambda d: d.withColumn("valid", F.col("id") % 2 == 0), lambda d: d.withColumn("valid", F.col("id") % 3 == 0)], str(tmp_path / "rounds"))
    assert sorted(r.id for r in scored.collect()) == [0, 2, 3, 4, 6, 8, 9]
