from pyspark.sql import functions as F

from verdictlake.functions import labels as L
from verdictlake.operators import build, compare


def test_labels(spark):
    df = spark.createDataFrame([("model_a", None, 1, "3", '{"score": 9} [RESULT] 4'), ("x", "0.9", None, None, "Relevance: 4, clarity: 2")], "w string, s string, f int, r string, raw string")
    a, b = df.select(L.winner("w").alias("w"), L.factuality_of_scores("s").alias("s"), L.factuality_of_binaries("f").alias("f"), L.row_score("r", ["s"], ["f"]).alias("score"), L.direct_score("raw").alias("d"), L.one_to_five("r").alias("n")).collect()
    assert (a.w, a.s, a.f, a.score, a.d, a.n) == ("A>B", None, "supported", -3.0, 4.0, 3.0)
    assert (b.w, b.s, b.f, b.score, b.d, b.n) == (None, "supported", "unsupported", 0.9, 3.0, None)


def test_builders(spark):
    df = spark.createDataFrame([("1", "p", "One. Two.", "other", "A>B")], "id string, prompt string, answer_a string, answer_b string, human_label string")
    rows = {r.bias_type: r for r in build.perturb(df).collect()}
    assert rows["position"].answer_a == "other" and rows["position"].human_label == "B>A"
    assert rows["format"].answer_a == "- One.\n- Two." and rows["length"].human_label == "A>B"
    assert build.swap(df).first().human_label == "B>A"
    nested = df.select("id", F.struct("prompt", F.struct("answer_a").alias("x")).alias("s"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    assert build.flatten(nested).columns == ["id", "s_prompt", "s_x_answer_a", "m"]


def test_deltas(spark):
    df = spark.createDataFrame([("base", 0.5), ("new", 0.75)], "system string, acc double")
    assert {r.system: r.acc_delta for r in compare.deltas(df, "system", "base", ["acc"]).collect()} == {"base": 0.0, "new": 0.25}
