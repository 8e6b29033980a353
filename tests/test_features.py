from pyspark.sql import functions as F

from verdictlake.operators import features
from verdictlake.plans.views import samples
from verdictlake.sources import collectors


def test_frames_and_ablations(spark, small):
    s = samples(spark, small).withColumn("score_a", F.lit(1.0)).withColumn("score_b", F.lit(None).cast("double"))
    p = features.pairwise(s, ("d0", "d1", "d2"))
    assert p.count() == s.count() and {c.split("_")[0] for c in p.columns} == {"id", "base", "text", "bias", "meta"}
    assert not any(c.startswith("bias") for c in features.without(p, "bias").columns)
    f = features.factuality(s, ("d0",))
    assert all(c == "id" or "numeric" in c or "date" in c or "entity" in c for c in features.only(f, ("evidence",), ("gaps",)).columns)
    x = features.matrix(f).first()
    assert len(x.x) == len(f.columns) - 1 and None not in x.x
    w = features.weighted(s, "human_label", "dataset", {"Tie": 3.0}, {"d1": 2.0}).select("human_label", "dataset", "weight").collect()
    assert all(r.weight == (3.0 if r.human_label == "Tie" else 1.0) * (2.0 if r.dataset == "d1" else 1.0) for r in w)
    r = spark.range(1).select(features.pair_probabilities(F.lit(2.0), F.lit(1.0)).alias("p"), features.margin_label(F.lit(1.0), F.lit(1.1), 0.2).alias("m")).first()
    assert abs(sum(r.p) - 1) < 1e-12 and r.p[0] > r.p[1] and r.m == "Tie"


def test_collectors(spark):
    a = spark.createDataFrame([("p1", "ctx", ["q one?", "q two?"], ["1", "2"], ["a one", ""])], "id string, context string, questions array<string>, question_ids array<string>, answers array<string>")
    one = collectors.parallel_questions(a, "papers")
    assert [r.source_record_id for r in one.collect()] == ["1"] and one.first().group_key == "p1"
    b = spark.createDataFrame([("7", "pick", ["A", "B"], ["x", "y"], "B")], "id string, question string, labels array<string>, texts array<string>, answer_key string")
    two = collectors.multiple_choice(b, "choices")
    assert two.first().answer == "y" and two.first().options == {"A": "x", "B": "y"}
    c = collectors.tab_separated(spark.createDataFrame([("1\tq\ta",), ("bad",)], "value string"), "tsv")
    assert c.count() == 1
    d = collectors.keyed(spark.createDataFrame([({"k": ("q?", "c", "a")},)], "records map<string,struct<question:string,context:string,answer:string>>"), "map")
    all_ = collectors.corpus([one, two, c, c, d], {"en": 10})
    assert all_.count() == 4 and set(all_.columns) == {*collectors.COLUMNS, "split"}
    t = spark.createDataFrame([([("user", "hi"), ("assistant", "yo"), ("user", "so?"), ("assistant", "ok")],)], "turns array<struct<role:string,content:string>>")
    r = collectors.conversation(t).first()
    assert (r.prompt, r.answer, r.context) == ("so?", "ok", "user: hi\nassistant: yo")
