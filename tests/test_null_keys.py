"""Null keys are keys, and de-duplication by either of two keys equals one pass in order."""

import random

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import compare, metrics, ranking


@pytest.mark.parametrize("seed", [1, 2])
def test_either_key_equals_one_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice([None, "", *"abcdefghijklmn"])) for i in range(120)]
    rows += [(200 + k, 1000 + k // 2, f"x{(k + 1) // 2}") for k in range(30)]  # a chain: id, content, id, ...
    df = spark.createDataFrame(rows, "o long, id long, content string").repartition(5)
    kept, gone = ranking.deduplicate_either(df, ["id"], ["content"], "o")
    ids, contents, stay, out = set(), set(), [], {}
    for o, i, c in rows:
        why = [n for n, seen in (("duplicate_id", i in ids), ("duplicate_content", c in contents)) if seen]
        if why:
            out[o] = why
        else:
            ids.add(i)
            contents.add(c)
            stay.append(o)
    assert sorted(r.o for r in kept.collect()) == stay and {r.o: r.reasons for r in gone.collect()} == out
    assert ranking.deduplicate_either(df.where("false"), ["id"], ["content"], "o")[0].count() == 0


def test_null_keys_stay_in_every_operator(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", None), (4, "a", "y"), (5, "b", None)], "id long, k string, label string")
    kept, gone = ranking.deduplicate(df, ["k"], "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 5] and {r.id: r.kept_by for r in gone.collect()} == {2: 1, 4: 3}
    assert ranking.stratified_draw(df, "k", "id", 5).count() == 5
    pred = df.select("k", F.col("label").alias("gold"), F.lit("z").alias("predicted"))
    assert {(r.k, r.gold): r.share for r in compare.error_taxonomy(pred, ["k"]).collect()} == {(None, "x"): 1.0, ("a", "y"): 1.0}
    both = df.select("k", "label", F.col("label").alias("again"))
    assert {r.k: (r.n, r.agreement) for r in metrics.kappa(both, "label", "again", ["k"]).collect()} == {None: (2, 1.0), "a": (2, 1.0), "b": (1, 1.0)}
    assert metrics.kappa(both, "label", "again", []).first().agreement == 1.0


def test_hash_ranks_equal_a_sort(spark):
    import hashlib

    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(6)
    got = {r.id: (r["rank"], r.group_size) for r in ranking.hash_ranked(df, ["g"], "id").collect()}
    for g in {g for _, g in rows}:
        own = sorted((i for i, x in rows if x == g), key=lambda i: (hashlib.sha1(str(i).encode()).hexdigest(), i))
        assert [got[i] for i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    assert ranking.hash_ranked(df.where("false"), ["g"], "id").count() == 0
