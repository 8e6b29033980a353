import itertools
import random
import re

import numpy as np

from verdictlake.llm import mixing


def test_knapsack_against_all_subsets():
    rng = random.Random(3)
    for _ in range(100):
        lengths = np.array(sorted(rng.sample(range(30), 5))[::-1])
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        budget = rng.randint(0, 120)
        taken = mixing.knapsack(lengths, counts, budget)
        sums = (sum(a * b for a, b in zip(x, lengths)) for x in itertools.product(*[range(c + 1) for c in counts]))
        assert (taken <= counts).all() and abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_budgets_reshare_the_excess():
    target = mixing.budgets({"a": 10, "b": 100, None: 100}, 315)
    assert target == {"a": 20.0, "b": 2 / 3 * 295, None: 1 / 3 * 295} and abs(sum(target.values()) - 315) < 1e-9


def test_budgets_large_fit_is_near():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 3000)
    counts = rng.integers(0, 2000, len(lengths))
    size = int((lengths * counts).sum())
    for share in (0.1, 0.77, 1.3, 1.99):
        copies, more = mixing.fit_source(lengths, counts, share * size)
        assert (more <= counts).all() and (more >= 0).all()
        assert abs(copies * size + int((more * lengths).sum()) - share * size) <= 1


def test_plan_meets_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = mixing.plan_mix(docs).toPandas()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert dict(zip(plan.doc_id, plan["size"])) == sizes
    plan["taken"] = plan["copies"] * plan["size"]
    assert plan["copies"].max() <= 2
    for _, group in plan.groupby("source"):
        reach = 1  # the sums of all subsets, as bits
        for n in group["size"]:
            reach |= reach << n
        whole, target = int(group["size"].sum()), group["target"].iloc[0]
        goal = round(target) - int(target // whole) * whole
        best = min(abs(i - goal) for i in range(reach.bit_length()) if reach >> i & 1)
        assert abs(group["taken"].sum() - round(target)) == best
    again = mixing.plan_mix(docs.repartition(3)).toPandas()
    assert sorted(zip(plan.doc_id, plan["copies"])) == sorted(zip(again.doc_id, again["copies"]))
    assert mixing.mix(docs).count() == plan["copies"].sum()


def test_odd_rows(odd, none):
    plan = mixing.plan_mix(odd).toPandas()
    assert len(plan) == odd.count() and plan.loc[plan.doc_id == 1, "size"].iloc[0] == 0
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_sources_of_few_long_documents():
    def off(lengths, counts, target):
        lengths, counts = np.array(lengths), np.array(counts)
        copies, more = mixing.fit_source(lengths, counts, target)
        assert (0 <= more).all() and (more <= counts).all()
        return abs(copies * int((lengths * counts).sum()) + int((more * lengths).sum()) - target)

    assert off([140_000], [1], 139_000) == 1_000
    assert off([60_000], [5], 90_000) == 30_000
    assert off([70_000, 71_000, 100_000], [1, 1, 1], 141_000) == 0
    rng = random.Random(7)
    for _ in range(20):
        lengths = sorted(rng.sample(range(66_000, 400_000), 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        whole = sum(a * b for a, b in zip(lengths, counts))
        target = rng.randint(1, whole - 1)
        sums = [sum(a * b for a, b in zip(x, lengths)) for x in itertools.product(*[range(c + 1) for c in counts])]
        assert off(lengths, counts, target) == min(abs(s - target) for s in sums)


def test_long_documents_beyond_the_exact_search(monkeypatch):
    monkeypatch.setattr(mixing, "EXACT_SUMS", 0)
    copies, more = mixing.fit_source(np.array([140_000]), np.array([1]), 139_000)
    assert copies == 0 and more.tolist() == [1]


def test_many_lengths_take_little_memory():
    lengths = np.arange(60_000, 80_000)  # one document of each length
    counts = np.ones(len(lengths), np.int64)
    copies, more = mixing.fit_source(lengths, counts, 0.4 * lengths.sum())
    assert abs(int((more * lengths).sum()) - 0.4 * lengths.sum()) <= 1 and copies == 0
    taken = mixing.few_long(np.array([70_000, 90_000]), np.array([2, 1]), 139_000)
    assert taken.tolist() == [2, 0]


def test_rows_that_are_alike(spark):
    rows = [(1, "a b c", "x", 1)] * 2500 + [(k, "w " * k, "x", k) for k in range(2, 30)] + [(1, "z " * 4000, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key int")
    plan, mixed = mixing.plan_mix(docs), mixing.mix(docs)
    want = {(r[0], r[1]): r[2] for r in plan.groupBy("doc_id", "source").sum("copies").collect() if r[2]}
    assert {(r[0], r[1]): r[2] for r in mixed.groupBy("doc_id", "source").count().collect()} == want and mixed.columns == docs.columns


def test_long_documents_are_searched_whatever_their_size():
    for lengths, target, want in (([40_000_000, 41_000_000, 43_000_000, 44_500_000], 84_000_000, 84_000_000), ([10**9, 2 * 10**9 + 7, 5 * 10**9 + 1], 6 * 10**9, 6 * 10**9 + 1)):
        lengths = np.array(lengths)
        copies, more = mixing.fit_source(lengths, np.ones(len(lengths), np.int64), target)
        assert copies == 0 and int((more * lengths).sum()) == want
    rng = random.Random(11)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(10**6, 10**8), 8)))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        goal = rng.randint(1, int((lengths * counts).sum()) - 1)
        sums = [sum(a * b for a, b in zip(x, lengths.tolist())) for x in itertools.product(*[range(c + 1) for c in counts])]
        taken = mixing.sparse_knapsack(lengths, counts, goal, 1 << 22)
        assert (taken <= counts).all() and abs(int((taken * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)
    assert mixing.sparse_knapsack(lengths, counts, goal, 5) is None


def test_a_cut_through_rows_that_are_alike(spark):
    rows = [(7, "a b c d e", "x")] * 3000 + [(k, "v w x y z", "x") for k in range(100, 700)] + [(1, "z " * 9000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, total_share=0.7)
    taken = plan.where("source = 'x'").selectExpr("sum(copies * size)", "max(target)", "count(*)").first()
    assert taken[2] == 3600 and abs(taken[0] - taken[1]) <= 5
    count = lambda p: sorted(map(tuple, p.groupBy("doc_id", "source", "copies").count().collect()))
    assert count(plan) == count(mixing.plan_mix(docs.repartition(7), total_share=0.7))
    alike = plan.where("doc_id = 7").groupBy("copies").count().collect()
    assert sum(r["count"] for r in alike) == 3000
