"""Closed itemsets and rules against brute force over all subsets, whole and split shards alike."""

import hashlib
import itertools
import random

import pytest

from verdictlake.llm import itemsets


def brute(baskets, least, per):
    sets, total = {}, len(baskets)
    least = max(least, -(-total // per), 1)
    for b in baskets.values():
        for k in range(1, len(b) + 1):
            for s in itertools.combinations(sorted(b), k):
                sets[s] = sets.get(s, 0) + 1
    often = {s: n for s, n in sets.items() if n >= least}
    longer = {(s[:k] + s[k + 1 :], n) for s, n in often.items() for k in range(len(s))}
    out = {}
    for s, n in often.items():
        if (s, n) not in longer:
            rules = [(c, sets[rest], sets[(c,)]) for c in s if len(s) > 1 for rest in [tuple(x for x in s if x != c)]]
            rules = [(c, a, t) for c, a, t in rules if 100 * n >= 10 * a and n * total > a * t]
            best = min(((a, c) for c, a, _ in rules), default=(None, None))[1]
            out[",".join(map(str, s))] = (len(s), n, len(rules), best, hashlib.sha256(";".join(f"{c}:{a}:{t}" for c, a, t in rules).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,shard_rows", [(1, 4096), (2, 3), (3, 1), (4, 8)])
def test_brute_force(spark, seed, shard_rows):
    rng = random.Random(seed)
    baskets = {k: {min(int(rng.expovariate(0.4)), 11) * 7 - 20 for _ in range(rng.randint(1, 8))} for k in range(150)}
    baskets |= {k: {1, 8, 15, 22, 29} for k in range(200, 230)}  # copies: one closed set
    rows = [(k, i, "x") for k, b in baskets.items() for i in b for _ in range(rng.randint(1, 2))] + [(None, 1, "x"), (5, None, "x"), (None, None, None)]
    lines = spark.createDataFrame(rows, "sale_id long, item_id long, items string")
    got = itemsets.digest(itemsets.closed_itemsets(lines, least=8, per=2000, shard_rows=shard_rows)).collect()
    want = brute(baskets, 8, 2000)
    assert {r["items"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_share_of_baskets_and_empty_table(spark):
    rows = [(k, i) for k in range(100) for i in ([1, 2, 3] if k < 30 else [1, k % 5 + 10])]
    lines = spark.createDataFrame(rows, "sale_id long, item_id long")
    got = itemsets.digest(itemsets.closed_itemsets(lines, least=1, per=4)).collect()
    baskets = {}
    for k, i in rows:
        baskets.setdefault(k, set()).add(i)
    assert {r["items"]: tuple(r)[1:] for r in got} == brute(baskets, 1, 4)
    assert itemsets.closed_itemsets(lines.where("false")).count() == 0


def test_the_tree_prunes_without_loss():
    rng = random.Random(7)
    for _ in range(30):
        baskets = [sorted(rng.sample(range(14), rng.randint(0, 9))) for _ in range(60)]
        weights = [rng.randint(1, 3) for _ in baskets]
        want = {}
        for s in {tuple(sorted(set.intersection(*map(set, c)))) for k in (1, 2, 3) for c in itertools.combinations(baskets, k)}:
            holders = [b for b in baskets if set(s) <= set(b)]
            if tuple(sorted(set.intersection(*map(set, holders)))) == s:
                want[s] = sum(w for b, w in zip(baskets, weights) if set(s) <= set(b))
        got = dict(itemsets.intersect(baskets, weights, 12))
        deep = {s: n for s, n in want.items() if n >= 12}
        assert {s: got.get(s) for s in deep} == deep and all(n >= 12 for n in got.values())
        for s, n in got.items():
            holders = [set(b) for b in baskets if set(s) <= set(b)]
            assert tuple(sorted(set.intersection(*holders))) == s
        tree = itemsets.Intersections(12, {i: sum(w for b, w in zip(baskets, weights) if i in b) for i in range(14)})
        for b, w in zip(baskets, weights):
            tree.add(b, w)
            tree._prune()
        assert dict(tree.sets()) == got
