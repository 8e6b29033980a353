import math

import numpy as np

from verdictlake.llm import vector_dedup as v


def brute(rows, cosine=0.9):
    units = []
    for i, x in rows:
        ok = x and all(c is not None and math.isfinite(c) for c in x) and any(x)
        units.append(np.array(x, float) / np.linalg.norm(np.array(x, float)) if ok else None)
    n = len(rows)
    linked = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in linked[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return sorted((rows[i][0], len(linked[i]), label[i], label[i] == rows[i][0]) for i in range(n))


def data(seed=1, groups=12, dim=24):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(groups):
        center = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 2, 5, 30]))):
            rows.append((k, [float(x) for x in (center + rng.normal(size=dim) * 0.12)]))
            k += 1
    rows += [(k + i, [float(x) for x in rng.normal(size=dim)]) for i in range(80)]
    return rows


def test_against_brute_force(spark):
    rows = data()
    last = rows[-1][0]
    rows += [(last + 1, None), (last + 2, [0.0] * 24), (last + 3, [float("nan")] * 24), (last + 4, [None] + [1.0] * 23), (last + 5, rows[0][1]), (last + 5, rows[0][1]), (last + 6, [2 * x for x in rows[0][1]]), (last + 7, [1.0, 2.0]), (last + 8, [2.0, 4.0]), (last + 9, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, n_links int")
    for options in ({}, {"per_cell": 20, "block": 7, "margin": 1.0}):
        found = sorted(tuple(r) for r in v.near_duplicates(df, **options).collect())
        assert found == brute(rows), options


def test_recall_of_cells_with_margin(spark):
    rows = data(seed=2, groups=40, dim=64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sum(r[1] for r in brute(rows))
    found = v.near_duplicates(df, per_cell=15).agg({"n_links": "sum"}).first()[0]
    assert 0.98 * want <= found <= want


def test_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.01]), (None, None)], "vec_id long, embedding array<float>")
    found = {tuple(r) for r in v.near_duplicates(df).collect()}
    assert found == {(None, 1, 3, False), (3, 1, 3, True), (None, 0, None, False)}
    assert v.near_duplicates(df.limit(0)).count() == 0


def test_default_loses_no_link_on_many_cells_of_few_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=2)]) for k in range(300)]  # a circle: every link is along the line between centroids
    rows += [(300 + k, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in v.near_duplicates(df, per_cell=10).collect()) == brute(rows)
