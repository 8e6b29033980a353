import os

import numpy as np

from verdictlake.llm import common
from verdictlake.llm import vector_dedup as v

from test_vector_dedup import brute


def written_bytes(spark) -> int:
    top = common.shared_folder(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_vectors_are_written_once_whatever_is_compared(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=64)]) for k in range(3000)]
    rows += [(3000 + k, [x + float(e) for x, e in zip(rows[7 * k][1], rng.normal(size=64) * 0.05)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    before = written_bytes(spark)
    found = v.near_duplicates(df, per_cell=100)
    assert written_bytes(spark) - before < 2 * len(rows) * 64 * 4
    links = {r.vec_id: r.n_links for r in found.collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert [links[k] for k in range(len(rows))] == ((x @ x.T >= 0.9).sum(1) - 1).tolist() and sum(links.values()) >= 400


def test_cells_in_many_blocks_and_dense_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [1.0 + float(x) for x in rng.normal(size=12) * 0.3]) for k in range(400)]  # most pairs near the limit
    rows += [(400 + k, [float(x) for x in rng.normal(size=12)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in v.near_duplicates(df, per_cell=150, block=40).collect()) == brute(rows)
