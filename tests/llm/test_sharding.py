from collections import Counter

import pytest

from verdictlake.llm import sharding as s


def slow_table(names, size):
    orders = [[(s.number(f"{n}#offset") + j * (s.number(f"{n}#skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner = {}
    while len(owner) < size:
        for k, order in enumerate(orders):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = k
    return [owner[i] for i in range(size)]


@pytest.mark.parametrize("shards,size", [(1, 7), (3, 13), (5, 101), (16, 131)])
def test_table(shards, size):
    names = s.shard_names(shards)
    assert s.lookup_table(names, size) == slow_table(names, size)


def test_balance_and_stability():
    names = s.shard_names(16)
    counts = Counter(s.lookup_table(names))
    assert max(counts.values()) - min(counts.values()) <= 1
    before = [names[k] for k in s.lookup_table(names)]
    fewer = names[:-1]
    after = [fewer[k] for k in s.lookup_table(fewer)]
    moved = sum(a != b for a, b in zip(before, after) if a != names[-1])
    assert moved < 0.2 * len(before)


@pytest.mark.parametrize("names,size", [([], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(names, size):
    with pytest.raises(ValueError):
        s.lookup_table(names, size)


def test_rows(spark, odd, none, tmp_path):
    names = s.shard_names(4)
    owner = s.lookup_table(names, 101)
    rows = s.assign(odd.withColumnRenamed("bpe_ids", "shard"), names, size=101).collect()
    assert len(rows) == odd.count()
    for r in rows:
        slot = s.number("null" if r["doc_id"] is None else str(r["doc_id"])) % 101
        assert (r["slot"], r["shard"]) == (slot, names[owner[slot]])
    assert s.assign(none, names).count() == 0
    s.write_shards(odd, str(tmp_path / "out"), names, size=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


def test_clashing_names(spark, tmp_path):
    names = s.shard_names(4)
    owner = s.lookup_table(names, 101)
    docs = spark.createDataFrame([(k, "a", "b", "c", "d", 900 + k) for k in range(40)], "doc_id long, _slot string, _owner string, _shard string, _file string, slot long")
    for key, column in (("doc_id", lambda r: r["doc_id"]), ("slot", lambda r: 900 + r["doc_id"])):
        for r in s.assign(docs, names, key=key, size=101).collect():
            slot = s.number(str(column(r))) % 101
            assert (r["slot"], r["shard"], r["_slot"], r["_owner"], r["_shard"], r["_file"]) == (slot, names[owner[slot]], "a", "b", "c", "d")
    hot = spark.createDataFrame([(1, str(k)) for k in range(400)], "doc_id long, _file string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones do
    try:
        s.write_shards(hot, str(tmp_path / "hot"), names, size=101)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "hot").glob("shard=*/*.parquet"))
    assert len(files) > 1 and spark.read.parquet(str(tmp_path / "hot")).count() == 400
