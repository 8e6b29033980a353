import numpy as np

from verdictlake.llm import common, phrases


def test_tables_of_words_and_pairs_are_read_by_one_pass(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 300) if x < 40), "en") for _ in range(60)], "text string, lang string").repartition(3)
    chunks, words = phrases._words(docs)
    frequent = words.where("f >= 10")
    of_words = phrases._stored(frequent.select("w0", "f"), 1, frequent.count(), 1000, "f")
    pairs = phrases._counted(chunks, 2, of_words, None, 10, 50)
    of_pairs = phrases._stored(pairs, 2, pairs.count(), 50, "f")
    rows = lambda df: sorted(map(tuple, df.select("w0", "w1", "w2", "f").collect()))
    triples = rows(phrases._counted(chunks, 3, of_words, of_pairs, 10, 50))
    assert len(triples) > 100
    for table in (of_words, of_pairs):
        common.remove(spark, table.folder)
    assert rows(phrases._counted(chunks, 3, of_words, of_pairs, 10, 50)) == triples
    names = {r.w0: r.word for r in frequent.collect()}
    texts = [r.text.split() for r in docs.collect()]
    for a, b, c, f in triples[::20]:
        assert f == sum(tuple(t[k : k + 3]) == (names[a], names[b], names[c]) for t in texts for k in range(len(t) - 2))


def test_chunks_of_more_words_than_three_places_hold(monkeypatch):
    rng = np.random.default_rng(7)
    keys, ids = rng.integers(1, 1 << 62, 50), rng.integers(0, 51, 4000).astype(np.int32)

    class Marks:
        def pairs(self, keys, ids):
            return np.append((ids[:-1] > 10) & (ids[1:] > 10), False)

    rows, counts = phrases._phrases(3, keys, ids, Marks())
    monkeypatch.setattr(phrases, "WORDS", 1)
    more, again = phrases._phrases(3, keys, ids, Marks())
    assert len(rows) > 1000 and (rows == more).all() and (counts == again).all()
    assert counts.sum() == sum((ids[k : k + 3] > 10).all() for k in range(len(ids) - 2))
