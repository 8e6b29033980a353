import zlib

from pyspark.sql import functions as F

from verdictlake.llm import language_id as l


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", l.held_out())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.select("doc_id", "held_out").collect())
    model = l.fit(docs.where("not held_out"))
    found = l.predict(docs, model, keep=("doc_id", "lang", "held_out")).where("held_out")
    right, total, rejected = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("lang_rejected").cast("int"))).first()
    assert right / total > 0.95 and rejected / total < 0.05


def test_odd_rows(odd, none):
    model = l.fit(odd)
    rows = {r["doc_id"]: r for r in l.predict(odd, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["lang_rejected"] and rows[i]["score"] == 0 for i in (1, 2, 3))
    assert rows[6]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in rows.values())
    assert l.predict(none, model).count() == 0
    empty = l.fit(none)
    assert {r["lang_pred"] for r in l.predict(odd, empty).collect()} == {"und"}


def test_labels_are_not_inputs(odd):
    model = l.fit(odd)
    a = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in l.predict(odd, model).collect())
    b = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in l.predict(odd.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), model).collect())
    assert a == b


def test_every_prediction_equals_a_plain_loop(spark, small):
    import zstandard

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = l.fit(docs.where(~l.held_out()))
    got = {r["doc_id"]: r for r in l.predict(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    parameters = zstandard.ZstdCompressionParameters.from_level(l.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = {name: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters) for name, content in model.dictionaries}
    for doc, text in texts.items():
        letters = any(c.isalpha() for c in text)
        small_ = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " if ord(c) < 33 or ord(c) == 127 else "" for c in text).encode()
        sizes = {name: sum(len(c.compress(small_[i : i + l.BLOCK_BYTES])) for i in range(0, len(small_), l.BLOCK_BYTES)) for name, c in made.items()}
        order = sorted(sizes, key=lambda name: (sizes[name], name))
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]] if letters else 0.0
        r = got[doc]
        assert r["lang_pred"] == (order[0] if letters else "und") and abs(r["margin"] - margin) < 1e-12
        assert abs(r["score"] - (0.5 + 0.5 * min(1.0, 5 * margin) if letters else 0.0)) < 1e-12 and r["lang_rejected"] == (not letters or margin < l.NARROW)


def test_ties_go_to_the_first_language_and_are_rejected(spark):
    same = b"the same words for both of them " * 20
    model = l.CompressionModel((("aa", same), ("bb", same)))
    r = l.predict(spark.createDataFrame([(1, "the same words for both")], "doc_id long, text string"), model).first()
    assert (r["lang_pred"], r["score"], r["margin"], r["lang_rejected"]) == ("aa", 0.5, 0.0, True)
