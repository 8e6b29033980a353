import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as c
from verdictlake.llm import byte_bpe, language_id, mixing, secret_scan, simhash_dedup


def test_stages_against_their_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}

    first = c.STAGES[0][1](spark, docs, small)
    model = language_id.fit(docs.where(~language_id.held_out()))
    compressors = model.compressors()
    want = {i for i, r in texts.items() if (x := language_id.classify((r["text"] or "").encode(), compressors))[0] != "und" and x[2] >= language_id.NARROW}
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == want

    second = c.STAGES[1][1](spark, first, small)
    fps = {i: simhash_dedup.wide_fingerprint((texts[i]["text"] or "").encode()) for i in want}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]["text"] or "")) for i in want}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}

    def near(i, j):
        (_, _, x), (_, _, y) = fps[i], fps[j]
        a, b = shingles[i], shingles[j]
        return int(np.bitwise_count(x ^ y).sum()) <= simhash_dedup.WIDE_RADIUS and len(a & b) >= 0.8 * len(a | b)

    label = {i: i for i in want}
    links = {i: [j for j in want if near(i, j)] for i in want}
    while True:
        after = {i: min(label[j] for j in links[i]) for i in want}
        if after == label:
            break
        label = after
    kept = {i for i in want if label[i] == i}
    assert {r["doc_id"] for r in second.collect()} == kept

    third = {r["doc_id"]: r for r in c.STAGES[2][1](spark, second, small).collect()}
    spans = {r["doc_id"]: r["secrets"] for r in secret_scan.scan(second).collect()}
    assert set(third) == kept
    for i, r in third.items():
        assert (r["text"] == texts[i]["text"]) == (not spans[i])
        assert all(texts[i]["text"][s["start"] : s["stop"]] not in r["text"] for s in spans[i])

    cleaned = spark.createDataFrame(list(third.values()), docs.schema)
    fourth = Counter(r["doc_id"] for r in c.STAGES[3][1](spark, cleaned, small).collect())
    assert fourth == Counter({r["doc_id"]: r["copies"] for r in mixing.plan_mix(cleaned).collect() if r["copies"]})

    own = byte_bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    final = c.run(spark, small).collect()
    assert Counter(r["doc_id"] for r in final) == fourth
    for r in final:
        ids = other.encode_ordinary(third[r["doc_id"]]["text"])
        assert r["bpe_ids"] == ids and r["decoded_sha256"] == hashlib.sha256(third[r["doc_id"]]["text"].encode()).hexdigest()


def test_odd_rows(spark, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    want = [
        {4, 5, 6, None, 7},  # language ID: rows without letters go, the repeated row stays twice
        {4, 6, None, 7},  # near copies: 5 has the words of 4, whose repeated row goes
        {4, 6, None, 7},
    ]
    for table in (odd.select(*columns), none.select(*columns)):
        empty = table.count() == 0
        for k, (_, stage) in enumerate(c.STAGES):
            table = stage(spark, table, "")
            if k < 3 and not empty:
                found = [r["doc_id"] for r in table.collect()]
                assert set(found) <= want[k] and (k == 0 or len(found) == len(set(found))), (k, found)
            assert k == len(c.STAGES) - 1 or table.columns == c.COLUMNS
        assert not (empty and table.count())


def test_rows_without_or_with_the_same_id_stay(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4)]
    rows = [(None, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1), (5, texts[2], "en", "s", 1), (5, texts[3], "en", None, 1)]
    near = texts[0].split()
    near[10] = "changed"
    rows += [rows[0], (9, " ".join(near), "en", "s", 2), (5, texts[3], "en", None, 1), (7, None, None, None, None), (8, "", None, None, None), (8, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [sorted(map(str, c.near_duplicate_stage(spark, d, "").collect())) for d in (docs, docs.repartition(5), docs.orderBy("text"))]
    kept = c.near_duplicate_stage(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, texts[1]), (5, texts[2]), (5, texts[3]), (9, " ".join(near)), (7, "")])
    assert runs[0] == runs[1] == runs[2]
