import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from verdictlake.llm import token_codes as t

FILE = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_round_trip_and_random_access(n):
    rng = random.Random(n)
    ids = np.array([rng.choice([0, 3, 255, 256, 40000, 65535, 65536, 2**40]) for _ in range(n)], np.uint64)
    file = t.CodeFile(t.pack([7, None], [n // 2, n - n // 2], ids))
    assert file.doc_ids == [7, None] and (file.tokens(0, n) == ids).all()
    for i in range(0, n, 5):
        assert file.token(i) == int(ids[i])
    for _ in range(60):
        a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
        assert (file.tokens(a, b) == ids[a:b]).all()
    assert file.document(1)[0] == n // 2


def test_words_are_cut_without_loss():
    encoder = t.WordEncoder(FILE)
    rng = random.Random(3)
    parts = [" ", "\n", "\t", "  ", "A", "é", "H̱", "İ", "ſ", "the", "'s", "12", "!", "😀", " ", "\x1c", "Σ", "漢", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x."]
    tokenizer = Tokenizer.from_file(FILE)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(encoder.encode_all([text.encode()])[0], encoder.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(encoder.encode_all([b"a <|endoftext|> b"])[0], encoder.kind).tolist() == [320, 49407, 321]


def test_the_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(t, "MEMO_BYTES", 20_000)
    encoder, tokenizer, rng = t.WordEncoder(FILE), Tokenizer.from_file(FILE), random.Random(9)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.choice([3, 7, 400]))) for _ in range(40)) for _ in range(4)]
        found = encoder.encode_all([x.encode() for x in texts])
        assert [np.frombuffer(x, encoder.kind).tolist() for x in found] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert max(map(len, encoder.words)) <= t.MEMO_LONGEST and len(encoder.words) + len(encoder.old) <= 2 * (20_000 // t.MEMO_ENTRY + 160)


def test_files(spark, odd, none, small, monkeypatch):
    monkeypatch.setattr(t, "RANGE_BYTES", 40_000)
    monkeypatch.setattr(t, "FILE_TOKENS", 5_000)
    hot = spark.createDataFrame([(None, f"row {i}") for i in range(300)] + [(7, "the same text")] * 300 + [(8, "a <|endoftext|> b")], "doc_id long, text string")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id > 8").unionByName(odd.select("doc_id", "text")).unionByName(hot)
    files = t.write_codes(docs, FILE, end_id=2)
    assert files.count() > 5
    rows = sorted(t.read_documents(files).collect(), key=lambda r: r["start"])
    tokenizer, start, at = Tokenizer.from_file(FILE), 0, {}
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        at.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted((d for d in at for _ in at[d]), key=lambda d: (d is None, d or 0))
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in at.items()}
    empty = t.write_codes(none, FILE, 2)
    assert empty.count() == 0 and t.read_documents(empty).count() == 0
