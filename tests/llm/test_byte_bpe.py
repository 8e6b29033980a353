import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from verdictlake.llm import byte_bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = byte_bpe.tokenizer(FILE, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_random_texts(both):
    own, other = both
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "ing", "'s", "'", ".", "12", "é", "\x1c", "\x85", "​", " ", "　", "﻿", "😀", "漢", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for text, found in zip(texts, own.encode_all(texts)):
        want = other.encode_ordinary(text)
        ids = np.frombuffer(found, own.kind)
        assert ids.tolist() == want, text
        assert b"".join(own.decimals(ids)).decode() == ",".join(map(str, want))
        assert own.decode(want) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "the" * 9000, "=-" * 9000, "é漢" * 5000, " " * 9000, "1234567890" * 2000])
def test_long_pretokens(both, text):
    own, other = both
    assert own.encode(text) == other.encode_ordinary(text)


def test_queue_alone_and_together_agree(both):
    own, _ = both
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abenthiosr ") for _ in range(rng.randint(2, 32))) for _ in range(3000)]
    packed = lambda ids: np.array(ids, own.kind).tobytes()
    assert own.merge_short(pieces) == [packed(own.merge(p)) if p not in own.ranks else own.merge_short([p])[0] for p in pieces]


def test_words_with_marks(both):
    own, other = both
    rng = random.Random(8)
    parts = ["the", "ing.", "a,", "x!?", "don't", "it's,", "..", "é.", "naïve", "s", "S;", "漢字", "a1.", "<|endoftext|>", "q" * 60, "b.c", "'", "'s."]
    texts = [" ".join(rng.choice(parts) + rng.choice(["", "", "\n", "\n\n"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    for text, found in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(found, own.kind).tolist() == other.encode_ordinary(text), text


def test_the_memo_is_bounded_in_bytes(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 20_000)
    own = byte_bpe.ByteBPE(both[0].ranks, P.PATTERN)
    rng = random.Random(9)
    for _ in range(30):
        texts = ["a " + " ".join("".join(rng.choice("abcdef") for _ in range(rng.choice([3, 7, 400]))) for _ in range(40)) for _ in range(4)]
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode_all(texts)] == [both[1].encode_ordinary(t) for t in texts]
        assert max(map(len, own.words), default=0) <= byte_bpe.MEMO_CHARS
        assert len(own.words) + len(own.old) <= 2 * (20_000 // byte_bpe.MEMO_ENTRY + 160)


def test_documents(both, odd, none):
    _, other = both
    rows = byte_bpe.encode_documents(odd, FILE, P.PATTERN, keep=("doc_id", "text"), digests=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = other.encode_ordinary(r["text"] or "")
        assert r["bpe_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(none, FILE, P.PATTERN).count() == 0
