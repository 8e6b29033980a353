"""Repeated bytes against brute force over all strings, and suffix arrays against sorting, spilled or not."""

import hashlib
import random

import numpy as np
import pytest

from verdictlake.llm import induced_sort, suffix_dedup


def brute(texts, length):
    counts = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, length):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(length) for _ in range(4)]
    texts = [prose(rng.randint(0, 3 * length)) for _ in range(25)]
    for _ in range(30):  # passages of all lengths around the limit between texts of their own
        s = rng.choice(shared)
        n, at = rng.randint(length - 3, 3 * length), rng.randint(0, len(s) // 2)
        texts.append(prose(rng.randint(0, 30)) + s[at : at + n] + prose(rng.randint(0, 30)))
    texts += ["x" * (5 * length), "x" * (2 * length) + "y" + "x" * (length + 7), "ab" * (3 * length), "same " * 30, shared[0], shared[0], "", " \n", prose(9) + "z" * length, "z" * (length - 1)]
    return texts


@pytest.mark.parametrize("seed,length,k,shard_bytes", [(1, 400, 64, 1 << 20), (2, 40, 8, 5000), (3, 40, 16, 300), (4, 24, 8, 200)])
def test_brute_force(spark, monkeypatch, seed, length, k, shard_bytes):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    texts = corpus(random.Random(seed), length)
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, None, 1), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, td int").repartition(4)
    got = suffix_dedup.repeated_bytes(docs, length, k, shard_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows], length))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_odd_and_empty(spark, odd, none):
    assert suffix_dedup.repeated_bytes(none).count() == 0
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    got = suffix_dedup.repeated_bytes(odd).collect()
    short = [(i, *b) for (i, t), b in zip(rows, brute([t[:3000] for _, t in rows], 400)) if len(t) <= 3000]
    of = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    assert len(got) == len(rows) and set(short) <= of
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] in (6, 7))


def sorted_suffixes(t):
    places = sorted(range(len(t)), key=lambda i: t[i:])
    shared = [0]
    for a, b in zip(places, places[1:]):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        shared.append(k)
    return places, shared


@pytest.mark.parametrize("batch,held", [(1 << 15, 0), (3, 0), (4, 5)])
def test_suffix_array(tmp_path, monkeypatch, batch, held):
    monkeypatch.setattr(induced_sort, "BATCH", batch)
    monkeypatch.setattr(induced_sort, "DEPTH", 2)
    rng = random.Random(batch + held)
    spill = induced_sort.Spill(f"file://{tmp_path}" if held else None, held)
    for _ in range(150):
        t = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 70))]
        t = (t * rng.choice([1, 1, 3])) + [0]
        places, shared = induced_sort.suffix_array(np.array(t), spill)
        assert (places.tolist(), shared.tolist()) == sorted_suffixes(t)
    assert not held or spill.names
    spill.close()
    assert not list(tmp_path.iterdir())
