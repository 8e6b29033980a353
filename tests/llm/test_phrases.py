"""Collocations against a plain count of all phrases, and the perfect hash against a dictionary."""

import random
import re

import numpy as np
import pytest

from verdictlake.llm import phrases


def brute(rows, least, top):
    counts, sizes = {}, {}
    for text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] = sizes.get(lang, 0) + len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    g = (lang, *w[i : i + k])
                    counts[g] = counts.get(g, 0) + 1
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    out = {}
    for g, a in found.items():
        lang, w = g[0], g[1:]
        if any(len(t) == 4 and t[0] == lang and w in (t[1:3], t[2:4]) and 100 * b >= 50 * a for t, b in found.items()) and len(w) == 2:
            continue
        cuts = [(1000000 * a * a // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])], sizes[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n, -s) for lang, x in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("block_keys,slots,fan", [(200_000, 2 << 20, 8), (7, 5, 2)])
def test_brute_force(spark, monkeypatch, block_keys, slots, fan):
    monkeypatch.setattr(phrases, "SLOTS", slots)
    monkeypatch.setattr(phrases, "FAN", fan)
    rng = random.Random(3)
    words = ["New", "york", "CITY", "état", "straße", "de", "la", "x\x1cy", " ", "É", "é", "日本", "#", "a" * 300]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b", "  "]) for _ in range(rng.randint(0, 60)))
    rows = [(make(), rng.choice(["en", "en", "fr", None])) for _ in range(200)] + [(None, "en"), ("", "en"), (None, None)] + [("very long " * 3000, "en")]
    rows += [("new york city " * 3, "de")] * 40
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "text string, lang string, f int, word string").repartition(5)
    for least, top in ((10, 2000), (10, 3)):
        got = phrases.collocations(docs, least, top, block_keys).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, got)) == brute(rows, least, top)


def apart(rng):
    """Rows of which each fourth has words of its own, so that phrases are missing in the first partitions."""
    words = [[f"{c}{k}" for k in range(6)] for c in "abcd"]
    return [(" ".join(rng.choice(words[i // 50]) for _ in range(40)), "en") for i in range(200)]


@pytest.mark.parametrize("digest", [0, 3])
def test_phrases_of_one_digest(spark, monkeypatch, digest):
    monkeypatch.setattr(phrases, "DIGEST", digest)
    rows = apart(random.Random(4))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "text string, lang string")
    got = phrases.collocations(docs, 10, 2000, 50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 2000)


def test_each_candidate_is_sent_once(spark):
    rows = [(" ".join(f"w{k}" for k in range(30)), "en")] * 200 + apart(random.Random(5))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    chunks, words = phrases._words(docs)
    assert chunks.select("part").distinct().count() == 8
    frequent = words.where("f >= 10")
    of_words = phrases._stored(frequent.select("w0", "f"), 1, frequent.count(), 1000, "f")
    able = phrases._filtered(chunks, 2, of_words, None, 10, 5)
    sent = phrases._sent(chunks, 2, of_words, None, able).collect()
    often = phrases._counted(chunks, 2, of_words, None, 10, 1000).select("w0", "w1").collect()
    assert set(often) == set(sent) and len(sent) == len(often) > 29  # all eight parts hold all phrases


def test_small_and_empty(spark, none, odd):
    assert phrases.collocations(none).count() == 0
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    got = phrases.collocations(odd).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 2000)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-50, 50, (5000, 2)), axis=0)
    table = phrases.PerfectHash.load(phrases.PerfectHash.build(keys).dump())
    assert sorted(table.lookup(keys).tolist()) == list(range(len(keys)))
    others = rng.integers(51, 10**9, (5000, 2))
    assert (table.lookup(others) == -1).all()
    assert len(phrases.PerfectHash.build(keys[:0]).lookup(keys)) == len(keys)
