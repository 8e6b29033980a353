import random
import re

import numpy as np
import xxhash

from verdictlake.llm import simhash_dedup as s
from verdictlake.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def labels(ids, fps, radius=3):
    f = np.array(fps, np.uint64)
    near, label = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, np.array(ids)
    while True:
        after = np.where(near, label[None, :], (1 << 63) - 1).min(1)
        if (after == label).all():
            return label.tolist()
        label = after


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "Ein Wort"), (9005, "ein  wort"), (9005, "ein  wort")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    fps = [plain(t) for _, t in rows]
    want = sorted(zip((i for i, _ in rows), (f"{f:016x}" for f in fps), labels([i for i, _ in rows], fps)))
    for tile in (s.TILE, 3):
        found = s.duplicate_groups(docs, tile=tile).select("doc_id", s.hexadecimal(), "component_id")
        assert sorted(tuple(r) for r in found.collect()) == want


def test_chains_and_near_fingerprints(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << bit
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for tile in (4096, 5):
        edges = s.fingerprint_links(df, 3, tile)
        root = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        assert [root.get(f, f) for f in signed] == labels(signed, fps)


def test_odd_rows(odd, none):
    rows = s.duplicate_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert s.duplicate_groups(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3)], "a long, b long")
    assert {r["root"] for r in components(edges, "a", "b").collect()} == {0}


def test_near_copies_against_exact_similarity(spark):
    """Copies with changed words: what shares 0.9 of its five-word shingles is linked, what shares under half is not."""
    rng, rows, groups = random.Random(12), [], {}
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    for g in range(60):
        text = [word() for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(text)))
        groups[len(rows) - 1] = g
        for _ in range(rng.randint(0, 3)):
            copy = list(text)
            for _ in range(max(1, len(text) // 200)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
            groups[len(rows) - 1] = g
        rows.append((len(rows), " ".join(text[: len(text) // 2] + [word() for _ in range(len(text) // 2)])))
        groups[len(rows) - 1] = -len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in s.without_near_copies(docs, tile=16).collect()}
    first = {min(i for i in groups if groups[i] == g) for g in set(groups.values())}
    assert kept >= {i for i in first} and len(kept) <= len(first) + 2
    assert kept == {r["doc_id"] for r in s.without_near_copies(docs.repartition(7), tile=4096).collect()}


def test_rows_whose_columns_run_together_stay_apart(spark):
    rows = [(1, "a\x1f1b one two three four five six", "en", "s"), (2, "a", "b one two three four five six", "en\x1f1s"), (2, "a", "b one two three four five six", "en\x1f1s"), (3, None, "null", None), (3, "null", None, None)]
    docs = spark.createDataFrame([(1, *r[1:]) for r in rows[:3]] + [tuple(r) for r in rows[3:]], "doc_id long, text string, lang string, source string")
    assert s.without_near_copies(docs).count() == 4


def test_near_copies_are_those_of_the_shingles(spark):
    """Copies of every similarity around 0.8, in chains, against a plain comparison of all pairs; many blocks and one."""
    rng, texts = random.Random(31), []
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    for _ in range(110):
        text = [word() for _ in range(rng.randint(20, 300))]
        texts.append(text)
        for _ in range(rng.randint(1, 4)):
            text = list(rng.choice([text, texts[-1]]))
            for _ in range(max(1, int(len(text) * rng.uniform(0.005, 0.04)))):
                text[rng.randrange(len(text))] = word()
            texts.append(text)
    texts += [[], ["one"], ["one", "two"], ["One"]]
    sets = [{tuple(w.lower() for w in t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for t in texts]
    near = np.zeros((len(texts), len(texts)), bool)
    prints = [s.wide_fingerprint(" ".join(t).encode())[2] for t in texts]
    sure = missed = 0
    for i in range(len(texts)):
        for j in range(i + 1):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) / union >= 0.8:
                found = int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= s.WIDE_RADIUS
                near[i, j] = near[j, i] = found
                sure, missed = sure + (i != j), missed + (not found)
    assert sure > 80 and missed <= sure // 50
    label = np.arange(len(texts))
    while True:
        after = np.where(near, label[None, :], len(texts)).min(1)
        if (after == label).all():
            break
        label = after
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for block in (s.BLOCK, 4000):
        kept = {r["doc_id"] for r in s.without_near_copies(docs, block=block).collect()}
        assert kept == {i for i in range(len(texts)) if label[i] == i}
