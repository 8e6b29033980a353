"""SimHash near-duplicates by tiled exact comparison.

Fingerprints differ in at least as many bits as the population counts of their four 16-bit
quarters differ in sum. Equal fingerprints are merged first. The distinct ones are dealt into
tiles by those four counts (at most 17 ** 4 kinds) and, within a kind, by a hash into tiles of
about TILE fingerprints. A pair of tiles is skipped when the counts differ by more than the
radius in sum; every other pair is compared completely by numpy exclusive-or and bit counts, so
no link is lost. A tile pair hands on a spanning forest of its links, never the links themselves.

Cost for n distinct fingerprints: each is sent to at most 65 kinds of tiles (times the tiles of
a kind, once a kind exceeds TILE), and is compared with about a twentieth of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches
from .common import arrow_rows, free_names, text_bytes, written
from .components import components, forest

#: Fingerprints that a tile should hold, and cells of a comparison that are held at a time.
TILE, CELLS = 4096, 1 << 20


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of all shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    n, counts, digest = max(1, len(words) - shingle_words + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
    for start in range(0, n, 65536):
        bits = np.unpackbits(hashes[start : start + 65536].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and fp (the fingerprint's 64 bits as a signed long) of every row; a null text counts as empty."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle_words, seed) for x in batch.column(len(fields))]
            column = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], column], names=[*keep, "fp"])

    return map_batches(docs.select(*(F.col(f"`{c}`") for c in keep), text_bytes().alias("_text")), hashed, schema)


def _later_kinds(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of the four counts within radius in sum, one of each pair of opposites."""
    steps = range(-radius, radius + 1)
    return [d for d in product(steps, repeat=4) if sum(map(abs, d)) <= radius and d > (0, 0, 0, 0)]


def _compare(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            here, there, same = batch.column(0), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                r = here[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                v = r if same[k].as_py() else there[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                a, b = [], []
                step = max(1, CELLS // len(v))
                for start in range(0, len(r), step):
                    x, y = np.nonzero(np.bitwise_count(r[start : start + step, None] ^ v[None, :]) <= radius)
                    a.append(x + start)
                    b.append(y)
                a, b = np.concatenate(a), np.concatenate(b)
                if same[k].as_py():
                    a, b = a[a < b], b[a < b]
                    nodes = r
                else:
                    b, nodes = b + len(r), np.concatenate([r, v])
                if len(a):
                    x, y = forest(a, b, len(nodes))
                    found_a.append(nodes[x])
                    found_b.append(nodes[y])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f).view(np.int64)) for f in (found_a, found_b)], names=["a", "b"])

    return links


def fingerprint_links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct.fp that differ in radius bits at most.

    distinct has one row for each value of fp and is read several times.
    """
    quarters = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {s}) & 65535")) for s in (0, 16, 32, 48)]
    kind = lambda parts: parts[0] * 4913 + parts[1] * 289 + parts[2] * 17 + parts[3]
    kinds = distinct.select(kind(quarters).alias("kind"), "fp")
    # At most 83,521 rows of two numbers whatever the input.
    tiles = written(kinds.groupBy("kind").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")), "tiles")
    dealt = (
        kinds.join(F.broadcast(tiles), "kind")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .groupBy("kind", "tile", "tiles")
        .agg(F.collect_list("fp").alias("fps"))
    )
    dealt = written(dealt, "tiles")
    parts = [F.expr(e) for e in ("kind div 4913", "kind div 289 % 17", "kind div 17 % 17", "kind % 17")]
    meets = []
    for d in _later_kinds(radius):
        other = [p + x for p, x in zip(parts, d)]
        inside = None
        for o, x in zip(other, d):
            if x:
                ok = o.between(0, 16)
                inside = ok if inside is None else inside & ok
        meets.append(F.when(inside, kind(other).cast("int")))
    visits = dealt.select(F.explode(F.array_compact(F.array(*meets))).alias("kind"), F.col("fps").alias("visitors"))
    visits = visits.join(F.broadcast(tiles), "kind").select("kind", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "visitors", F.lit(False).alias("same"))
    own = dealt.where("tile + 1 < tiles").select(
        "kind", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.col("fps").alias("visitors"), F.lit(False).alias("same")
    )
    residents = dealt.select(F.col("kind").cast("int").alias("kind"), "tile", "fps")
    pairs = residents.join(visits.unionByName(own), ["kind", "tile"]).select("fps", "visitors", "same")
    within = residents.select("fps", F.array().cast("array<long>").alias("visitors"), F.lit(True).alias("same"))
    return map_batches(pairs.unionByName(within), _compare(radius), "a long, b long")


def duplicate_groups(docs: DataFrame, radius: int = 3, shingle_words: int = 3, seed: int = 42, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links of radius bits at most, itself
    included. Null and wordless texts have fingerprint 0 and link like any other. A null doc_id
    keeps its row and is never a component_id, unless a component has no other. Repeated rows
    stay repeated. An empty table gives none. Other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle_words, seed), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct, radius, tile), "a", "b").withColumnRenamed("node", "fp")
    grouped = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(column: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


# Near copies of a given similarity: the same comparison over wider fingerprints finds what may be near, the shingles themselves decide.

#: Words of a fingerprint, and bits that may differ: documents that share 0.8 of all their shingles differ in 39 of 256 on average, with a deviation of 6.
WORDS, WIDE_RADIUS = 4, 54
#: Population counts that a band of tiles covers.
BAND = 32
#: Bytes of shingles' hashes in a block of texts that are compared by their shingles, a text at least.
BLOCK = 2 << 20
_ITEM = np.dtype([("same", "S16"), ("n", "<u4"), ("fp", "<u8", (WORDS,))])


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Further 64-bit hashes from each hash, one column for each word of a fingerprint; the first are the hashes themselves."""
    out = np.empty((len(hashes), WORDS), "<u8")
    out[:, 0] = x = hashes
    for k in range(1, WORDS):  # splitmix64
        x = x + np.uint64(0x9E3779B97F4A7C15)
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def shingle_hashes(text: bytes, shingle_words: int = 5, seed: int = 42) -> tuple[bytes, np.ndarray]:
    """A digest of the lower-cased words, and the sorted hashes of the different shingles; none without words."""
    words = text.lower().split()
    same, digest = xxhash.xxh3_128_digest(b" ".join(words)), xxhash.xxh64_intdigest
    if not words:
        return same, np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if len(words) > shingle_words else [b" ".join(words)]
    return same, np.unique(np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(1, len(words) - shingle_words + 1)))


def _wide(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64 * WORDS, np.int64)
    for start in range(0, len(hashes), 16384):
        bits = np.unpackbits(_spread(hashes[start : start + 16384]).view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64 * WORDS).sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(text: bytes, shingle_words: int = 5, seed: int = 42) -> tuple[bytes, int, np.ndarray]:
    """A digest of the lower-cased words, the number of different shingles, and their fingerprint; zeros without words."""
    same, hashes = shingle_hashes(text, shingle_words, seed)
    return same, len(hashes), _wide(hashes)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The share of two texts' shingles that both have, by their sorted hashes; 1 if neither has any."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / union if (union := len(x) + len(y) - both) else 1.0


def _kind(n: int, ones: int, similarity: float) -> int:
    """The tiles' kind: the number of shingles on a scale on which similar texts are one step apart at most, and the band of the population count."""
    size = int(np.log(n) / -np.log(similarity) + 1e-9) + 1 if n else 0
    return size * 16 + ones // BAND


def wide_near(x: np.ndarray, y: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of x and y that differ in radius bits at most and whose numbers of shingles allow the similarity."""
    a, b, step = [], [], max(1, CELLS // max(1, len(y)))
    first, second = (np.ascontiguousarray(y["fp"][:, k]) for k in (0, 1))
    for start in range(0, len(x), step):
        p = x["fp"][start : start + step]
        half = np.bitwise_count(p[:, 0, None] ^ first)
        half += np.bitwise_count(p[:, 1, None] ^ second)
        i, j = np.nonzero(half <= radius)  # few pairs are left for the other words
        rest = np.bitwise_count(p[i, 2:] ^ y["fp"][j, 2:]).sum(1, dtype=np.int64)
        low, high = np.minimum(x["n"][i + start], y["n"][j]), np.maximum(x["n"][i + start], y["n"][j])
        near = (half[i, j] + rest <= radius) & (low >= similarity * high)
        a.append(i[near] + start)
        b.append(j[near])
    return np.concatenate(a), np.concatenate(b)


def _wide_compare(radius: int, similarity: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here, there, same = batch.column(0), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                x = np.frombuffer(b"".join(here[k].values.to_pylist()), _ITEM)
                own = same[k].as_py()
                y = x if own else np.frombuffer(b"".join(there[k].values.to_pylist()), _ITEM)
                a, b = wide_near(x, y, radius, similarity)
                if own:
                    a, b = a[a < b], b[a < b]
                    nodes = x
                else:
                    b, nodes = b + len(x), np.concatenate([x, y])
                if len(a):
                    i, j = forest(a, b, len(nodes))
                    raw = nodes.tobytes()
                    name = lambda at: pa.array([raw[q * _ITEM.itemsize : q * _ITEM.itemsize + 16] for q in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([name(i), name(j)], names=["a", "b"])

    return links


def _row_digest(docs: DataFrame):
    """A digest of all columns of a row, the same for rows that are alike; columns are hashed one by one, so no text can stand for two columns."""
    each = [F.coalesce(F.md5(F.col(f"`{c}`").cast("string").cast("binary")), F.lit("null")) for c in docs.columns]
    return F.md5(F.concat_ws(",", *each).cast("binary"))


def wide_links(distinct: DataFrame, radius: int, similarity: float, tile: int) -> DataFrame:
    """(a, b): links of distinct (item, kind) whose components are those of all near pairs."""
    # A row for each kind: the steps of the scale up to 2 ** 32 shingles times the bands, under 2,000 for a similarity of 0.8.
    tiles = written(distinct.groupBy("kind").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")), "tiles")
    dealt = (
        distinct.join(F.broadcast(tiles), "kind")
        .withColumn("tile", F.pmod(F.xxhash64("item"), F.col("tiles")).cast("int"))
        .groupBy("kind", "tile", "tiles")
        .agg(F.collect_list("item").alias("items"))
    )
    dealt = written(dealt, "tiles")
    reach, top = -(-radius // BAND), 64 * WORDS // BAND  # tiles of bands farther apart hold no link
    band = F.col("kind") % 16
    near = [(F.lit(d), band + d) for d in range(1, reach + 1)] + [(F.lit(16 + d), band + d) for d in range(-reach, reach + 1)]
    meets = F.array(*(F.when(b.between(0, top), F.col("kind") + d) for d, b in near))
    visits = dealt.select(F.explode(F.array_compact(meets)).alias("kind"), F.col("items").alias("visitors"))
    visits = visits.join(F.broadcast(tiles), "kind").select("kind", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "visitors", F.lit(False).alias("same"))
    own = dealt.where("tile + 1 < tiles").select(
        "kind", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.col("items").alias("visitors"), F.lit(False).alias("same")
    )
    residents = dealt.select("kind", "tile", "items")
    pairs = residents.join(visits.unionByName(own), ["kind", "tile"]).select("items", "visitors", "same")
    within = residents.select("items", F.array().cast("array<binary>").alias("visitors"), F.lit(True).alias("same"))
    return map_batches(pairs.unionByName(within), _wide_compare(radius, similarity), "a binary, b binary")


def _verify_hubs(similarity: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, hubs = batch.column("grams"), batch.column("hub")
            near = [jaccard(np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)) >= similarity for g, h in zip(grams, hubs)]
            columns = [batch.column(c) for c in ("root", "same", "item", "grams")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(near, pa.bool_())], names=["root", "same", "item", "grams", "settled"])

    return verified


def _verify_blocks(radius: int, similarity: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                here, there = (batch.column(c)[k].values for c in ("residents", "visitors"))
                x, y = (np.frombuffer(b"".join(t.field("item").to_pylist()), _ITEM) for t in (here, there))
                settled, own = here.field("settled").to_pylist(), [np.frombuffer(g.as_buffer(), np.uint64) for g in here.field("grams")]
                other = [np.frombuffer(g.as_buffer(), np.uint64) for g in there.field("grams")]
                # Residents, visitors, and a node for the texts that are settled; a visitor among the residents is the same node.
                place = {name: i for i, name in enumerate(x["same"].tolist())}
                seat = [place.setdefault(name, len(place)) for name in y["same"].tolist()]
                parent = list(range(len(place) + 1))

                def root(i: int) -> int:
                    while parent[i] != i:
                        parent[i] = i = parent[parent[i]]
                    return i

                for i, known in enumerate(settled):
                    if known:
                        parent[i] = len(place)
                found = []
                for i, j in zip(*(at.tolist() for at in wide_near(x, y, radius, similarity))):
                    p, q = root(i), root(seat[j])
                    if p != q and jaccard(own[i], other[j]) >= similarity:
                        parent[p] = q
                        found.append((i, j))
                if found:
                    raw = [t.field("same").take([f[e] for f in found]) for e, t in enumerate((here, there))]
                    yield pa.RecordBatch.from_arrays(raw, names=["a", "b"])

    return links


def verified_links(texts: DataFrame, radius: int, similarity: float, shingle_words: int, block: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs of texts of one root that are near by fingerprint and share the similarity by shingles.

    texts (root, _text) holds each text once, roots being components of near fingerprints. Texts are first held against
    the root's own text. What isn't settled by that is compared, block by block, with all texts of its root, so a root whose texts are all near
    its own costs one comparison a text; a root with s bytes of hashes that are not settled sends them s / block times.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, items, grams = [], [], []
            for t in batch.column(1):
                name, hashes = shingle_hashes(t.as_py(), shingle_words)
                same.append(name)
                items.append(np.array((name, len(hashes), _wide(hashes)), _ITEM).tobytes())
                grams.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in (same, items, grams))], names=["root", "same", "item", "grams"])

    spark, columns = texts.sparkSession, "root binary, same binary, item binary, grams binary"
    with arrow_rows(spark, 256):
        sets = written(map_batches(texts, hashed, columns), "sets")
    hubs = sets.where("same = root")
    met = sets.where("same <> root").join(hubs.select("root", F.col("grams").alias("hub")), "root")
    with arrow_rows(spark, 64):
        held = written(map_batches(met, _verify_hubs(similarity), columns + ", settled boolean"), "held")
    opened = held.where("not settled").select("root").distinct()
    live = held.unionByName(hubs.withColumn("settled", F.lit(True))).join(opened, "root", "left_semi")
    blocks = live.groupBy("root").agg(F.ceil(F.sum(F.length("grams")) / F.lit(block)).cast("int").alias("blocks"))
    dealt = live.join(blocks, "root").withColumn("blocks", F.greatest("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    residents = dealt.groupBy("root", "block").agg(F.collect_list(F.struct("same", "item", "grams", "settled")).alias("residents"))
    visitors = dealt.where("not settled").groupBy("root", "block", "blocks").agg(F.collect_list(F.struct("same", "item", "grams")).alias("visitors"))
    visitors = visitors.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "visitors")
    with arrow_rows(spark, 2):
        rest = written(map_batches(residents.join(visitors, ["root", "block"]).select("residents", "visitors"), _verify_blocks(radius, similarity), "a binary, b binary"), "rest")
    return held.where("settled").select(F.col("root").alias("a"), F.col("same").alias("b")).unionByName(rest)


def without_near_copies(
    docs: DataFrame, similarity: float = 0.8, radius: int = WIDE_RADIUS, shingle_words: int = 5, tile: int = TILE, block: int = BLOCK
) -> DataFrame:
    """docs (doc_id, text and others) with one row of each group of near copies, the one with the smallest doc_id.

    Texts are near copies if they share the similarity of their different shingles, counted exactly, and the
    fingerprints of these differ in radius bits at most, by which pairs are found (of pairs with a similarity of just 0.8
    a radius of 54 misses one in two hundred); groups are what such
    links connect, links through other texts included. Equal words (in small case) always link, so
    null, empty and blank texts are one group. Groups go by row, not by doc_id: rows of one doc_id, and
    rows without, stay if their texts differ. Null doc_ids come after others, ties fall by a digest
    of the whole row, and of rows that are alike one stays. An empty table gives none.
    """
    row, = free_names(docs, "_row")
    digest = _row_digest(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, items = [], []
            for x in batch.column(2):
                same, n, fp = wide_fingerprint(x.as_py(), shingle_words)
                kinds.append(_kind(n, int(np.bitwise_count(fp).sum()), similarity))
                items.append(np.array((same, n, fp), _ITEM).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.int32()), pa.array(items, pa.binary())], names=["row", "doc_id", "kind", "item"])

    prints = map_batches(docs.select(digest.alias("row"), F.col("doc_id").cast("long"), text_bytes().alias("_text")), hashed, "row string, doc_id long, kind int, item binary")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best")
    distinct = written(prints.groupBy("item", "kind").agg(best), "prints")
    may = components(wide_links(distinct.select("item", "kind"), radius, similarity, tile), "a", "b").withColumnRenamed("node", "same")
    rows = distinct.select(F.substring("item", 1, 16).alias("same"), F.col("best.row").alias(row)).join(may, "same").select(row, F.col("root").alias("_root"))
    texts = docs.select(digest.alias(row), text_bytes().alias("_text")).join(rows, row).dropDuplicates([row]).select(F.col("_root").alias("root"), "_text")
    roots = components(verified_links(texts, radius, similarity, shingle_words, block), "a", "b").withColumnRenamed("node", "same")
    grouped = distinct.select(F.substring("item", 1, 16).alias("same"), "best").join(roots, "same", "left")
    kept = grouped.groupBy(F.coalesce("root", "same").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return docs.withColumn(row, digest).join(kept, row, "left_semi").dropDuplicates([row]).drop(row)
