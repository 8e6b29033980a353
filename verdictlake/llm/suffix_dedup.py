"""Removal of bytes that repeat: every string of LENGTH bytes that starts at two places or more, found by suffix arrays.

Every string of LENGTH bytes has a least K-byte gram by hash; neighbouring strings with the same one
form a piece of the text, and equal strings always have the same least gram. Pieces whose gram occurs in
one place only hold nothing that repeats and go no further; equal pieces go on once. The others are dealt by
their gram into shards of about SHARD_BYTES. A shard's pieces are put one after the other, and its suffix
array with common prefixes is made by external induced sorting (induced_sort.py): neighbours that share LENGTH
bytes repeat. A gram with more bytes of pieces than a shard should hold has its pieces dealt over
several shards; each hands on a 128-bit digest for every string of its pieces, once for those that repeat within, packed by
buckets of digests, and digests that meet from two shards repeat, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches, ship_package
from .common import by_bytes, new_folder, text_bytes, written
from .induced_sort import Spill, suffix_array

#: Bytes of a repeated string, of a gram, of a shard, and of texts that are looked at together; strings of a piece at most.
LENGTH, K, SHARD_BYTES, TOGETHER, PIECE = 400, 64, 1 << 20, 1 << 20, 1 << 16
#: Strings of split grams that one task compares by their digests.
BUCKET = 100_000
#: Tuples of a queue that a task holds before it writes them to files in the shared folder.
HELD = 8 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def string_hashes(data: bytes, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of ``length`` (8 or more) bytes of data."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, n = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)), 8
    h = _mix(h)
    while n < length:
        step = min(n, length - n)
        h = _mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        n += step
    return h


def least_grams(v: np.ndarray, length: int, k: int) -> np.ndarray:
    """The least of the hashes v of k-byte grams in each string of ``length`` bytes: minima of windows by minima of blocks."""
    w = length - k + 1
    blocks = np.append(v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pieces(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(number of the text, first string, strings, least gram, whether it occurs in the piece again, digest of the piece's bytes) for all pieces of the texts, which hold a string each."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    start = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(first - start, counts)
    v, w = string_hashes(data, k), length - k + 1
    grams = least_grams(v, length, k)[at]
    fresh = np.append(True, (grams[1:] != grams[:-1]) | (np.diff(at) != 1))
    where = np.flatnonzero(fresh)
    since = np.arange(len(at)) - np.repeat(where, np.diff(np.append(where, len(at))))
    where = np.flatnonzero(fresh | (since % PIECE == 0))
    number = np.diff(np.append(where, len(at)))
    begin = at[where]
    view = memoryview(data)
    grams = grams[where]
    again = np.array([n > w or np.count_nonzero(v[b : b + n + w - 1] == g) > 1 for b, n, g in zip(begin.tolist(), number.tolist(), grams)], bool)
    digests = [xxhash.xxh3_128_digest(view[b : b + n + length - 1]) for b, n in zip(begin.tolist(), number.tolist())]
    text = np.searchsorted(start, begin, "right") - 1
    return text, begin - start[text], number, grams, again, digests


def _cut(length: int, k: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1, TOGETHER):
                text, first, number, grams, again, digests = pieces(batch.column(1).to_pylist(), length, k)
                columns = [batch.column(0).take(pa.array(text)), pa.array(first, pa.int64()), pa.array(number, pa.int64()), pa.array(grams.view(np.int64)), pa.array(again), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["td", "first", "number", "gram", "again", "sd"])

    return cut


def _send(length: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 0, TOGETHER):
                rows = []
                for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(p["shard"], p["salt"], p["sd"], text[p["first"] : p["first"] + p["number"] + length - 1]) for p in wanted]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["shard", "salt", "sd", "piece"])

    return send


def repeats_of(parts: list[bytes], length: int, spill: Spill | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of all parts one after the other: whether each starts anywhere else among them, and whether it is the first of its kind in order; sizes."""
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 2
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 1
    # Of more than 2 * length equal bytes in a row the inner ones are left out: each string that starts there is such a row itself.
    edges = np.flatnonzero(np.append(True, raw[1:] != raw[:-1]))
    widths = np.diff(np.append(edges, len(raw)))
    since = np.arange(len(raw)) - np.repeat(edges, widths)
    kept = (since < length) | (np.repeat(widths, widths) - since <= length)
    place = np.flatnonzero(kept)
    order, shared = suffix_array(np.append(raw[kept], 0), spill)
    near = shared >= length
    repeated = ~kept
    repeated[place[order[1:][near[1:]]]] = True
    leading = np.zeros(len(raw), bool)
    heads = np.append(near[1:], False) & ~near
    repeated[place[order[np.flatnonzero(heads)]]] = True
    leading[place[order[np.flatnonzero(heads)]]] = True
    return repeated, leading, sizes


#: A string of a split gram: its digest, the digest of its piece, its place there.
_STRING = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("sd", "V16"), ("at", "<i8")])
_RANGES = [("sd", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("bucket", pa.int64()), ("strings", pa.binary())]


def _ranges(sds: list[bytes], own: np.ndarray, offset: np.ndarray, hit: np.ndarray) -> dict[str, list]:
    """The runs of hits: own ascends, and so does offset within equal own."""
    own, offset = own[hit], offset[hit]
    fresh = np.append(True, (own[1:] != own[:-1]) | (np.diff(offset) != 1)) if len(own) else np.zeros(0, bool)
    edge = np.flatnonzero(fresh)
    stop = np.append(edge[1:], len(own)) - 1 if len(edge) else edge
    return {"sd": [sds[k] for k in own[edge].tolist()], "low": offset[edge].tolist(), "high": (offset[stop] + 1).tolist()}


def _table(ranges: dict[str, list], buckets: list[int] = (), strings: list[bytes] = ()) -> pa.Table:
    none = [None] * len(buckets)
    columns = [*(ranges[c] + none for c in ("sd", "low", "high")), [-1] * len(ranges["sd"]) + list(buckets), [None] * len(ranges["sd"]) + list(strings)]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _RANGES)], names=[n for n, _ in _RANGES])


def _sort(length: int, folder: str, buckets: int):
    def sort(table: pa.Table) -> pa.Table:
        salted = table.column("salt")[0].as_py() >= 0
        sds, parts = table.column("sd").to_pylist(), table.column("piece").to_pylist()
        spill = Spill(folder, HELD)
        try:
            repeated, leading, sizes = repeats_of(parts, length, spill)
        finally:
            spill.close()
        begin = np.cumsum(sizes + 1) - sizes - 1
        counts = sizes - length + 1
        first = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) - np.repeat(first - begin, counts)  # all strings
        own = np.repeat(np.arange(len(parts)), counts)
        hit, offset = repeated[at], at - begin[own]
        found = _ranges(sds, own, offset, hit)
        if not salted:
            return _table(found)
        told = np.flatnonzero(~hit | leading[at])  # one string of each kind
        data, out = b"\0".join(parts), np.empty(len(told), _STRING)
        out["h1"], out["h2"] = (string_hashes(data, length, seed)[at[told]] for seed in (1, 2))
        out["sd"], out["at"] = np.array(sds, "V16")[own[told]], offset[told]
        bucket = (out["h1"] % np.uint64(buckets)).astype(np.int64)
        out = out[np.argsort(bucket, kind="stable")]
        used, sizes = np.unique(bucket, return_counts=True)
        return _table(found, used.tolist(), [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])])

    return sort


def _meet(table: pa.Table) -> pa.Table:
    """Strings of one bucket that came from more than one shard."""
    rows = np.concatenate([np.frombuffer(b, _STRING) for b in table.column("strings").to_pylist()])
    rows = rows[np.lexsort((rows["h2"], rows["h1"]))]
    same = (rows["h1"][1:] == rows["h1"][:-1]) & (rows["h2"][1:] == rows["h2"][:-1])
    rows = rows[np.append(False, same) | np.append(same, False)]
    sds = sorted({s.tobytes() for s in rows["sd"]})
    place = {s: k for k, s in enumerate(sds)}
    own = np.array([place[s.tobytes()] for s in rows["sd"]], np.int64)
    order = np.lexsort((rows["at"], own))
    return _table(_ranges(sds, own[order], rows["at"][order], np.ones(len(rows), bool)))


def union(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own, digest, last = union([(r["low"], r["high"]) for r in ranges]), hashlib.sha256(), 0
            for a, b in own:
                digest.update(text[last:a])
                last = b
            digest.update(text[last:])
            spans.append([{"start": a, "end": b} for a, b in own])
            kept.append(digest.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.string())], names=["td", "spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of start, end), kept_sha256 for every row of docs (doc_id, text).

    A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere, in the same text or another
    row; rows are told apart by place, so repeated rows lose all bytes if they are that long. Null texts
    are empty, null ids stay, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", text_bytes().alias("text"))
    rows = rows.withColumn("td", F.unhex(F.md5("text")))
    long_ = rows.where(F.octet_length("text") >= length).select("td", "text")
    runs = written(map_batches(long_, _cut(length, k), "td binary, first long, number long, gram long, again boolean, sd binary"), "pieces")
    where = F.struct("td", "first")
    grams = runs.groupBy("gram").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.bool_or("again").alias("again")).where("a <> b or again").select("gram")
    found = written(runs.join(grams, "gram", "left_semi").distinct(), "candidates")
    reps = found.groupBy("sd").agg(F.min(F.struct("td", "first", "number", "gram")).alias("r"), F.max(where).alias("b"))
    reps = reps.select("sd", "r.*", (F.struct("r.td", "r.first") != F.col("b")).alias("often"))
    reps = written(reps, "pieces")
    size = F.col("number") + F.lit(length - 1)
    total = reps.agg(F.sum(size)).first()[0] or 0
    hot = reps.groupBy("gram").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > shard_bytes).select("gram", F.ceil(F.col("bytes") / F.lit(shard_bytes)).cast("int").alias("salts"))
    dealt = reps.join(hot, "gram", "left")
    shard = F.when(F.col("salts").isNull(), F.pmod(F.xxhash64("gram"), F.lit(max(1, -(-total // shard_bytes))))).otherwise(F.col("gram"))
    salt = F.coalesce(F.pmod(F.xxhash64("sd"), F.col("salts")), F.lit(-1)).cast("int")
    sent = dealt.select("td", F.struct("first", "number", "sd", shard.cast("long").alias("shard"), salt.alias("salt")).alias("p")).groupBy("td").agg(F.collect_list("p").alias("wanted"))
    once = long_.dropDuplicates(["td"])
    touched = found.select("td").distinct().join(sent, "td", "left")
    texts = written(once.join(touched, "td").select("td", "text", F.coalesce("wanted", F.array().cast(sent.schema["wanted"].dataType)).alias("wanted")), "texts")
    strings = map_batches(texts.where(F.size("wanted") > 0).select("text", "wanted"), _send(length), "shard long, salt int, sd binary, piece binary")
    kinds = "sd binary, low long, high long, bucket long, strings binary"
    many = reps.join(hot, "gram", "left_semi").agg(F.sum("number")).first()[0] or 0
    sorted_ = written(strings.groupBy("shard", "salt").applyInArrow(_sort(length, new_folder(spark, "queues"), -(-many // BUCKET) or 1), kinds), "repeats")
    met = sorted_.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet, kinds)
    hits = sorted_.where("bucket < 0").unionByName(met).select("sd", "low", "high")
    hits = hits.unionByName(reps.where("often").select("sd", F.lit(0).cast("long").alias("low"), F.col("number").alias("high")))
    ranges = found.select("td", "first", "sd").join(hits, "sd").select("td", F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + F.lit(length - 1)).alias("high")).alias("r"))
    ranges = ranges.groupBy("td").agg(F.collect_list("r").alias("ranges"))
    removed = map_batches(texts.select("td", "text").join(ranges, "td").select("td", "text", "ranges"), _remove, "td binary, spans array<struct<start:long,end:long>>, kept_sha256 string")
    copies = long_.groupBy("td").agg(F.count("*").alias("copies")).where("copies > 1").select("td", F.lit(True).alias("copied"))
    of_text = written(copies.join(removed, "td", "full"), "removed")
    narrow = rows.select("doc_id", "td", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    told = narrow.join(of_text, "td", "left")
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    told = told.withColumn("spans", F.when(F.col("copied"), every).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))))
    kept = F.when(F.col("copied"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "whole"))
    return told.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", kept.alias("kept_sha256")
    )
