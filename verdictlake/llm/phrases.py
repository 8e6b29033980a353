"""Collocations: phrases of two and three words that stand together more often than their parts suggest.

Texts are cut once; chunks of about CHUNK bytes keep the keys of their words and 4-byte places in
that list. Candidates are Apriori-safe: pairs of words that are both frequent, triples of which both
pairs are, and only those whose digest has enough occurrences of all phrases there. Of all parts of the texts
that hold a digest one sends its candidates, so that about as many are sent as there are; a phrase that shares its digest
with another one, which alone was sent, is counted by its keys. Candidates are dealt by hash into blocks of about BLOCK keys, and a task makes of each block a
minimal perfect hash (levels of bits, where keys that share a place go on to the next level) with
the keys stored by slot, which tells candidates from others. Mappers look their phrases up, add
them into numpy arrays by slot, and hand on what is not zero; the arrays of a block are summed in
a tree of FAN at a time. What is frequent in a chunk is looked up once and kept as bits in a file for each chunk, and
phrases of several chunks are looked up together, so that blocks are read for each of them as seldom as memory allows. The counts of parts (words, pairs) are read by slot where a candidate is cut.

Word keys are 64-bit hashes of language and word. Two words of one key would be seen when words
are counted, and another seed is taken then, so counts are exact.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import map_batches, ship_package
from .common import arrow_rows, by_bytes, get, new_folder, put, text_bytes, written

#: Bytes of text of a chunk, keys of a block, arrays that are summed at a time, and bytes of blocks that a worker keeps.
CHUNK, BLOCK, FAN, KEPT = 2 << 20, 200_000, 8, 32 << 20
#: Phrases that a task merges before it sends them on.
PHRASES = 1_000_000
#: Chunks, and texts, that a worker gets at a time.
CHUNKS_AT_ONCE, TEXTS_AT_ONCE = 2, 1000
#: Bytes of texts of all languages that wait for their chunk in a task.
HELD = 4 * CHUNK
#: Bits of a phrase's hash that tell phrases of one range apart.
DIGEST = (1 << 32) - 1
#: Slots that a mapper counts before it hands its arrays on.
SLOTS = 4 << 20
#: Words of a chunk of which three places fit into 63 bits.
WORDS = 2_000_000
#: Piece ends become a line end, A-Z are lower-cased; no UTF-8 text holds the byte that then marks an end.
_LOWER = bytes.maketrans(b".,;:!?\x0b\x0c\r" + bytes(range(65, 91)), b"\n" * 9 + bytes(range(97, 123)))
_END = b"\xff"


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words, with a mark at the end of each piece."""
    return text.translate(_LOWER).replace(b"\n", b" \xff ").split()


def _encode(seed: int):
    lists = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def chunk(lang: str, parts: list[bytes]) -> pa.RecordBatch:
        words = words_of(b"".join(parts))
        places = {_END: 0}
        for w in words:
            if w not in places:
                places[w] = len(places)
        ids = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
        del words
        counts = np.bincount(ids, minlength=len(places))[1:]
        del places[_END]
        start = xxhash.xxh64(lang.encode() + _END, seed)
        keys = np.zeros(len(places), np.uint64)
        for k, w in enumerate(places):
            x = start.copy()
            x.update(w)
            keys[k] = x.intdigest()
        columns = [[[w.decode() for w in places]], [keys.view(np.int64)], [counts]]
        arrays = [pa.array(c, t) for c, t in zip(columns, lists)]
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([lang]), *arrays, pa.array([ids.tobytes()], pa.binary()), part], names=["lang", "words", "keys", "counts", "ids", "part"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _kept.clear()
        texts: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}
        for whole in batches:
            for batch in by_bytes(whole, 1, CHUNK // 4):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    texts.setdefault(lang, []).extend((text, b"\n"))
                    held[lang] = held.get(lang, 0) + len(text)
                for lang in [x for x, n in held.items() if n >= CHUNK]:
                    del held[lang]
                    yield chunk(lang, texts.pop(lang))
                if sum(held.values()) > HELD:  # many languages: the largest goes first
                    lang = max(held, key=held.get)
                    del held[lang]
                    yield chunk(lang, texts.pop(lang))
        for lang in list(texts):
            yield chunk(lang, texts.pop(lang))

    return encoded


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    """64-bit hashes of rows of keys (columns of words), other ones at each level."""
    x = np.full(len(keys), (0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1), np.uint64)
    for column in keys.T:
        x = (x ^ column.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


def _mixed(keys: np.ndarray) -> np.ndarray:
    """The keys, which are hashes, turned by 21 bits each and mixed."""
    x = np.zeros(len(keys), np.uint64)
    for k, column in enumerate(keys.T):
        w = column.view(np.uint64)
        x ^= (w << np.uint64(21 * k)) | (w >> np.uint64(64 - 21 * k)) if k else w
    return x


def place_of(keys: np.ndarray) -> np.ndarray:
    """A place from 0 to 2 ** 31 - 1, of which blocks are ranges."""
    return (_mixed(keys) >> np.uint64(33)).astype(np.int64)


def digests_of(keys: np.ndarray, ranges: int, mask: int) -> np.ndarray:
    """The range of each row's place, and below it 32 bits of its hash or what mask leaves of them."""
    x = _mixed(keys)
    return ((x >> np.uint64(33)).astype(np.int64) * ranges >> 31 << 32) | (x & np.uint64(mask)).astype(np.int64)


def place(width: int):
    """place_of() as a column."""
    turned = lambda w, n: F.shiftleft(w, n).bitwiseOR(F.shiftrightunsigned(w, 64 - n)) if n else w
    x = F.col("w0")
    for k in range(1, width):
        x = x.bitwiseXOR(turned(F.col(f"w{k}"), 21 * k))
    return F.shiftrightunsigned(x, 33)


class PerfectHash:
    """Slots 0 to n - 1 for n different rows of keys; rows stored by slot tell members from others."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray, more: dict[str, np.ndarray]):
        self.levels, self.keys, self.more = levels, keys, more
        self.sums, base = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.sums.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.size = sum(a.nbytes for a in (*levels, *self.sums, keys, *more.values()))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            words = 1 + 2 * len(rest) // 64
            at = _hash(rest, len(levels) + 1) % np.uint64(words * 64)
            met = np.bincount(at.astype(np.int64), minlength=words * 64)
            levels.append(np.packbits(met == 1, bitorder="little").view(np.uint64))
            rest = rest[met[at.astype(np.int64)] > 1]
        out = cls(levels, keys, {})
        slots = out._slots(keys)
        stored = np.empty_like(keys)
        stored[slots] = keys
        return cls(levels, stored, {})

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, sums) in enumerate(zip(self.levels, self.sums)):
            at = (_hash(keys[left], k + 1) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, shift = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1)))
            slots[left[hit]] = sums[at[hit] >> 6] + below
            left = left[~hit]
        return slots

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each row, -1 for rows that are not stored."""
        slots = self._slots(keys)
        seen = np.flatnonzero(slots >= 0)
        slots[seen[(self.keys[slots[seen]] != keys[seen]).any(1)]] = -1
        return slots

    def dump(self) -> bytes:
        """A line of names, types and shapes, then the arrays' bytes one after the other, read without a copy."""
        arrays = {"keys": self.keys, **{f"level{k}": b for k, b in enumerate(self.levels)}, **{f"more_{k}": v for k, v in self.more.items()}}
        head = json.dumps([[name, a.dtype.str, a.shape] for name, a in arrays.items()]).encode()
        head += b" " * (-(len(head) + 1) % 64) + b"\n"
        return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        at = data.index(b"\n") + 1
        found = {}
        for name, kind, shape in json.loads(data[:at]):
            found[name] = np.frombuffer(data, kind, math.prod(shape), at).reshape(shape)
            at += found[name].nbytes
        return cls([a for name, a in found.items() if name.startswith("level")], found["keys"], {name[5:]: a for name, a in found.items() if name.startswith("more_")})


_kept: OrderedDict[str, PerfectHash] = OrderedDict()


def _block(folder: str, block: int) -> PerfectHash:
    """A block's file; a worker keeps up to KEPT bytes of those it read last."""
    uri = f"{folder}/{block}.hash"
    for other in [x for x in _kept if not x.startswith(folder)]:  # one table at a time is looked up often
        if len(_kept) > 8:
            del _kept[other]
    if uri in _kept:
        _kept.move_to_end(uri)
        return _kept[uri]
    _kept[uri] = found = PerfectHash.load(get(uri))
    held = sum(x.size for x in _kept.values())
    while held > KEPT and len(_kept) > 1:
        held -= _kept.popitem(last=False)[1].size
    return found


class Table:
    """Blocks of perfect hashes in a folder that driver and executors share; width columns of keys a row."""

    def __init__(self, folder: str, blocks: int, width: int):
        self.folder, self.blocks, self.width = folder, blocks, width
        self.marks: Marks | None = None

    def each_block(self, keys: np.ndarray) -> Iterator[tuple[int, PerfectHash, np.ndarray]]:
        """(block, its hash, places of keys that may be in it)."""
        if not self.blocks or not len(keys):
            return
        at = place_of(keys) * self.blocks >> 31
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(self.blocks + 1))
        for block in np.flatnonzero(np.diff(ends)).tolist():
            try:
                found = _block(self.folder, block)
            except FileNotFoundError:  # no candidate fell into this block
                continue
            yield block, found, order[ends[block] : ends[block + 1]]

    def read(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """What is stored under names for each row of keys, read by slot; 0 for rows that are not stored."""
        out: list = [np.zeros(len(keys), np.int64) for _ in names]
        for _, found, at in self.each_block(keys):
            slots = found.lookup(keys[at])
            for name, values in zip(names, out):
                values[at[slots >= 0]] = found.more[name][slots[slots >= 0]]
        return out


def _stored(rows: DataFrame, width: int, n: int, block_keys: int, *more: str) -> Table:
    """Rows (w0, w1, ... and the columns named in more) as a table of perfect hashes, made by one task a block."""
    spark, names = rows.sparkSession, [f"w{k}" for k in range(width)]
    blocks = -(-n // block_keys)
    folder = new_folder(spark, "phrases")

    def build(table: pa.Table) -> pa.Table:
        block, keys = table.column("block")[0].as_py(), _keys(table, width)
        out = PerfectHash.build(keys)
        slots = out.lookup(keys)
        for name in more:
            out.more[name] = np.empty(len(keys), np.int64)
            out.more[name][slots] = table.column(name).to_numpy()
        put(f"{folder}/{block}.hash", out.dump())
        return pa.table({"block": pa.array([block], pa.int64())})

    if blocks:
        dealt = rows.select(*names, *more, F.shiftright(place(width) * F.lit(blocks), 31).cast("long").alias("block"))
        dealt.groupBy("block").applyInArrow(build, "block long").agg(F.count("*")).first()
    return Table(folder, blocks, width)


def _keys(table, width: int) -> np.ndarray:
    return np.column_stack([table.column(k).to_numpy() for k in range(width)]).astype(np.int64).reshape(-1, width)


class Marks:
    """Which words of a chunk are frequent, and at which places frequent pairs begin, as bits in a file for each chunk: looked up once, read by all later passes."""

    def __init__(self, folder: str):
        self.folder = folder

    def _uri(self, kind: str, keys: np.ndarray, ids: np.ndarray) -> str:
        return f"{self.folder}/{kind}-{xxhash.xxh3_128(keys.tobytes()).hexdigest()}-{xxhash.xxh3_128(ids.tobytes()).hexdigest()}"

    def words(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each number in ids whether it is a frequent word; 0 is a piece's end."""
        return np.append(False, self._read("words", keys, ids, len(keys)))

    def pairs(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each place whether a frequent pair begins there."""
        return self._read("pairs", keys, ids, len(ids))

    def _read(self, kind: str, keys: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(get(self._uri(kind, keys, ids)), np.uint8), count=n).astype(bool)

    def write(self, kind: str, keys: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> None:
        put(self._uri(kind, keys, ids), np.packbits(bits).tobytes())


def _marked(chunks: DataFrame, marks: Marks, words: Table | None, pairs: Table | None) -> None:
    """Writes what is frequent in each chunk, by the table of words or of pairs. Chunks of about PHRASES rows are looked up together: a table of many blocks is read once for all of them."""

    def looked_up(found: list[tuple]) -> None:
        rows = np.concatenate([x[2] for x in found])
        often = (words or pairs).read(rows, "f")[0] > 0
        for keys, ids, own, at, of in found:
            fit, often = often[: len(own)], often[len(own) :]
            if words:
                marks.write("words", keys, ids, fit)
            else:
                bits = np.zeros(len(ids), bool)
                bits[at] = fit[of]
                marks.write("pairs", keys, ids, bits)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, n = [], 0, 0
        for keys, ids, _ in _chunks(batches):
            if words:
                found.append((keys, ids, np.ascontiguousarray(keys[:, None]), None, None))
            else:
                at, numbers = _pairs(keys, ids, marks)
                unique, of = np.unique(numbers, return_inverse=True)
                found.append((keys, ids, _pair_rows(unique, keys), at, of.astype(np.int32)))
            held, n = held + len(found[-1][2]), n + 1
            if held >= PHRASES // 2:
                looked_up(found)
                found, held = [], 0
        if found:
            looked_up(found)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    with arrow_rows(chunks.sparkSession, CHUNKS_AT_ONCE):
        map_batches(chunks.select("keys", "ids", "part"), marked, "n long").agg(F.sum("n")).first()


def _marks(chunks: DataFrame, words: Table, pairs: Table | None) -> Marks:
    """The chunks' marks by the tables given, written when they are first asked for."""
    if words.marks is None:
        words.marks = Marks(new_folder(chunks.sparkSession, "marks"))
        _marked(chunks, words.marks, words, None)
    if pairs is not None and pairs.marks is None:
        _marked(chunks, words.marks, None, pairs)
        pairs.marks = words.marks
    return words.marks


def _pairs(keys: np.ndarray, ids: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of frequent words, and the pairs' numbers in the chunk (places of the two words in one)."""
    often = marks.words(keys, ids)
    at = np.flatnonzero(often[ids[:-1]] & often[ids[1:]])
    return at, ids[at].astype(np.int64) * (len(keys) + 1) + ids[at + 1]


def _pair_rows(numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
    n = len(keys) + 1
    return keys[np.column_stack([numbers // n, numbers % n]) - 1].reshape(-1, 2)


def _phrases(width: int, keys: np.ndarray, ids: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's different Apriori-safe phrases as rows of keys, and how often each occurs."""
    n = len(keys) + 1
    if width == 2:
        unique, counts = np.unique(_pairs(keys, ids, marks)[1], return_counts=True)
        return _pair_rows(unique, keys), counts
    often = marks.pairs(keys, ids)
    start = np.flatnonzero(often[:-1] & often[1:])
    first = ids[start].astype(np.int64) * n + ids[start + 1]
    if n < WORDS:
        unique, counts = np.unique(first * n + ids[start + 2], return_counts=True)
        unique, last = unique // n, unique % n
    else:  # three places need more than 63 bits
        rows, counts = np.unique(np.column_stack([first, ids[start + 2]]), axis=0, return_counts=True)
        unique, last = rows.reshape(-1, 2).T
    return np.column_stack([_pair_rows(unique, keys), keys[last - 1]]).reshape(-1, 3), counts


def _different(found: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows of keys, each once."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T)]
    rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))] if len(rows) else rows
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].values.to_numpy(zero_copy_only=False), np.frombuffer(batch.column(1)[k].as_buffer(), np.int32), batch.column(2)[k].as_py()


def _together(batches: Iterator[pa.RecordBatch], width: int, marks: Marks) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Phrases, counts and the part of chunks of one part, about PHRASES / 2 rows at a time (a phrase comes once for each chunk that has it): what they are looked up in is read once for all."""
    found, held, last = [], 0, None
    for keys, ids, part in _chunks(batches):
        if found and (held >= PHRASES // 2 or part != last):
            yield *(np.concatenate(x) for x in zip(*found)), last
            found, held = [], 0
        found.append(_phrases(width, keys, ids, marks))
        held, last = held + len(found[-1][0]), part
    if found:
        yield *(np.concatenate(x) for x in zip(*found)), last


_places: OrderedDict[str, np.ndarray] = OrderedDict()


class Filter:
    """Digests of which the phrases occur often enough together, in a file for each range, and the part of the texts that sends them, in another; other phrases can't."""

    def __init__(self, folder: str, ranges: int, mask: int):
        self.folder, self.ranges, self.mask = folder, ranges, mask

    def passes(self, rows: np.ndarray, part: int | None = None) -> np.ndarray:
        """Whether each row has such a digest; with a part, one that this part sends."""
        out = np.zeros(len(rows), bool)
        if not len(rows):
            return out
        digests = digests_of(rows, self.ranges, self.mask)
        order = np.argsort(digests, kind="stable")
        digests = digests[order]
        ends = np.searchsorted(digests, np.arange(self.ranges + 1) << 32)
        low = digests.astype(np.uint32)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            own, often = slice(ends[k], ends[k + 1]), self._file(f"{k}", np.uint32)
            if len(often):
                where = np.minimum(np.searchsorted(often, low[own]), len(often) - 1)
                hit = often[where] == low[own]
                out[order[own]] = hit if part is None else hit & (self._file(f"{k}-parts", np.int32)[where] == part)
        return out

    def _file(self, name: str, kind: type) -> np.ndarray:
        uri = f"{self.folder}/{name}"
        if uri not in _places:
            try:
                _places[uri] = np.frombuffer(get(uri), kind)
            except FileNotFoundError:  # no phrase fell into this range
                _places[uri] = np.zeros(0, kind)
            held = sum(x.nbytes for x in _places.values())
            while held > KEPT and len(_places) > 1:
                held -= _places.popitem(last=False)[1].nbytes
        return _places[uri]


def _filtered(chunks: DataFrame, width: int, words: Table, pairs: Table | None, least: int, ranges: int) -> Filter:
    """What phrases of one digest count together bounds each of them, so digests below ``least`` leave no candidate. Counts travel packed, cut at least."""
    spark = chunks.sparkSession
    marks = _marks(chunks, words, pairs)
    folder, kind, mask = new_folder(spark, "places"), np.dtype(np.uint8 if least < 256 else np.uint32), DIGEST

    def packed(found: list[tuple[np.ndarray, np.ndarray]], part: int) -> pa.RecordBatch:
        digests, counts = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(digests, kind="stable")
        digests, counts = digests[order], counts[order]
        start = np.flatnonzero(np.append(True, digests[1:] != digests[:-1])[: len(digests)])
        counts = np.minimum(np.add.reduceat(counts, start), least).astype(kind) if len(start) else counts.astype(kind)
        digests = digests[start]
        at = np.searchsorted(digests, np.arange(ranges + 1) << 32)
        used = np.flatnonzero(np.diff(at))
        columns = [[x[at[k] : at[k + 1]].tobytes() for k in used] for x in (digests.astype(np.uint32), counts)]
        names = ["range", "places", "counts", "part"]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(c, pa.binary()) for c in columns), pa.array([part] * len(used), pa.int32())], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, last = [], 0, None
        for keys, ids, part in _chunks(batches):
            if found and (held >= PHRASES or part != last):
                yield packed(found, last)
                found, held = [], 0
            rows, counts = _phrases(width, keys, ids, marks)
            found.append((digests_of(rows, ranges, mask), counts))
            held, last = held + len(rows), part
        if found:
            yield packed(found, last)

    def often(table: pa.Table) -> pa.Table:
        k = table.column("range")[0].as_py()
        each = [np.frombuffer(b, np.uint32) for b in table.column("places").to_pylist()]
        place, part = np.concatenate(each), np.repeat(table.column("part").to_numpy(), [len(x) for x in each])
        counts = np.concatenate([np.frombuffer(b, kind) for b in table.column("counts").to_pylist()])
        order = np.argsort(place, kind="stable")
        place = place[order]
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        enough = np.add.reduceat(counts[order].astype(np.int64), start) >= least
        put(f"{folder}/{k}-parts", np.minimum.reduceat(part[order], start)[enough].astype(np.int32).tobytes())
        put(f"{folder}/{k}", place[start[enough]].tobytes())
        return pa.table({"range": pa.array([k], pa.int64())})

    with arrow_rows(spark, CHUNKS_AT_ONCE):
        sent = map_batches(chunks.select("keys", "ids", "part"), hashed, "range long, places binary, counts binary, part int")
        sent.groupBy("range").applyInArrow(often, "range long").agg(F.count("*")).first()
    return Filter(folder, ranges, mask)


def _sent(chunks: DataFrame, width: int, words: Table, pairs: Table | None, able: Filter) -> DataFrame:
    """(w0, w1, ...) of candidates, each from the part of the texts that sends its digest; it comes again only from further tasks with that part."""
    names, marks = [f"w{k}" for k in range(width)], _marks(chunks, words, pairs)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for rows, _, part in _together(batches, width, marks):
            found.append(rows[able.passes(rows, part)])
            held += len(found[-1])
            if held >= PHRASES:
                yield _different(found, names)
                found, held = [], 0
        if found:
            yield _different(found, names)

    return map_batches(chunks.select("keys", "ids", "part"), seen, ", ".join(f"{c} long" for c in names))


def _counted(chunks: DataFrame, width: int, words: Table, pairs: Table | None, least: int, block_keys: int) -> DataFrame:
    """(w0, w1, ..., f) of all phrases of width words that occur at least ``least`` times."""
    names = [f"w{k}" for k in range(width)]
    fields = ", ".join(f"{c} long" for c in names)

    spark, marks = chunks.sparkSession, _marks(chunks, words, pairs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(chunks.count() // 2, 10_000))
    able = _filtered(chunks, width, words, pairs, least, parts)

    with arrow_rows(spark, CHUNKS_AT_ONCE):  # merged in the mapper and after the shuffle: not in between, where a task's phrases would be held again
        candidates = written(_sent(chunks, width, words, pairs, able).repartition(parts, *names).distinct(), "candidates")
    n = candidates.count()
    table = _stored(candidates, width, n, block_keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows, counts, _ in _together(batches, width, marks):
            fit = able.passes(rows)
            rows, counts = rows[fit], counts[fit]
            stored = np.zeros(len(rows), bool)
            for block, found, at in table.each_block(rows):
                slots = found.lookup(rows[at])
                at, slots = at[slots >= 0], slots[slots >= 0]
                stored[at] = True
                own = sums.setdefault(block, np.zeros(len(found.keys), np.int32))
                own += np.bincount(slots, weights=counts[at], minlength=len(own)).astype(np.int32)  # a task's text has fewer words
            if not stored.all():  # another phrase of its digest was sent
                yield _array_row(-1, np.ascontiguousarray(rows[~stored]), counts[~stored].astype(np.int64))
            if sum(map(len, sums.values())) > SLOTS:
                yield _arrays(sums)
                sums = {}
        if sums:
            yield _arrays(sums)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for block, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots = np.concatenate([np.frombuffer(p["slots"], np.int32) for p in parts])
                counts = np.concatenate([np.frombuffer(p["counts"], np.int64) for p in parts])
                total = np.zeros(int(slots.max()) + 1, np.int64)
                np.add.at(total, slots, counts)
                out[block] = total
            yield _arrays(out)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, slots, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                slots, counts = np.frombuffer(slots, np.int32), np.frombuffer(counts, np.int64)
                rows = _block(table.folder, block).keys[slots[counts >= least]]
                columns = [*(np.ascontiguousarray(c) for c in rows.T), counts[counts >= least]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*names, "f"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(batch.column(k).to_pylist() for k in range(2))):
                columns = [*(np.ascontiguousarray(c) for c in np.frombuffer(keys, np.int64).reshape(-1, width).T), np.frombuffer(counts, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*names, "f"])

    if not n:
        return candidates.withColumn("f", F.lit(0).cast("long"))
    sums = map_batches(chunks.select("keys", "ids", "part"), counted, _SUMS)
    with arrow_rows(spark, CHUNKS_AT_ONCE):
        sums = written(sums.withColumn("part", F.spark_partition_id()), "sums")
    rest, sums = sums.where("block < 0").select("slots", "counts"), sums.where("block >= 0")
    parts = sums.agg(F.max("part")).first()[0]
    while True:
        parts = -1 if parts is None else parts // FAN
        tree = sums.groupBy("block", F.expr(f"part div {FAN}").cast("int").alias("part")).agg(F.collect_list(F.struct("slots", "counts")).alias("arrays"))
        # Written each time: two Python steps in one stage would take two workers a core, which stay.
        sums = written(map_batches(tree.select("block", "arrays", "part"), _with_part(summed), f"{_SUMS}, part int"), "sums")
        if parts < 1:
            break
    found = written(map_batches(sums.select("block", "slots", "counts"), often, f"{fields}, f long"), "often")
    if not rest.limit(1).count():
        return found
    more = map_batches(rest, unpacked, f"{fields}, f long").groupBy(*names).agg(F.sum("f").alias("f"))
    return found.unionByName(written(more.where(F.col("f") >= least), "often"))


_SUMS = "block long, slots binary, counts binary"


def _with_part(function):
    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for out in function(iter([batch.slice(k, 1).select([0, 1])])):
                    yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2).slice(k, 1)], names=["block", "slots", "counts", "part"])

    return parted


def _arrays(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    slots = [np.flatnonzero(x).astype(np.int32) for x in sums.values()]
    counts = [x[s].astype(np.int64).tobytes() for x, s in zip(sums.values(), slots)]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in slots], pa.binary()), pa.array(counts, pa.binary())], names=["block", "slots", "counts"])


def _array_row(block: int, slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, slots.tobytes(), counts.tobytes()), kinds)], names=["block", "slots", "counts"])


def _words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks, and (key, lang, word, f) of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes().alias("_text"))
    for seed in range(64):
        with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
            chunks = written(map_batches(texts, _encode(seed), "lang string, words array<string>, keys array<long>, counts array<long>, ids binary, part int"), "chunks")
        each = chunks.select("lang", F.explode(F.arrays_zip("words", "keys", "counts")).alias("x")).select("lang", "x.words", "x.keys", "x.counts")
        told = F.struct("lang", F.col("words").alias("word"))
        words = written(each.groupBy(F.col("keys").alias("w0")).agg(F.min(told).alias("told"), F.max(told).alias("other"), F.sum("counts").alias("f")), "words")
        if not words.where("told <> other or w0 = 0").limit(1).count():
            return chunks, words.select("w0", "told.lang", "told.word", "f")
    raise RuntimeError("no seed gives every word a key of its own")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, block_keys: int = BLOCK) -> DataFrame:
    """The ``top`` collocations of each language of docs (text, lang): lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, null languages are ``und``; a language without a phrase of ``least``
    occurrences gives no rows, nor does an empty table. Equal scores fall by a, then by phrase in
    UTF-8 byte order. Rows count as often as they occur, other columns are ignored.
    """
    ship_package(docs.sparkSession)
    chunks, words = _words(docs)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = written(words.where(F.col("f") >= least), "frequent")
    of_words = _stored(frequent.select("w0", "f"), 1, frequent.count(), block_keys, "f")
    pairs = _counted(chunks, 2, of_words, None, least, block_keys)
    of_pairs = _stored(pairs, 2, pairs.count(), block_keys, "f")
    triples = _counted(chunks, 3, of_words, of_pairs, least, block_keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = _keys(batch, 3), []
            ones = [of_words.read(np.ascontiguousarray(keys[:, k : k + 1]), "f")[0] for k in range(3)]
            first, last = (of_pairs.read(np.ascontiguousarray(keys[:, k : k + 2]), "f")[0] for k in (0, 1))
            three = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            out = [ones[0], np.where(three, last, ones[1]), np.where(three, first, 0), np.where(three, ones[2], 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=["w0", "w1", "w2", "a", "three", "l1", "r1", "l2", "r2"])

    both = pairs.select("w0", "w1", F.lit(0).cast("long").alias("w2"), F.col("f").alias("a"), F.lit(False).alias("three")).unionByName(
        triples.select("w0", "w1", "w2", F.col("f").alias("a"), F.lit(True).alias("three"))
    )
    cuts = map_batches(both, cut, "w0 long, w1 long, w2 long, a long, three boolean, l1 long, r1 long, l2 long, r2 long")
    inner = triples.select(F.explode(F.array(F.struct("w0", "w1"), F.struct(F.col("w1").alias("w0"), F.col("w2").alias("w1")))).alias("p"), "f")
    inner = inner.groupBy("p.w0", "p.w1").agg(F.max("f").alias("longer")).withColumn("three", F.lit(False))
    kept = cuts.join(inner, ["w0", "w1", "three"], "left").where("longer is null or 100 * longer < 50 * a")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    wide = kept.select("*", (exact("a") * exact("a")).alias("aa"))
    score = lambda l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * aa) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")
    scored = wide.select("*", score("l1", "r1").alias("s1"), F.when(F.col("three"), score("l2", "r2")).alias("s2"))
    second = F.col("three") & (F.col("s2") < F.col("s1"))
    scored = scored.select("w0", "w1", "w2", "three", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    text = lambda k: frequent.select(F.col("w0").alias(f"w{k}"), F.col("word").alias(f"t{k}"), *(["lang"] if not k else []))
    told = scored.join(text(0), "w0").join(text(1), "w1").join(text(2), "w2", "left").withColumn("phrase", F.concat_ws(" ", "t0", "t1", "t2"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS MATERIALIZED (
  SELECT lang, g, count(*) AS f FROM (
    SELECT lang, unnest([[x] for x in w]) AS g FROM lists
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) FROM lists WHERE len(w) > 1
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) FROM lists WHERE len(w) > 2
  ) GROUP BY 1, 2
), n AS (SELECT lang, sum(f) AS n FROM grams WHERE len(g) = 1 GROUP BY 1
), cand AS MATERIALIZED (SELECT * FROM grams WHERE f >= 10 AND len(g) > 1
), kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand t WHERE len(c.g) = 2 AND len(t.g) = 3 AND t.lang = c.lang AND t.g[1:2] = c.g AND 100 * t.f >= 50 * c.f)
    AND NOT EXISTS (SELECT 1 FROM cand t WHERE len(c.g) = 2 AND len(t.g) = 3 AND t.lang = c.lang AND t.g[2:3] = c.g AND 100 * t.f >= 50 * c.f)
), cuts AS (
  SELECT k.lang, k.g, k.f AS a, u.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * k.f * k.f) // (x.f::HUGEINT * y.f) AS score
  FROM kept k, unnest(range(1, len(k.g))) AS u(cut)
  JOIN grams x ON x.lang = k.lang AND x.g = k.g[1:u.cut] JOIN grams y ON y.lang = k.lang AND y.g = k.g[u.cut + 1:len(k.g)]
), low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), told AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM low
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM told)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
