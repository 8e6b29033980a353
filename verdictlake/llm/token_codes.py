"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. A level holds one chunk of every id that
reaches it, a bitmap tells which of these continue on the next level, and a rank directory counts
the ones before every 512th bit. The chunk of token i on the next level is at rank(i), so any
token is read with one step a level, and no block is decoded.

File layout (little endian): the magic ``DAC1``, counts of documents, tokens and levels (three
64-bit numbers) and each level's length; then document ids, a flag byte for each (0: null) and the
end of each document in tokens; then for each level its chunks, its bitmap (bit 0 first, padded
to whole 512-bit runs) and its rank directory (32-bit).
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_batches
from .common import by_bytes, free_names, get, new_folder, put, text_bytes, written

MAGIC = b"DAC1"
#: Bits that a rank directory's entry covers.
RUN = 512
#: Tokens after which a file is closed, bytes of text that a range of documents should hold, most ranges (a number for each goes through one task).
FILE_TOKENS, RANGE_BYTES, MOST_RANGES = 4_000_000, 16_000_000, 65_536
#: Bytes of a worker's memo (twice: the last full one is kept), an entry's without its word and ids, and the bytes of the longest word kept.
MEMO_BYTES, MEMO_ENTRY, MEMO_LONGEST = 120 << 20, 180, 64
#: Bytes of text that are encoded together (one document at least).
PART_BYTES = 2 << 20

MARKS = frozenset(bytes([b]) for b in b".,;:!?")
#: Small letters that no normalisation changes and that make one pre-token; words of these are encoded so many at a time, side by side.
_LETTERS, ABREAST = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch, 500


def encode_codes(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of unsigned ids: chunks, bitmap, rank directory."""
    levels, rest = [], np.asarray(ids).astype(np.uint64)
    while True:
        more = rest > 255
        bits = np.zeros(-(-max(1, len(rest)) // RUN) * RUN, np.uint8)
        bits[: len(rest)] = more
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, RUN).sum(1, dtype=np.int64))])[:-1]
        levels.append(((rest & np.uint64(255)).astype(np.uint8), np.packbits(bits, bitorder="little"), ranks.astype("<u4")))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(8)


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file: documents in the given order, their token counts, all ids one after another."""
    levels = encode_codes(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        MAGIC,
        np.array([len(doc_ids), len(ids), len(levels), *(len(x[0]) for x in levels)], "<i8").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        known.tobytes(),
        np.cumsum(np.array(lengths, "<i8")).astype("<i8").tobytes(),
    ]
    for chunks, bitmap, ranks in levels:
        parts += [chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class CodeFile:
    """Random access to the tokens of a file's bytes."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_tokens, depth = np.frombuffer(raw, "<i8", 3, 4).tolist()
        sizes, at = np.frombuffer(raw, "<i8", depth, 28).tolist(), 28 + 8 * depth
        ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        known = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known.tolist())]
        self.ends = np.frombuffer(raw, "<i8", self.n_docs, at + 9 * self.n_docs)
        at += 17 * self.n_docs
        self.levels = []
        for n in sizes:
            runs = -(-max(1, n) // RUN)
            chunks, bitmap = np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, runs * RUN // 8, at + n)
            self.levels.append((chunks, bitmap, np.frombuffer(raw, "<u4", runs, at + n + len(bitmap))))
            at += n + len(bitmap) + 4 * runs

    def _rank(self, level: int, i: int) -> int:
        """How many tokens before the i-th one of the level continue."""
        _, bitmap, ranks = self.levels[level]
        run = min(i // RUN, len(ranks) - 1)
        start = run * RUN // 8
        ones = np.bitwise_count(bitmap[start : i >> 3]).sum(dtype=np.int64)
        rest = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[run]) + int(ones) + rest.bit_count()

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        value, level = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            value |= int(chunks[i]) << 8 * level
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(level, i)
            level += 1

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The tokens from start to stop, read from each level's own stretch alone."""
        out = np.zeros(stop - start, np.uint64)
        where = np.arange(stop - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:stop].astype(np.uint64) << np.uint64(8 * level)
            first = start >> 3
            bits = np.unpackbits(bitmap[first : (stop + 7) >> 3], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            start = self._rank(level, start)
            where = where[bits]
            stop = start + len(where)
        return out

    def document(self, k: int) -> tuple[int, np.ndarray]:
        """Where the k-th document starts in the file, and its tokens."""
        start = int(self.ends[k - 1]) if k else 0
        return start, self.tokens(start, int(self.ends[k]))


class WordEncoder:
    """The ids of whole texts as little-endian 16- or 32-bit numbers, for a tokenizer that drops white space between words.

    Texts are cut at spaces and line feeds, and words that recur are encoded once while the memo
    holds them. A text that holds an added token of the tokenizer (in any case of letters) is encoded
    as a whole, since such tokens are found before anything else.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.lowers = '"Lowercase"' in self.tokenizer.to_str()
        self.added = tuple(t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        # Which tokens end a pre-token, for tokenizers that mark them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _abreast(self, words: list[bytes]) -> list[bytes]:
        """_batch() of words of one pre-token each: many in one text, whose ids are parted where a pre-token ends."""
        out, width = [], np.dtype(self.kind).itemsize
        lots = [words[i : i + ABREAST] for i in range(0, len(words), ABREAST)]
        found = self.tokenizer.encode_batch_fast([b" ".join(lot).decode() for lot in lots], add_special_tokens=False)
        for lot, x in zip(lots, found):
            ids = np.array(x.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(stops) != len(lot) or stops[-1] != ids.nbytes:
                out += self._batch(lot)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        # The tokenizer lower-cases after composing characters; without combining marks the order is the same.
        low = [t.lower() for t in texts]
        whole = {k for k, t in enumerate(low) if any(x in t for x in self.added)}
        small = [b"" if k in whole else t if not self.lowers or b"\xcc" in t or b"\xcd" in t else low[k] for k, t in enumerate(texts)]
        cut = [t.replace(b"\n", b" ").split(b" ") for t in small]
        if self.held > MEMO_BYTES:
            self.old, self.words, self.held = self.words, {b"": b""}, 0
        words, old, new, marked, added = self.words, self.old, set(), [], {}
        known_before = old.get
        for word in set().union(*cut).difference(words):
            if (known := known_before(word)) is not None:
                added[word] = known
            elif word[-1:] in MARKS and word[-2:-1].isalpha():
                # Letters and a mark after them are tokenized apart, so the letters' ids serve every mark.
                stem, mark = word[:-1], word[-1:]
                marked.append((word, stem, mark))
                for part in (stem, mark):
                    if part not in words and part not in added:
                        if (known := known_before(part)) is not None:
                            added[part] = known
                        else:
                            new.add(part)
            else:
                new.add(word)
        if new:
            plain = [w for w in new if _LETTERS(w)]
            odd = list(new.difference(plain))
            added.update(zip(plain, self._abreast(plain)))
            added.update(zip(odd, self._batch(odd)))
        words.update(added)
        for word, stem, mark in marked:
            words[word] = added[word] = words[stem] + words[mark]
        self.held += MEMO_ENTRY * len(added) + sum(map(len, added)) + sum(map(len, added.values()))
        take = words.__getitem__
        out = [b"".join(map(take, x)) for x in cut]
        for word in [w for w in added if len(w) > MEMO_LONGEST]:  # what is long serves its own call alone
            self.held -= MEMO_ENTRY + len(word) + len(words.pop(word))
        if whole:
            for k, ids in zip(sorted(whole), self._batch([texts[k] for k in sorted(whole)])):
                out[k] = ids
        return out


@lru_cache(maxsize=1)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def write_codes(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts, each closed by end_id, in ascending doc_id order (null last).

    Returns a written table of the files: uri, tokens and before (the tokens of all files before
    it). Texts are shuffled by ranges of doc_id, of which Spark samples the bounds; rows of one
    doc_id, and those without, are dealt over as many ranges as they need by a digest of their text,
    so the order among them is by that digest, and by place where that is the same. A null or empty
    text has end_id alone. Repeated rows stay repeated, other columns are ignored, an empty table
    gives no file. folder is in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "codes")
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-size // RANGE_BYTES)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        end = np.array([end_id], encoder.kind).tobytes()
        doc_ids, parts, held, files, made = [], [], 0, 0, []
        place = TaskContext.get().partitionId()

        def close() -> None:
            nonlocal doc_ids, parts, held, files
            uri = f"{folder}/part-{place:06d}-{files:06d}.dac"
            lengths = [len(x) // np.dtype(encoder.kind).itemsize for x in parts]
            put(uri, pack(doc_ids, lengths, np.frombuffer(b"".join(parts), encoder.kind)))
            made.append((place, files, uri, sum(lengths)))
            doc_ids, parts, held, files = [], [], 0, files + 1

        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                for doc, ids in zip(part.column(0).cast(pa.int64()).to_pylist(), encoder.encode_all(part.column(1).to_pylist())):
                    if held >= FILE_TOKENS:
                        close()
                    doc_ids.append(doc)
                    parts.append(ids + end)
                    held += len(parts[-1]) // np.dtype(encoder.kind).itemsize
        if parts:
            close()
        columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "file", "uri", "tokens"])

    text, digest, row = free_names(docs.select("doc_id"), "text", "digest", "row")
    rows = docs.select("doc_id", text_bytes().alias(text), F.xxhash64("text").alias(digest), F.monotonically_increasing_id().alias(row))
    order = [F.col("doc_id").asc_nulls_last(), F.col(digest), F.col(row)]
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", text)
    made = written(map_batches(ordered, write, "place int, file int, uri string, tokens long"), "files")
    # A row for each range: MOST_RANGES at most, so their running sum and its broadcast are bounded.
    places = made.groupBy("place").agg(F.sum("tokens").alias("all")).withColumn("start", F.sum("all").over(Window.orderBy("place")) - F.col("all"))
    within = F.sum("tokens").over(Window.partitionBy("place").orderBy("file")) - F.col("tokens")
    files = made.withColumn("within", within).join(F.broadcast(places), "place")
    return written(files.select("uri", "tokens", (F.col("start") + F.col("within")).alias("before")), "files")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files of write_codes(); no files give no rows."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(*(c.to_pylist() for c in batch.columns)):
                file = CodeFile(get(uri))
                ids = memoryview(file.tokens(0, file.n_tokens).astype("<u4").tobytes())  # FILE_TOKENS and one document at most
                cuts = [0, *file.ends.tolist()]
                starts = [before + x for x in cuts[:-1]]
                sizes = [b - a for a, b in zip(cuts, cuts[1:])]
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (file.doc_ids, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(10_000, files.count()))
    return map_batches(files.select("uri", "before").repartition(tasks), read, schema)
