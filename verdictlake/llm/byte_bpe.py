"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that the vocabulary can merge is put
into the bucket of its merge rank as the position of its left part. A bitmap over ranks, with
bitmaps of its non-empty words on two further levels, gives the lowest rank by three
find-first-set steps. All pairs of that rank are taken from left to right; an entry whose pair
has changed since is stale and skipped. One merge costs a constant number of steps, so a
pre-token of n bytes takes O(n) queue steps however long it is (plus sorting within a bucket).

Space-separated words recur, so each Python worker keeps the packed ids of those met since its
memo, which is bounded in bytes, was last full; every entry came from the queue.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches
from .common import by_bytes, text_bytes

#: Bytes of a worker's memo (twice: the last full memo is kept), an entry's without its characters and ids, and the characters of the longest word kept.
MEMO_BYTES, MEMO_ENTRY, MEMO_CHARS = 40 << 20, 190, 48
#: Characters of text that are encoded together (one document at least), which bounds what is held beside the memo.
PART_BYTES = 1 << 20
MARKS = frozenset(".,;:!?")
#: Pre-tokens of up to SHORT bytes have their queues stepped together, TOGETHER at a time.
SHORT, TOGETHER = 32, 2048
#: The pattern for which a text may be cut before a space that a word follows; others are matched over the whole text.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that a pattern's \s and str.isspace() may take differently.
ODD = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"


class ByteBPE:
    """Encodes and decodes by merge ranks; ids are the ranks themselves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.spaced = pattern == SPACED
        size = max(ranks.values(), default=-1) + 1
        self.vocabulary: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.single = [np.array([i], self.kind).tobytes() for i in range(size)]
        longest = len(str(max(0, size - 1))) + 1
        self.digits = np.frombuffer(b"".join(f"{i},".encode().ljust(longest) for i in range(size)), np.uint8).reshape(size, longest)
        self.written = self.digits != 32
        # The rank queue: 64 ranks a word of low, 64 words of low a word of mid, and one word for mid. It is empty between calls.
        self.low, self.mid, self.buckets = [0] * (size // 64 + 1), [0] * (size // 4096 + 1), {}
        self.tables = None
        # The memo: packed ids of what stands between two spaces, with that space; the last full memo is kept beside the new one.
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held, self.passing = 0, []

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return (whole,)
        low, mid, buckets = self.low, self.mid, self.buckets
        top, n = 0, len(piece)
        end = list(range(1, n + 1))  # the part at i is piece[i:end[i]]
        before = list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank of the part at i with the next one
        pair.append(-1)
        new = [(rank, i) for i, rank in enumerate(pair) if rank >= 0]
        while True:
            for rank, i in new:  # push
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 6] |= 1 << (rank & 63)
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    top |= 1 << (rank >> 12)
            if not top:
                break
            a = (top & -top).bit_length() - 1  # find first set, on three levels
            word = mid[a]
            b = a << 6 | (word & -word).bit_length() - 1
            word = low[b]
            rank = b << 6 | (word & -word).bit_length() - 1
            low[b] = word = word & (word - 1)
            if not word:
                mid[a] = word = mid[a] & ~(1 << (b & 63))
                if not word:
                    top &= ~(1 << a)
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            new = []
            for k, i in enumerate(bucket):
                if pair[i] != rank:  # stale
                    continue
                j = end[i]
                end[i] = after = end[j]
                pair[i] = pair[j] = least = -1
                if after < n:
                    before[after] = i
                    if (r := rank_of(piece[i : end[after]], -1)) >= 0:
                        new.append((r, i))
                        pair[i] = least = r
                if (h := before[i]) >= 0:
                    pair[h] = r = rank_of(piece[h:after], -1)
                    if r >= 0:
                        new.append((r, h))
                        if r < least or least < 0:
                            least = r
                if 0 <= least < rank:  # that pair comes before the rest of this bucket
                    new += [(rank, x) for x in bucket[k + 1 :] if pair[x] == rank]
                    break
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The id of each byte, the rank of each pair of bytes, and all pairs of ids that merge (sorted) with their ranks."""
        rank_of = self.ranks.get
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (x := rank_of(token[:cut])) is not None and (y := rank_of(token[cut:])) is not None:
                    keys.append(x << 32 | y)
                    merged.append(rank)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int32)
        order = np.argsort(keys)
        single = np.array([rank_of(bytes([x]), -1) for x in range(256)], np.int32)
        double = np.array([rank_of(bytes([x, y]), -1) for x in range(256) for y in range(256)], np.int32)
        return single, double, keys[order], merged[order]

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens of up to SHORT bytes: the same queue as in merge(), one for each pre-token, all stepped together."""
        if self.tables is None:
            self.tables = self._pairs()
        single, double, keys, merged = self.tables
        size = np.array([len(p) for p in pieces])
        n, wide, bits = len(pieces), int(size.max()) + 2, np.uint64(63)
        one, six = np.uint64(1), np.uint64(6)
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(n, wide).astype(np.int64)
        at = np.arange(wide)
        real = at[None, :] < size[:, None]
        ids = np.where(real, single[raw], -1)
        end = np.repeat(at[None, :] + 1, n, 0)  # linked lists: the next part, the part before
        before = end - 2
        pair = np.full((n, wide), -1, np.int64)
        two = real[:, 1:]
        pair[:, :-1][two] = double[raw[:, :-1] << 8 | raw[:, 1:]][two]
        low, mid, top = np.zeros((n, len(self.low)), np.uint64), np.zeros((n, len(self.mid)), np.uint64), np.zeros(n, np.uint64)

        def push(row: np.ndarray, rank: np.ndarray) -> None:
            word, r = rank >> 6, rank.astype(np.uint64)
            np.bitwise_or.at(low, (row, word), one << (r & bits))
            np.bitwise_or.at(mid, (row, rank >> 12), one << (r >> six & bits))
            np.bitwise_or.at(top, row, one << (r >> np.uint64(12)))

        def first(word: np.ndarray) -> np.ndarray:
            return np.bitwise_count((word & (~word + one)) - one).astype(np.int64)

        row, place = np.nonzero(pair >= 0)
        push(row, pair[row, place])
        row = np.flatnonzero(top)
        while len(row):
            a = first(top[row])
            b = a << 6 | first(mid[row, a])
            word = low[row, b]
            rank = b << 6 | first(word)
            there = pair[row] == rank[:, None]  # the bucket: the positions that still have this rank, others are stale
            count = there.sum(1)
            last = count <= 1
            if last.any():  # the bucket will be empty: clear its bit, and those above it that stand for nothing more
                k, bk, ak = row[last], b[last], a[last]
                low[k, bk] = left = word[last] & (word[last] - one)
                k, bk, ak = k[left == 0], bk[left == 0], ak[left == 0]
                mid[k, ak] &= ~(one << (bk & 63).astype(np.uint64))
                done = mid[k, ak] == 0
                top[k[done]] &= ~(one << ak[done].astype(np.uint64))
            hit = count > 0
            k, i, rank = row[hit], there[hit].argmax(1), rank[hit]
            j = end[k, i]
            after = end[k, j]
            end[k, i], ids[k, i] = after, rank
            pair[k, i] = pair[k, j] = -1
            before[k, after] = i
            more = after < size[k]
            right_key = rank << 32 | np.where(more, ids[k, after], -1)
            h = before[k, i]
            has = h >= 0
            left_key = np.where(has, ids[k, h].astype(np.int64) << 32 | rank, -1)
            key = np.concatenate([np.where(more, right_key, -1), left_key])
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            new = np.where((keys[spot] == key) & (key >= 0), merged[spot], -1).astype(np.int64)
            pair[k, i] = new[: len(k)]
            pair[k[has], h[has]] = new[len(k) :][has]
            made = new >= 0
            push(np.concatenate([k, k])[made], new[made])
            row = row[top[row] != 0]
        alive = np.zeros((n, wide), bool)
        rows, where = np.arange(n), np.zeros(n, np.int64)
        while len(rows):
            alive[rows, where] = True
            where = end[rows, where]
            going = where < size[rows]
            rows, where = rows[going], where[going]
        flat, stops = ids[alive].astype(self.kind).tobytes(), (np.cumsum(alive.sum(1)) * np.dtype(self.kind).itemsize).tolist()
        return [flat[x:y] for x, y in zip([0, *stops], stops)]

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, packed: whole tokens by a look, short ones with their queues together, long ones one by one."""
        out: list[bytes] = [b""] * len(pieces)
        short, kind = [], self.kind
        for k, raw in enumerate(pieces):
            if (whole := self.ranks.get(raw)) is not None:
                out[k] = self.single[whole]
            elif len(raw) <= SHORT:
                short.append(k)
            else:
                out[k] = np.array(self.merge(raw), kind).tobytes()
        short.sort(key=lambda k: len(pieces[k]))
        for start in range(0, len(short), TOGETHER):
            part = short[start : start + TOGETHER]
            for k, ids in zip(part, self.merge_short([pieces[k] for k in part])):
                out[k] = ids
        return out

    def _cut(self, word: str) -> list[str] | None:
        """The pre-tokens of what stands between two spaces, with the space before it; None if they can't be told from it alone.

        A line feed that starts word has no space before it: it comes from encode_all(), which puts
        that space there. A match of SPACED never goes over the place before a space that a
        character other than white space follows, nor over either side of a line feed between two such.
        """
        fed = word[:1] == "\n"
        body = word[1:] if fed else word
        if not body or body[0].isspace() or body[0] in ODD:
            return None
        return ["\n", *self.find(body)] if fed else self.find(" " + word)

    def _remember(self, word: str, ids: bytes) -> None:
        """An entry of the memo; what is long serves its own call alone."""
        self.words[word] = ids
        if len(word) > MEMO_CHARS:
            self.passing.append(word)
        else:
            self.held += MEMO_ENTRY + len(word) + len(ids)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as numbers of ``kind``."""
        heads, tails = [], []
        for text in texts:
            first, space, rest = text.partition(" ")
            simple = self.spaced and space and first and "\n" not in first
            heads.append(first if simple else text)
            tails.append(rest.replace("\n", " \n").split(" ") if simple else None)
        if self.held > MEMO_BYTES:
            self.old, self.words, self.held = self.words, {}, 0
        words, old = self.words, self.old
        cuts: dict[str, list[str] | None] = {}
        marked, stems = [], set()
        for word in set(chain.from_iterable(t for t in tails if t)).difference(words):
            if (known := old.get(word)) is not None:
                self._remember(word, known)
                continue
            stem = word[:-1] if word[-1:] in MARKS else word
            if stem.isascii() and stem.isalpha():  # letters are one pre-token, a mark after them is another
                if stem is not word:
                    marked.append((word, stem, word[-1]))
                if stem not in words:
                    if (known := old.get(stem)) is not None:
                        self._remember(stem, known)
                    else:
                        stems.add(stem)
            else:
                cuts[word] = self._cut(word)
        odd = {word for word, pieces in cuts.items() if pieces is None}
        if odd:  # texts with such places are matched as a whole
            for k, tail in enumerate(tails):
                if tail and not odd.isdisjoint(tail):
                    heads[k], tails[k] = texts[k], None
        heads = [self.find(x) for x in heads]
        found = set(chain.from_iterable(x for x in cuts.values() if x))
        found.update(*heads)
        found.update(mark for _, _, mark in marked)
        own, pieces = list(stems), list(found)
        ids = self.learn([b" " + x.encode() for x in own] + [x.encode() for x in pieces])
        for stem, x in zip(own, ids):
            self._remember(stem, x)
        piece = dict(zip(pieces, ids[len(own) :]))
        for word, stem, mark in marked:
            self._remember(word, words[stem] + piece[mark])
        for word, parts in cuts.items():
            if parts is not None:
                self._remember(word, b"".join(map(piece.__getitem__, parts)))
        get, head = words.__getitem__, piece.__getitem__
        out = [b"".join(chain(map(head, h), map(get, tail or ()))) for h, tail in zip(heads, tails)]
        for word in self.passing:
            words.pop(word, None)
        self.passing.clear()
        return out

    def decimals(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids in decimal, joined by commas, in parts."""
        for start in range(0, len(ids), 1 << 18):
            part = ids[start : start + (1 << 18)]
            text = self.digits[part][self.written[part]].tobytes()
            yield text if start + len(part) < len(ids) else text[:-1]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], self.kind).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str) -> ByteBPE:
    """The tokenizer of a rank file (lines of base64 bytes and a rank); loaded once in each Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again, without a shuffle.

    Returns the columns in keep, n_tokens, with with_ids the ids (array of int), and with digests
    the sha256 of the ids in decimal joined by commas and of the decoded bytes. A null or empty
    text has no tokens. Repeated rows stay repeated, other columns are dropped, an empty table
    gives none. rank_file must be at the same path on every executor.
    """
    fields = [docs.schema[c] for c in keep]
    added = ["n_tokens long"] + ["bpe_ids array<int>"] * with_ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *added])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file, pattern)
        for batch in batches:
            for part in by_bytes(batch, len(fields), PART_BYTES):
                raws = bpe.encode_all([raw.decode("utf-8", "replace") for raw in part.column(len(fields)).to_pylist()])
                found = [np.frombuffer(x, bpe.kind) for x in raws]
                counts = np.array([len(x) for x in found], np.int64)
                columns = [*part.columns[: len(fields)], pa.array(counts)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32))))
                if digests:
                    shas, decoded = [], []
                    for ids in found:
                        sha = hashlib.sha256()
                        for text in bpe.decimals(ids):
                            sha.update(text)
                        shas.append(sha.hexdigest())
                        decoded.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                    columns += [pa.array(shas), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(a.split()[0] for a in added)])

    return map_batches(docs.select(*(F.col(f"`{c}`") for c in keep), text_bytes().alias("_text")), encode, schema)
