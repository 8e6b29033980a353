"""Suffix arrays with common-prefix lengths by induced sorting over priority queues that spill to files.

Suffixes at the left ends of rises (LMS) are named and sorted by recursion on the names. From them
the falling suffixes are induced in ascending order, and from these the rising ones in descending
order: a suffix that leaves the queue puts the one before it in the queue, as a tuple of its first
symbol, the number of its source, its place. The common prefix of neighbours of one first symbol is one more than
the least common prefix between their sources, which a table of block minima over what has left
the queue so far gives. All steps take sorted batches: of the smallest tuples so many leave at once
as no suffix that they put in can come before.
"""

from __future__ import annotations

import io
import uuid

import numpy as np

from .common import get, put

#: Tuples that leave a queue at a time, and tuples of a block of a spilled run.
BATCH, BLOCK = 1 << 15, 1 << 18
#: Generations of tuples that a batch may put in before its own end.
DEPTH = 6


class Spill:
    """Files of a task for the runs of its queues in a folder that outlives the executor; close() removes them."""

    def __init__(self, folder: str | None, most: int):
        self.folder, self.most, self.names = folder, most, []

    def write(self, columns: list[np.ndarray]) -> str:
        out, name = io.BytesIO(), f"{self.folder}/{uuid.uuid4().hex}.npz"
        np.savez(out, *columns)
        put(name, out.getvalue())
        self.names.append(name)
        return name

    def read(self, name: str) -> list[np.ndarray]:
        with np.load(io.BytesIO(get(name))) as x:
            return [x[f"arr_{k}"] for k in range(len(x.files))]

    def close(self) -> None:
        import pyarrow.fs

        for name in self.names:
            system, path = pyarrow.fs.FileSystem.from_uri(name)
            system.delete_file(path)
        self.names = []


class _Run:
    """Sorted tuples: what is in memory, then blocks in files."""

    def __init__(self, columns: list[np.ndarray], later: list[str]):
        self.columns, self.later = columns, later

    def __len__(self) -> int:
        return len(self.columns[0])


class BatchQueue:
    """A priority queue of tuples (key, ...) in columns; keys are unsigned and differ."""

    def __init__(self, spill: Spill):
        self.spill, self.runs, self.held = spill, [], 0

    def push(self, columns: list[np.ndarray]) -> None:
        """columns ascend by key."""
        if not len(columns[0]):
            return
        self.runs.append(_Run(columns, []))
        self.held += len(columns[0])
        while len(self.runs) > 1 and not (self.runs[-1].later or self.runs[-2].later) and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            self._merge(self.runs.pop(), self.runs.pop())
        if self.spill.folder and self.held > self.spill.most:
            self._write()

    def _merge(self, x: _Run, y: _Run) -> None:
        both = [np.concatenate(c) for c in zip(x.columns, y.columns)]
        order = np.argsort(both[0], kind="stable")
        self.runs.append(_Run([c[order] for c in both], []))

    def _write(self) -> None:
        """All tuples in memory become one run in files, of which a block stays in memory."""
        free = [r for r in self.runs if not r.later]
        both = [np.concatenate(c) for c in zip(*(r.columns for r in free))]
        order = np.argsort(both[0], kind="stable")
        both = [c[order] for c in both]
        size = min(BLOCK, max(1, self.spill.most // 2))
        later = [self.spill.write([c[k : k + size] for c in both]) for k in range(size, len(order), size)]
        self.runs = [_Run([c[:size].copy() for c in both], later), *(r for r in self.runs if r.later)]
        self.held = sum(map(len, self.runs))

    def pop(self, most: int) -> list[np.ndarray] | None:
        """The smallest tuples, about ``most``, ascending; None when there are none."""
        self.runs = [r for r in self.runs if len(r)]
        if not self.runs:
            return None
        share, limit = max(1, most // len(self.runs)), None
        for r in self.runs:
            last = r.columns[0][min(share, len(r)) - 1] if len(r) > share or r.later else None
            if last is not None and (limit is None or last < limit):
                limit = last
        parts = []
        for r in self.runs:
            n = len(r) if limit is None else int(np.searchsorted(r.columns[0], limit, "right"))
            parts.append([c[:n] for c in r.columns])
            r.columns = [c[n:] for c in r.columns]
            self.held -= n
            if not len(r) and r.later:
                r.columns = self.spill.read(r.later.pop(0))
                self.held += len(r)
        if len(parts) == 1:
            return parts[0]
        both = [np.concatenate(c) for c in zip(*parts)]
        order = np.argsort(both[0], kind="stable")
        return [c[order] for c in both]


class Minima:
    """Numbers that are appended, with the minima of aligned blocks of 2, 4, 8, ... of them."""

    def __init__(self, n: int):
        self.levels, self.n = [], 0
        size = n + 2
        while True:
            self.levels.append(np.full(size + 2, np.iinfo(np.int32).max, np.int32))
            if size <= 2:
                break
            size = size // 2 + 1

    def append(self, values: np.ndarray) -> None:
        low, high = self.n, self.n + len(values)
        self.levels[0][low:high] = values
        self.n = high
        for below, level in zip(self.levels, self.levels[1:]):
            low, high = low >> 1, ((high - 1) >> 1) + 1
            level[low:high] = np.minimum(below[2 * low : 2 * high : 2], below[2 * low + 1 : 2 * high + 1 : 2])

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of each non-empty range [low, high)."""
        out = np.full(len(low), np.iinfo(np.int32).max, np.int32)
        at, low, high = np.arange(len(low)), low.copy(), high.copy()
        for level in self.levels:
            odd = low & 1 == 1
            out[at[odd]] = np.minimum(out[at[odd]], level[low[odd]])
            low += odd
            odd = (high & 1 == 1) & (low < high)
            high -= high & 1
            out[at[odd]] = np.minimum(out[at[odd]], level[high[odd]])
            low >>= 1
            high >>= 1
            left = low < high
            if not left.all():
                at, low, high = at[left], low[left], high[left]
            if not len(at):
                return out
        return out


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place whether its suffix is smaller than the next one (rising), and how many equal symbols start there."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(differs, n - 1)
    following = ends[np.searchsorted(ends, np.arange(n))]
    rising = np.ones(n, bool)
    inner = following < n - 1
    rising[inner] = text[following[inner] + 1] > text[following[inner]]
    return rising, (following - np.arange(n) + 1).astype(np.int32)


def _names(text: np.ndarray, rising: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, bool]:
    """The rank of each piece from one LMS place to the next, itself included; whether all differ."""
    n = len(lms)
    length = np.append(np.diff(lms) + 1, 1)
    symbol = text.astype(np.uint64) * np.uint64(2) + rising
    rank = np.zeros(n, np.uint64)
    todo, depth = np.arange(n), 0
    while len(todo):  # pieces that share a rank so far are told apart by their next symbol
        inside = length[todo] > depth
        more = np.zeros(len(todo), np.uint64)
        more[inside] = symbol[lms[todo[inside]] + depth] + np.uint64(1)
        order = np.lexsort((more, rank[todo]))
        r, m = rank[todo][order], more[order]
        new_group = np.append(True, r[1:] != r[:-1])
        fresh = new_group | np.append(True, m[1:] != m[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        first = np.maximum.accumulate(np.where(new_group, np.arange(len(r)), 0))
        rank[todo[order]] = r + (start - first).astype(np.uint64)
        alone = fresh & np.append(fresh[1:], True)
        keep = ~alone & (m > 0)
        todo, depth = todo[order][keep], depth + 1
    order = np.argsort(rank, kind="stable")
    sizes = np.append(True, np.diff(rank[order].astype(np.int64)) != 0)
    names = np.empty(n, np.int64)
    names[order] = np.cumsum(sizes) - 1
    return names, bool(sizes.all())


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols are equal from each a and b on; the end of the text is a symbol of its own."""
    out, at, k = np.zeros(len(a), np.int32), np.arange(len(a)), 0
    while len(at):
        at = at[text[a[at] + k] == text[b[at] + k]]
        k += 1
        out[at] = k
    return out


class _Pass:
    """One induction: tuples leave the queue in order, what they put in follows; keeps the order and its common prefixes."""

    def __init__(self, text: np.ndarray, symbol: np.ndarray, run: np.ndarray, left: np.ndarray, member: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, spill: Spill):
        """symbol: keys of places, small ones first; run, left: how many equal symbols start and end at a place; member:
        places that are to be induced; seeds in order, with the common prefix of each and the one before.

        A place is put in together with those of equal symbols to its left: those with fewer of them from
        there on leave first. Keys are symbol, seed or not, number of equal symbols, order of the source.
        """
        n = len(text)
        number_bits, run_bits = np.uint64((n + 1).bit_length()), np.uint64(int(run.max()).bit_length())
        shift = number_bits + run_bits + np.uint64(1)
        if int(shift) + int(symbol.max()).bit_length() > 64:
            raise ValueError("a text of this length needs more than 64 bits for its tuples")
        mark, last_number = np.uint64(1) << (number_bits + run_bits), (np.uint64(1) << number_bits) - np.uint64(1)
        runs = (np.uint64(1) << run_bits) - np.uint64(1)
        head = symbol.astype(np.uint64) << shift
        queue, minima, seq = BatchQueue(spill), Minima(n + 1), 0
        queue.push([head[seeds] | mark | np.arange(len(seeds), dtype=np.uint64), seeds, np.arange(len(seeds))])
        places, prefixes = [], []
        last = [np.array([-1]), np.array([False]), np.array([0]), np.array([0]), np.array([0])]
        done, most = 0, BATCH
        while (batch := queue.pop(most)) is not None:
            limit, held, first, cut = batch[0][-1], len(batch[0]), 0, None
            keys, all_places, parents, out = [batch[0]], [batch[1]], [np.full(held, -1)], []
            for depth in range(DEPTH + 1):  # what the batch puts in before its own end, generation by generation
                place = all_places[-1]
                before = np.maximum(place - 1, 0)
                at = np.flatnonzero((place > 0) & member[before] & (symbol[before] != symbol[place]))
                width = left[before[at]]
                parent = np.repeat(at, width)
                k = np.arange(len(parent)) - np.repeat(np.cumsum(width) - width, width)
                place, parent = before[parent] - k, parent + first
                own = head[place] | ((k + 1).astype(np.uint64) << number_bits)
                inside = (own | last_number) <= limit  # after older tuples of its symbol and run
                first += len(all_places[-1])
                if depth == DEPTH and inside.any():
                    cut = own[inside].min()
                    inside[:] = False
                out.append((parent[~inside], place[~inside], own[~inside]))
                if not inside.any():
                    break
                keys.append(own[inside] | last_number)
                all_places.append(place[inside])
                parents.append(parent[inside])
            key, place, parent = (np.concatenate(c) for c in (keys, all_places, parents))
            if len(keys) > 1:
                columns, at = [key], np.arange(len(key))
                for _ in range(len(keys) - 1):
                    at = np.where(at >= 0, parent[at], -1)
                    columns.append(np.where(at >= 0, key[at], np.uint64(0)))
                order = np.lexsort(columns[::-1])
            else:
                order = np.arange(held)
            if cut is not None:
                dropped = key >= cut
                order = order[~dropped[order]]
                late = np.flatnonzero(dropped[:held])
                queue.push([c[late] for c in batch])
                late = held + np.flatnonzero(dropped[held:])
                out.append((parent[late], place[late], key[late] & ~last_number))
            n = len(order)
            most = BATCH if cut is None else min(BATCH, max(256, 2 * n))
            number = np.full(len(key), -1)
            number[order] = done + np.arange(n)
            source = np.append(batch[2], number[parent[held:]])[order]
            key, place = key[order], place[order]
            now = [(key >> shift).astype(np.int64), key & mark != 0, ((key >> number_bits) & runs).astype(np.int32), source, place]
            was = [np.append(x[-1:], y[:-1]) for x, y in zip(last, now)]
            same = was[0] == now[0]
            lcp = np.zeros(n, np.int32)
            x = same & now[1] & was[1]
            lcp[x] = seed_lcp[source[x]]
            x = same & (now[1] != was[1])
            lcp[x] = np.minimum(run[place[x]], run[was[4][x]])
            both = same & ~now[1] & ~was[1]
            x = both & (now[2] != was[2])
            lcp[x] = was[2][x]
            x = np.flatnonzero(both & (now[2] == was[2]))
            open_ = x[source[x] >= done]  # their sources are in this batch, too
            lcp[open_] = 1 << 30
            x = x[source[x] < done]
            if len(x):
                lcp[x] = now[2][x] + minima.least(was[3][x] + 1, source[x] + 1)
            minima.append(lcp)
            while len(open_):
                found = now[2][open_] + minima.least(was[3][open_] + 1, source[open_] + 1)
                if (found == lcp[open_]).all():
                    break
                lcp[open_] = found
                minima.n = done
                minima.append(lcp)
            places.append(place)
            prefixes.append(lcp)
            parent, place, own = (np.concatenate(c) for c in zip(*out))
            source = number[parent]
            at = np.flatnonzero(source >= 0)
            at = at[np.argsort(source[at], kind="stable")]
            put_key = own[at] | np.arange(seq, seq + len(at), dtype=np.uint64)
            by_key = np.argsort(put_key, kind="stable")
            at = at[by_key]
            queue.push([put_key[by_key], place[at], source[at]])
            seq, done, last = seq + len(at), done + n, [x[-1:] for x in now] if n else last
        self.places, self.prefixes = np.concatenate(places), np.concatenate(prefixes)


def suffix_array(text: np.ndarray, spill: Spill | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in order, common prefix of each and the one before) of a text whose last symbol is its only 0.

    Texts of 4 MB with runs of up to 2 ** 18 equal symbols fit into the 64 bits of a key; a longer one may raise ValueError.
    """
    spill = spill or Spill(None, 0)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    rising, run = _types(text)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    names, unique = _names(text, rising, lms)
    if unique:
        order, shared = np.argsort(names), np.zeros(len(lms), np.int32)
    else:
        order, shared = suffix_array(names, spill)
    seeds = lms[order]
    seed_lcp = np.zeros(len(lms), np.int32)
    x, y = order[:-1], order[1:]
    base = lms[x + shared[1:]] - lms[x]
    seed_lcp[1:] = base + _extend(text, lms[x + shared[1:]], lms[y + shared[1:]])
    top = int(text.max())
    left = _types(text[::-1])[1][::-1]
    falling = _Pass(text, text, run, left, ~rising, seeds, seed_lcp, spill)
    own = ~rising[falling.places]
    fall, fall_lcp = falling.places[own], falling.prefixes[own]  # neighbours of one symbol are neighbours there, too
    del falling
    back = fall[::-1]
    back_lcp = np.append(0, fall_lcp[:0:-1]).astype(np.int32)
    member = rising.copy()
    member[n - 1] = False
    last = _Pass(text, top - text, run, left, member, back, back_lcp, spill)
    places = np.append(last.places, n - 1)[::-1]
    prefixes = np.append(0, np.append(last.prefixes, 0)[:0:-1]).astype(np.int32)
    return places, prefixes
