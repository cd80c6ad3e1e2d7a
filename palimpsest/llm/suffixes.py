"""Suffix arrays with common-prefix values by external induced sorting (after Bingmann, Fischer and Osipov, 2013).

A suffix is of type S if it is less than the next one, else L; an S suffix after an L one is a seed (S*). Seeds are
sorted by naming the pieces between them and sorting the string of names by the same induction again, whatever their
number, until all names differ; a string of names is half as long at most. Then L suffixes are induced from the seeds in ascending order and S suffixes
from the L ones in descending order. Induced suffixes wait in a priority queue of buckets, one for each first symbol, as
tuples of place and common prefix. As the scan only moves on, a bucket is read once, in the order of arrival and in
blocks; a queue beyond its memory goes to disk bucket by bucket. The common prefix of two induced suffixes that follow
each other in a bucket is one more than the least common prefix met by the scan between the two that induced them, which
is looked up in a table of range minima over one block.

Whatever has an entry for each place (types, order, common prefixes, sorted L suffixes) is an array in memory while it is
small and a file of the task's scratch folder beyond that; scans hold blocks. The strings of names are sorted in memory,
with some 100 bytes for each seed, of which text has one in three places; they need no common prefixes, as those of the
seeds are read from the text.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 64 << 20  # bytes of queue entries, and of an array, that are held before they go to disk
BLOCK = 1 << 18  # entries scanned at once
FAR = np.iinfo(np.int32).max


class Scratch:
    """Arrays and files of one task; the folder is made when the first of them does not fit the memory."""

    def __init__(self, memory: int):
        self.memory, self.at, self.made = memory, "", 0

    def path(self, name: str) -> str:
        if not self.at:
            self.at = tempfile.mkdtemp(prefix="suffixes-")
        return os.path.join(self.at, name)

    def array(self, n: int, kind: type, width: int = 1) -> np.ndarray:
        shape = (n,) if width == 1 else (n, width)
        if n * width * np.dtype(kind).itemsize <= self.memory:
            return np.empty(shape, kind)
        self.made += 1
        return np.memmap(self.path(f"array-{self.made}"), kind, "w+", shape=shape)

    def close(self) -> None:
        if self.at:
            shutil.rmtree(self.at, ignore_errors=True)


class BucketQueue:
    """Entries (place, common prefix with the entry before) by bucket, in order of arrival."""

    def __init__(self, scratch: Scratch, name: str):
        self.scratch, self.name, self.used = scratch, name, 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.spilled: set[int] = set()

    def _path(self, bucket: int) -> str:
        return self.scratch.path(f"{self.name}-{bucket}")

    def push(self, bucket: int, entries: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append(entries)
        self.used += entries.nbytes
        if self.used > self.scratch.memory:
            for b, parts in self.held.items():
                with open(self._path(b), "ab") as f:
                    for p in parts:
                        f.write(np.ascontiguousarray(p).tobytes())
                self.spilled.add(b)
            self.held, self.used = {}, 0

    def waits(self, bucket: int) -> bool:
        return bucket in self.held or bucket in self.spilled

    def take(self, bucket: int) -> Iterator[np.ndarray]:
        """What waits in a bucket now, in blocks; what is pushed meanwhile waits on."""
        parts = self.held.pop(bucket, [])
        self.used -= sum(p.nbytes for p in parts)
        if bucket in self.spilled:
            self.spilled.remove(bucket)
            path = self._path(bucket)
            os.rename(path, path + "-read")
            with open(path + "-read", "rb") as f:
                while raw := f.read(8 * BLOCK):
                    yield np.frombuffer(raw, np.int32).reshape(-1, 2).copy()
            os.remove(path + "-read")
        few: list[np.ndarray] = []
        for p in parts:
            few.append(p)
            if sum(map(len, few)) >= BLOCK:
                yield np.concatenate(few)
                few = []
        if few:
            yield np.concatenate(few)


class Minima:
    """Least value of any range of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of ``values[lo:hi]`` for each pair, lo < hi."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int32)
        for k in np.unique(level).tolist():
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        return out


def types(text: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """True where a suffix is of type S. The last one is L: what follows the end is less than any symbol."""
    n = len(text)
    out = np.empty(n, bool) if out is None else out
    after, follows = -1, False  # the symbol and type at the start of the block behind
    for lo in range((max(n, 1) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        part = text[lo : lo + BLOCK].astype(np.int64)
        step = np.sign(np.diff(np.append(part, after)))
        m = len(part)
        decided = np.where(step != 0, np.arange(m), m)
        nearest = np.minimum.accumulate(decided[::-1])[::-1]
        out[lo : lo + m] = np.append(step > 0, follows)[nearest]
        after, follows = int(part[0]) if m else -1, bool(out[lo]) if m else False
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b`` of a byte text, up to ``cap``, eight symbols at once."""
    n = len(text)
    out = np.zeros(len(a), dtype=np.int32)

    def word(at: np.ndarray) -> np.ndarray:
        # Places beyond the end have 255, which is no symbol.
        w = np.full((len(at), 8), 255, np.uint8)
        for k in range(8):
            ok = at + k < n
            w[ok, k] = text[at[ok] + k]
        return w

    live, depth = np.arange(len(a)), 0
    while len(live) and depth < cap:
        x, y = word(a[live] + depth), word(b[live] + depth)
        equal = (x == y) & (x != 255)
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        out[live] += run.astype(np.int32)
        live, depth = live[run == 8], depth + 8
    return np.minimum(out, cap)


def _names(text: np.ndarray, kind: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each piece from a seed to the next one, both included, symbols compared with their types."""
    n = len(text)
    length = np.append(seeds[1:], n - 1) - seeds + 1
    bits = (2 * int(text.max()) + 2).bit_length()
    per = 63 // bits  # symbols in a key
    rank = np.zeros(len(seeds), dtype=np.int64)
    tied = np.arange(len(seeds))  # pieces not yet told apart
    depth = 0
    while len(tied):
        key = np.zeros(len(tied), dtype=np.int64)
        for k in range(per):
            at = np.minimum(seeds[tied] + depth + k, n - 1)
            symbol = text[at].astype(np.int64) * 2 + kind[at] + 1
            key = key << bits | np.where(depth + k < length[tied], symbol, 0)
        by = np.lexsort((key, rank[tied]))
        one, two = rank[tied][by], key[by]
        other = np.concatenate(([True], one[1:] != one[:-1]))
        new = other | np.concatenate(([True], two[1:] != two[:-1]))
        # Ranks leave room: a group keeps its first rank, later members move on by their number in the group.
        start = np.maximum.accumulate(np.where(other, np.arange(len(by)), 0))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        rank[tied[by]] = one + (lead - start)
        depth += per
        size = np.diff(np.append(np.flatnonzero(new), len(by)))
        group = np.cumsum(new) - 1
        tied = tied[by][(size[group] > 1) & (length[tied[by]] > depth)]
        tied.sort()
    uniq, dense = np.unique(rank, return_inverse=True)
    return dense, len(uniq)


def _seeds(kind: np.ndarray) -> np.ndarray:
    n = len(kind)
    return np.concatenate([np.flatnonzero(kind[lo + 1 : lo + BLOCK + 1] & ~kind[lo : min(lo + BLOCK, n - 1)]) + lo + 1 for lo in range(0, n, BLOCK)])


def _sorted_names(names: np.ndarray, count: int) -> np.ndarray:
    """Order of the suffixes of a string of names, ``count`` different ones, by induction. There are about as many buckets
    as names, so entries are moved one by one rather than in arrays."""
    if count == len(names):
        return np.argsort(names)
    kind = types(names)
    seeds = _seeds(kind)
    if len(seeds):
        seeds = seeds[_sorted_names(*_names(names, kind, seeds))]
    symbol, is_s = names.tolist(), kind.tolist()
    up: list[list[int]] = [[] for _ in range(count)]
    down: list[list[int]] = [[] for _ in range(count)]
    own: list[list[int]] = [[] for _ in range(count)]
    for i in seeds.tolist():
        own[symbol[i]].append(i)
    up[symbol[-1]].append(len(symbol) - 1)
    for c in range(count):
        waiting = up[c]
        for i in waiting:  # grows meanwhile
            if i and not is_s[i - 1]:
                up[symbol[i - 1]].append(i - 1)
        for i in own[c]:
            up[symbol[i - 1]].append(i - 1)
    for c in range(count - 1, -1, -1):
        for i in down[c]:
            if i and is_s[i - 1]:
                down[symbol[i - 1]].append(i - 1)
        for i in reversed(up[c]):
            if i and is_s[i - 1]:
                down[symbol[i - 1]].append(i - 1)
    return np.array([i for c in range(count) for i in (*up[c], *reversed(down[c]))], dtype=np.int64)


def suffix_array(text: np.ndarray, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte text in order, and each one's common prefix with the one before, exact below ``cap`` and at
    least ``cap`` otherwise. Texts must not hold 255. ``memory``: see MEMORY."""
    scratch = Scratch(memory)
    try:
        order, common = _sorted(text, cap, scratch)
        return (np.array(order), np.array(common)) if scratch.at else (order, common)
    finally:
        scratch.close()


def _sorted(text: np.ndarray, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    kind = types(text, scratch.array(n, bool))
    seeds = _seeds(kind)
    if len(seeds):
        seeds = seeds[_sorted_names(*_names(text, kind, seeds))]
    shared = np.zeros(len(seeds), dtype=np.int32)
    for lo in range(1, len(seeds), BLOCK):
        shared[lo : lo + BLOCK] = common_prefix(text, seeds[lo - 1 : lo + BLOCK - 1][: len(seeds) - lo], seeds[lo : lo + BLOCK], cap)
    return _induce(text, kind, seeds, shared, cap, scratch)


class _Scan:
    """What a scan in one direction pushes, and the least common prefix since a bucket was last pushed to."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, wanted: bool, bucket: np.ndarray, k: int, cap: int, queue: BucketQueue):
        self.text, self.kind, self.wanted, self.bucket, self.cap, self.queue = text, kind, wanted, bucket, cap, queue
        self.carry = np.full(k, FAR, dtype=np.int64)
        self.started = np.zeros(k, dtype=bool)

    def block(self, batch: np.ndarray, common: np.ndarray) -> None:
        """Push what the suffixes of ``batch``, in order of the scan, induce; ``common``: with the one scanned before."""
        at = np.flatnonzero(batch > 0)
        before = batch[at] - 1
        ok = self.kind[before] == self.wanted
        at, before = at[ok], before[ok]
        least = int(common.min())
        if not len(at):
            self.carry = np.minimum(self.carry, least)
            return
        to = self.bucket[self.text[before]]
        by = np.argsort(to, kind="stable")
        at, before, to = at[by], before[by], to[by]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        lo = np.concatenate(([0], at[:-1] + 1))
        lo[first] = 0
        minima = Minima(common)
        low = minima.between(lo, at + 1)
        own = to[first]
        low[first] = np.minimum(low[first], self.carry[own])
        value = np.minimum(low.astype(np.int64) + 1, self.cap).astype(np.int32)
        value[first] = np.where(self.started[own], value[first], 0)
        last = np.append(first[1:], len(to)) - 1
        self.carry = np.minimum(self.carry, least)
        tail = at[last] + 1
        rest = np.full(len(own), FAR, dtype=np.int64)
        open_ = tail < len(common)
        rest[open_] = minima.between(tail[open_], np.full(int(open_.sum()), len(common)))
        self.carry[own] = rest
        self.started[own] = True
        entries = np.column_stack((before.astype(np.int32), value))
        for b, x, y in zip(own.tolist(), first.tolist(), (last + 1).tolist()):
            self.queue.push(b, entries[x:y])


def _induce(text: np.ndarray, kind: np.ndarray, seeds: np.ndarray, shared: np.ndarray, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    counts = sum(np.bincount(text[lo : lo + BLOCK], minlength=256) for lo in range(0, n, BLOCK))
    symbols = np.flatnonzero(counts)
    k = len(symbols)
    bucket = np.zeros(256, np.int64)
    bucket[symbols] = np.arange(k)
    edge = np.concatenate(([0], np.cumsum(np.bincount(bucket[text[seeds]], minlength=k))))  # seeds are in order

    def direct(a: int, b: int) -> int:
        return int(common_prefix(text, np.array([a]), np.array([b]), cap)[0])

    ascending = _Scan(text, kind, False, bucket, k, cap, BucketQueue(scratch, f"up-{scratch.made}"))
    low, used = scratch.array(n - int(np.count_nonzero(kind)), np.int32, 2), 0  # the L suffixes in order
    low_at = np.zeros(k + 1, np.int64)
    end = int(bucket[text[n - 1]])
    ascending.queue.push(end, np.array([[n - 1, 0]], dtype=np.int32))
    ascending.started[end] = True
    ascending.carry[end] = 0  # the empty suffix shares nothing with what is scanned next
    for c in range(k):
        while ascending.queue.waits(c):
            for got in ascending.queue.take(c):
                if used == low_at[c]:
                    got[0, 1] = 0
                low[used : used + len(got)] = got
                used += len(got)
                ascending.block(got[:, 0].astype(np.int64), got[:, 1])
        low_at[c + 1] = used
        for lo in range(int(edge[c]), int(edge[c + 1]), BLOCK):
            own = seeds[lo : min(lo + BLOCK, int(edge[c + 1]))]
            common = shared[lo : lo + len(own)].copy()
            if lo == edge[c]:
                common[0] = direct(int(low[used - 1, 0]), int(own[0])) if used > low_at[c] else 0
            ascending.block(own, common)
    descending = _Scan(text, kind, True, bucket, k, cap, BucketQueue(scratch, f"down-{scratch.made}"))
    out, out_common, at = scratch.array(n, np.int64), scratch.array(n, np.int32), n
    for c in range(k - 1, -1, -1):
        top = at
        while descending.queue.waits(c):
            for got in descending.queue.take(c):
                # A value belongs to the later of two in ascending order, so it stands beside the one scanned before.
                if at == top:
                    got[0, 1] = 0
                m = len(got)
                out[at - m : at] = got[::-1, 0]
                if at < top:
                    out_common[at] = got[0, 1]
                out_common[at - m + 1 : at] = got[1:, 1][::-1]
                at -= m
                descending.block(got[:, 0].astype(np.int64), got[:, 1])
        a, b = int(low_at[c]), int(low_at[c + 1])
        border = direct(int(low[b - 1, 0]), int(out[at])) if b > a and at < top else 0
        if at < top:
            out_common[at] = border
        for hi in range(b, a, -BLOCK):
            lo = max(a, hi - BLOCK)
            out[at - (hi - lo) : at], out_common[at - (hi - lo) : at] = low[lo:hi, 0], low[lo:hi, 1]
            at -= hi - lo
            down = low[lo:hi, 0][::-1].astype(np.int64)
            before = border if hi == b else int(low[hi, 1])
            descending.block(down, np.concatenate(([before], low[lo + 1 : hi, 1][::-1])).astype(np.int32))
        if at < top:
            out_common[at] = 0
    return out, out_common
