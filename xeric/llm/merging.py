"""Byte-pair merges on ragged numpy arrays, many sequences at a time."""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.int64(1) << 30
#: Sequences of more symbols are merged one by one with a heap, as a round of all sequences applies one merge in each.
LONG = 256


class MergeTable:
    """Which adjacent symbols merge: (left, right) -> (rank, merged symbol), in an open-addressed hash table.

    Lower ranks merge first; of equal ranks the leftmost pair does.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank = np.full(1 << bits, NO_RANK)
        self.merged = np.zeros(1 << bits, np.int64)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[todo[put]], rank[todo[put]], merged[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._home(keys)
        rank, merged = np.full(len(keys), NO_RANK), np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        while len(at):
            held = self.keys[slot]
            hit = held == keys[at]
            rank[at[hit]], merged[at[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            on = ~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))
            at, slot = at[on], (slot[on] + 1) & self.mask
        return rank, merged


def merge_all(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apply each sequence's merges until none is left. Returns the surviving symbols and each sequence's count."""
    n = len(lengths)
    counts, results = np.zeros(n, np.int64), [None] * n
    starts = np.cumsum(lengths) - lengths
    order, short = [], np.flatnonzero((lengths > 0) & (lengths <= LONG))
    chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(lengths > LONG):
        out = _merge_long(table, symbols[starts[i] : starts[i] + lengths[i]])
        chunks.append((np.array([i]), out, np.array([len(out)])))
    if len(short):
        own = _gather(starts[short], lengths[short])
        chunks += _merge_rounds(table, symbols[own], lengths[short], short)
    del results, order
    for who, _, m in chunks:
        counts[who] = m
    out = np.empty(int(counts.sum()), np.int64)
    begin = np.cumsum(counts) - counts
    for who, kept, m in chunks:
        out[_gather(begin[who], m)] = kept
    return out, counts


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0] + lengths[0] - 1, starts[1] .. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def _merge_rounds(table: MergeTable, sym: np.ndarray, lengths: np.ndarray, who: np.ndarray) -> list:
    """One merge in every sequence a round; sequences without one leave with their symbols."""
    sym, lengths = sym.astype(np.int64), lengths.astype(np.int64)
    done = []
    ends = np.cumsum(lengths)
    rank, merged = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)
    if len(sym) > 1:
        rank[:-1], merged[:-1] = table.find(sym[:-1], sym[1:])
        rank[ends - 1] = NO_RANK
    while len(who):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), starts)
        live = (best >> 32) < NO_RANK
        if not live.all():
            stay = np.repeat(live, lengths)
            done.append((who[~live], sym[~stay], lengths[~live]))
            shift = np.cumsum(np.where(live, 0, lengths))
            best = (best & 0xFFFFFFFF)[live] - (shift - np.where(live, 0, lengths))[live]
            sym, rank, merged, lengths, who = sym[stay], rank[stay], merged[stay], lengths[live], who[live]
            if not len(who):
                break
            ends = np.cumsum(lengths)
        else:
            best = best & 0xFFFFFFFF
        sym[best] = merged[best]
        keep = np.ones(len(sym), bool)
        keep[best + 1] = False
        rank[best] = NO_RANK
        at = best - np.arange(len(best))  # one symbol went from each sequence before
        sym, rank, merged = sym[keep], rank[keep], merged[keep]
        lengths = lengths - 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        after, before = at[at + 1 < ends], at[at > starts] - 1
        touched = np.concatenate([after, before])
        rank[touched], merged[touched] = table.find(sym[touched], sym[touched + 1])
    return done


def _merge_long(table: MergeTable, sym: np.ndarray) -> np.ndarray:
    """The same merges in one sequence, with a heap of pairs."""
    n = len(sym)
    s, left, right = sym.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    rank, merged = table.find(sym[:-1], sym[1:])
    heap = [(int(r), i, int(sym[i]), int(sym[i + 1]), int(m)) for i, (r, m) in enumerate(zip(rank, merged, strict=True)) if r < NO_RANK]
    heapq.heapify(heap)
    memo: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int) -> None:
        j = right[i]
        if j >= n:
            return
        pair = (s[i], s[j])
        if pair not in memo:
            r, m = table.find(np.array([pair[0]]), np.array([pair[1]]))
            memo[pair] = (int(r[0]), int(m[0]))
        r, m = memo[pair]
        if r < NO_RANK:
            heapq.heappush(heap, (r, i, pair[0], pair[1], m))

    alive = [True] * n
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or s[i] != a or j >= n or s[j] != b:
            continue
        s[i], alive[j] = m, False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return np.array([x for x, a in zip(s, alive, strict=True) if a], np.int64)
