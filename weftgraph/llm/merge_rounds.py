"""Byte-pair merges of many words at once, in rounds over flat numpy arrays."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int64).max
#: Symbols from which on a word is merged by itself, at many places a round; rounds of it before the rest goes one by one.
LONG, LONG_ROUNDS = 256, 250


class MergeTable:
    """Ranked pairs of symbol ids. Pairs of one rank give one symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        """`left`, `right`, `rank`: one entry a pair; `merged`: the symbol by rank."""
        self.merged = np.asarray(merged, dtype=np.int64)
        keys = (np.asarray(left, dtype=np.int64) << 32) | np.asarray(right, dtype=np.int64)
        # A symbol that takes part in a better pair than the one that makes it must not
        # be made at several places of a word at once: that better pair comes first.
        best = np.full(int(max(self.merged.max(), np.max(left), np.max(right))) + 1, NONE)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        self.one_by_one = best[self.merged] < np.arange(len(self.merged))
        # Characters of the longest symbol: what lies farther away can't reach a pair by merges.
        size = np.ones(len(best), dtype=np.int64)
        while True:
            longer = size.copy()
            np.maximum.at(longer, self.merged[rank], size[left] + size[right])
            if (longer == size).all():
                break
            size = longer
        self.reach = int(size.max())
        self.bits = 20
        self.keys, self.ranks = self._hashed(keys, np.asarray(rank, dtype=np.int64))

    def _hashed(self, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing: a key lies in its slot or one of the next; `self.probes` is the most steps needed."""
        size = 1 << self.bits
        table, values = np.full(size + 64, -1, dtype=np.int64), np.full(size + 64, NONE)
        self.probes, slots, todo = 0, self._slot(keys), np.arange(len(keys))
        while len(todo):
            self.probes += 1
            if self.probes > 60:
                raise ValueError("too many pairs for this table")
            at = slots[todo] + self.probes - 1
            free = table[at] == -1
            _, first = np.unique(at[free], return_index=True)
            placed = todo[free][first]
            table[slots[placed] + self.probes - 1], values[slots[placed] + self.probes - 1] = keys[placed], ranks[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
        return table, values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        slots = self._slot(keys)
        out = np.full(len(keys), NONE)
        open_ = np.arange(len(keys))
        for step in range(self.probes):
            at = slots[open_] + step
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
        return out

    def run(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains; gives the symbols left and their words, each word's in order.

        In each round every word finds its best pair (a segmented minimum), merges it
        wherever it stands, from the left, and the symbols are compacted; words without
        a pair leave. Only pairs beside a merge are looked up again. Words of LONG symbols and more go through `long_word`.
        """
        if not len(symbols):
            return symbols, owner
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(np.append(starts, len(symbols)))
        if sizes.max() < LONG:
            return self._run(symbols, owner)
        long = np.flatnonzero(sizes >= LONG)
        rest = np.repeat(sizes < LONG, sizes)
        parts = [self._run(symbols[rest], owner[rest])]
        for w in long.tolist():
            word = self.long_word(symbols[starts[w] : starts[w] + sizes[w]])
            parts.append((word, np.full(len(word), owner[starts[w]])))
        symbols, owner = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def _run(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = self._all_ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            active = np.repeat(best != NONE, sizes)
            if not active.all():
                done.append((symbols[~active], owner[~active]))
                symbols, owner, ranks = symbols[active], owner[active], ranks[active]
                best, sizes = best[best != NONE], sizes[best != NONE]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            # Of hits that overlap (a a a), every second counts, from the left of each run.
            order = np.arange(len(hits))
            new_run = np.concatenate(([True], np.diff(hits) != 1))
            hits = hits[(order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0]
            rank = ranks[hits]
            words = owner[hits]
            first = np.concatenate(([True], words[1:] != words[:-1]))
            allowed = first | ~self.one_by_one[rank]
            hits, rank = hits[allowed], rank[allowed]
            symbols[hits] = self.merged[rank]
            stays = np.ones(len(symbols), dtype=bool)
            stays[hits + 1] = False
            new_at = (np.cumsum(stays) - 1)[hits]
            symbols, owner, ranks = symbols[stays], owner[stays], ranks[stays]
            beside = np.zeros(len(symbols), dtype=bool)
            beside[new_at] = True
            beside[new_at[new_at > 0] - 1] = True
            again = np.flatnonzero(beside)
            last = again == len(symbols) - 1
            ranks[again[last]] = NONE
            again = again[~last]
            within = owner[again] == owner[again + 1]
            ranks[again[~within]] = NONE
            again = again[within]
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
        if not done:
            return symbols, owner
        symbols, owner = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def _all_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), NONE)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[at] = self.rank(symbols[at], symbols[at + 1])
        return ranks

    def long_word(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols left of one word, merged in each round wherever a pair is the best in reach.

        Before a pair is merged only better ones are, or ones as good on its left. Symbols made of those can't grow over
        `reach` characters, so a pair that has none of them within `reach` symbols is merged sooner or later, and may be at once.
        Pairs of one rank don't wait for another where the symbol that they make takes part in no better pair; where pairs
        of one rank overlap, every second counts, from the left of their run. So time grows with the length; text that
        makes merges wait for each other all along is finished by a heap.
        """
        symbols = symbols.copy()
        ranks = np.append(self.rank(symbols[:-1], symbols[1:]), NONE)
        for _ in range(LONG_ROUNDS):
            if len(symbols) < 2 or (ranks == NONE).all():
                return symbols
            before, after = _least_before(ranks, self.reach), _least_before(ranks[::-1], self.reach)[::-1]
            real = ranks != NONE
            alone = self.one_by_one[np.where(real, ranks, 0)]
            safe = real & (after >= ranks) & np.where(alone, before > ranks, before >= ranks)
            # In a run of equal ranks what counts is safe from the run's left end on.
            at = np.arange(len(ranks))
            first = np.concatenate(([True], ranks[1:] != ranks[:-1]))
            start = np.maximum.accumulate(np.where(first, at, 0))
            bad = np.maximum.accumulate(np.where(safe, -1, at))
            hits = np.flatnonzero(safe & (bad < start) & ((at - start) % 2 == 0))
            symbols[hits] = self.merged[ranks[hits]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[hits + 1] = False
            new_at = (np.cumsum(stays) - 1)[hits]
            symbols, ranks = symbols[stays], ranks[stays]
            again = np.unique(np.concatenate((new_at, new_at[new_at > 0] - 1)))
            last = again == len(symbols) - 1
            ranks[again[last]] = NONE
            again = again[~last]
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
        return self._by_heap(symbols, ranks)

    def _by_heap(self, symbols: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The same, one merge after the other."""
        s: list[int | None] = symbols.tolist()
        known = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        n = len(s)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(ranks.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j], right[i] = int(self.merged[r]), None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (found := known.get((s[p] << 32) | s[q], NONE)) != NONE:
                    heapq.heappush(heap, (found, p, s[p], s[q]))
        return np.array([x for x in s if x is not None], dtype=np.int64)


def _least_before(ranks: np.ndarray, reach: int) -> np.ndarray:
    """For each place the least of the `reach` ranks before it."""
    pad = np.full(reach, NONE)
    least = np.concatenate((pad, ranks[:-1]))
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    return least[: len(ranks)]
