"""A word-level FM-index over one shard of texts: suffix order, wavelet tree, backward search, sampled positions.

Symbols: 1..k are the words that occur in the test phrases; 0 stands for a run of any other words, or the end of a text.
Zeros never match, and every zero sorts by its place, so two suffixes always differ at the latest where a run of phrase
words ends. That keeps suffix sorting to a few doublings, whatever the texts repeat.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in sorted order, by doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    zero = symbols == 0
    first = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + int(zero.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.ones(n, bool)
    head[1:] = first[order[1:]] != first[order[:-1]]
    starts = np.flatnonzero(head)
    rank[order] = starts[np.cumsum(head) - 1]
    tied = _tied(head)
    step = 1
    while len(tied):
        places = order[tied]
        group = rank[places]
        key = group * (n + 2) + rank[np.minimum(places + step, n)] + 1
        again = np.argsort(key, kind="stable")
        places, key, group = places[again], key[again], group[again]
        order[tied] = places  # groups keep their own slots, because the old rank leads the key
        head = np.ones(len(tied), bool)
        head[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(head)
        rank[places] = tied[starts[np.cumsum(head) - 1]]
        tied = tied[_tied(head)]
        step *= 2
    return order


def _tied(head: np.ndarray) -> np.ndarray:
    """Slots whose group, marked by its first slot, has more than one member."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return np.flatnonzero(~alone)


class WaveletTree:
    """Rank of any symbol up to any slot, and the symbol at a slot, by one bit vector with counts per level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            counts = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(len(values) - int(counts[-1]))
            one = bit.astype(bool)
            values = np.concatenate([values[~one], values[one]])

    def rank(self, symbol: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each slot."""
        low, high = np.zeros_like(slot), slot
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[i], self.zeros[i]
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def symbol_and_rank(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol, low, high = np.zeros_like(slot), np.zeros_like(slot), slot
        for i in range(self.bits):
            ones, zeros = self.ones[i], self.zeros[i]
            one = (ones[high + 1] - ones[high]).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
            symbol = symbol * 2 + one
        return symbol, high - low


class FMIndex:
    """Index of one symbol sequence. ``sample``: every such place keeps its position; so does every run's first place."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        order = suffix_order(symbols)
        before = symbols[order - 1]  # the place before 0 is the last one, which is a zero
        self.tree = WaveletTree(before.astype(np.int32), max(1, int(alphabet).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))]).astype(np.int64)
        self.sampled = (order % sample == 0) | (before == 0)
        self.position = order[self.sampled]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot ranges [low, high) of the suffixes that start with each phrase (rows padded at the left)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.first[-1])
        width = phrases.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back].astype(np.int64)
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at ``slots``: steps back in the text until a sampled one is met."""
        found, steps = np.empty(len(slots), np.int64), 0
        open_, at = np.arange(len(slots)), slots
        while len(open_):
            known = self.sampled[at]
            found[open_[known]] = self.position[self.sampled_before[at[known]]] + steps
            open_, at = open_[~known], at[~known]
            symbol, rank = self.tree.symbol_and_rank(at)
            at = self.first[symbol] + rank
            steps += 1
        return found
