"""Words in their context: each is a symbol of a binary code, whose bits are predicted from hashed contexts and mixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lumora.llm.mixer import CODES, MIX, Mixer, add_counts, huffman

END, RARE = 0, 1  # symbols of the end of a text and of a rare word; rare words' classes and then the code's words follow, the most frequent first
FREQUENT = 24
HIGH, LOW = 8, 6  # levels of what the last word, and the last two frequent ones, have seen
BLOCK = 1 << 12
NODE = np.uint64(0xBF58476D1CE4E5B9)


def _of_codes(less: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, total) of a pair of coded counts, zeros * 256 + ones; less: the bit whose own occurrence is taken off."""
    n0, n1 = np.repeat(CODES, 256), np.tile(CODES, 256)
    if less is not None:
        n0, n1 = np.maximum(n0 - (1 - less), 0), np.maximum(n1 - less, 0)
    return np.log((n1 + 0.3) / (n0 + 0.3)).astype("f4"), n0 + n1


def _level(total: np.ndarray, levels: int) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(total + 1)), levels - 1).astype(np.intp)  # gates are places, too


PLAIN, TOTAL = _of_codes(None)
LESS = np.concatenate([_of_codes(0)[0], _of_codes(1)[0]])
# by whether an own occurrence is taken off: the gate's part that the last word, and the last two frequent words, tell
LAST = [_level(np.maximum(TOTAL - off, 0), HIGH) * LOW for off in (0, 1)]
OFTEN = [_level(np.maximum(TOTAL - off, 0), LOW) for off in (0, 1)]


class WordCode:
    """A binary code by counts of END, RARE, `classes` classes of rare words, and the most frequent words; and its bits' contexts.

    A bit is known by its node in the code tree. Contexts: none; the last two of the FREQUENT most frequent words; the last word,
    hashed to 2 ** table_bits places.
    """

    def __init__(self, counts: np.ndarray, classes: int, table_bits: int):
        self.symbols, self.table_bits = len(counts), table_bits
        self.first_word = RARE + 1 + classes
        offsets, nodes, bits = huffman(np.maximum(counts, 1))
        self.offsets, self.nodes, self.bits = offsets[:-1], nodes, bits
        self.size = np.diff(offsets)
        self.pairs = (FREQUENT + 1) ** 2
        self.sizes = [self.symbols, self.pairs * self.symbols, 1 << table_bits]

    def contexts(self, symbols: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For every symbol of texts that follow one another: the last two frequent words (0: none), and the last symbol."""
        first = np.zeros(len(symbols), bool)
        first[np.cumsum([0, *lengths])[:-1]] = True
        at = np.arange(len(symbols))
        prev = np.concatenate([[END], symbols[:-1]])
        prev[first] = END
        often = prev - self.first_word + 1
        often[(often < 0) | (often > FREQUENT)] = 0
        begin = np.maximum.accumulate(np.where(first, at, 0))
        seen = np.maximum.accumulate(np.where(first | (often > 0), at, 0))
        older = np.concatenate([[0], seen[:-1]])[seen]  # where the frequent word before that one was seen
        return np.where(older >= begin, often[older], 0) * (FREQUENT + 1) + often[seen], prev

    def bits_of(self, symbols: np.ndarray, two: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(start of each symbol's bits, bits, places in each context's table)."""
        size = self.size.take(symbols)
        start = np.cumsum(size) - size
        at = np.repeat(self.offsets.take(symbols) - start, size)
        at += np.arange(len(at))
        node = self.nodes.take(at)
        last = np.repeat(prev.astype(np.uint64) * MIX, size) ^ node.view(np.uint64) * NODE
        last ^= last >> np.uint64(29)
        places = [node, np.repeat(two * self.symbols, size) + node, (last * MIX >> np.uint64(64 - self.table_bits)).view(np.int64)]
        return start, self.bits.take(at), places


class Pairs:
    """Counts of (context, symbol) pairs, which are fewer than bits; the tables of bits are made of them at the end.

    Counts are kept in 16 bits; what grows beyond half of that is moved to a dictionary of the few that do.
    """

    def __init__(self, code: WordCode):
        self.code = code
        self.small = [np.zeros(code.pairs * code.symbols, np.uint16), np.zeros(code.symbols * code.symbols, np.uint16)]
        self.large: list[dict[int, int]] = [{}, {}]

    def add(self, symbols: np.ndarray, two: np.ndarray, prev: np.ndarray) -> None:
        for a in range(0, len(symbols), 1 << 15):  # no pair grows by more than half the range at once
            part = slice(a, a + (1 << 15))
            for small, large, context in zip(self.small, self.large, (two[part], prev[part])):
                at = np.unique(context * self.code.symbols + symbols[part], return_counts=True)
                small[at[0]] += at[1].astype(np.uint16)
                for k in at[0][small[at[0]] >= 1 << 15].tolist():
                    large[k] = large.get(k, 0) + int(small[k])
                    small[k] = 0

    def tables(self) -> list[np.ndarray]:
        """For each context: tables[2 * place + bit], how often."""
        n, out = self.code.symbols, [np.zeros(2 * size, np.uint32) for size in self.code.sizes]
        for k, (small, large) in enumerate(zip(self.small, self.large), 1):
            for a in range(0, len(small), 1 << 20):
                met = np.flatnonzero(small[a : a + (1 << 20)]) + a
                for b in range(0, len(met), 1 << 16):
                    self._spread(out[k], k, met[b : b + (1 << 16)], small[met[b : b + (1 << 16)]])
            self._spread(out[k], k, np.array(list(large), np.int64), np.array(list(large.values()), np.int64))
        out[0] += out[1].reshape(self.code.pairs, 2 * n).sum(axis=0, dtype=np.uint32)
        return out

    def _spread(self, table: np.ndarray, k: int, pairs: np.ndarray, counts: np.ndarray) -> None:
        context, symbols = np.divmod(pairs, self.code.symbols)
        _, bit, places = self.code.bits_of(symbols, context, context)
        add_counts(table, 2 * places[k] + bit, np.repeat(counts.astype(np.uint32), self.code.size.take(symbols)))


class WordModel:
    """Tables of coded counts of a WordCode, and the mixer. A distribution over texts of symbols."""

    def __init__(self, code: WordCode, tables: list[np.ndarray]):
        self.code, self.tables = code, tables  # zeros * 256 + ones
        self.mixer = Mixer(HIGH * LOW, [0.5, 0.25, 0.25])

    def inputs(self, places: list[np.ndarray], bit: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds of every context, and the gate. With bit: its own occurrence is taken off the counts first."""
        codes = [t.take(p).astype(np.intp) for t, p in zip(self.tables, places)]
        less = None if bit is None else bit << 16
        stretch = [PLAIN.take(c) for c in codes] if bit is None else [LESS.take(c + less) for c in codes]
        off = int(bit is not None)
        return stretch, LAST[off].take(codes[2]) + OFTEN[off].take(codes[1])

    def learn(self, symbols: np.ndarray, contexts: tuple[np.ndarray, np.ndarray]) -> float:
        for a in range(0, len(symbols), BLOCK):
            _, bit, places = self.code.bits_of(*(x[a : a + BLOCK] for x in (symbols, *contexts)))
            self.mixer.learn(bit, *self.inputs(places, bit))
        return float(len(symbols))

    def log2(self, symbols: np.ndarray, contexts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log2 probability of each symbol."""
        out = [np.zeros(0)]
        for a in range(0, len(symbols), BLOCK):
            start, bit, places = self.code.bits_of(*(x[a : a + BLOCK] for x in (symbols, *contexts)))
            out.append(np.add.reduceat(self.mixer.log2(bit, *self.inputs(places)), start, dtype=float))
        return np.concatenate(out)
