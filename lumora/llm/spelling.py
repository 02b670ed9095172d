"""What it costs to spell a rare word: hashed-context predictions of its bits, mixed; learnt from the rare training words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from lumora.llm.mixer import CODES, MIX, STEP, Mixer, hashed

STOP = 0x20  # byte after a word; words hold no white space
HASHED = 4  # hashed contexts of a bit: the last 1, 2, 3 and 4 bytes; the fifth is the whole beginning of the word
STEM = 4  # words with the same first bytes come to the same task; below, the whole beginning is a hashed context too
CLASS = 2  # a rare word's class is its first bytes, with the stop if it is shorter
LEVELS = 10
PLACES = 6
COUNTED = 1 << 17
SETS = PLACES * LEVELS  # gates: place in the word by how much the longest context has seen


@dataclass
class Events:
    """Bytes to be predicted, each once for all words that share it and what stands before it.

    slots[k] is context k's hash, byte the byte, weight how often training saw it, and chains tells which words
    end with which events. exact: (8 bits, zero or one, event) counts among words with the same beginning; -1 where those are not
    all in this stretch, so that the longest hashed context stands in.
    """

    slots: np.ndarray
    byte: np.ndarray
    weight: np.ndarray
    place: np.ndarray
    exact: np.ndarray
    chains: list = field(default_factory=list)


def _among_siblings(prefix: np.ndarray, byte: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each bit of each event: how often a zero and a one followed the same prefix and higher bits. Sorted input."""
    out = np.empty((8, 2, len(byte)), "f4")
    for k in range(7, -1, -1):
        high = byte >> (k + 1)
        new = np.ones(len(byte), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (high[1:] != high[:-1])
        group = np.cumsum(new) - 1
        bit = byte >> k & 1
        for b in range(2):
            out[7 - k, b] = np.bincount(group, weight * (bit == b))[group]
    return out


def events_of(words: list[bytes], counts: np.ndarray, stem: int = STEM) -> Events:
    """Every distinct (word so far, next byte) of the words with their stops; words must be sorted.

    Words with a common beginning are neighbours, so one byte at a time the groups are runs: a step is a few
    operations on whole arrays. Words that share their first `stem` bytes are all here.
    """
    n = len(words)
    if not n:
        return Events(np.zeros((HASHED, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((8, 2, 0), "f4"))
    size = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words) + b" ", np.uint8)
    start = np.cumsum(size) - size
    slots, byte, weight, place, exact, chains = [], [], [], [], [], []
    live, total, j = np.arange(n), 0, 0
    whole = np.zeros(n, np.int64)  # number of the run of words with the same beginning
    recent = np.full(n, STOP, np.uint64)
    while len(live):
        ended = size[live] == j
        now = np.where(ended, STOP, flat[np.minimum(start[live] + j, len(flat) - 1)]).astype(np.int64)
        key = whole[live]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (now[1:] != now[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        r = recent[live][head]
        salt = np.uint64(1) << np.uint64(58)
        slots.append(np.stack([hashed(salt * np.uint64(k) + np.uint64(11 * k) + (r & np.uint64((1 << 8 * k) - 1))) for k in range(1, HASHED + 1)]))
        byte.append(now[head])
        weight.append(np.add.reduceat(counts[live], head))
        place.append(np.full(len(head), j))
        exact.append(_among_siblings(key[head], now[head], weight[-1]) if j >= stem else np.full((8, 2, len(head)), -1, "f4"))
        chains.append((live, total + group))
        total += len(head)
        whole[live] = group
        recent[live] = (recent[live] << np.uint64(8) | now.astype(np.uint64)) & np.uint64((1 << 40) - 1)
        live = live[~ended]
        j += 1
    return Events(
        np.concatenate(slots, axis=1), np.concatenate(byte), np.concatenate(weight).astype(float), np.concatenate(place),
        np.concatenate(exact, axis=2), chains,
    )


def _bit_steps(e: Events, table_bits: int, part: slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(table places of every hashed context, bit, exact counts) for the eight bits of each byte, the highest first."""
    node = np.ones(part.stop - part.start, np.uint64)
    byte = e.byte[part].astype(np.uint64)
    for k in range(7, -1, -1):
        at = (hashed(e.slots[:, part] + node * MIX) >> np.uint64(64 - table_bits)).astype(np.int64)
        bit = (byte >> np.uint64(k) & np.uint64(1)).astype(np.int64)
        yield at, bit, e.exact[7 - k][:, part]
        node = node << np.uint64(1) | bit.astype(np.uint64)


def _parts(n: int, step: int = STEP) -> Iterator[slice]:
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


class Speller:
    """Hashed tables of coded zero and one counts, and the mixer."""

    def __init__(self, table_bits: int, zeros: np.ndarray, ones: np.ndarray):
        self.table_bits, self.zeros, self.ones = table_bits, zeros, ones
        self.mixer = Mixer(SETS, [0.1, 0.1, 0.1, 0.1, 0.6])

    def inputs(self, at: np.ndarray, exact: np.ndarray, place: np.ndarray, bit: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds of every context, and the gate. With bit: its own occurrence is taken off the counts first."""
        codes = CODES.astype("f4")
        n0 = [codes.take(self.zeros[k].take(at[k])) for k in range(HASHED)]
        n1 = [codes.take(self.ones[k].take(at[k])) for k in range(HASHED)]
        n0.append(np.where(exact[0] < 0, n0[-1], exact[0]))
        n1.append(np.where(exact[1] < 0, n1[-1], exact[1]))
        if bit is not None:
            n0, n1 = [np.maximum(n - (1 - bit), 0) for n in n0], [np.maximum(n - bit, 0) for n in n1]
        stretch = [np.log((b + 0.02) / (a + 0.02)).astype("f4") for a, b in zip(n0, n1)]
        level = np.minimum(np.ceil(np.log2(n0[-1] + n1[-1] + 1)), LEVELS - 1).astype(np.int64)
        return stretch, np.minimum(place, PLACES - 1) * LEVELS + level

    def learn(self, e: Events) -> float:
        """From all events, in random order."""
        order = np.random.default_rng(5).permutation(len(e.byte))
        mixed = Events(e.slots[:, order], e.byte[order], e.weight[order], e.place[order], e.exact[:, :, order])
        for part in _parts(len(order)):
            for at, bit, exact in _bit_steps(mixed, self.table_bits, part):
                self.mixer.learn(bit, *self.inputs(at, exact, mixed.place[part], bit), mixed.weight[part])
        return float(e.weight.sum())

    def log2(self, e: Events) -> np.ndarray:
        """log2 probability of each event's byte."""
        out = np.zeros(len(e.byte))
        for part in _parts(len(e.byte)):
            for at, bit, exact in _bit_steps(e, self.table_bits, part):
                out[part] += self.mixer.log2(bit, *self.inputs(at, exact, e.place[part]))
        return out

    def words(self, words: list[bytes], counts: np.ndarray, stem: int = STEM) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each of the sorted words with its stop, and of what follows its class."""
        e = events_of(words, counts, stem)
        each, whole, rest = self.log2(e), np.zeros(len(words)), np.zeros(len(words))
        for j, (rows, at) in enumerate(e.chains):
            whole[rows] += each[at]
            if j >= CLASS:
                rest[rows] += each[at]
        return whole, rest


def count_into(tables: list[np.ndarray], e: Events, table_bits: int) -> None:
    """tables[k][2 * place + bit] += weight."""
    for part in _parts(len(e.byte), COUNTED):
        for at, bit, _ in _bit_steps(e, table_bits, part):
            for k in range(HASHED):
                tables[k] += np.bincount(2 * at[k] + bit, e.weight[part], len(tables[k]))


def stretches(frames: Iterator[pd.DataFrame], most: int = 100_000) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, counts, stem): a sorted partition in stretches that hold all words with the same first `stem` bytes.

    Stretches are cut where the first STEM bytes change; a stem with very many words is cut where longer beginnings do.
    """
    words: list[bytes] = []
    counts: list[int] = []
    was = STEM
    for frame in frames:
        words += map(bytes, frame["word"])
        counts += frame["n"].tolist()
        while len(words) >= most:
            for stem in range(STEM, 40):
                cut = next((i for i in range(len(words) - 1, 0, -1) if words[i][:stem] != words[i - 1][:stem]), 0)
                if cut > most // 4:
                    break
            if not cut:
                break
            yield words[:cut], np.array(counts[:cut], float), max(was, stem)
            words, counts, was = words[cut:], counts[cut:], stem
    if words:
        yield words, np.array(counts, float), was
