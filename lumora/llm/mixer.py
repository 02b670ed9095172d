"""Gated logistic mixing of bit predictions, learnt online, with an adaptive refinement behind it."""

from __future__ import annotations

import heapq

import numpy as np

LIMIT = 12.0
# counts are kept in a byte: exact to 32, then in steps of 8 %
CODES = np.concatenate([np.arange(33.0), 32 * 1.08 ** np.arange(1, 224)[:223]])
MIX = np.uint64(0x9E3779B97F4A7C15)
CELLS = 33
STEP = 1 << 15


def hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def coded(counts: np.ndarray) -> np.ndarray:
    """The code of the nearest kept count below or at each count."""
    return (np.searchsorted(CODES, counts, side="right") - 1).astype(np.uint8)


def add_counts(table: np.ndarray, at: np.ndarray, amount: np.ndarray | None = None) -> None:
    """table[at] += amount (1) for places that repeat."""
    if amount is None:
        at = np.sort(at)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        table[at[first]] += np.diff(np.append(first, len(at))).astype(table.dtype)
    else:
        order = np.argsort(at, kind="stable")
        at, amount = at[order], amount[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        if len(first):
            table[at[first]] += np.add.reduceat(amount, first).astype(table.dtype)


class Mixer:
    """For each gate: weights of the inputs, and a curve that corrects the mixture's log odds.

    Inputs are log odds. Both parts learn in one online pass by Newton steps: a step's curvature is the sum over all of the
    gate's bits so far, so steps shrink as evidence gathers.
    """

    def __init__(self, gates: int, start: list[float]):
        self.gates, self.inputs = gates, len(start)
        self.weights = np.tile(np.array(start, float)[:, None], (1, gates))
        self.curve = np.tile(np.linspace(-LIMIT, LIMIT, CELLS), (gates, 1))

    def mixed(self, stretch: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        dot = self.weights[0].astype("f4").take(gate) * stretch[0]
        for w, x in zip(self.weights[1:], stretch[1:]):
            dot += w.astype("f4").take(gate) * x
        return np.clip(dot, -LIMIT, LIMIT, out=dot)

    def refined(self, dot: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds after the curve (interpolated between its cells and averaged with the mixture), cell, share above it."""
        x = np.minimum((dot + np.float32(LIMIT)) * np.float32(16 / LIMIT), np.float32(31.999))
        low = x.astype(np.int32)
        part = x - low.astype("f4")
        cell = gate.astype(np.intp, copy=False) * CELLS + low
        flat = self.curve.astype("f4").ravel()
        a = flat.take(cell)
        return 0.5 * dot + 0.5 * (a + (flat.take(cell + 1) - a) * part), cell, part

    def log2(self, bit: np.ndarray, stretch: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """log2 probability of each bit."""
        odds = self.refined(self.mixed(stretch, gate), gate)[0]
        return np.log(1 + np.exp(np.where(bit == 1, -odds, odds))) * np.float32(-1 / np.log(2))

    def begin(self) -> None:
        self._bend = np.tile(np.eye(self.inputs) * 200.0, (self.gates, 1, 1))
        self._near = np.full(self.gates * CELLS, 200.0)

    def learn(self, bit: np.ndarray, stretch: list[np.ndarray], gate: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
        by = np.argsort(gate.astype(np.min_scalar_type(self.gates)), kind="stable")  # bits of a gate stand together
        gate, bit, stretch = gate.take(by), bit.take(by).astype("f4"), [x.take(by) for x in stretch]
        weight = np.take(weight, by).astype("f4") if np.ndim(weight) else np.float32(weight)
        seen = np.flatnonzero(np.bincount(gate, minlength=self.gates))
        first = np.searchsorted(gate, seen)
        dot = self.mixed(stretch, gate)
        p = 1 / (1 + np.exp(-dot))
        err, curve = (bit - p) * weight, p * (1 - p) * weight
        slope = np.zeros((self.gates, self.inputs))
        for i in range(self.inputs):
            slope[seen, i] = np.add.reduceat(err * stretch[i], first, dtype=float)
            bent = curve * stretch[i]
            for j in range(i, self.inputs):
                h = np.add.reduceat(bent * stretch[j], first, dtype=float)
                self._bend[seen, i, j] += h
                if i != j:
                    self._bend[seen, j, i] += h
        step = np.linalg.solve(self._bend, slope[:, :, None])[:, :, 0]
        self.weights = np.clip(self.weights + np.clip(step, -0.1, 0.1).T, -0.5, 1.5)
        odds, cell, share = self.refined(dot, gate)
        q = 1 / (1 + np.exp(-odds))
        err, curve = (bit - q) * weight, q * (1 - q) * weight
        for at, s in ((cell, 1 - share), (cell + 1, share)):
            self._near += np.bincount(at, curve * s, self.gates * CELLS)
            move = np.bincount(at, err * s, self.gates * CELLS) / self._near
            self.curve += np.clip(move, -0.2, 0.2).reshape(self.gates, CELLS)

    def state(self) -> bytes:
        return np.concatenate([self.weights.ravel(), self.curve.ravel()]).tobytes()

    def restore(self, states: list[bytes], seen: list[float]) -> None:
        """The mean of several tasks' states by how much each has seen."""
        share = np.array(seen) / sum(seen)
        both = sum(s * np.frombuffer(b) for s, b in zip(share, states))
        self.weights = both[: self.weights.size].reshape(self.weights.shape)
        self.curve = both[self.weights.size :].reshape(self.curve.shape)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits) of a binary code by counts: symbol s goes by nodes[offsets[s]:offsets[s + 1]], the root first."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    parent, bit, new = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        bit[j] = 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    steps, live, at = [], np.arange(n), np.arange(n)
    size = np.zeros(n, np.int64)
    while len(live):
        go = at != new - 1
        live, at = live[go], at[go]
        steps.append((live, parent[at] - n, bit[at]))
        size[live] += 1
        at = parent[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    nodes, bits = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
    for k, (s, node, b) in enumerate(steps):
        place = offsets[s] + size[s] - 1 - k
        nodes[place], bits[place] = node, b
    return offsets, nodes, bits
