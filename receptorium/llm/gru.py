"""A bidirectional gated recurrent network over bytes in numpy: training by backpropagation through time, and inference.

A sequence is a piece of at most ``LONGEST`` bytes of one word. Every byte position gets a probability per class from the
states of both directions.
"""

from __future__ import annotations

import numpy as np

LONGEST = 16
HIDDEN = 8
_BATCH = 4096


def _gates(table: np.ndarray, u: np.ndarray, bytes_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for rows of bytes: update and reset gates, candidate, its recurrent part, and the new state."""
    k = h.shape[1]
    x, s = table[bytes_], h @ u
    gates = np.tanh((x[:, :2 * k] + s[:, :2 * k]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    z, r = gates[:, :k], gates[:, k:]
    n = np.tanh(x[:, 2 * k:] + r * s[:, 2 * k:])
    return z, r, n, s[:, 2 * k:], n + z * (h - n)


def reversed_pieces(pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first ``length`` entries in reverse order."""
    at = lengths[:, None] - 1 - np.arange(pieces.shape[1])
    return np.where(at >= 0, np.take_along_axis(pieces, np.maximum(at, 0), 1), 0)


class Network:
    """Parameters: per direction a byte table with biases (256 x 3H) and recurrent weights (H x 3H); output (2H x K) and
    bias."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.classes, self.hidden = classes, hidden
        self.p = {"t0": draw(256, 3 * hidden), "u0": draw(hidden, 3 * hidden), "t1": draw(256, 3 * hidden),
                  "u1": draw(hidden, 3 * hidden), "o": draw(2 * hidden, len(classes)), "c": np.zeros(len(classes), np.float32)}

    def probabilities(self, pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Class probabilities (rows x positions x classes); positions past a row's length are zero. Rows must come with
        descending lengths, so that each step runs over the rows that are still going."""
        out = np.zeros((*pieces.shape, len(self.classes)), np.float32)
        for a in range(0, len(pieces), _BATCH):
            part, size = pieces[a:a + _BATCH], lengths[a:a + _BATCH]
            states = np.zeros((2, part.shape[1], len(part), self.hidden), np.float32)
            for d, rows in enumerate((part, reversed_pieces(part, size))):
                h = np.zeros((len(part), self.hidden), np.float32)
                for t in range(int(size[0])):
                    live = int(np.searchsorted(-size, -t))  # lengths over t
                    h = _gates(self.p[f"t{d}"], self.p[f"u{d}"], rows[:live, t], h[:live])[-1]
                    states[d, t, :live] = h
            for t in range(int(size[0])):
                live = int(np.searchsorted(-size, -t))
                back = states[1, size[:live] - 1 - t, np.arange(live)]
                logit = states[0, t, :live] @ self.p["o"][:self.hidden] + back @ self.p["o"][self.hidden:] + self.p["c"]
                e = np.exp(logit - logit.max(1, keepdims=True))
                out[a:a + live, t] = e / e.sum(1, keepdims=True)
        return out

    def gradients(self, pieces: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        k, (rows, width) = self.hidden, pieces.shape
        mask = (np.arange(width) < lengths[:, None]).astype(np.float32)
        sides = (pieces, reversed_pieces(pieces, lengths))
        trace, states = [[], []], np.zeros((2, width, rows, k), np.float32)
        for d in (0, 1):
            h = np.zeros((rows, k), np.float32)
            for t in range(width):
                z, r, n, s, new = _gates(self.p[f"t{d}"], self.p[f"u{d}"], sides[d][:, t], h)
                trace[d].append((h, z, r, n, s))
                h = np.where(mask[:, t:t + 1] > 0, new, h)
                states[d, t] = h
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        d_states, loss, total = np.zeros_like(states), 0.0, mask.sum()
        every = np.arange(rows)
        for t in range(width):
            opposite = np.maximum(lengths - 1 - t, 0)
            both = np.concatenate([states[0, t], states[1, opposite, every]], 1)
            logit = both @ self.p["o"] + self.p["c"]
            e = np.exp(logit - logit.max(1, keepdims=True))
            prob = e / e.sum(1, keepdims=True)
            loss -= float((np.log(prob[every, labels] + 1e-9) * mask[:, t]).sum())
            prob[every, labels] -= 1
            d_logit = prob * (mask[:, t:t + 1] / total)
            grad["o"] += both.T @ d_logit
            grad["c"] += d_logit.sum(0)
            d_both = d_logit @ self.p["o"].T
            d_states[0, t] += d_both[:, :k]
            d_states[1, opposite, every] += d_both[:, k:]
        for d in (0, 1):
            carry, u = np.zeros((rows, k), np.float32), self.p[f"u{d}"]
            for t in range(width - 1, -1, -1):
                h, z, r, n, s = trace[d][t]
                m = mask[:, t:t + 1]
                total_d = carry + d_states[d, t]
                d_new = total_d * m
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * s * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_n], 1)
                d_s = np.concatenate([d_z, d_r, d_n * r], 1)
                np.add.at(grad[f"t{d}"], sides[d][:, t], d_x)
                grad[f"u{d}"] += h.T @ d_s
                carry = total_d * (1 - m) + d_new * z + d_s @ u.T
        return loss / float(total), grad


def train(network: Network, pieces: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 512,
          rate: float = 0.02, seed: int = 11) -> Network:
    """Adam over random batches, the rate falling to a tenth; deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(pieces), min(batch, len(pieces)))
        width = int(lengths[pick].max())
        _, grad = network.gradients(pieces[pick, :width], lengths[pick], labels[pick])
        now = rate * 0.1 ** (step / steps)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            network.p[k] -= (now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return network
