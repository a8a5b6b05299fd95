"""A linear-chain conditional random field over sparse binary features.

Fitted and decoded inside Spark tasks, many sequences at a time.
"""

from __future__ import annotations

import numpy as np


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every item in a (sequences x longest) array."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class ChainCRF:
    def __init__(self, features: int, labels: int):
        self.emit = np.zeros((features, labels), np.float32)
        self.step, self.start, self.end = np.zeros((labels, labels)), np.zeros(labels), np.zeros(labels)

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Emission scores of items with the flat feature ``ids``, ``sizes`` of them each (at least one)."""
        if len(sizes) == 0:
            return np.zeros((0, self.emit.shape[1]))
        return np.add.reduceat(self.emit.take(ids, axis=0), np.cumsum(sizes) - sizes, axis=0).astype(float)

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of every item; ``lengths`` are items per sequence, none empty."""
        if len(scores) == 0:
            return np.zeros(0, int)
        n, longest, k = len(lengths), int(lengths.max()), scores.shape[1]
        if n > 1 and n * longest > 100_000:  # long sequences apart, so that short ones aren't padded to them
            long = lengths > np.median(lengths) if lengths.min() < longest else np.arange(n) >= n // 2
            of, out = np.repeat(long, lengths), np.zeros(len(scores), int)
            for part in (True, False):
                out[of == part] = self.decode(scores[of == part], lengths[long == part])
            return out
        rows, cols = _padded(lengths)
        grid = np.zeros((n, longest, k))
        grid[rows, cols] = scores
        best, back = grid[:, 0] + self.start, np.zeros((n, longest, k), np.int8)
        for t in range(1, longest):
            options = best[:, :, None] + self.step
            back[:, t] = options.argmax(axis=1)
            going = (lengths > t)[:, None]
            best = np.where(going, options.max(axis=1) + grid[:, t], best)
        label = (best + self.end).argmax(axis=1)
        out = np.zeros((n, longest), int)
        for t in range(longest - 1, -1, -1):
            label = np.where(lengths - 1 > t, back[np.arange(n), min(t + 1, longest - 1), label], label)
            out[:, t] = label
        return out[rows, cols]

    def fit(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.3, ridge: float = 1e-5, batch: int = 256, seed: int = 5, free: np.ndarray | None = None, least: np.ndarray | None = None) -> ChainCRF:
        """Adaptive gradient steps on the mean negative log likelihood of batches of the labelled sequences.

        Weights of features and labels that are not ``free`` stay zero, and
        none falls below ``least``.
        """
        if len(labels) == 0:
            return self
        live, ids = np.unique(ids, return_inverse=True)  # weights of features that no item has stay as they are
        item_at = np.concatenate([[0], np.cumsum(sizes)])
        seq_at = np.concatenate([[0], np.cumsum(lengths)])
        parts = [self.emit[live].astype(float), self.step, self.start, self.end]
        squares = [np.full_like(p, 1e-8) for p in parts]
        random = np.random.default_rng(seed)
        total, kept = [np.zeros_like(p) for p in parts], 0
        for epoch in range(epochs):
            order = random.permutation(len(lengths))
            for block in (order[i : i + batch] for i in range(0, len(order), batch)):
                items = ranges(seq_at[block], lengths[block])
                flat = ranges(item_at[items], sizes[items])
                grads = self._gradient(parts, ids[flat], sizes[items], lengths[block], labels[items])
                if free is not None:
                    grads[0] *= free[live]
                for p, g, v in zip(parts, grads, squares):
                    g = g + ridge * p
                    v += g * g
                    p -= rate * g / np.sqrt(v)
                if least is not None:
                    np.maximum(parts[0], least[live], out=parts[0])
            if epoch >= epochs // 3:
                kept += 1
                for t, p in zip(total, parts):
                    t += p
        emit, self.step, self.start, self.end = (t / kept for t in total)  # steadier than the last one
        self.emit[live] = emit
        return self

    @staticmethod
    def _gradient(parts: list[np.ndarray], ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean negative log likelihood.

        The items are taken by their place in the sequence, the longest
        sequences first, so that each step of the forward and the backward
        pass is one range of rows; every row is scaled to the sum one.
        """
        emit, step, start, end = parts
        n, k, moves, ones = len(lengths), len(start), np.exp(step), np.ones((len(start), 1))
        rows, cols = _padded(lengths)
        rank = np.empty(n, int)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(n)
        at = np.cumsum([0, *np.bincount(cols)])
        place = at[cols] + rank[rows]
        scores = np.add.reduceat(emit.take(ids, axis=0), np.cumsum(sizes) - sizes, axis=0)
        fits = np.empty_like(scores)
        fits[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
        ahead, behind = np.empty_like(fits), np.empty_like(fits)
        behind[:] = np.exp(end - end.max())
        ahead[:n] = fits[:n] * np.exp(start - start.max())
        ahead[:n] /= ahead[:n].sum(axis=1, keepdims=True)
        longest = len(at) - 1
        for t in range(1, longest):
            now = ahead[at[t - 1] : at[t - 1] + at[t + 1] - at[t]] @ moves
            now *= fits[at[t] : at[t + 1]]
            now /= now @ ones
            ahead[at[t] : at[t + 1]] = now
        for t in range(longest - 1, 0, -1):
            now = (fits[at[t] : at[t + 1]] * behind[at[t] : at[t + 1]]) @ moves.T
            now /= now @ ones
            behind[at[t - 1] : at[t - 1] + len(now)] = now
        miss = ahead * behind
        miss /= miss.sum(axis=1, keepdims=True)
        before = np.arange(at[1], at[-1]) - np.repeat(np.diff(at)[:-1], np.diff(at)[1:])
        left, right = ahead[before], fits[at[1] :] * behind[at[1] :]
        steps = moves * (left.T @ (right / ((left @ moves) * right).sum(axis=1, keepdims=True)))
        gold = np.empty(len(labels), int)
        gold[place] = labels
        steps -= np.bincount(gold[before] * k + gold[at[1] :], minlength=k * k).reshape(k, k)
        miss[np.arange(len(gold)), gold] -= 1
        item = np.repeat(miss[place].T, sizes, axis=1)
        grad_emit = np.column_stack([np.bincount(ids, of, len(emit)) for of in item])
        ends = place[np.cumsum(lengths) - 1]
        return [grad_emit / n, steps / n, miss[:n].sum(axis=0) / n, miss[ends].sum(axis=0) / n]
