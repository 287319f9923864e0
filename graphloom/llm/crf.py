"""A linear-chain conditional random field with sparse binary features."""

from __future__ import annotations

import math
import random
from collections import defaultdict

Sequence = list[list[str]]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class LinearChainCRF:
    """Labels are 0 and 1. Weights: one for each (feature, label) and each pair of neighbouring labels."""

    def __init__(self) -> None:
        self.weights: dict[str, list[float]] = {}
        self.steps = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, features: Sequence) -> list[list[float]]:
        out = []
        for token in features:
            a = b = 0.0
            for f in token:
                w = self.weights.get(f)
                if w:
                    a += w[0]
                    b += w[1]
            out.append([a, b])
        return out

    def viterbi(self, features: Sequence) -> list[int]:
        """The most probable labels."""
        if not features:
            return []
        scores, steps = self.scores(features), self.steps
        best, back = [scores[0]], []
        for s in scores[1:]:
            last, now, came = best[-1], [], []
            for y in (0, 1):
                zero, one = last[0] + steps[0][y], last[1] + steps[1][y]
                came.append(int(one > zero))
                now.append(max(zero, one) + s[y])
            best.append(now)
            back.append(came)
        labels = [int(best[-1][1] > best[-1][0])]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]

    def _expectations(self, features: Sequence) -> tuple[list[list[float]], list[list[float]]]:
        """Marginals of the labels, and expected counts of neighbouring labels, by forward-backward."""
        s, t, n = self.scores(features), self.steps, len(features)
        fwd = [s[0]]
        for k in range(1, n):
            fwd.append([_log_add(fwd[-1][0] + t[0][y], fwd[-1][1] + t[1][y]) + s[k][y] for y in (0, 1)])
        bwd = [[0.0, 0.0]]
        for k in range(n - 2, -1, -1):
            bwd.append(
                [_log_add(t[y][0] + s[k + 1][0] + bwd[-1][0], t[y][1] + s[k + 1][1] + bwd[-1][1]) for y in (0, 1)]
            )
        bwd.reverse()
        z = _log_add(*fwd[-1])
        marginals = [[math.exp(fwd[k][y] + bwd[k][y] - z) for y in (0, 1)] for k in range(n)]
        pairs = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(n - 1):
            for x in (0, 1):
                for y in (0, 1):
                    pairs[x][y] += math.exp(fwd[k][x] + t[x][y] + s[k + 1][y] + bwd[k + 1][y] - z)
        return marginals, pairs

    def fit(self, data: list[tuple[Sequence, list[int]]], *, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4,
            seed: int = 5) -> LinearChainCRF:
        """Adaptive gradient ascent on the conditional likelihood."""
        order = [k for k, d in enumerate(data) if d[0]]
        rng = random.Random(seed)
        squares: dict[str, list[float]] = defaultdict(lambda: [1e-8, 1e-8])
        step_squares = [[1e-8, 1e-8], [1e-8, 1e-8]]
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, labels = data[k]
                marginals, pairs = self._expectations(features)
                for x, y in zip(labels, labels[1:]):
                    pairs[x][y] -= 1
                for x in (0, 1):
                    for y in (0, 1):
                        g = -pairs[x][y]
                        step_squares[x][y] += g * g
                        self.steps[x][y] += rate * g / math.sqrt(step_squares[x][y])
                for token, label, m in zip(features, labels, marginals):
                    up = [(label == y) - m[y] for y in (0, 1)]
                    if abs(up[0]) < 1e-4:
                        continue
                    for f in token:
                        w, q = self.weights.setdefault(f, [0.0, 0.0]), squares[f]
                        for y in (0, 1):
                            g = up[y] - decay * w[y]
                            q[y] += g * g
                            w[y] += rate * g / math.sqrt(q[y])
        return self
