"""A hashed linear scorer: sparse binary text features, log-count ratios and logistic regression.

Fitting takes a bounded sample of rows as index arrays; scoring is one pass over the texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Hashed features, and the letters of a word's beginning that make a feature of their own.
SPACE, STEM = 1 << 18, 5
#: Features of a sample that are worked on at a time.
STEP = 1 << 17
_WORD = re.compile(r"[^\W\d_]+")
_memo: dict[str, tuple[int, int]] = {}


def text_features(text: str) -> np.ndarray:
    """Distinct feature ids of a whole text: its lower-cased words and the beginnings of its words."""
    ids, memo = set(), _memo
    for w in set(_WORD.findall(text.lower())):
        if (hit := memo.get(w)) is None:
            if len(memo) > 300_000:
                memo.clear()
            b = w.encode("utf-8", "surrogatepass")
            hit = memo[w] = (zlib.crc32(b) % SPACE, zlib.crc32(w[:STEM].encode("utf-8", "surrogatepass"), 7) % SPACE)
        ids.update(hit)
    return np.fromiter(ids, dtype=np.int32, count=len(ids))


def forget() -> None:
    """Let go of the words that this worker remembers."""
    _memo.clear()


def _slices(ptr: np.ndarray):
    """Rows and features to take at a time: (first row, last, first feature, last), at most STEP features or one row."""
    at = 0
    while at < len(ptr) - 1:
        end = max(at + 1, int(np.searchsorted(ptr, ptr[at] + STEP, side="right")) - 1)
        yield at, end, int(ptr[at]), int(ptr[end])
        at = end


def _margins(of, ptr: np.ndarray) -> np.ndarray:
    """The sum of each row's features; of(i, j) gives what features i to j count for. Only a slice's values are held, sums run on from slice to slice."""
    out, before = np.empty(len(ptr) - 1), 0.0
    for at, end, i, j in _slices(ptr):
        total = np.cumsum(np.concatenate([[before], of(i, j)]))
        out[at:end] = total[ptr[at + 1 : end + 1] - i] - total[ptr[at:end] - i]
        before = total[-1]
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scorer:
    """weights over hashed features, weights over dense extras (earlier probabilities), and a bias."""

    def __init__(self, weights: np.ndarray, extra: np.ndarray, bias: float):
        self.weights, self.extra, self.bias = weights.astype(np.float32), extra, bias

    def one(self, ids: np.ndarray, extra: list[float]) -> float:
        z = self.bias + float(self.weights[ids].sum()) + sum(a * b for a, b in zip(self.extra, extra))
        return float(sigmoid(z))

    def many(self, feats: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        ptr = np.cumsum([0, *map(len, feats)])
        idx = np.concatenate(feats) if feats else np.zeros(0, dtype=np.int32)
        w = self.weights.astype(float)
        return sigmoid(_margins(lambda i, j: w[idx[i:j]], ptr) + extra @ self.extra + self.bias)


def fit(feats: list[np.ndarray], y: np.ndarray, extra: np.ndarray, rounds: int = 60, l2: float = 1.0) -> Scorer:
    """Logistic regression on features scaled by their log-count ratio. y may be probabilities.

    Without rows, or with one class only, the scorer gives the base rate.
    """
    n, k = len(y), extra.shape[1]
    rate = float(y.mean()) if n else 0.0
    flat = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    if n == 0 or rate < 1e-9 or rate > 1 - 1e-9:
        return Scorer(np.zeros(SPACE), np.zeros(k), flat)
    ptr, idx = np.cumsum([0, *map(len, feats)]), np.concatenate(feats)
    per = np.diff(ptr)

    def counted(weights, of, size):
        """For each feature the sum of its rows' weights times of(i, j), a slice at a time."""
        out = np.zeros(size)
        for at, end, i, j in _slices(ptr):
            np.add.at(out, idx[i:j], np.repeat(weights[at:end], per[at:end]) * of(i, j))
        return out

    pos = counted(y, lambda i, j: 1.0, SPACE) + 0.1
    neg = counted(1 - y, lambda i, j: 1.0, SPACE) + 0.1
    ratio = np.log((pos / y.sum()) / (neg / (1 - y).sum()))
    seen = np.zeros(SPACE, dtype=bool)
    seen[idx] = True
    used, idx = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)[idx]
    ratio_used = ratio[used]
    # plain accelerated gradient steps on the scaled features
    mean, dev = (extra.mean(axis=0), extra.std(axis=0) + 1e-6) if k else (np.zeros(0), np.ones(0))
    dense = (extra - mean) / dev
    v, e, b = np.zeros(len(used)), np.zeros(k), flat
    m1, m2 = np.zeros(len(used) + k + 1), np.zeros(len(used) + k + 1)
    for t in range(1, rounds + 1):
        scaled = v * ratio_used
        err = sigmoid(_margins(lambda i, j: scaled[idx[i:j]], ptr) + dense @ e + b) - y
        g = np.concatenate([counted(err, lambda i, j: ratio_used[idx[i:j]], len(used)) / n + l2 * v / n, dense.T @ err / n, [err.mean()]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
        v, e, b = v - step[: len(used)], e - step[len(used) : len(used) + k], b - step[-1]
    w = np.zeros(SPACE)
    w[used] = v * ratio_used
    return Scorer(w, e / dev, float(b - (e * mean / dev).sum()))
