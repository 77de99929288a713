"""Fitting holds a slice of the sample's features beside the sample itself, and its sums do not depend on the slices."""

import tracemalloc

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import linear  # noqa: E402


def sample(rows, most):
    rng = np.random.default_rng(1)
    feats = [rng.integers(0, linear.SPACE, rng.integers(0, most)).astype(np.int32) for _ in range(rows)]
    return feats, (rng.random(rows) < 0.2).astype(float), rng.random((rows, 1))


def test_memory_of_a_fit():
    feats, y, extra = sample(2500, 2000)
    tracemalloc.start()
    linear.fit(feats, y, extra, rounds=2).many(feats, extra)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(map(len, feats))  # bytes


def test_slices_do_not_matter(monkeypatch):
    feats, y, extra = sample(200, 300)
    got = []
    for step in (1, 1000, 1 << 30):
        monkeypatch.setattr(linear, "STEP", step)
        s = linear.fit(feats, y, extra, rounds=5)
        got.append((s.weights.tobytes(), s.extra.tobytes(), s.bias, s.many(feats, extra).tobytes()))
        one = [s.one(f, [x]) for f, x in zip(feats, extra[:, 0])]
        assert np.allclose(s.many(feats, extra), one, atol=1e-5)
    assert got[0] == got[1] == got[2]
