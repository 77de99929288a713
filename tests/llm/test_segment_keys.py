"""Keys of the n-gram Jaccard join: every pair of sets that links has a key in common that counts."""

import pytest

pytest.importorskip("tidemark.llm")
import numpy as np  # noqa: E402

from tidemark.llm import jaccard  # noqa: E402


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("sets", [1e3, 5e6, 1e10])
def test_linking_sets_meet(percent, sets):
    rng = np.random.default_rng(percent)
    some = lambda n: rng.integers(0, 1 << 63, int(n), dtype=np.int64).astype(np.uint64)
    linked = 0
    for turn in range(1500):
        a = np.unique(some(rng.integers(60, 500) if turn % 3 == 0 else rng.integers(1, 60)))
        gone = rng.choice(len(a), int(rng.integers(0, len(a) // 7 + 1)), replace=False)
        b = np.unique(np.concatenate([np.delete(a, gone), some(rng.integers(0, len(a) // 8 + 1))]))
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        linked += 1
        at = {}
        for key, before, deletion in zip(*jaccard.segment_keys(b, sets, percent)):
            at.setdefault(int(key), []).append((int(before) >> 32, bool(deletion)))
        met = [(int(before) >> 32, bool(deletion), *other) for key, before, deletion in zip(*jaccard.segment_keys(a, sets, percent)) for other in at.get(int(key), [])]
        # as in the second round: two deletions don't meet, and of a run of shared segments the first counts
        assert any(not (d and e) and (x != y or d or e or x == 0) for x, d, y, e in met)
    assert linked > 200
