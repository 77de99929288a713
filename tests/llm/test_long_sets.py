"""Long sets of the n-gram Jaccard join: pairs that share a passage are ruled out before they are verified, and sets travel only where they have a pair."""

import random

import pytest

pytest.importorskip("tidemark.llm")
import numpy as np  # noqa: E402

from tidemark.llm import jaccard  # noqa: E402


def link(a, b, percent):
    both = len(np.intersect1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


@pytest.mark.parametrize("percent", [80, 90])
def test_long_sketches_rule_out_and_lose_none(spark, percent):
    rng = np.random.default_rng(percent)
    some = lambda n: rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    sets, pairs, want, far = [], [], set(), set()
    for k in range(120):
        base = some(int(rng.integers(500, 5000)))
        keep = len(base) - int(len(base) * rng.random() * 0.2) if k % 2 else len(base) // 8
        other = np.concatenate([base[:keep], some(0 if k % 4 == 1 else int((len(base) - keep) * rng.random()) if k % 2 else len(base) - keep)])
        for h in (base, other):
            h = np.unique(h)
            sets.append((len(sets), len(h), jaccard.odd_sketch(h), jaccard.long_sketch(h)))
        pairs.append((2 * k, 2 * k + 1))
        (want if link(base, other, percent) else far if k % 2 == 0 and len(base) > 700 else set()).add(pairs[-1])
    assert len(want) > 20 and len(far) > 20
    table = spark.createDataFrame(sets, "set long, n long, sk array<long>, long array<long>")
    got = {(r.u, r.v) for r in jaccard.likely(spark.createDataFrame(pairs, "u long, v long"), table, percent).collect()}
    assert want <= got and not far & got


def test_slices_do_not_matter(spark, monkeypatch):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(500) for _ in range(80)]
    texts = []
    for _ in range(40):  # a chain of versions: many blocks of one component
        base = list(base)
        base[rng.randrange(80)] = "w%d" % rng.randrange(500)
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = [jaccard.shingles(t) for t in texts]
    sets = spark.createDataFrame([(jaccard.set_id(h), i, len(h)) for i, h in enumerate(hashes)], "set long, rep long, n long")
    ids = [jaccard.set_id(h) for h in hashes]
    every = [(i, j) for i in range(40) for j in range(i) if j >= i - 6]
    pairs = spark.createDataFrame([(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in every], "u long, v long")
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in every if link(hashes[i], hashes[j], 90))
    assert 0 < len(want) < len(every)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    for held in (1 << 24, 1):
        monkeypatch.setattr(jaccard, "HELD", held)
        assert sorted(tuple(r) for r in jaccard.verify(docs, sets, pairs).collect()) == want
