"""Lists of news worked on in stretches: the same rows as a walk, and no more pairs of alike titles than stay open."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from test_news import SCHEMA, listed, walk
from tidemark.operators import news


@pytest.fixture
def short_stretches(monkeypatch):
    monkeypatch.setattr(news, "FIRST", 24, raising=False)
    monkeypatch.setattr(news, "GROWTH", 2, raising=False)
    monkeypatch.setattr(news, "BLOCK", 15)


def test_same_as_a_walk(spark, short_stretches):
    rows = listed(5, 260)
    got = news.without_near_copies(spark.createDataFrame(rows, SCHEMA), "symbol", "n")
    assert sorted((r.symbol, r.n) for r in got.collect()) == walk(rows)


def test_copies_of_one_title_do_not_all_meet(spark, short_stretches, monkeypatch):
    rng, met = random.Random(8), []
    rows = [("A", i, "shares of the bank rise on strong results in the third quarter " + "".join(rng.choice("abcdefgh") for _ in range(8)), None) for i in range(320)]
    keep = news.kept

    def kept(df, label):
        out = keep(df, label)
        met.append(out.count() if label == "alike" else 0)
        return out

    monkeypatch.setattr(news, "kept", kept)
    got = news.without_near_copies(spark.createDataFrame(rows, SCHEMA), "symbol", "n")
    assert [r.n for r in got.collect()] == [0]
    assert sum(met) < 320 * 320 / 8


def test_swept_loses_no_pair():
    rng = random.Random(4)
    titles = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 73))) for _ in range(150)} | {"abcd" * k for k in range(1, 19)}, key=len)
    x, y = news.Block(np.arange(len(titles)), titles), news.Block(np.arange(len(titles)), [*titles])
    for both in (x, y):
        found = set(zip(*(v.tolist() for v in news.swept(x, both, 0.8))))
        alike = {(i, j) for j, t in enumerate(titles) for i, s in enumerate(titles) if (i < j or both is y) and SequenceMatcher(None, s, t).ratio() >= 0.8}
        assert alike <= found and len(found) < len(titles) ** 2 / 2
