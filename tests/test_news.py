"""Lists of news without later near copies, against a walk of each list."""

import random
import re
from difflib import SequenceMatcher

import pytest

from tidemark.operators import news

SCHEMA = "symbol string, n int, title string, url string"


def walk(rows):
    out = []
    for s in sorted({r[0] for r in rows}):
        urls, titles = set(), []
        for _, n, title, url in sorted(r for r in rows if r[0] == s):
            t = re.sub(r"\s+", " ", title or "").strip()
            if t.lower() in ("", "n/a", "na", "none", "null", "nan", "-"):
                continue
            u = (url or "").strip().split("#", 1)[0].rstrip("/")
            t = re.sub(r"[^\w\s]", "", t.lower()).strip()
            if (u and u in urls) or any(SequenceMatcher(None, t, p).ratio() >= 0.8 for p in titles):
                continue
            if u:
                urls.add(u)
            titles.append(t)
            out.append((s, n))
    return out


def listed(seed, n=220):
    rng, base = random.Random(seed), []
    words = "profit rises bank shares fall on weak quarter loss dividend as việt nam steel đường sữa company reports record sales 2024 2025 plan approves".split()
    rows = []
    for i in range(n):
        if base and rng.random() < 0.6:
            t = list(rng.choice(base))
            for _ in range(rng.randrange(0, 14)):
                k = rng.randrange(len(t))
                t[k] = rng.choice("abcdeé -")
            t = "".join(t) if rng.random() < 0.8 else " ".join(rng.sample("".join(t).split(" "), len("".join(t).split(" "))))
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 6, 9, 12, 45])))
            base.append(t)
        rows.append((rng.choice("ABC"), i, rng.choice([t, t, t.upper() + "!", "  " + t, "" if i % 20 == 0 else t, None if i % 31 == 0 else t]), rng.choice([None, "", "http://x/%d/" % rng.randrange(60), "http://x/%d#top" % rng.randrange(60)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_a_walk(spark, seed):
    rows = listed(seed)
    got = news.without_near_copies(spark.createDataFrame(rows, SCHEMA), "symbol", "n")
    assert got.columns == ["symbol", "n", "title", "url"] and sorted((r.symbol, r.n) for r in got.collect()) == walk(rows)


def test_short_and_chained(spark):
    rows = [("A", i, t, None) for i, t in enumerate(["a", "a", "b", "ab", "abc", "abcd", "abcde", "é!", "é", "-", "n/a", "abcdefghij", "abcdefghkl", "abcdefgzkl", "abcdexgzkl", "same", "same"])]
    rows += [("B", 0, "one", "http://x/1/"), ("B", 1, "two words here", "http://x/1#a"), ("B", 2, "two words here", "http://x/2"), ("B", 3, "one more", "http://x/2/"), ("B", 4, "no address at all", "")]
    got = news.without_near_copies(spark.createDataFrame(rows, SCHEMA), "symbol", "n")
    assert sorted((r.symbol, r.n) for r in got.collect()) == walk(rows)
    assert news.without_near_copies(spark.createDataFrame([], SCHEMA), "symbol", "n").count() == 0


def test_titles_that_share_most_letters(spark):
    """Titles that all share most letters and pairs of them, over several blocks: what meets in a task stays bounded, and likes are those of a walk."""
    rng, syllables = random.Random(3), "the an en tion re er in on th at".split()
    titles = ["".join(rng.choice(syllables) for _ in range(rng.randrange(18, 26))) for _ in range(260)]
    titles += [t[:k] + "xyz"[: rng.randrange(4)] + t[k + rng.randrange(4) :] for t in titles[:60] for k in [rng.randrange(len(t))]] + ["ab" * 300 + "c", "ab" * 299 + "cd", "y" * 64, "y" * 65, "z" * 129, "z" * 128]
    rows = [("A", i, t, None) for i, t in enumerate(titles)]
    news.BLOCK, whole = 50, news.BLOCK
    try:
        pairs = news.alike_titles(spark.createDataFrame([("A", i, t) for i, t in enumerate(titles)], "g string, c long, t string"))
        got = {(r.c, r.to) for r in pairs.collect()}
        kept_ = news.without_near_copies(spark.createDataFrame(rows, SCHEMA), "symbol", "n").collect()
    finally:
        news.BLOCK = whole
    assert got == {(a, b) for a, x in enumerate(titles) for b, y in enumerate(titles) if SequenceMatcher(None, x, y).ratio() >= 0.8}
    assert sorted((r.symbol, r.n) for r in kept_) == walk(rows)
