"""Centroid clustering, periodic runs and decontamination against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import annulus, decontaminate, periods  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = (1 << 60) + 1
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_means(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    seeds = sorted((sha(f"2:{i}"), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        where = [near(v)[1] for _, v in kept]
        at = [[sum(x) // len(x) for x in zip(*own)] if (own := [v for (_, v), w in zip(kept, where) if w == n]) else c for n, c in enumerate(at)]
    found = [(i, *near(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in found if m == n) for n in range(len(at))}
    return sorted(((i, n, d, total[n], sum(total.values()), sha(",".join(map(str, at[n])))) for i, d, n in found), key=str)


def test_centroids(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.001, -0.004, 2.0]) * (1 + i % 3) for _ in range(8)]) for i in range(120)]
    rows += [(BIG, rows[0][1]), (BIG + 2, rows[1][1]), (7, rows[7][1]), (None, rows[3][1])] + [(200 + i, [0.0] * 8) for i in range(5)]
    bad = [(300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 7 + [None]), (304, [1.0] * 7 + [float("nan")]), (305, [1.0] * 7 + [float("inf")])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, cluster int, h string").coalesce(1)
    for k, rounds in ((9, 3), (200, 1)):
        got = annulus.cluster(df, k=k, dim=8, rounds=rounds).collect()
        single = [(i, None if v is None else [float(np.float32(x)) for x in v]) for i, v in rows]
        assert sorted((tuple(r) for r in got), key=str) == plain_means(single, k, rounds)
    assert annulus.cluster(df.where("false"), dim=8).collect() == [] and annulus.cluster(df.where("vec_id > 299 and vec_id < 400"), dim=8).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        annulus.cluster(df.withColumn("embedding", F.transform("embedding", lambda x: F.lit(1e30).cast("float"))), dim=8)


def test_annulus_has_all_ties():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (3000, 5))
    c = np.concatenate([rng.integers(-3, 4, (30, 5)), np.zeros((3, 5), np.int64), x[:5]])
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    number, distance, pairs = annulus.Annuli(c).nearest(x)
    assert (number == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all() and pairs < x.shape[0] * len(c)


def plain_runs(w, least):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                e = i
                while e + q < n and w[e] == w[e + q]:
                    e += 1
                s, e2 = i, e + q
                if e2 - s >= max(least, 2 * q) and not any(all(w[x] == w[x + d] for x in range(s, e2 - d)) for d in range(1, q)):
                    out.add((s, e2 - s, q))
                i = e
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_sequences():
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 4:
            p = rng.randrange(1, n // 2 + 1)
            w = [w[i % p] if rng.random() > 0.02 else 9 for i in range(n)]
        least = rng.choice([2, 4, 12])
        assert [tuple(r) for r in periods.find_runs(np.array(w, dtype=np.int64), least).tolist()] == plain_runs(w, least)
    morse = [bin(i).count("1") % 2 for i in range(1 << 12)]  # hashes modulo a power of two would take its halves for equal
    assert [tuple(r) for r in periods.find_runs(np.array(morse), 4).tolist() if r[2] < 40] == [r for r in plain_runs(morse, 4) if r[2] < 40]
    assert periods.find_runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]


def plain_periodic(doc, text, plant):
    w = WORD.findall(text or "")
    n = len(w)
    if plant and doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 12)
    gone = {x for s, k, q in runs for x in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4), sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(8)
    say = lambda n, k=60: " ".join("w%d" % rng.randrange(k) for _ in range(n))
    texts = [say(rng.randrange(1, 160)) for _ in range(60)] + [say(3) + " " + "la lá " * 30 + "\n" + say(40), "x " * 12, "x " * 11, "", None, " \t\n ", " a b " * 9, say(2, 1) * 50]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(BIG, "ab c " * 20, 1, "s"), (BIG + 2, "ab c " * 20, 1, "s"), (None, "ab c " * 20, 1, "s"), (3, texts[3], 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, name string").coalesce(1)
    for plant in (True, False):
        got = sorted((tuple(r) for r in periods.periodic_runs(docs, plant).collect()), key=str)
        assert got == sorted((plain_periodic(d, t, plant) for d, t, _, _ in rows), key=str)
    assert periods.periodic_runs(docs.where("false")).count() == 0
    kept = periods.keep_collapsed(docs)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id") == BIG).first()["text"] == "ab c" and kept.where("doc_id is null").count() == 1
    long = spark.createDataFrame([(1, "a b c " * 100_000 + " " * 1_000_000)], "doc_id long, text string")
    assert [tuple(r)[1:6] for r in periods.periodic_runs(long, False).collect()] == [(1, 0, 300_000, 3, 100_000_000)]


LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, w):
    """(doc, words, hit words, items, longest match and its place) by every window and every longer match."""
    windows, strings = {}, {}
    for name, t in items:
        x = ITEM_WORD.findall((t or "").translate(LOWER))
        n = min(w, len(x))
        for i in range(len(x) - n + 1 if x else 0):
            windows.setdefault(tuple(x[i : i + n]), set()).add(name)
            for k in range(n, len(x) - i + 1):
                strings.setdefault(k, set()).add(tuple(x[i : i + k]))
    out = []
    for doc, t in docs:
        x, hit, names, best = ITEM_WORD.findall((t or "").translate(LOWER)), set(), set(), None
        for k in {len(v) for v in windows}:
            for i in range(len(x) - k + 1):
                if tuple(x[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    names |= windows[tuple(x[i : i + k])]
        for k in sorted(strings, reverse=True):
            at = [i for i in range(len(x) - k + 1) if tuple(x[i : i + k]) in strings[k]]
            if at:
                best = (k, at[0])
                break
        ids = sorted(str(n) for n in names if n is not None)
        out.append((doc, len(x), len(hit), len(ids), sha(",".join(ids)), bool(hit), *(best or (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,block", [(3, 1 << 19), (3, 20), (10, 60)])
def test_decontamination(spark, window, block):
    rng = random.Random(window)
    say = lambda n: " ".join(rng.choice(["a", "B", "c1", "É", "é", "d-e"]) for _ in range(n))
    items = [(i, say(rng.randrange(0, 25))) for i in range(14)] + [(2, say(12)), (None, say(14)), (5, None), (6, "only two"), (BIG, say(11)), (BIG + 2, "z " * 30)]
    items.append(items[0])
    docs = [(i, say(rng.randrange(0, 50)) + " " + rng.choice(items)[1:][0].__str__()) for i in range(50)]
    docs += [(60, None), (61, ""), (62, "Only, TWO!"), (63, "z " * 40), (BIG, docs[0][1]), (BIG + 2, docs[1][1]), (None, docs[2][1]), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, 1, "u") for r in docs], "doc_id long, text string, item_id int, source string").coalesce(1)
    b = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, items string")
    got = decontaminate.contamination(d, b, window, shard=300, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_hits(docs, items, window)
    clean = decontaminate.keep_clean(d, b, window)
    bad = {str(r[0]) for r in plain_hits(docs, items, window) if r[5]}
    assert clean.columns == d.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad)
    assert decontaminate.contamination(d.where("false"), b).count() == 0
    none = decontaminate.contamination(d, b.where("false"), window)
    assert none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == len(docs)


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        t = [rng.randrange(rng.choice([2, 3, 5])) for _ in range(rng.randrange(0, 60))] + [0]
        depth = rng.choice([1, 2, 5, 70])
        cut = lambda i: (t[i:] + [0])[: min(depth, (t[i:] + [0]).index(0))]
        order = decontaminate.suffix_order(np.array(t), rng.choice([5, 1 << 15, 1 << 40]), depth).tolist()
        assert sorted(order) == [i for i, x in enumerate(t) if x] and [cut(i) for i in order] == sorted(cut(i) for i in order)
