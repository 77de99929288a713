"""Repeated windows of a corpus: what substring and suffix-array de-duplication share.

A window is `width` consecutive units (bytes or words) of one document. Consecutive windows that have the same
minimiser (the rightmost least gram of `gram` units, by hash) form a run, a few dozen windows long; equal windows always have equal
minimisers, so only runs whose minimiser occurs twice need a closer look. Runs are identified by 64 bits of their minimiser and 64 of
their content, equal runs are counted before anything else is done with them, and only one source of each distinct run is read again.

Documents are identified by a 64-bit hash of id and text, so that rows of one id, or null ids, stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import discard, materialize

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 31) - 1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def sliced(batches, rows: int = 512):
    """Frames of at most so many rows, so that what is made of them stays small."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def byte_units(text: str) -> np.ndarray:
    """A 64-bit value for each UTF-8 byte."""
    return _BYTES[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]


def words_of(text: str) -> list[bytes]:
    """The words, runs of anything but ASCII white space, in UTF-8; splitting bytes splits at just those characters."""
    return text.encode("utf-8").split()


def word_units(text: str) -> np.ndarray:
    """A 64-bit hash for each word."""
    return hashed_words(text.encode("utf-8"))


def word_spans(raw: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that are not marked in `space` start and stop."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space[raw], [True]]).view(np.int8)))
    return edges[0::2], edges[1::2]


def hashed_words(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8, all words in one pass."""
    x = np.frombuffer(raw, dtype=np.uint8)
    return Hashes(_BYTES[x]).of(*word_spans(x))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any range of units, from prefix sums of units times powers modulo 2**64."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        if len(_powers[0]) <= n:
            size = 2 * n + 1
            for k, base in enumerate((_ODD, _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(units * _powers[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * _powers[1][start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * _powers[1][:n])


def window_runs(units: np.ndarray, width: int, gram: int, contents: bool = True) -> tuple[np.ndarray, ...]:
    """Minimiser hash of each run, and its content hash, first window and number of windows if they are asked for."""
    n = len(units)
    if n < width:
        return (np.zeros(0, dtype=np.int64),) * (4 if contents else 1)
    h = Hashes(units)
    g = h.grams(gram)
    key = (g & ~_PLACE) | (_PLACE - np.arange(len(g), dtype=np.uint64))
    span, size, low = width - gram + 1, 1, key
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(key) - span + 1], low[span - size :][: len(key) - span + 1])
    place = (_PLACE - (low & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    if not contents:
        return (g[place[first]].view(np.int64),)
    count = np.diff(np.append(first, len(place)))
    content = h.of(first, first + count + (width - 1))
    return g[place[first]].view(np.int64), content.view(np.int64), first, count


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) with null text as empty."""
    cols = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return cols.withColumn("key", F.xxhash64("doc_id", "text"))


def runs(docs: DataFrame, units: Callable[[str], np.ndarray], width: int, gram: int) -> DataFrame:
    """(g, c, key, s, n): minimiser, content, document, first window and number of windows of every run."""

    def scan(batches):
        for b in batches:
            parts = [(k, window_runs(units(t), width, gram)) for k, t in zip(b["key"], b["text"])]
            size = [len(p[0]) for _, p in parts]
            cols = [np.concatenate([p[j] for _, p in parts]) if parts else [] for j in range(4)]
            yield pd.DataFrame({"g": cols[0], "c": cols[1], "key": np.repeat(b["key"].to_numpy(), size), "s": cols[2], "n": cols[3]})

    return docs.select("key", "text").mapInPandas(scan, "g long, c long, key long, s int, n int")


def repeated_runs(docs: DataFrame, units: Callable[[str], np.ndarray], width: int, gram: int) -> DataFrame:
    """The runs whose minimiser occurs at least twice in the corpus; the others can't hold a repeated window."""

    def scan(batches):
        for b in batches:
            parts = [window_runs(units(t), width, gram, contents=False)[0] for t in b["text"]]
            yield pd.DataFrame({"g": np.concatenate(parts) if parts else []})

    often = docs.select("text").mapInPandas(scan, "g long").groupBy("g").count().where("count > 1").select("g")
    return materialize(runs(docs, units, width, gram).join(often, "g"), "runs")


def distinct_runs(repeated: DataFrame) -> DataFrame:
    """(g, c, times, n, key, s, kinds), a table: each distinct run, one source of it, and the number of distinct runs of its minimiser."""
    one = repeated.groupBy("g", "c").agg(F.count("*").alias("times"), F.min(F.struct("key", "s", "n")).alias("at"))
    one = materialize(one.select("g", "c", "times", "at.n", "at.key", "at.s"), "distinct-runs")
    kinds = materialize(one.join(one.groupBy("g").agg(F.count("*").alias("kinds")), "g"), "kinds")
    discard(one)
    return kinds


def read_again(docs: DataFrame, wanted: DataFrame, make: Callable, schema: str) -> DataFrame:
    """make(text, rows) for the wanted runs of each document, rows being dicts of lists; texts meet their runs by a join on key."""
    names = ("g", "c", "times", "n", "s")
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("r"))  # at most a document's own runs
    # equal rows have equal keys: one of them is enough
    both = docs.select("key", "text").join(lists.select("key", *[F.col("r")[c].alias(c) for c in names]), "key")

    def run(batches):
        for b in batches:
            done = set()
            for key, text, *cols in zip(b["key"], b["text"], *[b[c] for c in names]):
                if key not in done:
                    done.add(key)
                    yield make(text, dict(zip(names, map(np.asarray, cols))))

    return both.mapInPandas(run, schema)


def windows_by_hash(docs: DataFrame, wanted: DataFrame, units: Callable[[str], np.ndarray], width: int) -> DataFrame:
    """(g, c, lo, hi), a table: the repeated windows of the wanted runs, as intervals of window numbers within the run.

    Every window of a distinct run is an edge of the de Bruijn graph, identified by its minimiser and its own hash. Edges are counted
    with the number of times their run occurs, those that occur twice are joined back to their runs, and neighbouring edges of a run
    compact into paths.
    """

    def explode(text, r):
        h = Hashes(units(text))
        n = r["n"].astype(np.int64)
        at = np.repeat(r["s"].astype(np.int64), n) + (j := np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return pd.DataFrame({"g": np.repeat(r["g"], n), "c": np.repeat(r["c"], n), "times": np.repeat(r["times"], n), "j": j, "w": h.of(at, at + width).view(np.int64)})

    edges = materialize(read_again(docs, wanted, explode, "g long, c long, times long, j int, w long").distinct(), "edges")
    twice = edges.groupBy("g", "w").agg(F.sum("times").alias("t")).where("t > 1").select("g", "w")
    found = edges.join(twice, ["g", "w"])
    # the paths of a run have at most a few hundred windows together
    paths = found.groupBy("g", "c").agg(F.sort_array(F.collect_list("j")).alias("js")).select("g", "c", F.explode(_islands(F.col("js"))).alias("i"))
    paths = materialize(paths.select("g", "c", "i.lo", "i.hi"), "paths")
    discard(edges)
    return paths


def _islands(js):
    """Intervals [lo, hi) of a sorted array of integers."""
    starts = F.filter(js, lambda x: ~F.array_contains(js, x - 1))
    stops = F.transform(F.filter(js, lambda x: ~F.array_contains(js, x + 1)), lambda x: x + 1)
    return F.arrays_zip(starts.alias("lo"), stops.alias("hi"))


def covered(docs: DataFrame, repeated: DataFrame, found: DataFrame, extra: str = "") -> DataFrame:
    """docs with `spans`: the intervals [from, to) of windows of each document that are repeated, or null."""
    hits = repeated.join(found, ["g", "c"]).select("key", (F.col("s") + F.col("lo")).alias("a"), (F.col("s") + F.col("hi")).alias("b"))
    lists = hits.distinct().groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return docs.join(lists, "key", "left")


def mask(n: int, starts, stops, width: int) -> np.ndarray:
    """Which of n units are covered by windows in [start, stop)."""
    out = np.zeros(n + 1, dtype=np.int64)
    if starts is not None and len(starts):
        np.add.at(out, np.asarray(starts, dtype=np.int64), 1)
        np.add.at(out, np.asarray(stops, dtype=np.int64) + (width - 1), -1)
    return np.cumsum(out[:-1]) > 0
