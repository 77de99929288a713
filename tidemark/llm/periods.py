"""Periodic runs of words, from Lyndon words under both orders of the words.

A text is scanned from right to left, once under an order of its words and once under the reverse order; a stack of Lyndon words
gives the longest one that starts at each word. Every run has a root among them, so each such word is extended to both sides as far as its period lasts.
Where two places agree in their first words, how far they agree is found by a binary search over rolling hashes, and the words
at both ends of what it finds, and in the end every word of a run, are compared themselves. There is no suffix array.

A text is read whole within its task and nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Modulus of the rolling hashes (two of them, 62 bits together); words that a comparison looks at before it turns to hashes.
PRIME, DIRECT = (1 << 31) - 1, 8


class Rolling:
    """Hashes of all ranges of a sequence of word numbers, from prefix sums of random values times powers."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng([seed, 61])
        n = len(words)
        self.n, self.sums, self.powers = n, [], []
        for _ in range(2):
            base, value = int(rng.integers(1 << 20, PRIME - 1)), rng.integers(1, PRIME, int(words.max()) + 1 if n else 1)
            power = np.ones(n + 1, dtype=np.int64)
            done, step = 1, base
            while done <= n:
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * step % PRIME
                done, step = done * 2, step * step % PRIME
            total = np.zeros(n + 1, dtype=np.int64)
            for a in range(0, n, 1 << 30):  # so many values below PRIME add up below 2**63
                part = value[words[a : a + (1 << 30)]]
                part = np.cumsum(part * power[a : a + len(part)] % PRIME)
                total[a + 1 : a + 1 + len(part)] = (total[a] + part) % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def same(self, i, j, length):
        """Whether the ranges of this length from i and from j > i have one hash, element by element."""
        ok = True
        for s, p in zip(self.sums, self.powers):
            ok = ok & (((s[i + length] - s[i]) % PRIME * p[j - i] - (s[j + length] - s[j])) % PRIME == 0)
        return ok

    def scalars(self):
        """The same of two single places, over Python's integers."""
        (s, t), (p, q) = [x.tolist() for x in self.sums], [x.tolist() for x in self.powers]

        def same(i, j, length):
            return (
                ((s[i + length] - s[i]) * p[j - i] - (s[j + length] - s[j])) % PRIME == 0
                and ((t[i + length] - t[i]) * q[j - i] - (t[j + length] - t[j])) % PRIME == 0
            )

        return same


def lyndon_ends(a: list[int], hashes) -> list[int]:
    """Where the longest Lyndon word that starts at each place ends, under the order of the numbers; the end of the text is less than any word."""
    n = len(a)
    end = [0] * n
    last: dict[int, tuple[int, int]] = {}  # by distance, the last place found to agree long with the one so far on, and how long
    for i in range(n - 1, -1, -1):
        x, j = a[i], i + 1
        while j < n:
            y = a[j]
            if x < y:
                j = end[j]
            elif x > y:
                break
            else:
                k, most = 1, n - j
                stop = min(DIRECT, most)
                while k < stop and a[i + k] == a[j + k]:
                    k += 1
                if k == stop and k < most:
                    before = last.get(j - i, (n, 0))
                    k = before[0] - i + before[1] if before[0] - i <= k else _search(a, i, j, k, hashes())
                    last[j - i] = i, k
                if k == most or a[i + k] > a[j + k]:  # the later suffix is a prefix of the earlier, or less
                    break
                j = end[j]
        end[i] = j
    return end


def _search(a: list[int], i: int, j: int, k: int, same) -> int:
    """How far a agrees from i and from j > i on, k words at least: doubled steps, then halved ones, the words at the end of it compared."""
    most, step = len(a) - j, 2 * k
    while step < most and same(i, j, step):
        k, step = step, 2 * step
    high = min(step, most) + 1
    while k + 1 < high:
        mid = (k + high) // 2
        if same(i, j, mid):
            k = mid
        else:
            high = mid
    if a[i + k - 1] != a[j + k - 1] or (k < most and a[i + k] == a[j + k]):
        raise Collision
    return k


class Collision(Exception):
    """Two different ranges have one hash."""


def _agree(same, room: np.ndarray) -> np.ndarray:
    """The largest length up to room for which same(rows, length) holds, for each row, all rows in step."""
    low, high = np.zeros(len(room), np.int64), room + 1
    rows = np.arange(len(room))
    while len(rows):
        mid = (low[rows] + high[rows]) // 2
        ok = same(rows, mid)
        low[rows[ok]] = mid[ok]
        high[rows[~ok]] = mid[~ok]
        rows = rows[low[rows] + 1 < high[rows]]
    return low


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run by start, then period: stretches of smallest period q, at least max(least, 2 q) long, that neither neighbour extends."""
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    for seed in range(100):
        try:
            return _runs(words, seed, least)
        except Collision:
            continue
    raise RuntimeError("a hundred pairs of hashes collided")


def _directly(words: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
    """How far the words agree from i and j on in direction `step`, DIRECT at most."""
    far, rows = np.zeros(len(i), np.int64), np.flatnonzero(room > 0)
    for k in range(DIRECT):
        rows = rows[words[i[rows] + step * k] == words[j[rows] + step * k]]
        far[rows] += 1
        rows = rows[room[rows] > k + 1]
        if not len(rows):
            break
    return far


def _runs(words: np.ndarray, seed: int, least: int) -> np.ndarray:
    n = len(words)
    rolling = functools.cache(lambda: Rolling(words, seed))
    scalars = functools.cache(lambda: rolling().scalars())
    ends = [np.array(lyndon_ends((words if up else -words).tolist(), scalars), dtype=np.int64) for up in (True, False)]
    i, j = np.tile(np.arange(n), 2), np.concatenate(ends)
    i, j = i[j < n], j[j < n]
    # a few words on both sides tell for nearly all roots that their period goes on for too short
    right, left = _directly(words, i, j, 1, n - j), _directly(words, i - 1, j - 1, -1, i)
    long = (right == DIRECT) | (left == DIRECT) | (left + right + j - i >= np.maximum(least, 2 * (j - i)))
    i, j, right, left = i[long], j[long], right[long], left[long]
    if not len(i):
        return np.zeros((0, 3), np.int64)
    more = np.flatnonzero(right == DIRECT)
    right[more] = _agree(lambda r, k: rolling().same(i[more[r]], j[more[r]], k), n - j[more])
    more = np.flatnonzero(left == DIRECT)
    left[more] = _agree(lambda r, k: rolling().same(i[more[r]] - k, j[more[r]] - k, k), i[more])
    start, stop, period = i - left, j + right, j - i
    enough = stop - start >= np.maximum(least, 2 * period)
    runs = np.unique(np.stack([start[enough], stop[enough] - start[enough], period[enough]], axis=1), axis=0)
    for s, length, q in runs.tolist():  # word by word, to both ends
        e = s + length
        if not np.array_equal(words[s : e - q], words[s + q : e]) or (s and words[s - 1] == words[s - 1 + q]) or (e < n and words[e] == words[e - q]):
            raise Collision
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(words: list[bytes], doc: str | None) -> list[bytes]:
    """The words with a periodic tail in every tenth document by the hash of its id; a null id has none."""
    n, h = len(words), zlib.crc32(doc.encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], least: int = LEAST) -> tuple[np.ndarray, list[bytes]]:
    """The runs of a text, and its words without those that a run has after its first period."""
    number: dict[bytes, int] = {}
    runs = find_runs(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64), least)
    if not len(runs):
        return runs, words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(depth[:-1]) == 0
    return runs, [w for w, k in zip(words, keep.tolist()) if k]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, plant: bool = True, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: the smallest start, then period), runs_sha256 and collapsed_sha256 of every document.

    With plant, every tenth document by the hash of its id gets a periodic tail first. Null and empty texts have no words and no run; texts of any length
    are read whole; a null doc_id is kept and gets no tail; repeated rows each give a row; an empty table gives none; extra columns are ignored.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for doc, text in zip(part.column("name").to_pylist(), part.column("text")):
                    words = text.as_py().encode().split()
                    runs, kept = collapse(planted(words, doc) if plant else words, least)
                    best = [None] * 4
                    if len(runs):
                        s, n, q = runs[np.argmax(runs[:, 1])].tolist()
                        best = [s, n, q, 1000 * n // q]
                    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                    rows.append([len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()])
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return cols.mapInArrow(run, SCHEMA)


def keep_collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with every periodic run of words cut to its first period, the kept words joined by single spaces; texts without a run stay as they are.

    Other columns stay, whatever their names; n_chars, if there, follows the text. Null texts stay null.
    """
    @F.pandas_udf("string")
    def short(texts):
        out = texts.copy()
        for k, t in enumerate(texts):
            if t is not None:
                runs, kept = collapse(t.encode().split(), least)
                out.iloc[k] = b" ".join(kept).decode() if len(runs) else t
        return out

    out = docs.withColumn("text", short("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
