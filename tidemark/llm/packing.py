"""Best-fit packing by patterns: non-negative least squares on the histogram of piece lengths.

Documents become token pieces of at most `size`; only longer ones are cut, the rest of the division first.
Every multiset of up to three lengths that fills a sequence exactly is a pattern. Repeat counts are fitted
to the histogram by non-negative least squares (accelerated projected gradient; the matrix has at most three
entries a column), rounded down, and what is left is packed best-fit, longest first. All planning works on the
histogram, which has at most `size` rows whatever the corpus; pieces then find their places by their rank
among the pieces of their length, which is computed in salted groups so that a length that a large part of
the corpus shares is spread over many tasks.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from tokenizers import Tokenizer
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import map_rows, materialize

#: The id after each document, and the tokens of a sequence.
END, SIZE = 2, 1024


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@lru_cache(maxsize=2)
def _library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def patterns(size: int) -> np.ndarray:
    """All multisets of one to three lengths that sum to size: rows of three lengths, zero where unused."""
    out = [np.array([[size, 0, 0]])]
    a = np.arange(1, size // 2 + 1)
    out.append(np.stack([size - a, a, 0 * a], 1))
    for c in range(1, size // 3 + 1):
        b = np.arange(c, (size - c) // 2 + 1)
        out.append(np.stack([size - c - b, b, 0 * b + c], 1))
    return np.concatenate(out)


def fit_counts(have: np.ndarray, pats: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - have|, A counting a pattern's lengths. have[l]: pieces of length l."""
    size = len(have)
    step = 1.0 / (3 * np.bincount(pats.ravel(), minlength=size)[1:].max() + 1e-9)
    x = np.zeros(len(pats))
    # start from an even split of each length over the patterns that use it
    use = np.bincount(pats.ravel(), minlength=size).astype(float)
    use[0] = 1
    share = have / np.maximum(use, 1)
    share[0] = np.inf
    x = share[pats].min(axis=1)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        r = np.bincount(pats.ravel(), weights=np.repeat(y, 3), minlength=size) - have
        r[0] = 0
        new = np.maximum(0, y - step * r[pats].sum(axis=1))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[pd.DataFrame, int]:
    """Places for counts of lengths: rows (length, lo, hi, base, offset), and the number of sequences.

    The pieces of rank lo to hi - 1 among those of their length go to sequences base, base + 1, ... at that offset.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    rows, done, made = [], np.zeros(size + 1, dtype=np.int64), 0

    def place(lengths: list[int], repeats: int) -> None:
        nonlocal made
        at = 0
        for k in lengths:
            rows.append((k, done[k], done[k] + repeats, made, at))
            done[k] += repeats
            at += k
        made += repeats

    if left.sum():
        pats = patterns(size)
        pats = pats[(left[pats] > 0)[:, 0] & ((left[pats] > 0) | (pats == 0)).all(axis=1)]
        if len(pats):
            x = np.floor(fit_counts(left.astype(float), pats) + 1e-6).astype(np.int64)
            for i in np.argsort(-x, kind="stable"):
                if x[i] <= 0:
                    break
                ks = [int(k) for k in pats[i] if k]
                need = defaultdict(int)
                for k in ks:
                    need[k] += 1
                if n := int(min([x[i], *(left[k] // m for k, m in need.items())])):
                    place(ks, n)
                    for k, m in need.items():
                        left[k] -= n * m
        # best fit of the rest, longest first: open sequences of equal content are one group
        gaps: dict[int, list[list]] = defaultdict(list)
        for k in range(size, 0, -1):
            n = int(left[k])
            while n:
                gap = next((g for g in range(k, size) if gaps.get(g)), None)
                if gap is None:
                    each = size // k
                    if n >= each and each:
                        full, n = n // each, n % each
                        gaps[size - each * k].append([[k] * each, full])
                    else:
                        gaps[size - n * k].append([[k] * n, 1])
                        n = 0
                    continue
                group = gaps[gap][-1]
                m = min(n, group[1])
                gaps[gap - k].append([[*group[0], k], m])
                group[1] -= m
                if not group[1]:
                    gaps[gap].pop()
                n -= m
            left[k] = 0
        for groups in gaps.values():
            for lengths, n in groups:
                place(lengths, n)
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "base", "offset"], dtype="int64"), made


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], size: int = SIZE, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text with the end id, in one narrow pass. Null text: empty.

    Texts that the fast encoder's pattern gives up on (runs of white space of about a million) are encoded by the tokenizers library with the file `tokenizer`.
    """
    names = tuple(special.items())

    def run(batches):
        enc = _encoding(ranks_path, pattern, names)

        def encoded(text):
            try:
                return enc.encode(text, allowed_special="all")
            except ValueError:  # its pattern's stack is full
                if tokenizer is None:
                    raise
                return _library(tokenizer).encode(text, add_special_tokens=False).ids

        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*encoded(text), end], dtype="<u4")
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                rows += [(doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes())) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    cols = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(cols, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], size: int = SIZE, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """Pack every document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text counts as empty (a piece of the end id alone), an empty table gives no rows, equal rows of the same
    doc_id are each packed, as are rows without one; pieces of equal length tie by id, piece and content and then take any order; texts
    of any length are encoded whole; extra columns, whatever their names, are ignored.
    """
    keys = ("doc_id", "piece", "ids_crc32")
    pieces = materialize(token_pieces(docs, ranks_path, pattern, special, size, end, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    where, _ = plan(counts, size)

    # a length's pieces fall into about the square root of their number of salted groups
    salts = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int(n**0.5) + 1)]) if counts else F.create_map(F.lit(0).cast("long"), F.lit(1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*keys), F.element_at(salts, F.col("length"))))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*keys)) - 1)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))

    table = where.sort_values(["length", "lo"], kind="stable")
    step = int(max(counts.values(), default=0)) + 1
    at = (table["length"] * step + table["lo"]).to_numpy()
    lo, base, offset = (table[c].to_numpy() for c in ("lo", "base", "offset"))

    def run(batches):
        for b in batches:
            i = np.searchsorted(at, (b["length"] * step + b["rank"]).to_numpy(), side="right") - 1
            b["sequence_id"] = base[i] + b["rank"].to_numpy() - lo[i]
            b["offset"] = offset[i]
            yield b.drop(columns=["rank"])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return map_rows(ranked.select(*cols, "rank"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
