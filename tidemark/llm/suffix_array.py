"""Suffix-array de-duplication: remove every byte covered by a 200-byte string that also starts elsewhere.

The runs of windows that may repeat (see repeats) are dealt to shards by their minimiser, so that equal windows meet in one
shard. A shard joins its distinct runs to one text, sorts its suffixes by induced sorting and takes the permuted common-prefix
array; a window is repeated when its suffix shares 200 bytes with a neighbour.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import repeats
from tidemark.llm.common import discard, map_rows, materialize

#: Bytes of a repeated string, bytes of a minimiser's gram, bytes of a shard, and the distinct runs of one minimiser
#: beyond which its windows are counted by hash over all tasks, as a shard could not hold them.
WIDTH, GRAM, SHARD, MOST_RUNS = 200, 40, 1 << 20, 2000
#: Letters up to which a sweep takes a bucket at a time.
FEW_LETTERS = 600


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of t from its leftmost-smaller suffixes in order, bucket by bucket, many suffixes at a time.

    A first sweep places the larger suffixes from the left, a second the smaller ones from the right. Within a
    bucket, suffixes that a suffix of the same bucket induces follow in waves, one for each further equal letter.
    """
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    n_s = np.bincount(t[is_s], minlength=sigma)
    heads = np.cumsum(count) - count
    mids = heads + count - n_s  # where a bucket's smaller suffixes begin
    sa = np.full(n, -1, dtype=np.int64)
    fill = heads.copy()
    by_letter = np.searchsorted(t[lms], np.arange(sigma + 1))  # lms comes sorted by suffix, so by letter

    def put_left(j):
        """Append suffixes in this order to the fronts of their buckets."""
        if len(j):
            c = t[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
            k = np.bincount(c, minlength=sigma)
            before = np.cumsum(k) - k
            sa[fill[c] + np.arange(len(j)) - before[c]] = j
            fill[:] += k

    # the last suffix is a larger one that nothing induces
    put_left(np.array([n - 1]))
    for c in np.flatnonzero(count):
        at = heads[c]
        while at < fill[c]:
            stop = fill[c]
            j = sa[at:stop] - 1
            at = stop
            j = j[j >= 0]
            put_left(j[~is_s[j]])
        j = lms[by_letter[c] : by_letter[c + 1]] - 1
        j = j[j >= 0]
        put_left(j[~is_s[j]])

    fill = heads + count  # from the right end of each bucket

    def put_right(j):
        if len(j):
            c = t[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
            k = np.bincount(c, minlength=sigma)
            before = np.cumsum(k) - k
            sa[fill[c] - 1 - (np.arange(len(j)) - before[c])] = j
            fill[:] -= k

    for c in np.flatnonzero(count)[::-1]:
        at = heads[c] + count[c]
        while at > fill[c]:
            stop = fill[c]
            j = sa[stop:at][::-1] - 1
            at = stop
            j = j[j >= 0]
            put_right(j[is_s[j]])
        j = sa[heads[c] : mids[c]][::-1] - 1
        j = j[j >= 0]
        put_right(j[is_s[j]])
    return sa


def _induce_many(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same, one suffix at a time: for a string over so many letters that most buckets hold a few suffixes."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    ends = np.cumsum(count)
    first = np.full(n, -1, dtype=np.int64)
    c = t[lms]
    of = np.bincount(c, minlength=sigma)
    first[ends[c] - of[c] + np.arange(len(lms)) - (np.cumsum(of) - of)[c]] = lms  # the leftmost-smaller suffixes in order at the ends of their buckets
    # the suffix that each one induces in either sweep, or -1; the entry behind the last is that of an empty place
    before = np.arange(-1, n)
    before[-1] = -1
    some = before >= 0
    larger, smaller = np.full(n + 1, -1), np.full(n + 1, -1)
    larger[some] = np.where(is_s[before[some]], -1, before[some])
    smaller[some] = np.where(is_s[before[some]], before[some], -1)
    larger, smaller, letters, sa, head, tail = (array("q", x.astype(np.int64).tobytes()) for x in (larger, smaller, t, first, ends - count, ends))  # denser than lists
    c = letters[n - 1]  # the last suffix is a larger one that nothing induces: it comes first in its bucket
    sa[head[c]] = n - 1
    head[c] += 1
    for v in sa:  # grows ahead of the loop
        j = larger[v]
        if j >= 0:
            c = letters[j]
            h = head[c]
            sa[h] = j
            head[c] = h + 1
    for v in reversed(sa):
        j = smaller[v]
        if j >= 0:
            c = letters[j]
            h = tail[c] - 1
            sa[h] = j
            tail[c] = h
    return np.array(sa, dtype=np.int64)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of a string of integers below sigma, by induced sorting.

    Suffixes are classified, the leftmost-smaller substrings are sorted by a first induction and named, and the string of
    names is sorted recursively. The order of the leftmost-smaller suffixes then induces that of all. Over a few hundred letters a sweep takes
    a bucket at a time, over more (the strings of names) a suffix at a time.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    induce = _induce if sigma <= FEW_LETTERS else _induce_many
    # smaller: less than the next suffix; equal letters take the class of the next one
    up = np.concatenate([t[:-1] < t[1:], [False]])
    even = np.concatenate([t[:-1] == t[1:], [False]])
    known = np.flatnonzero(~even)
    is_s = up[known[np.searchsorted(known, np.arange(n))]]
    lms = np.flatnonzero(is_s & np.concatenate([[False], ~is_s[:-1]]))
    if not len(lms):
        return induce(t, is_s, lms, sigma)
    rough = lms[np.argsort(t[lms], kind="stable")]
    sa = induce(t, is_s, rough, sigma)
    place = np.zeros(n, dtype=bool)
    place[lms] = True
    order = sa[place[sa]]
    # name the substrings from one leftmost-smaller place to the next, inclusive
    stop = np.append(lms[1:], n - 1)
    index = np.full(n, -1, dtype=np.int64)
    index[lms] = np.arange(len(lms))
    a, b = order[:-1], order[1:]
    la, lb = stop[index[a]] - a, stop[index[b]] - b
    same = (la == lb) & (index[a] != len(lms) - 1) & (index[b] != len(lms) - 1)
    live, off = np.flatnonzero(same), 0
    while len(live):
        ok = (t[a[live] + off] == t[b[live] + off]) & (is_s[a[live] + off] == is_s[b[live] + off])
        same[live[~ok]] = False
        live = live[ok & (off < la[live])]
        off += 1
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] < len(lms) - 1:
        reduced = np.empty(len(lms), dtype=np.int64)
        reduced[index[order]] = name
        order = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return induce(t, is_s, order, sigma)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, by place in the text, the one before it in order (-1: none) and their common prefix.

    Only where the letters before the two differ is it compared, all such places in step; elsewhere it is one less
    than that of the place before.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    prev = phi - 1
    derived = (phi > 0) & (np.arange(n) > 0)
    derived[derived] = (t[np.flatnonzero(derived) - 1] == t[prev[derived]]) & (phi[np.flatnonzero(derived) - 1] == prev[derived])
    places = np.flatnonzero(~derived)
    length = np.zeros(n, dtype=np.int64)
    live = places[phi[places] >= 0]
    while len(live):
        i, j = live + length[live], phi[live] + length[live]
        live, i, j = live[ok := (i < n) & (j < n)], i[ok], j[ok]
        live = live[t[i] == t[j]]
        length[live] += 1
    back = np.maximum.accumulate(np.where(derived, 0, np.arange(n)))
    return phi, np.maximum(0, length[back] - (np.arange(n) - back))


def repeated_places(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string the places whose next `width` bytes, within the string, also start at another place of these strings."""
    size = [len(s) for s in strings]
    t = np.zeros(sum(size) + len(size), dtype=np.int64)
    starts = np.cumsum([0, *[s + 1 for s in size]])[:-1]
    for at, s in zip(starts, strings):
        t[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 1
    sa = suffix_array(t, 257)
    phi, lcp = permuted_lcp(t, sa)
    long = lcp >= width
    hit = long.copy()
    hit[phi[long]] = True
    ends = np.repeat(starts + np.array(size), np.array(size) + 1)
    hit &= np.arange(len(t)) + width <= ends
    return [np.flatnonzero(hit[at : at + n]) for at, n in zip(starts, size)]


def repeated_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD, most_runs: int = MOST_RUNS) -> DataFrame:
    """(key, doc_id, text, a, b): documents with the intervals of their windows that are repeated."""
    docs = repeats.keyed(docs)
    again = repeats.repeated_runs(docs, repeats.byte_units, width, gram)
    kinds = repeats.distinct_runs(again)
    # a run that occurs twice is repeated as a whole, whatever else its minimiser has
    whole = kinds.where("times > 1").select("g", "c", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    mixed = kinds.where(F.col("kinds") > 1)

    def cut(text, r):
        raw = text.encode("utf-8")
        return pd.DataFrame({"g": r["g"], "c": r["c"], "times": r["times"], "raw": [raw[s : s + n + width - 1] for s, n in zip(r["s"], r["n"])]})

    strings = materialize(repeats.read_again(docs, mixed.where(F.col("kinds") <= most_runs), cut, "g long, c long, times long, raw binary"), "strings")
    total = strings.agg(F.sum(F.length("raw"))).first()[0] or 0
    shards = max(1, -(-total // shard))

    def sort(g):
        rows, strings = [], g["raw"].to_list()
        for (_, r), at in zip(g[["g", "c", "times"]].iterrows(), repeated_places(strings, width)):
            if r["times"] < 2 and len(at):
                first = np.concatenate([[True], np.diff(at) > 1])
                lo = at[first]
                hi = at[np.append(first[1:], True)] + 1
                rows += [(r["g"], r["c"], a, b) for a, b in zip(lo, hi)]
        return pd.DataFrame(rows, columns=["g", "c", "lo", "hi"]).astype("int64")

    sorted_ = strings.groupBy(F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard")).applyInPandas(sort, "g long, c long, lo int, hi int")
    hot = repeats.windows_by_hash(docs, mixed.where(F.col("kinds") > most_runs), repeats.byte_units, width)
    found = materialize(whole.unionByName(sorted_).unionByName(hot), "found")
    discard(kinds, strings, hot)
    return repeats.covered(docs, again, found)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_raw of every document.

    Null text counts as empty. Strings never cross documents, overlaps and repeats within a document count, equal rows are copies of each
    other, a null doc_id is kept, texts of any length are read whole, an empty table gives no rows and extra columns, whatever their names, are ignored.
    """

    def apply(batches):
        for b in batches:
            rows = []
            for doc, text, lo, hi in zip(b["doc_id"], b["text"], b["a"], b["b"]):
                raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
                gone = repeats.mask(len(raw), lo, hi, width)
                kept = raw[~gone].tobytes()
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_raw"])

    cols = repeated_strings(docs, width, gram).select("doc_id", "text", "a", "b")
    return map_rows(cols, apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_raw binary")


#: Columns that keep_rest adds to a user's own.
KEY, FROM, TO = "_repeat_key", "_repeat_from", "_repeat_to"


def keep_rest(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """documents with the repeated bytes cut out of `text`, other columns as they are; n_chars, if there, follows the text.

    A character of which only some bytes are covered goes as a whole. Documents left without text stay, as empty ones. Null text counts as empty, equal
    rows are copies of each other, texts of any length are read whole, an empty table gives no rows; extra columns may have any name but KEY, FROM and TO.
    """
    spans = repeated_strings(documents, width, gram).where("a is not null").groupBy("key").agg(F.first("a").alias(FROM), F.first("b").alias(TO)).withColumnRenamed("key", KEY)
    both = documents.withColumn(KEY, F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).join(spans, KEY, "left")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, lo, hi):
            raw = text.encode("utf-8")
            out.append(np.frombuffer(raw, dtype=np.uint8)[~repeats.mask(len(raw), a, b, width)].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    none = F.array().cast("array<int>")
    text = F.when(F.col(FROM).isNull(), F.coalesce("text", F.lit(""))).otherwise(rest(F.coalesce("text", F.lit("")), F.coalesce(FROM, none), F.coalesce(TO, none)))
    out = both.withColumn("text", text).select(*documents.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
