"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of some million words and sorts the shard's suffixes. Every suffix of every test item is
binary-searched in every shard, word after word, which gives its longest verbatim match, all its places, and those of its first
ten words. Words that no test item has end a suffix, and suffixes that begin with one, which nothing can match, are left out of the array.

Documents are never shuffled; shards follow the order in which they are read, and no result depends on where one ends. The test
items come to the tasks in blocks of a bounded number of words, one pass of the same stage a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import materialize

#: Words of a window; words of a shard; words of a block of test items; blocks that one stage goes through.
WINDOW, SHARD, BLOCK, AT_ONCE = 10, 1 << 20, 1 << 19, 4
#: Words consist of digits, letters and what is not ASCII; capitals count as small, all else as a space.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def suffix_order(t: np.ndarray, letters: int, depth: int) -> np.ndarray:
    """The places of t other than 0 in the order of their suffixes, the first `depth` letters compared; a 0 ends a suffix.

    t has integers below `letters` and a 0 at its end. As many letters as 62 bits hold are sorted at once, then ever twice as many
    by the ranks of what is sorted, and only where suffixes are still tied and go on.
    """
    at = np.flatnonzero(t)
    if not len(at):
        return at
    bits = max(1, int(letters - 1).bit_length())
    h = min(62 // bits, max(1, depth))
    zeros = np.flatnonzero(t == 0)
    left = zeros[np.searchsorted(zeros, at)] - at  # letters up to the next 0
    padded = np.concatenate([t, np.zeros(h, dtype=t.dtype)]).astype(np.int64)
    key, over = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for k in range(h):
        over |= left <= k
        key = key << bits | np.where(over, 0, padded[at + k])
    order = np.argsort(key, kind="stable")
    sa, key = at[order], key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(len(t) + 1, np.int64)  # 0: a suffix that has ended
    rank[sa] = group = np.maximum.accumulate(np.where(first, np.arange(len(sa)), 0)) + 1
    left = left[order]
    while h < depth:
        tied = np.concatenate([~first[1:], [False]]) | ~first
        live = np.flatnonzero(tied & (left >= h))
        if not len(live):
            break
        own, then = group[live], rank[np.minimum(sa[live] + h, len(t))]
        new = np.lexsort((then, own))
        own, then = own[new], then[new]
        sa[live], left[live] = sa[live][new], left[live][new]
        starts = np.concatenate([[True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])])
        first[live] = starts
        group[live] = np.maximum.accumulate(np.where(starts, live, 0)) + 1
        rank[sa[live]] = group[live]
        h *= 2
    return sa


class Items:
    """Test items of one block: their words as numbers from 1, suffixes, and which of them are windows."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names, seqs = [], []
        for name, text in sorted(set(rows), key=lambda r: (r[0] is None, r)):
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if seq:
                self.names.append(name)
                seqs.append(seq)
        size = np.array([len(s) for s in seqs], dtype=np.int64)
        self.t = np.array([x for s in seqs for x in s] + [0], dtype=np.int64)
        self.item = np.repeat(np.arange(len(seqs)), size)
        stop = np.repeat(np.cumsum(size), size)
        self.left = stop - np.arange(len(self.t) - 1)  # words of each suffix
        whole = np.repeat(size, size)
        self.needs = np.where(whole < window, whole, window)  # words of a match that make it a window
        self.depth = int(size.max()) if len(size) else 0


class Shard:
    """Documents in a row, their words as numbers of test words, 0 for all others and after each document."""

    def __init__(self, texts: list[list[bytes]], number: dict[bytes, int]):
        self.size = np.array([len(w) for w in texts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        self.t = np.zeros(int((self.size + 1).sum()), dtype=np.int64)
        get = number.get
        for at, words in zip(self.start.tolist(), texts):
            self.t[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(longest, doc, item): for each place the words of the longest match that is a window and starts there, and pairs of a document and an item that has a window in it."""
        t = self.t
        sa = suffix_order(t, len(items.number) + 1, items.depth)
        longest = np.zeros(len(t), np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        q = np.arange(len(items.item))
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(sa))
        for k in range(items.depth):
            live = (items.left[q] > k) & (low < high)
            q, low, high = q[live], low[live], high[live]
            if not len(q):
                break
            word = items.t[q + k]
            low, high = _bound(t, sa, k, word, low, high, False), _bound(t, sa, k, word, low, high, True)
            live = low < high
            q, low, high = q[live], low[live], high[live]
            # a match of this many words that is a window: suffixes of an interval are those of one string
            deep = items.needs[q] <= k + 1
            spans = np.unique(low[deep])
            stops = high[deep][np.unique(low[deep], return_index=True)[1]]
            longest[sa[_ranges(spans, stops)]] = k + 1
            just = items.needs[q] == k + 1
            if just.any():
                pairs.append(self._pairs(sa, low[just], high[just], items.item[q[just]]))
        found = np.unique(np.concatenate(pairs), axis=0)
        return longest, found[:, 0], found[:, 1]

    def _pairs(self, sa, low, high, item):
        """Distinct (document, item), from intervals of the array and the items they belong to; an interval's documents are told apart once."""
        spans, which = np.unique(low, return_inverse=True)
        stops = high[np.unique(low, return_index=True)[1]]
        count = stops - spans
        doc = np.searchsorted(self.start, sa[_ranges(spans, stops)], "right") - 1
        seen = np.unique(np.stack([np.repeat(np.arange(len(spans)), count), doc], axis=1), axis=0)
        wants = np.unique(np.stack([which, item], axis=1), axis=0)
        begin, end = np.searchsorted(seen[:, 0], wants[:, 0], "left"), np.searchsorted(seen[:, 0], wants[:, 0], "right")
        return np.unique(np.stack([seen[_ranges(begin, end), 1], np.repeat(wants[:, 1], end - begin)], axis=1), axis=0)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of [low, high), one range after the other."""
    n = high - low
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)


def _bound(t, sa, k, word, low, high, after):
    """Within each interval of suffixes that share k letters, where the letter `word` begins, or ends, at place k; all searches in step."""
    low, high = low.copy(), high.copy()
    rows = np.arange(len(word))
    while len(rows):
        mid = (low[rows] + high[rows]) // 2
        letter = t[sa[mid] + k]
        right = letter <= word[rows] if after else letter < word[rows]
        low[rows[right]] = mid[right] + 1
        high[rows[~right]] = mid[~right]
        rows = rows[low[rows] < high[rows]]
    return low


#: Columns that go with a row from block to block: hit intervals, items, the longest match and its place.
NAMES = FROM, TO, ITEMS, LONGEST, AT = ("_hit_from", "_hit_to", "_hit_items", "_hit_longest", "_hit_longest_at")


def _scan(df: DataFrame, items: Items, shard: int) -> DataFrame:
    """df with what this block of items adds to the carried columns."""
    cast = df.sparkSession.sparkContext.broadcast(items)  # at most BLOCK words, or one item
    names = df.columns

    def run(batches):
        items = cast.value

        def done(parts, texts):
            s = Shard(texts, items.number)
            longest, doc, item = s.search(items)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows = []
            old = {c: [x for p in parts for x in p.column(c).to_pylist()] for c in NAMES}
            for k, (a, n) in enumerate(zip(s.start.tolist(), s.size.tolist())):
                here = longest[a : a + n]
                at = np.flatnonzero(here)
                lo, hi = _joined(at, at + here[at])
                best = int(np.argmax(here)) if len(at) else -1
                before = old[LONGEST][k]
                better = len(at) and (before is None or (-int(here[best]), best) < (-before, old[AT][k]))
                more = [items.names[x] for x in item[cut[k] : cut[k + 1]] if items.names[x] is not None]
                rows.append((
                    old[FROM][k] + lo.tolist(), old[TO][k] + hi.tolist(), old[ITEMS][k] + more,
                    int(here[best]) if better else before, best if better else old[AT][k],
                ))
            new = dict(zip(NAMES, zip(*rows)))
            types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64()]
            fresh = {c: pa.array(new[c], x) for c, x in zip(NAMES, types)}
            from_row = 0
            for p in parts:
                yield pa.RecordBatch.from_arrays([fresh[c].slice(from_row, p.num_rows) if c in fresh else p.column(c) for c in names], list(names))
                from_row += p.num_rows

        parts, texts, words = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                new = [words_of(x.as_py() or "") for x in part.column("text")]
                parts.append(part)
                texts += new
                words += sum(map(len, new))
                if words >= shard:
                    yield from done(parts, texts)
                    parts, texts, words = [], [], 0
        if parts:
            yield from done(parts, texts)

    return df.mapInArrow(run, df.schema)


def _joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals by their starts, those that meet or overlap as one."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK, only_text: bool = False) -> DataFrame:
    """doc_id and text of every document (text alone with only_text, whose other columns go along), with n_words and the carried columns, over all blocks of items."""
    spark = docs.sparkSession
    texts = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block)))  # a word and what parts it from the next has two characters at least
    df = docs if only_text else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    none = dict(zip(NAMES, (F.array().cast("array<bigint>"), F.array().cast("array<bigint>"), F.array().cast("array<string>"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))))
    df = df.withColumns(none)
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # bounded by the size of a block
        df = _scan(df, Items([(r.item_id, r.text) for r in rows], window), shard)
        if k % AT_ONCE == AT_ONCE - 1 and k + 1 < blocks:
            df = materialize(df, "decontaminate")
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match (words, number of its first word) of every document.

    benchmark has item_id and text. A word is hit that lies in any occurrence of `window` consecutive words of an item, or of an item that is shorter as a whole.
    Null and empty texts have no words and match nothing; texts of any length are read whole; a null doc_id is kept; repeated documents each give a row; an item
    that occurs twice counts once and an id with several texts has the windows of all; windows of a null item_id hit words but are not counted as an item; with
    an empty benchmark nothing is hit; an empty table gives no rows; extra columns are ignored. Of equally long matches the first in the text is told.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long"
    names = [f.split()[0] for f in schema.split(", ")]

    def told(batches):
        for b in batches:
            rows = []
            for text, lo, hi, items in zip(b.column("text"), *[b.column(c).to_pylist() for c in (FROM, TO, ITEMS)]):
                order = sorted(zip(lo, hi))
                a, z = _joined(np.array([x for x, _ in order], dtype=np.int64), np.array([x for _, x in order], dtype=np.int64))
                hit, ids = int((z - a).sum()), sorted(set(items))
                rows.append((len(words_of(text.as_py() or "")), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
            types = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)], b.column(LONGEST), b.column(AT)], names)

    return scan(docs, benchmark, window, shard, block).mapInArrow(told, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns as they are, without the documents that hold a window of a test item. Null text holds none; columns may have any name but NAMES."""
    return scan(docs, benchmark, window, only_text=True).where(F.col(LONGEST).isNull()).select(*docs.columns)


def contamination_sql(documents: str, benchmark: str, window: int = WINDOW) -> str:
    """The same rows as DuckDB SQL, by a join of all windows."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return (
        f"WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {documents}), b0 AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM {benchmark}),"
        f" b1 AS (SELECT item, w, least(len(w), {window}) AS n FROM b0 WHERE len(w) > 0),"
        " b AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b1)),"
        " x AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b)),"
        " h AS MATERIALIZED (SELECT rid, x.n, i, item FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM x) x JOIN b USING (n, s)),"
        " c AS (SELECT rid, count(DISTINCT j) AS hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),"
        " t AS (SELECT rid, list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)) AS items FROM h GROUP BY rid),"
        # matches of items as far as they go: steps of one along neighbouring windows of one item
        f" s AS (SELECT item, w, unnest(range(1, len(w) + 1)) AS p FROM b1 WHERE len(w) >= {window}),"
        f" m0 AS (SELECT rid, i, n AS len FROM h UNION ALL SELECT h.rid, h.i, k FROM (SELECT DISTINCT rid, i FROM h WHERE n = {window}) h JOIN d USING (rid) JOIN s ON s.w[p:p + {window - 1}] = d.w[i:i + {window - 1}] AND len(s.w) - p >= {window - 1},"
        f" LATERAL (SELECT unnest(range({window}, least(len(s.w) - p + 1, len(d.w) - i + 1) + 1)) AS k) WHERE s.w[p:p + k - 1] = d.w[i:i + k - 1]),"
        " m AS (SELECT rid, max((len, -i)) AS best FROM m0 GROUP BY rid)"
        " SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,"
        " coalesce(hit, 0) > 0 AS contaminated, best[1]::BIGINT AS longest, (-best[2] - 1)::BIGINT AS longest_at FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid) LEFT JOIN m USING (rid)"
    )
