"""News of which later near copies are left out, in the order of the list.

An item is kept unless an item kept before it has its address or a title alike. Lists are worked on in stretches, each many times as long as the one before:
titles of a stretch meet those kept before it, and what that leaves open meets among itself. Then rounds of joins settle items whose earlier likes
are all settled, so no list is walked in one task.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions import text as tx
from tidemark.plans.store import kept


def normal_title(title: Column) -> Column:
    """Lower case, letters, digits, underscores and white space alone."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", ""), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def canonical_url(url: Column) -> Column:
    """The address without what follows a #, and without slashes at its end."""
    return F.regexp_replace(F.substring_index(F.trim(F.coalesce(url, F.lit(""))), "#", 1), "/+$", "")


#: Titles of a block at most, on average, and four times as many if they are short; classes of letters and of pairs of letters; pairs of titles looked at in one go.
BLOCK, LETTERS, PAIRS, CHUNK = 2048, 64, 512, 1 << 14
#: Fixed value: the longest titles whose common subsequence is measured; longer ones that pass the other bounds are compared themselves.
LONGEST = 512
#: Titles of up to so many letters are swept: their first 64 are one word of bits. Items of a list's first stretch, about, by how much stretches grow, and parts that lists are cut into for them.
SHORT, FIRST, GROWTH, PARTS = 72, 4096, 4, 256


class Block:
    """Titles as numbers: their letters by class, and how often each has a letter and a pair of neighbouring letters."""

    def __init__(self, ids: np.ndarray, titles: list[str]):
        self.ids, self.titles, self.n = ids, titles, np.array([len(t) for t in titles], np.int64)
        codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(titles)), self.n)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        inner = row[1:] == row[:-1]
        pair = ((codes[:-1] * 1000003 + codes[1:]) * 2654435761 >> 7) % PAIRS
        self.counted = (row, codes % LETTERS, LETTERS, 12), (row[:-1][inner], pair[inner], PAIRS, 3)
        # of each letter its places, as bits, and of each place its letter; a class more stands for no letter
        short = at < LONGEST
        words = -(-min(int(self.n.max()), LONGEST) // 64) or 1
        self.places = np.zeros((len(titles), LETTERS + 1, words), np.uint64)
        np.bitwise_or.at(self.places, (row[short], codes[short] % LETTERS, at[short] // 64), np.uint64(1) << (at[short] % 64).astype(np.uint64))
        self.classes = np.full((min(int(self.n.max()), LONGEST), len(titles)), LETTERS, np.uint8)
        self.classes[at[short], row[short]] = codes[short] % LETTERS

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        return self._levels(*self.counted[0])

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self._levels(*self.counted[1])

    def _levels(self, row: np.ndarray, key: np.ndarray, size: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """A column for each class and level that says whether the title has it so often, and what is beyond the levels."""
        count = np.bincount(row * size + key, minlength=len(self.n) * size).reshape(len(self.n), size)
        return np.concatenate([count >= k for k in range(1, levels + 1)], axis=1).astype(np.float32), np.maximum(count - levels, 0).sum(axis=1)


def most_common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """At most so many letters, or pairs of letters, do titles of two blocks share."""
    return a[0] @ b[0].T + np.minimum.outer(a[1], b[1])


def longest_common(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of titles i of x and j of y, letters being alike by class: at least those of the titles."""
    places, words = x.places[i], x.places.shape[2]
    left = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
    at = np.arange(len(i))
    for letters in y.classes[: int(y.n[j].max())]:
        here, carry = places[at, letters[j]], None
        for w in range(words):
            both = left[w] & here[:, w]
            more = left[w] + both
            over = more < both
            if carry is not None:
                more += carry
                over |= more < carry
            carry = over.astype(np.uint64)
            left[w] = more | (left[w] & ~here[:, w])
    return sum(np.bitwise_count(~v).astype(np.int64) for v in left)


def swept(x: Block, y: Block, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of titles of two blocks, both in the order of their lengths and those of x of SHORT letters at most, that may be alike.

    Each title of y meets all of x at once: the common subsequence with their first 64 letters, and what is behind those, may be long enough. Of a block with itself i < j.
    """
    places, behind, ratio = np.ascontiguousarray(x.places[:, :LETTERS, 0].T), np.maximum(x.n - 64, 0), least / (2 - least)
    there = places.any(axis=1).tolist()
    whole, left, both, more = np.full(len(x.n), ~np.uint64(0)), *np.empty((3, len(x.n)), np.uint64)
    begins, ends = np.searchsorted(x.n, np.ceil(y.n * ratio - 1e-9)), np.searchsorted(x.n, np.floor(y.n / ratio + 1e-9), "right")
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for j, (n, lo, hi) in enumerate(zip(y.n.tolist(), begins.tolist(), ends.tolist())):
        hi = min(hi, j) if x is y else hi
        if lo >= hi or n > len(y.classes):
            rows.append(np.arange(lo, max(lo, hi)))  # too long for its letters to be held: left to the next step
            cols.append(np.full(len(rows[-1]), j))
            continue
        here, l, b, m = list(places[:, lo:hi]), left[lo:hi], both[lo:hi], more[lo:hi]
        l[:] = whole[lo:hi]
        for letter in y.classes[:n, j].tolist():
            if there[letter]:
                np.bitwise_and(l, here[letter], out=b)
                np.add(l, b, out=m)
                np.subtract(l, b, out=l)
                np.bitwise_or(l, m, out=l)
        common = np.bitwise_count(np.invert(l, out=m)) + behind[lo:hi]
        rows.append(np.flatnonzero(2 * common + 1e-9 >= least * (x.n[lo:hi] + n)) + lo)
        cols.append(np.full(len(rows[-1]), j))
    return np.concatenate(rows), np.concatenate(cols)


def filtered(x: Block, y: Block, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of titles of two blocks that may be alike by their letters and pairs of letters; of a block with itself i < j."""
    out = []
    for start in range(0, len(x.n), 512):
        part = slice(start, start + 512)
        n, m = np.minimum.outer(x.n[part], y.n), np.add.outer(x.n[part], y.n)
        shared = np.ceil(m * (least / 2) - 1e-9)  # letters in blocks at least; of the others there are m - 2 * shared at most
        ok = (n >= shared) & (most_common((x.letters[0][part], x.letters[1][part]), y.letters) >= shared)
        ok &= most_common((x.pairs[0][part], x.pairs[1][part]), y.pairs) >= shared - (m - 2 * shared + 1)
        rows, cols = np.nonzero(ok)
        rows += start
        fresh = rows < cols if x is y else slice(None)
        out.append((rows[fresh], cols[fresh]))
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def alike_in_blocks(x: Block, y: Block, least: float, both: bool = True) -> list[tuple[int, int]]:
    """Pairs of ids of different titles of two blocks, a new one and one before it, of which the new one is alike the other.

    Titles of either block may be the new ones; without `both` only those of x, of which each then has one pair.
    """
    out, done = [], set()
    rows, cols = swept(x, y, least) if x.n.max() <= SHORT else filtered(x, y, least)
    for k in range(0, len(rows), CHUNK):
        i, j = rows[k : k + CHUNK], cols[k : k + CHUNK]
        long = np.maximum(x.n[i], y.n[j]) > LONGEST
        near = long.copy()
        if not long.all():
            near[~long] = 2 * longest_common(x, y, i[~long], j[~long]) + 1e-9 >= least * (x.n[i] + y.n[j])[~long]
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            s, t = x.titles[a], y.titles[b]
            if both:
                out += [(x.ids[a], y.ids[b])] if SequenceMatcher(None, s, t).ratio() >= least else []
                out += [(y.ids[b], x.ids[a])] if SequenceMatcher(None, t, s).ratio() >= least else []
            elif a not in done and SequenceMatcher(None, s, t).ratio() >= least:
                done.add(a)
                out.append((x.ids[a], y.ids[b]))
    return out


def alike_titles(titles: DataFrame, least: float = 0.8, before: DataFrame | None = None) -> DataFrame:
    """(g, c, to): pairs of distinct titles (g, c, t) of a group of which the first, coming later, is alike the second; every title is alike itself.

    With titles `before`, of which none is among the first ones, `to` is one of those, at most one for each of their blocks.

    A group's titles are dealt into blocks, short ones and long ones apart, and every two blocks meet in a task. Titles of lengths m and n that are alike share least / 2 * (m + n) letters or
    more in blocks, of which there are at most one more than the other letters: so they share that many letters and, less the number of blocks, pairs of neighbouring
    letters, and have a common subsequence of that length. Titles that pass these bounds are compared themselves; short ones, of which most share letters and pairs, are only
    held against the last of them. Comparisons grow with the square of a group, memory does not.
    """
    c = F.col

    def dealt(of: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Titles with their block, and how many blocks each group has."""
        some = of.where("t <> ''").withColumn("long", (F.length("t") > SHORT).cast("int"))
        count = some.groupBy("g").agg(*[F.ceil(F.coalesce(F.sum(F.when(c("long") == k, 1)), F.lit(0)) / (BLOCK if k else 4 * BLOCK)).cast("int").alias(name) for k, name in ((0, "short"), (1, "tall"))])
        block = F.when(c("long") == 0, F.pmod(F.hash("c"), c("short"))).otherwise(c("short") + F.pmod(F.hash("c"), c("tall")))
        return some.join(count, "g").select("g", "c", "t", block.alias("b")), count.select("g", (c("short") + c("tall")).alias("of"))

    mine, blocks, alone = *dealt(titles), before is None
    each = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    if alone:
        met = mine.join(blocks, "g").select("*", each("of").alias("o"))
        met = met.select("g", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (c("b") > c("o")).alias("second"), "c", "t")
        cells = blocks.select((c("of").cast("long") * (c("of") + 1) / 2).alias("n"))
    else:
        theirs, others = dealt(before)
        met = mine.join(others, "g").select("g", c("b").alias("lo"), each("of").alias("hi"), F.lit(False).alias("second"), "c", "t")
        met = met.unionByName(theirs.join(blocks, "g").select("g", each("of").alias("lo"), c("b").alias("hi"), F.lit(True).alias("second"), "c", "t"))
        cells = blocks.join(others.withColumnRenamed("of", "more"), "g").select((c("of").cast("long") * c("more")).alias("n"))
    tasks = cells.agg(F.sum("n")).first()[0] or 1

    def compared(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.assign(n=pair["t"].str.len()).sort_values("n", kind="stable")
        g, same = pair["g"].iloc[0], alone and pair["lo"].iloc[0] == pair["hi"].iloc[0]
        x, y = (pair[pair["second"] == second] for second in (False, True))
        found = []
        if len(x) and (same or len(y)):
            one = Block(x["c"].to_numpy(), x["t"].tolist())
            found = alike_in_blocks(one, one if same else Block(y["c"].to_numpy(), y["t"].tolist()), least, alone)
        return pd.DataFrame({"g": pd.Series([g] * len(found), dtype=object), "c": np.array([a for a, _ in found], np.int64), "to": np.array([b for _, b in found], np.int64)})

    schema = StructType([titles.schema["g"], StructField("c", LongType()), StructField("to", LongType())])
    # a fixed number: few rows make much work here, which adaptive execution would put into few tasks
    alike = met.repartition(int(min(max(tasks, 1), 2000)), "g", "lo", "hi").groupBy("g", "lo", "hi").applyInPandas(compared, schema)
    return alike.unionByName(titles.select("g", "c", c("c").alias("to"))) if alone else alike


def stretches(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (g, i) with the number of their list's stretch, and how many there are; all of a stretch come before the next one's. Each begins where GROWTH times as many items lie before it."""
    count = rows.count()
    if rows.groupBy("g").count().where(F.col("count") > FIRST).isEmpty():
        return rows.withColumn("stretch", F.lit(0)), 1
    parts = int(min(PARTS, 1 + 4 * count // FIRST))
    cut = kept(rows.repartitionByRange(parts, "g", "i").withColumn("part", F.spark_partition_id()), "cut")
    ends = cut.groupBy("g", "part").count().withColumn("end", F.sum("count").over(Window.partitionBy("g").orderBy("part")))
    number = F.when(F.col("end") > FIRST, F.ceil(F.log(float(GROWTH), F.col("end") / FIRST))).otherwise(0).cast("int")
    ends = kept(ends.select("g", "part", number.alias("stretch")), "ends")
    return cut.join(F.broadcast(ends), ["g", "part"]).drop("part"), ends.agg(F.max("stretch")).first()[0] + 1


def settled_rows(open_: DataFrame, alike: DataFrame) -> DataFrame:
    """Those of rows (g, i, c, u, t) that stay, by the pairs of alike titles among them."""
    c, stay = F.col, None
    while True:
        # of each title and address the first row kept and the first not settled; of each title also those of titles that it is alike
        known = open_.drop("t").withColumn("k", F.lit(None).cast(open_.schema["i"].dataType)).withColumn("o", c("i"))
        if stay is not None:
            known = known.unionByName(stay.drop("t").withColumns({"k": c("i"), "o": F.lit(None).cast(open_.schema["i"].dataType)}))
        least_of = lambda d, *by: d.groupBy(*by).agg(F.min("k").alias("k"), F.min("o").alias("o"))
        by_title = least_of(alike.join(least_of(known, "g", "c").withColumnRenamed("c", "to"), ["g", "to"]), "g", "c")
        by_url = least_of(known.where("u <> ''"), "g", "u").select("g", "u", c("k").alias("ku"), c("o").alias("ou"))
        now = open_.join(by_title, ["g", "c"]).join(by_url, ["g", "u"], "left")
        gone = F.coalesce(c("k") < c("i"), F.lit(False)) | F.coalesce(c("ku") < c("i"), F.lit(False))
        free = (c("o") >= c("i")) & F.coalesce(c("ou") >= c("i"), F.lit(True))
        settled = kept(now.select("g", "i", "c", "u", "t", F.when(gone, "gone").when(free, "stay").otherwise("open").alias("is")), "settled")
        fresh = settled.where("is = 'stay'").drop("is")
        stay = fresh if stay is None else stay.unionByName(fresh)
        open_ = settled.where("is = 'open'").drop("is")
        if open_.isEmpty():
            return stay


def without_near_copies(news: DataFrame, group: str, order: str, least: float = 0.8) -> DataFrame:
    """The rows of news (title, url) that stay, list by list of `group` in the order of `order`, which tells rows of a list apart.

    A row without a title goes. One goes whose address, as canonical_url() has it and not empty, or whose title, by SequenceMatcher's ratio to it of at least `least`, is that of a row
    kept before. Rows that went do not count against others.
    """
    c = F.col
    head = tx.clean(c("title"))
    rows = news.where(head.isNotNull()).select(c(group).alias("g"), c(order).alias("i"), normal_title(head).alias("t"), canonical_url(c("url")).alias("u")).withColumn("c", F.xxhash64("t"))
    rows = rows.groupBy("g", "c", "u").agg(F.min("i").alias("i"), F.first("t").alias("t"))  # the same title at the same address: the first decides for all
    rows, many = stretches(kept(rows, "titles"))
    one_each = lambda d: d.groupBy("g", "c").agg(F.first("t").alias("t"))
    done = []
    for k in range(many):
        mine = rows.where(c("stretch") == k).drop("stretch")
        if done:
            # all that was kept comes before: a row that is alike one of those, or has its address, goes
            before = reduce(DataFrame.unionByName, done)
            mine = mine.join(before.where("u <> ''").select("g", "u"), ["g", "u"], "left_anti").join(before.select("g", "c"), ["g", "c"], "left_anti")
            mine = kept(mine, "open")
            mine = kept(mine.join(alike_titles(one_each(mine), least, one_each(before)).select("g", "c"), ["g", "c"], "left_anti"), "open")
        done.append(settled_rows(mine, kept(alike_titles(one_each(mine), least), "alike")))
    stay = reduce(DataFrame.unionByName, done)
    return news.join(stay.select(c("g").alias(group), c("i").alias(order)), [group, order], "left_semi")
