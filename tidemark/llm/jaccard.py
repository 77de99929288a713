"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets link when 100 * |intersection| >= P * |union|, that is when they differ in at most D = (s + t) * (100 - P) // (100 + P) elements, s and t
being their sizes and P the percentage, 90 if nothing else is asked for: D = (s + t) // 19. In each band of sizes the universe of shingle hashes is cut into segments, so many that a linking pair must agree on a whole
segment, or differ there by one element: an equal segment uses up one difference, a segment with its one-deletion neighbourhood two. How
many segments get deletion neighbourhoods is decided by cost, from the number of sets, and so are the segments to spare, for those that a set leaves empty and passes over. Keys of segments are joined, pairs that an odd sketch of
512 bits proves too far apart are left out, and the rest is verified on the whole sets.

Equal sets are one class from the start. Links inside a group of near copies grow with its square, components don't: a first round verifies a few
random pairs of each key, and a second one all remaining pairs of one key that the first has not connected, so no link between components is lost.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import repeats
from tidemark.llm.common import checkpoint, components, discard, map_rows, materialize, release

#: Words of a shingle; the growth of a size band; rows of a key that a window of the first round sees; sets of a verified block.
WORDS, GROWTH, TOGETHER, BLOCK = 3, 1.6, 512, 256
#: Elements of sets, in copies for all pairs of blocks, that are shuffled at once where the sets themselves have fewer.
HELD = 1 << 24
#: Orders that the keys of the first round go by, so that sets that share many keys meet few others; sets whose places are broadcast at most.
ORDERS, FEW = 2, 500_000
#: The least percentage of the union that linked sets share.
PERCENT = 90
#: The cost of meeting a set by chance, in keys; the share of sets that a shingle of a set is in; the share of meetings in empty segments that are
#: left where few sets have keys for them.
CHANCE, COMMON, RARE = 0.01, 1e-4, 1e-5
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence where there are fewer words; none without words."""
    w = repeats.hashed_words(text.encode("utf-8").lower())  # lower() of bytes is that of A to Z alone
    if not len(w):
        return w
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes())], dtype=np.uint64)
    h = np.zeros(len(w) - words + 1, dtype=np.uint64)
    for k in range(words):
        h = repeats.mixed(h * _A + w[k : len(w) - words + 1 + k] * (_B + np.uint64(2 * k)) + _C)
    return np.unique(h)


def bands(most: int = 1 << 40) -> list[int]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


_BANDS = np.array(bands())


def allot(band: int, sets: float, percent: int = PERCENT) -> tuple[int, int]:
    """Segments of a band, and how many of them get deletion neighbourhoods, at least cost for so many sets.

    Needed are units for one difference more than a pair of the band can have; more of them let sets pass over the segments that they leave empty
    (see segment_keys). A set's cost is its keys, and the sets that agree with it by chance, because a segment is empty or holds one shingle that
    many sets have.
    """
    low, top = int(_BANDS[band]), int(_BANDS[band + 1]) - 1
    needed = (top + top * 100 // percent) * (100 - percent) // (100 + percent) + 1
    best = None
    for share in (0, 4, 2):
        for extra in (-1, 0):  # without units to spare, or with as many as a small set passes over
            while extra <= needed:
                units = needed + max(extra, 0)
                deletions = units // share if share else 0
                segments = units - deletions
                none = float(np.exp(-low / segments))  # the share of a small set's segments that are empty, and that hold one
                one = none * low / segments
                lost = (segments - deletions) * none + 2 * deletions * (none + one)
                if extra < 0 or extra >= lost + 3 * lost**0.5:
                    break
                extra += 1
            if extra > needed:
                continue
            used = needed / units if extra >= 0 else 1.0
            each = (low + top) / 2 / segments
            alone = segments * one + deletions * none * (low / segments) ** 2
            cost = used * (segments + deletions * each) + CHANCE * sets * (segments * none * (1 if extra < 0 else RARE) + COMMON * used * alone)
            if best is None or cost < best[0]:
                best = (cost, segments, deletions)
    return best[1], best[2]


_allot = lru_cache(None)(allot)


def segment_keys(h: np.ndarray, sets: float, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set in the bands where it may meet others, the key of the segment before each, and whether a key is a deletion's.

    A segment without an equal key in another set tells of a difference, one with its one-deletion neighbourhood of two; but one that is empty, or has
    deletions and holds one element at most, may tell of none. So a set takes segments in order until those that tell make one difference more than any of
    its links can have, and leaves out keys of nothing: whichever of two linking sets takes fewer shares one of its keys with the other. A set that
    does not come so far has all keys of all segments, those of nothing too.
    """
    n = len(h)
    own = int(np.searchsorted(_BANDS, n, side="right")) - 1
    keys, before, kinds = [], [], []
    low = own
    while low > 0 and percent * n < 100 * int(_BANDS[low]):
        low -= 1
    for band in range(own, low - 1, -1):
        m, deletions = _allot(band, sets, percent)
        partner = n * 100 // percent if band == own else int(_BANDS[band + 1]) - 1
        most = (n + partner) * (100 - percent) // (100 + percent)
        seg = (repeats.mixed(h ^ _C) % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        value = repeats.mixed(h[order] * _A + _B)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        held = np.bincount(seg, minlength=m)
        stop = np.cumsum(held)
        total = sums[stop] - sums[stop - held]
        salt = np.arange(m, dtype=np.uint64) * _B + np.array([band], dtype=np.uint64) * _A
        base = repeats.mixed(total ^ salt)
        first = np.arange(m) < deletions
        told = np.cumsum(np.where(first, 2 * (held > 1), held > 0))
        whole = told[-1] <= most
        taken = m if whole else int(np.searchsorted(told, most + 1)) + 1
        use = (held > 0) & (np.arange(m) < taken) | whole
        # a segment after one without a key begins a run
        keys.append(base[use])
        before.append(np.concatenate([[np.uint64(0)], np.where(use[:-1], base[:-1], np.uint64(0))])[use])
        kinds.append(np.zeros(len(keys[-1]), dtype=bool))
        if deletions:
            s = seg[order]
            at = np.flatnonzero((s < min(deletions, taken)) & ((held[s] > 1) | whole))
            s = s[at]
            keys.append(repeats.mixed((total[s] - value[at]) ^ salt[s]))
            before.append(np.zeros(len(at), dtype=np.uint64))
            kinds.append(np.ones(len(at), dtype=bool))
    return np.concatenate(keys), np.concatenate(before), np.concatenate(kinds)


def odd_sketch(h: np.ndarray, size: int = 512) -> list[int]:
    """So many parities, a power of two; two sets' sketches differ in no more bits than the sets differ in elements."""
    bits = np.bincount((repeats.mixed(h * _B) >> np.uint64(7)) % np.uint64(size), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def long_sketch(h: np.ndarray) -> list[int] | None:
    """An odd sketch of one to two bits an element, for sets of over 512, of which 512 bits can rule out little or nothing."""
    return odd_sketch(h, 1 << (len(h) - 1).bit_length()) if len(h) > 512 else None


def _near(u: str, v: str, percent: int):
    """Whether sketches and sizes (sk and n of two rows) leave room for a link."""
    bits = sum((F.bit_count(F.col(f"{u}sk")[i].bitwiseXOR(F.col(f"{v}sk")[i])) for i in range(8)), F.lit(0))
    return bits * (100 + percent) <= (100 - percent) * (F.col(f"{u}n") + F.col(f"{v}n"))


def likely(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (u, v) of sets that their sizes and odd sketches do not rule out."""
    one = lambda c: sets.select(F.col("set").alias(c), F.col("n").alias(f"{c}_n"), F.col("sk").alias(f"{c}_sk"))
    return likely_long(pairs.distinct().join(one("u"), "u").join(one("v"), "v").where(_near("u_", "v_", percent)).select("u", "v"), sets, percent)


def likely_long(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of sets that their long sketches, if both have one, do not rule out; the halves of a sketch, one on the other, are the sketch of half the size."""
    one = lambda c: sets.where("long is not null").select(F.col("set").alias(c), F.col("n").alias(f"{c}_n"), F.col("long").alias(f"{c}_long"))
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)  # noqa: E731  sizes of linking sets are a factor of two apart at most
    u, v = F.col("u_long"), F.col("v_long")
    bits = F.aggregate(F.zip_with(fit(u, v), fit(v, u), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    near = F.when(u.isNull() | v.isNull(), True).otherwise(bits * (100 + percent) <= (100 - percent) * (F.col("u_n") + F.col("v_n")))
    return pairs.join(one("u"), "u", "left").join(one("v"), "v", "left").where(near).select("u", "v")


def verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of sets that link, by an exact count.

    Pairs are brought together by the components they form, so that a set travels once however many partners it
    has; a large component is cut into blocks, and a pair is verified where its two blocks meet, to which only sets that have a pair there
    travel. What would travel at once goes in slices of these places, if it is more than all sets hold. Sets are made again from the text
    of one document of each; where they are few their documents are picked out by a broadcast, else by a shuffle.
    """
    pairs = checkpoint(pairs)
    group = components(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    # numbers in blocks of a group: random, so no order over a whole group is needed
    sizes = group.groupBy("component").agg(F.count("*").alias("size"))
    placed = checkpoint(group.join(sizes, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("block")))
    at = lambda c, b: placed.select(F.col("node").alias(c), *(["component"] if c == "u" else []), F.col("block").alias(b))
    cells = checkpoint(pairs.join(at("u", "i"), "u").join(at("v", "j"), "v").select(F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "u", "v"))
    seats = cells.select("cell", F.explode(F.array("u", "v")).alias("node")).distinct().groupBy("node").agg(F.collect_list("cell").alias("cells"))  # as many as blocks of a component
    seats = checkpoint(seats.join(sets.select(F.col("set").alias("node"), "rep", "n"), "node"))
    count, load = seats.agg(F.sum(F.size("cells")), F.sum(F.size("cells") * F.col("n"))).first()
    if not count:
        return pairs
    slices = -(-load // max(HELD, sets.agg(F.sum("n")).first()[0]))

    def made(batches):
        for b in repeats.sliced(batches):
            rows = []
            for node, text, cells in zip(b["node"], b["text"], b["cells"]):
                h = shingles(text, words)
                if set_id(h) == node:  # another text of the same id has another set
                    rows.append((node, cells, h.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "cells", "s"])

    def check(left, right):
        have = {k: np.frombuffer(s, dtype=np.uint64) for k, s in zip(right["node"], right["s"])}
        out = []
        for u, v in zip(left["u"], left["v"]):
            a, b = have.get(u), have.get(v)
            if a is not None and b is not None:
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    links = []
    for k in range(slices):
        mine = seats.withColumn("cells", F.filter("cells", lambda c: F.pmod(c, F.lit(slices)) == k)).where(F.size("cells") > 0) if slices > 1 else seats
        texts = docs.join(F.broadcast(mine) if count <= FEW else mine, docs["doc_id"] == mine["rep"]).select("node", "text", "cells")
        known = texts.mapInPandas(made, "node long, cells array<long>, s binary").select("node", F.explode("cells").alias("cell"), "s")
        some = cells.where(F.pmod("cell", F.lit(slices)) == k) if slices > 1 else cells
        links.append(checkpoint(some.groupBy("cell").cogroup(known.groupBy("cell")).applyInPandas(check, "u long, v long")))
        release(docs.sparkSession)
    return reduce(DataFrame.unionByName, links)


def set_id(h: np.ndarray) -> int:
    """64 bits that name a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def features_of(docs: DataFrame, total: float, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, size n and name of each document's set, its odd sketch and its keys; a document without shingles has n = 0 and nothing else.

    Of the copies of a set that one task sees, the first alone gets keys, so a large group of copies doesn't crowd its keys.
    """

    def run(batches):
        seen = set()  # names of the sets of one partition's documents
        for b in repeats.sliced(batches):
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                h = shingles(text, words)
                if not len(h) or pd.isna(doc):
                    rows.append((doc, len(h), *[None] * 6))
                    continue
                name = set_id(h)
                if name in seen:
                    rows.append((doc, len(h), name, *[None] * 5))
                    continue
                seen.add(name)
                keys, before, kinds = segment_keys(h, total, percent)
                rows.append((doc, len(h), name, odd_sketch(h), long_sketch(h), keys.view(np.int64), (before >> np.uint64(32)).astype(np.uint32).view(np.int32), kinds))
            cols = dict(zip(("doc_id", "n", "set", "sk", "long", "ks", "before", "kinds"), map(list, zip(*rows))))
            yield pd.DataFrame(cols | {"doc_id": b["doc_id"].to_numpy(), "set": pd.array(cols["set"], dtype="Int64")})  # not by way of floats

    return map_rows(docs, run, "doc_id long, n long, set long, sk array<long>, long array<long>, ks array<long>, before array<int>, kinds array<boolean>")


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row.

    Null text, and text without words, has no shingles and is linked with nothing. Rows of one doc_id count as linked, whatever their texts; rows
    without an id are linked with nothing and have no component_id. A text of any length is read whole, ties do not arise, an empty table gives no
    rows and extra columns, whatever their names, are ignored. Sets are told apart by 64 bits.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = materialize(features_of(docs, float(documents.count()), words, percent), "features")
    members = materialize(made.select("doc_id", "n", "set"), "members")
    sets = materialize(made.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in ("sk", "long")]), "sets")

    # keys of two sets at least: one shuffle by key, in which copies fall together before a key's sets are counted
    keys = made.where("ks is not null").select("set", F.explode(F.arrays_zip("ks", "before", "kinds")).alias("k")).select("set", F.col("k.ks").alias("key"), F.col("k.before").alias("before"), F.col("k.kinds").alias("deletion"))
    keys = keys.repartition("key").groupBy("key", "set").agg(F.first("before").alias("before"), F.first("deletion").alias("deletion"))
    shared = keys.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")
    shared = materialize(shared.join(sets.select("set", "n"), "set"), "shared")
    discard(made)

    # first round: neighbours in a random order of each key, large keys in salted parts; the order, and so the neighbours, is one of a few
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size") / TOGETHER))).cast("long")
    by = F.xxhash64("set", F.pmod("key", F.lit(ORDERS)))
    salted = shared.withColumn("salt", F.pmod(by, F.greatest(parts, F.lit(1).cast("long"))))
    w = Window.partitionBy("key", "salt").orderBy(by, "set")
    a = F.struct("set", "n", "deletion")
    few = salted.select(a.alias("x"), F.array(*[F.lag(a, d).over(w) for d in (1, 2, 3)]).alias("ys")).select("x", F.explode("ys").alias("y"))
    alike = lambda x, y: (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")) & ~(F.col(f"{x}.deletion") & F.col(f"{y}.deletion"))
    some = few.where(F.col("y").isNotNull() & alike("x", "y")).select(F.least("x.set", "y.set").alias("u"), F.greatest("x.set", "y.set").alias("v"))
    links = verify(docs, sets, likely(some, sets, percent), words, percent)
    joined = components(links.select(F.col("u").alias("src"), F.col("v").alias("dst")))

    # second round: all pairs of a key that are not yet connected; of a run of shared segments only the first counts
    cols = shared.drop("size").join(joined.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    apart = cols.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    cols = materialize(cols.join(apart, "key").join(sets.select("set", "sk"), "set"), "apart")
    discard(shared)
    x, y = cols.alias("x"), cols.alias("y")
    new_run = (F.col("x.before") != F.col("y.before")) | F.col("x.deletion") | F.col("y.deletion") | (F.col("x.before") == 0)
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.component") != F.col("y.component")) & new_run & alike("x", "y") & _near("x.", "y.", percent)
    rest = x.join(y, on).select(F.col("x.set").alias("u"), F.col("y.set").alias("v")).distinct()
    links = links.unionByName(verify(docs, sets, likely_long(rest, sets, percent), words, percent))

    # from sets to documents: rows of one id are linked, and so are the sets they have
    rep = sets.select("set", "rep")
    far = links.join(rep.select(F.col("set").alias("u"), F.col("rep").alias("src")), "u").join(rep.select(F.col("set").alias("v"), F.col("rep").alias("dst")), "v").select("src", "dst")
    own = members.join(rep, "set").where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    final = components(far.unionByName(own))
    discard(cols, sets)
    out = members.join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of documents, all columns as they are, that are the smallest id of their group; rows without an id stay.

    All rows of a kept id stay, equal or not. Nulls, empty and long texts, an empty table and clashing names are as in near_duplicates.
    """
    kept = near_duplicates(documents, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    return documents.join(kept, "doc_id", "left_semi").unionByName(documents.where("doc_id is null"))
