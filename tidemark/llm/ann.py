"""Approximate nearest neighbours by a forest of sorted hash strings.

Every tree writes each vector as a string of 32 bits (the sides of random hyperplanes) and keeps the strings sorted.
A query descends in all trees to the longest prefixes that it shares with any string, then ascends in all trees at once, a bit at a
time, until the prefix ranges hold enough candidates; those are scored exactly.

The index is cut into blocks of rows by hashed id and each block has its own forest, so that copies of one vector spread over
all blocks, no task holds more than a block of rows and a block of queries, and recall does not depend on the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a block of the index and of a block of queries; trees, bits; the share of a block that is scored for a query
#: at least, and the rows below which a block is scored whole.
BLOCK, QUERY_BLOCK, TREES, BITS, SHARE = 4096, 4096, 48, 32, 0.5
WHOLE = 512


class Forest:
    """Sorted hash strings of one block of vectors (rows of x)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 17):
        self.x, self.bits = x, bits
        rng = np.random.default_rng([seed, x.shape[1]])
        self.planes = rng.standard_normal((trees, x.shape[1], bits))
        self.weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.mean = unit.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        codes = [self._code(unit, p) for p in self.planes]
        self.order = [np.argsort(c, kind="stable") for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.order)]

    def _code(self, unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return ((unit - self.mean) @ planes > 0).astype(np.uint64) @ self.weights

    def candidates(self, q: np.ndarray, least: int):
        """For each row of q the distinct rows of the block met on the way up, `least` of them at least (or all)."""
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        codes = [self._code(unit, p) for p in self.planes]
        n, found = len(self.x), []
        level = np.zeros(len(q), dtype=int)
        lows, highs = [], []
        for depth in range(self.bits + 1):  # ranges of the strings that share the first `depth` bits
            low, high = np.zeros((len(q), len(codes)), dtype=np.int64), np.zeros((len(q), len(codes)), dtype=np.int64)
            rest = np.uint64((1 << (self.bits - depth)) - 1)
            for t, (c, s) in enumerate(zip(codes, self.sorted)):
                low[:, t], high[:, t] = np.searchsorted(s, c & ~rest, "left"), np.searchsorted(s, c | rest, "right")
            enough = (high - low).sum(axis=1) >= least
            level[enough] = depth
            lows.append(low)
            highs.append(high)
            if not enough.any():
                break
        for i in range(len(q)):
            depth = level[i]
            while True:
                got = np.unique(np.concatenate([o[a:b] for o, a, b in zip(self.order, lows[depth][i], highs[depth][i])]))
                if len(got) >= min(least, n) or depth == 0:
                    break
                depth -= 1
            found.append(got)
        return found


def _usable(v):
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query, k: int = 20, share: float = SHARE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query among the other rows.

    vectors has vec_id and embedding; is_query is a column that marks the queries. Rows with a null id, and vectors null, empty,
    zero or holding null or non-finite components, take no part; vectors of different lengths are not compared; ties go to the
    smaller id; repeated rows each count; an empty table gives no rows and extra columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v"))
    n, asks = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asks // query_block))
    at = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    index = rows.select("dim", at(blocks).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "v")
    queries = rows.where("asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ib"), at(query_blocks).alias("qb"), "vec_id", "v")
    keys = ["dim", "ib", "qb"]

    def cell(left, right):
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            x, ids = np.stack(left["v"].to_list()), left["vec_id"].to_numpy()
            forest = Forest(x)
            least = max(8 * k, WHOLE, int(share * len(x)))
            q, asked = np.stack(right["v"].to_list()), right["vec_id"].to_numpy()
            for s in range(0, len(q), 512):
                for qi, vec, got in zip(asked[s : s + 512], q[s : s + 512], forest.candidates(q[s : s + 512], least)):
                    got = got[ids[got] != qi]
                    score = np.einsum("ij,j->i", x[got], vec)
                    best = np.lexsort((ids[got], -score))[:k]
                    out.append(pd.DataFrame({"query_id": qi, "vec_id": ids[got[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
