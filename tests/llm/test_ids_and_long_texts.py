"""Ids beyond 2**53 beside a null in one partition, and texts of a million characters, through every operator and stage."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import bpe, decontaminate, fingerprint, jaccard, lines, packing, periods, quality, substring, suffix_array, toxicity  # noqa: E402

IDS = [(1 << 60) + 1, (1 << 60) + 3, None, 5]
SPECIAL = {"<|endoftext|>": 50256}
CHAIN = toxicity.Chain(["bad"], [toxicity.Scorer(np.zeros(toxicity.SPACE), np.zeros(0), -3.0)], 0.5)
MODEL = quality.QualityModel(toxicity.Scorer(np.zeros(quality.SPACE), np.zeros(0), 0.0), {}, 0.5)
WORDS_49K = P.path("word_bpe_49k.json")


def pack(df):
    return packing.pack(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, SPECIAL, tokenizer=P.path("byte_bpe_50k.json"))


EVERY = {
    "op1": lambda d: toxicity.score(d, CHAIN), "keep_clean": lambda d: toxicity.keep_clean(d, CHAIN), "op2": pack, "op3": suffix_array.remove_repeats, "keep_rest": suffix_array.keep_rest,
    "op4": fingerprint.fingerprint_with_neighbour, "op5": lines.dedup_lines, "keep_lines": lines.keep_lines, "op6": substring.remove_repeats, "op7": jaccard.near_duplicates,
    "keep_one": jaccard.keep_one, "op9": lambda d: bpe.round_trip(d, WORDS_49K), "op9 encode": lambda d: bpe.encode_texts(d, WORDS_49K),
    "op9 decode": lambda d: bpe.decode_ids(bpe.encode_texts(d, WORDS_49K), WORDS_49K), "op10": lambda d: quality.score(d, MODEL), "op12": periods.periodic_runs,
    "keep_collapsed": periods.keep_collapsed, "op13": lambda d: decontaminate.contamination(d, d.selectExpr("doc_id as item_id", "text")),
    "keep_clean of op13": lambda d: decontaminate.keep_clean(d, d.where("false").selectExpr("doc_id as item_id", "text")),
}


@pytest.mark.parametrize("name", EVERY)
def test_ids_stay(spark, name):
    rows = [(i, f"text number {k} is not like text {k * k} in most of its {k + 7} words", IDS[-1 - k]) for k, i in enumerate(IDS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other long").coalesce(1)
    got = EVERY[name](df).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(IDS, key=str)
    if "other" in got[0]:
        assert {(r.doc_id, r.other) for r in got} == {(i, o) for i, _, o in rows}


def test_long_texts_are_packed_whole(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {1: "a" + " " * 2_000_000 + "b", 2: "\n" * 1_000_000, 3: "é" * 500_000, 4: "word " * 200_000}
    rows = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for doc, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)


def test_long_texts(spark):
    rng = np.random.default_rng(3)
    long = " ".join(map(str, rng.integers(0, 1 << 40, 90_000)))
    texts = {1: long, 2: "start" + " " * 2_000_000 + "end", 3: long[: len(long) // 2] + "\n" + long[: len(long) // 3], 4: "x" * 1_000_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: r for r in suffix_array.remove_repeats(df).collect()}
    half = len(long) // 2
    assert got[1].n_removed == half and got[1].kept_sha256 == sha(long[half:]) and got[3].n_removed == half + half * 2 // 3 - (half * 2 // 3 - len(long) // 3)
    assert got[2].kept_sha256 == sha("startend") and got[4].n_removed == 1_000_000
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert got[2].n_words == 2 and got[2].n_removed == 0 and got[1].n_removed > 40_000 and got[4].n_words == 1
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_hit > 0 for r in decontaminate.contamination(df, df.where("doc_id = 1").selectExpr("doc_id as item_id", "substring(text, 5000, 900) as text")).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert lines.dedup_lines(df).where("n_removed > 0").count() == 0
    assert toxicity.score(df, CHAIN).count() == quality.score(df, MODEL).count() == fingerprint.fingerprint_with_neighbour(df).count() == 4


NAMES = ("name", "key", "text_2", "id", "ids", "p", "p_bad", "rejected", "quality_score", "piece", "length", "salt", "r", "rank", "n", "h", "v", "n_words", "start", "period", "items", "component", "line", "set", "g", "c", "a", "b", "s")


@pytest.mark.parametrize("name", ["op1", "keep_clean", "op2", "op4", "op9", "op9 encode", "op10", "op12", "keep_collapsed", "op13", "keep_clean of op13"])
def test_clashing_names_and_no_rows(spark, name):
    from pyspark.sql import functions as F

    rows = [(k, f"text number {k} is not like text {k * k} in most of its {k + 7} words") for k in range(6)] + [(7, None), (8, ""), (3, "again")]
    plain = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    named = plain.select("*", *[F.lit(f"mine {c}").alias(c) for c in NAMES])
    a, b = EVERY[name](plain), EVERY[name](named)
    keep = [c for c in a.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(tuple, a.select(*keep).collect()), key=str) == sorted(map(tuple, b.select(*keep).collect()), key=str)
    if name.startswith("keep"):
        assert all(r[c] == f"mine {c}" for r in b.collect() for c in NAMES)
    assert EVERY[name](named.where("false")).count() == 0


def test_search_with_repeats_ties_and_clashing_names(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import annulus, ann

    rows = [(i, [float(i % 3), 1.0]) for i in range(45)] + [(20, [2.0, 1.0]), (None, [1.0, 1.0]), ((1 << 60) + 20, [0.5, 0.5]), (60, None), (80, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    named = df.select("*", *[F.lit(1).alias(c) for c in ("v", "asks", "dim", "ib", "qb", "rank", "score", "h", "cluster", "distance")])
    got = ann.search(named, F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    for q in {r.query_id for r in got}:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine) and all(i != q for _, i, _ in mine)
    key = lambda d: sorted(map(tuple, annulus.cluster(d, k=4, dim=2, rounds=2).collect()), key=str)
    assert key(named) == key(df)
