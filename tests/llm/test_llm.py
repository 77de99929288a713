"""The training-data operators against brute force, with null, empty, long, tied and repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import ann, bpe, common, fingerprint, jaccard, lines, packing, quality, suffix_array, substring, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, g long, a long"  # names that operators use inside


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, texts = say(60), []
    for i in range(n):
        texts.append(rng.choice([say(rng.randrange(1, 120)), say(50) + " " + shared + "\n" + say(30), shared, say(90)]))
    base = say(150).split()
    for _ in range(6):
        t = list(base)
        t[rng.randrange(len(t))] = "edited"
        texts.append(" ".join(t))
    texts += ["", None, " \n\t ", "a", "one two", "é" * 400, "x" * 1000, say(4000), texts[0], texts[0], "A b C d", "a B c D"]
    return [(i, t, "k", 7, 8) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)], "src long, dst long")
    assert {r.node: r.component for r in common.components(e).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}
    chain = spark.range(1, 300).selectExpr("id as src", "id - 1 as dst")
    assert {r.component for r in common.components(chain).collect()} == {0}


def test_packing(spark, docs, empty):
    import public_tokenizers as P

    at, special = P.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}
    rows = packing.pack(docs, at, P.PATTERN, special).toPandas()
    assert rows.groupby("doc_id").size().shape[0] == docs.count() and (rows["length"] <= 1024).all()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024
    assert packing.pack(empty, at, P.PATTERN, special).count() == 0
    where, made = packing.plan({5: 7, 1024: 3, 600: 10, 424: 9})
    assert made == 3 + 10 and {k: (g.hi - g.lo).sum() for k, g in where.groupby("length")} == {5: 7, 1024: 3, 600: 10, 424: 9}


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(60):
        t = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 90))]
        sa = suffix_array.suffix_array(np.array(t), 5)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute(units, width):
    c = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if c[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append([x for x, g in zip(u, gone) if not g])
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_suffix_array_dedup(docs, empty, most, monkeypatch):
    defaults = (200, 40, 1 << 20, most)
    monkeypatch.setattr(suffix_array.repeated_strings, "__defaults__", defaults)
    want = {r[0]: bytes(k) for r, k in zip(corpus(), brute([list((r[1] or "").encode()) for r in corpus()], 200))}
    got = {r.doc_id: r for r in suffix_array.remove_repeats(docs).collect()}
    assert {k: hashlib.sha256(v).hexdigest() for k, v in want.items()} == {k: r.kept_sha256 for k, r in got.items()}
    assert suffix_array.remove_repeats(empty).count() == 0


def test_substring_dedup(docs, empty):
    want = {r[0]: " ".join(k) for r, k in zip(corpus(), brute([WORD.findall(r[1] or "") for r in corpus()], 35))}
    assert {r.doc_id: r.kept_text for r in substring.remove_repeats(docs).collect()} == want
    assert substring.remove_repeats(empty).count() == 0


def test_fingerprint(spark, docs, empty):
    rows = sorted(corpus(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprint.fingerprint_with_neighbour(docs).collect()}
    for r, n in zip(rows, rows[1:] + rows[:1]):
        a, b = r[1] or "", n[1] or ""
        cut = len(a) // 3
        assert got[r[0]].edited_sha256 == hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()
    assert got[0].fingerprint == got[max(k for k in got if rows[len(rows) - 1 - k][1] == corpus()[0][1])].fingerprint
    assert fingerprint.fingerprint_with_neighbour(empty).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k")], "id long, t string").withColumn("sketch", fingerprint.sketch(F.col("t")))
    whole = fingerprint.merge_parts(two, "id").first().sketch
    assert whole == sorted(itertools.chain.from_iterable(r.sketch for r in two.collect()))


def test_jaccard(docs, empty):
    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    par = {i: i for i in sets}

    def find(x):
        return x if par[x] == x else find(par[x])

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.near_duplicates(empty).count() == 0


def test_lines(spark, empty):
    rows = [(1, "Hello, World 12\nkeep me\n\nlast"), (2, "hello world 99\nother line"), (3, None), (4, "keep me\nkeep me"), (5, "")]
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Hello, World 12\nkeep me\n\nlast", 2: "other line", 3: "", 4: "", 5: ""}
    assert lines.dedup_lines(empty).count() == 0


def test_bpe_round_trip(docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for i, text, *_ in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    v = bpe.Vocabulary(path)
    e = bpe.Encoder(v, 16)
    word = [v.inner[b] for b in b"theintheresting" * 30]
    e.lookahead = bpe.lookahead_of(path)
    assert list(e.stream(word)) == e.merge(word)
    assert bpe.round_trip(empty, path).count() == 0


def test_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, x[0].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(v, F.col("vec_id") % 20 == 0).toPandas()
    assert not set(got.query_id) & {900, 920, 940} and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.9 * 45 * 20
    assert ann.search(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_toxicity_and_quality(spark, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(30)) + (" vile" if i % 5 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame(rows + [(400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(200)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit_chain(d, labels, ["low_quality", "toxic"])
    got = {r.doc_id: r.rejected for r in toxicity.score(d, chain).collect()}
    held = range(200, 300)
    assert all(got[i] == (i % 5 == 0) for i in held) and not got[400] and not got[401]
    none = toxicity.fit_chain(d, labels.limit(0), ["low_quality", "toxic"])
    assert not any(r.rejected for r in toxicity.score(d, none).collect())
    assert toxicity.score(empty, chain).count() == 0
    m = quality.fit_quality(d)
    assert quality.score(d, m).count() == 302 and quality.score(empty, quality.fit_quality(empty)).count() == 0


def test_bpe_hard_texts(spark):
    """Long pre-tokens, many chunks, special tokens, and characters that this Python does not know, against the library; then the byte machine."""
    import unicodedata

    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(8)
    new = [chr(i) for i in [0x558, 0x88F, 0xC5C, 0x1C89, 0x208F, 0xA7CF, 0x10D56] if unicodedata.category(chr(i)) == "Cn"]
    texts = ["theintheresting" * 2500, "a" * 40_000, "é" * 20_000, "x y " * 60_000, "tail<|endoftext|>of<|startoftext|>text " * 3000, " ".join("ab" + c + "cd 1" + c + "2 !" + c + "?" for c in new) + " ΑΣ ΣΑΣ", "\u2003 \x85 e\u0301 " * 9000]
    texts += ["".join(rng.choice("aéΣ '1!\n\t" + "".join(new)) for _ in range(400)) for _ in range(20)]
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), i
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), i
    d = spark.createDataFrame([(0, "Hello wörld, it's 42"), (1, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(d, path), path).collect()}
    assert back[0].split() == ["hello", "wörld", ",", "it", "'s", "4", "2"] and back[1] == ""


CLASH = ("key", "a", "b", "gone", "g", "c", "n", "id", "bucket", "component", "s", "set", "line", "place")


def test_clashing_columns(spark):
    """Stages that return the columns of documents leave those of any name alone; the others ignore them."""
    import corpus_pipeline as cp

    base = [(0, "one line that is long enough to be kept\nshared line of some words"), (1, "shared line of some words\nanother line, of other words"), (2, None), (2, None), (None, "no id here"), (5, ""), (6, "z" * 700), (7, "z" * 700)]
    df = spark.createDataFrame(base, "doc_id long, text string").select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASH])
    for stage in (cp.dedup_lines, cp.dedup_near, cp.cut_repeats):
        out = stage(spark, df, "")
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASH)
    for op in (lines.dedup_lines, jaccard.near_duplicates, suffix_array.remove_repeats, substring.remove_repeats, fingerprint.fingerprint_with_neighbour):
        assert op(df).count() == len(base)
