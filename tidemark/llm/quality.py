"""Quality by weak labels: overlapping heuristic labellers, EM over their accuracies, and a hashed linear scorer.

Each labeller votes good, bad or abstains on a whole text. The counts of vote patterns over all documents (a table bounded by
the number of patterns) feed expectation-maximisation of the class share and each labeller's accuracies; the posterior of a
document's pattern is its weak label, and a linear scorer of hashed text features is fitted to those labels.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_rows, materialize
from tidemark.llm.linear import SPACE, Scorer, fit, text_features
from tidemark.llm.toxicity import _pack, _unpack

#: Weakly labelled documents that the scorer is fitted on at most: those with the smallest hashed ids.
MOST_ROWS = 12_000
_PLAIN = re.compile(r"[^\w\s.,;:!?'\"()\-|]")
#: Function words of the four languages of the corpus.
FUNCTION_WORDS = frozenset("the of and to in a is that it for was on are with as by at be this de la le et les des en un du une que est pour qui der die und den von zu das mit sich ist im auf el los las y una por con para del se".split())


def votes(text: str) -> list[int]:
    """Votes of the labellers: 1 good, 2 bad, 0 abstain."""
    words = text.split()
    n = len(words)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text)) / letters
    odd = len(_PLAIN.findall(text)) / (len(text) or 1)
    bare = sum(1 for w in words if len(w) == 1 and not w.isalnum()) / (n or 1)
    known = sum(1 for w in words if w.lower().strip(".,;:!?") in FUNCTION_WORDS) / (n or 1)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    loud = text.count("!!") / (n or 1)
    lines = [x for x in text.split("\n") if x.strip()]
    same = 1 - len(set(lines)) / (len(lines) or 1)
    mean = letters / (n or 1)

    def vote(bad: bool, good: bool) -> int:
        return 2 if bad else 1 if good else 0

    return [
        vote(odd > 0.05, odd < 0.01),
        vote(upper > 0.4, upper < 0.1),
        vote(bare > 0.15, bare < 0.02),
        vote(n >= 20 and known < 0.04, known > 0.12),
        vote(n >= 20 and triples < 0.6, n >= 20 and triples > 0.9),
        vote(loud > 0.2, loud < 0.01),
        vote(len(lines) >= 4 and same > 0.3, len(lines) >= 4 and same < 0.05),
        vote(n < 10, n > 60),
        vote(mean > 9 or mean < 2, 3 <= mean <= 7),
    ]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: posterior of good for each pattern, share of good, table[class, labeller, vote].

    It starts from the majority of the votes, which also fixes which class is the good one.
    """
    if not len(counts):
        return np.zeros(0), 0.5, np.full((2, patterns.shape[1] if patterns.ndim == 2 else 0, 3), 1 / 3)
    good, bad = (patterns == 1).sum(1), (patterns == 2).sum(1)
    q = np.clip(0.5 + 0.25 * (good / np.maximum(good + bad, 1)) - 0.2 * bad, 0.02, 0.98)
    hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    table = share = None
    for _ in range(rounds):
        w = np.stack([(1 - q) * counts, q * counts])
        share = (w[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cp,plv->clv", w, hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->cp", hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(np.log((1 - share) / share) + logs[0] - logs[1], -500, 500)))
        if np.abs(new - q).max() < 1e-7:
            q = new
            break
        q = new
    return q, float(share), table


class QualityModel:
    def __init__(self, scorer: Scorer, posterior: dict[int, float], share: float):
        self.scorer, self.posterior, self.share = scorer, posterior, share


def _coded(text: str) -> int:
    code = 0
    for v in votes(text):
        code = code * 3 + v
    return code


def fit_quality(docs: DataFrame, most_rows: int = MOST_ROWS) -> QualityModel:
    """Weak labels of all documents, and a scorer fitted to a bounded sample of them. Null text counts as empty."""
    cols = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def label(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "pattern": [_coded(t) for t in b["text"]]})

    labelled = materialize(map_rows(cols, label, "doc_id long, pattern int"), "votes")
    seen = labelled.groupBy("pattern").count().toPandas().sort_values("pattern")  # at most 3 to the number of labellers rows
    n = len(votes(""))
    codes = seen["pattern"].to_numpy(dtype=np.int64)
    pats = np.stack([codes // 3 ** (n - 1 - k) % 3 for k in range(n)], axis=1) if len(codes) else np.zeros((0, n), dtype=int)
    q, share, _ = fit_labellers(pats, seen["count"].to_numpy(dtype=float))
    posterior = dict(zip(map(int, codes), map(float, q)))

    chosen = labelled.where("doc_id is not null").groupBy("doc_id").agg(F.max("pattern").alias("pattern")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = cols.join(F.broadcast(chosen), "doc_id").select("doc_id", "pattern", "text")  # bounded by most_rows

    def extract(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "pattern": b["pattern"], "ids": [text_features(t) for t in b["text"]]})

    def train(_, g):
        g = g.sort_values("doc_id", kind="stable")
        y = g["pattern"].map(posterior).to_numpy(dtype=float)
        return pd.DataFrame({"blob": [_pack(fit([np.asarray(v, dtype=np.int32) for v in g["ids"]], y, np.zeros((len(g), 0))))]})

    got = rows.mapInPandas(extract, "doc_id long, pattern int, ids array<int>").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "blob binary").collect()
    return QualityModel(_unpack(got[0]["blob"]) if got else Scorer(np.zeros(SPACE), np.zeros(0), 0.0), posterior, share)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, quality_score (the linear scorer's), weak_label (the votes' posterior) and `good`, for every whole text.

    A document is good when the mean of the two, in log-odds, is over one half. Null text counts as empty, an empty
    table gives no rows, repeated rows are scored alike, a null doc_id is kept, texts of any length are read whole and extra columns, whatever their names, are ignored.
    """

    def run(batches):
        logit = lambda p: np.log((p + 1e-6) / (1 - p + 1e-6))
        for b in batches:
            s = np.array([model.scorer.one(text_features(t), []) for t in b["text"]])
            w = np.array([model.posterior.get(_coded(t), model.share) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality_score": s, "weak_label": w, "good": logit(s) + logit(w) > 0})

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, quality_score double, weak_label double, good boolean")
