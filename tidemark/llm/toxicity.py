"""Toxicity by a classifier chain: each category's linear model sees the probabilities of those before it.

The later models are trained with out-of-fold probabilities of the earlier ones, so that they learn from what an unseen
document would show. The last category decides; its threshold is the one with the best F-measure out of fold, precision counting double.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_rows, materialize
from tidemark.llm.linear import SPACE, Scorer, fit, forget, text_features

#: Labelled documents that a chain is fitted on at most (those with the smallest hashed ids), and folds.
MOST_ROWS, FOLDS = 12_000, 3


def _pack(s: Scorer) -> bytes:
    used = np.flatnonzero(s.weights).astype(np.int32)
    out = io.BytesIO()
    np.savez(out, used=used, w=s.weights[used], extra=s.extra, bias=s.bias)
    return out.getvalue()


def _unpack(blob: bytes) -> Scorer:
    z = np.load(io.BytesIO(blob))
    w = np.zeros(SPACE)
    w[z["used"]] = z["w"]
    return Scorer(w, z["extra"], float(z["bias"]))


class Chain:
    """The fitted models in order, the names of their categories and the last one's threshold."""

    def __init__(self, categories: list[str], scorers: list[Scorer], threshold: float):
        self.categories, self.scorers, self.threshold = categories, scorers, threshold

    def probabilities(self, text: str) -> list[float]:
        ids, out = text_features(text), []
        for s in self.scorers:
            out.append(s.one(ids, out))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F-measure, precision counting double, halfway to the next smaller probability; over 1 (none rejected) without positives."""
    if not len(p) or y.sum() == 0:
        return 2.0
    order = np.argsort(-p, kind="stable")
    hit, n = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    f1 = 1.25 * hit / (n + 0.25 * y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    k = int(np.argmax(f1))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], most_rows: int = MOST_ROWS, folds: int = FOLDS) -> Chain:
    """Fit a chain on documents with labels (doc_id and a 0/1 column for each category).

    Several labels of one document count as their maximum, null labels as 0; labels of unknown documents, and rows
    with a null doc_id, are left out. Without labelled documents every probability is 0 and nothing is rejected.
    """
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in categories])
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # bounded by most_rows, so broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.select("doc_id", "text", F.array(*categories).alias("y"))

    def extract(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "ids": [text_features(t) for t in b["text"]]})

    feats = rows.mapInPandas(extract, "doc_id long, y array<double>, ids array<int>")
    feats = materialize(feats.withColumns({"fold": F.pmod(F.xxhash64("doc_id"), F.lit(folds)), "row": F.monotonically_increasing_id()}), "chain")
    several = feats.withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(folds + 1)])))

    scorers, earlier, y_last = [], pd.DataFrame(index=pd.Index([], dtype="int64")), None
    for k, _ in enumerate(categories):
        known = earlier  # each link's function is sent before the next one is made

        def link(key, g):
            forget()  # the worker may have read texts before
            model = int(key[0])
            g = g.sort_values("row")
            extra = known.reindex(g["row"]).to_numpy(dtype=float) if k else np.zeros((len(g), 0))
            y, f = np.array([v[k] for v in g["y"]], dtype=float), [np.asarray(v, dtype=np.int32) for v in g["ids"]]
            held = (g["fold"] == model).to_numpy()
            s = fit([x for x, h in zip(f, held) if not h], y[~held], extra[~held])
            if model == folds:
                return pd.DataFrame({"row": [-1], "p": [0.0], "y": [0.0], "blob": [_pack(s)]})
            p = s.many([x for x, h in zip(f, held) if h], extra[held])
            return pd.DataFrame({"row": g["row"].to_numpy()[held], "p": p, "y": y[held], "blob": None})

        got = several.groupBy("model").applyInPandas(link, "row long, p double, y double, blob binary").toPandas()  # bounded by most_rows
        final = got[got["row"] == -1]
        scorers.append(_unpack(final["blob"].iloc[0]) if len(final) else Scorer(np.zeros(SPACE), np.zeros(k), -30.0))
        oof = got[got["row"] >= 0].set_index("row").sort_index()
        earlier = pd.concat([earlier, oof["p"].rename(str(k))], axis=1)
        y_last = oof
    threshold = best_threshold(y_last["p"].to_numpy(), y_last["y"].to_numpy()) if y_last is not None else 2.0
    return Chain(categories, scorers, threshold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability p_<category> for each link and `rejected`, for every whole text in one narrow pass.

    Null text counts as empty, repeated rows are scored alike, a null doc_id is kept, texts of any length are read whole, an empty table gives no rows
    and extra columns, whatever their names, are ignored.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for b in batches:
            p = np.array([chain.probabilities(t) for t in b["text"]]).reshape(len(b), len(names))
            yield pd.DataFrame({"doc_id": b["doc_id"], **{n: p[:, i] for i, n in enumerate(names)}, "rejected": p[:, -1] >= chain.threshold})

    schema = "doc_id long, " + "".join(f"{n} double, " for n in names) + "rejected boolean"
    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, schema)


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs, all columns as they are, whose text the chain does not reject.

    Only the text goes through Python. Null text counts as empty, repeated rows go or stay together, an empty table stays empty and columns may have any name.
    """

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([chain.probabilities(t)[-1] < chain.threshold for t in texts], dtype=bool)

    return docs.where(clean(F.coalesce("text", F.lit(""))))
