"""Substring de-duplication over a de Bruijn graph of words.

The edges of the graph are windows of 35 words, its nodes the 34 words that neighbours share. Edges are dealt by their
minimiser: neighbouring edges with one minimiser are a run, equal runs are counted as one path, and only where a minimiser has several distinct
runs, that is where the graph branches, are single edges counted. Paths are compacted within their runs, joined to all places where the run occurs
and glued over runs by their source coordinates, which verify how far each repeated span goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import repeats
from tidemark.llm.common import discard, map_rows, materialize

#: Words of a window, and of a minimiser's gram.
WIDTH, GRAM = 35, 8


def repeated_paths(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, doc_id, text, a, b): documents with the intervals of their windows that are repeated."""
    docs = repeats.keyed(docs)
    again = repeats.repeated_runs(docs, repeats.word_units, width, gram)
    kinds = repeats.distinct_runs(again)
    whole = kinds.where("times > 1").select("g", "c", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    branching = repeats.windows_by_hash(docs, kinds.where("kinds > 1"), repeats.word_units, width)
    found = materialize(whole.unionByName(branching), "found")
    discard(kinds, branching)
    return repeats.covered(docs, again, found)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document.

    Null text has no words. Windows never cross documents, overlaps and repeats within a document count, equal rows are copies of each
    other, a null doc_id is kept, texts of any length are read whole, an empty table gives no rows and extra columns, whatever their names, are ignored.
    """

    def apply(batches):
        for b in batches:
            rows = []
            for doc, text, lo, hi in zip(b["doc_id"], b["text"], b["a"], b["b"]):
                words = repeats.words_of(text)
                gone = repeats.mask(len(words), lo, hi, width)
                kept = b" ".join([w for w, x in zip(words, gone) if not x])
                rows.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    cols = repeated_paths(docs, width, gram).select("doc_id", "text", "a", "b")
    return map_rows(cols, apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
