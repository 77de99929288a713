"""The numbered queries over the driver's tables, each a thin call of its operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.annulus import annulus_sql
from tidemark.llm.decontaminate import contamination_sql


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import toxicity

    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The chain low quality, then toxic, fitted to the labels of these documents."""
    from tidemark.llm import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    return toxicity.fit_chain(docs, labels, ["low_quality", "toxic"])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, tokenizer=tokenizer_path("byte_bpe_50k.json"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_array import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).drop("kept_raw")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprint import fingerprint_with_neighbour

    return fingerprint_with_neighbour(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lines import dedup_lines

    return dedup_lines(_documents(spark, sf_dir)).drop("kept_text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).drop("kept_text")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidemark.llm.ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import round_trip

    return round_trip(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import fit_quality, score

    docs = _documents(spark, sf_dir)
    return score(docs, fit_quality(docs))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.annulus import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periods import periodic_runs

    return periodic_runs(_documents(spark, sf_dir))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contamination

    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_NUMBERED = (
    op1_toxicity_chain, op2_best_fit_packing, op3_suffix_array_dedup, op4_document_fingerprints, op5_line_dedup, op6_substring_dedup, op7_ngram_jaccard_join, op8_nearest_neighbours,
    op9_bpe_round_trip, op10_quality_classifier, op11_centroid_clustering, op12_periodic_runs, op13_benchmark_decontamination,
)
QUERIES = {f.__name__: f for f in _NUMBERED}

ORACLE: dict[str, str] = {"op11_centroid_clustering": annulus_sql("embeddings"), "op13_benchmark_decontamination": contamination_sql("documents", "benchmark")}
