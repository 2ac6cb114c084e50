"""The training-data pipeline over `documents`: five stages, each one operator over all that is left.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents, and a runner may write each result and hand the reread table on.
run() does that by itself, in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import decontaminate, exact_dedup, jaccard, langid, packing, token_counts
from cuesheet.llm.runtime import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language has half of the words or more; others go."""
    model = langid.learn(docs, "lang", "text", "doc_id")
    return langid.keep_languages(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: that of the smallest id."""
    return jaccard.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule lets pass."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence of a permitted length."""
    import public_tokenizers

    counts = written(token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), "pipeline-counts")
    return packing.pack_documents(counts, rows=docs.count())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_free),
    ("best_fit_packing", packed),
]

#: The language model of the first stage is not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
