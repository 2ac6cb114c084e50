"""The thin registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import decontaminate, exact_dedup, jaccard, langid, packing, passages, quality, secrets, token_counts, warc
from cuesheet.llm.runtime import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_rest(modulus: int) -> Column:
    """crc32 of doc_id's text, modulo `modulus`; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 is held out of learning."""
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_crc_rest(4) == 2, F.lit(False))
    model = langid.learn(docs, "lang", "text", "doc_id", accept=~held)
    out = langid.predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_languages", "proportions")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, exactly or nearly, across `documents`."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of `pages` with revisit records, written and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns and random tokens."""
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; fold 0 of 5 is held out of learning."""
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_crc_rest(5) == 0, F.lit(False))
    scorer = quality.learn(docs, _table(spark, sf_dir, "labels"), accept=~held)
    return quality.score(docs, scorer).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more."""
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the public 50k byte-level vocabulary."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of `documents`; the largest doc_id of each stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed by its token count into sequences of the permitted lengths."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    counts = written(token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), "packing-counts")
    return packing.pack_documents(counts, rows=docs.count())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, with the contract's contamination rule."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_passages": op2_passages,
    "op3_warc": op3_warc,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_jaccard": op6_jaccard,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
}
