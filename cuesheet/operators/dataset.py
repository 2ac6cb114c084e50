"""The dataset pipeline's transforms, registered by name: scan, filter, derive, sort, batch, pad."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import arrays, text
from cuesheet.operators import batching
from cuesheet.pipeline import register


@register("tokenize")
def tokenize(df: DataFrame, tokenizer=None, column: str = "text") -> DataFrame:
    """`text_token` from the text, and `instruct_token` if there are instructions. Default tokens: hashes of words."""
    make = tokenizer or (lambda c: F.transform(F.split(text.strip(c), r"\s+"), lambda w: F.pmod(F.hash(w), F.lit(65536))))
    out = df.withColumn("text_token", make(F.col(column)))
    return out.withColumn("instruct_token", make(F.col("instruct"))) if "instruct" in df.columns else out


@register("filter")
def keep(df: DataFrame, max_length: int = 10240, min_length: int = 10, token_max: int = 200, token_min: int = 1, min_ratio: float = 0.0005, max_ratio: float = 1.0, online: bool = False) -> DataFrame:
    """sequence_filter over speech, sample_rate and text_token; rows with empty output tokens go unless features are online."""
    frames = F.size("speech") / F.col("sample_rate") * 100
    out = batching.sequence_filter(df, frames, F.size("text_token"), None, max_length, min_length, token_max, token_min, min_ratio, max_ratio)
    for column in () if online else ("speech_token", "reject_speech_token"):
        if column in df.columns:
            out = out.filter(F.col(column).isNull() | (F.size(column) > 0))
    return out


@register("resample")
def resample(df: DataFrame, rate: int = 22050, least: int = 16000) -> DataFrame:
    """Speech at one rate, band-limited, its peak at most 1; slower rows go if they would have to be resampled."""
    out = batching.resample_filter(df, F.col("sample_rate"), rate, least)
    # A column first: no lambda may hold a pandas UDF.
    out = out.withColumn("speech", arrays.resampled(F.col("speech"), F.col("sample_rate"), rate))
    return out.withColumn("speech", arrays.peak_normalize(F.col("speech"))).withColumn("sample_rate", F.lit(rate))


@register("truncate")
def truncate(df: DataFrame, length: int = 24576, seed: int = 0) -> DataFrame:
    """A seeded window of the speech, or all of it and zeros."""
    start = batching.random_start(F.col("speech"), length, seed, F.col("utt"))
    return df.withColumn("speech", batching.crop_or_pad(F.transform("speech", lambda x: x.cast("double")), length, start))


@register("parse_embedding")
def parse_embedding(df: DataFrame) -> DataFrame:
    """Utterance and speaker embeddings as unit vectors; a missing speaker embedding is the utterance's."""
    spk = F.col("spk_embedding") if "spk_embedding" in df.columns else F.col("utt_embedding")
    # One after the other: in one projection a lambda would see the new column of the same name.
    out = df.withColumn("spk_embedding", arrays.l2_normalize(F.coalesce(spk, F.col("utt_embedding"))))
    return out.withColumn("utt_embedding", arrays.l2_normalize(F.col("utt_embedding")))


@register("shuffle")
def shuffle(df: DataFrame, shard: str = "src", seed: int = 0, size: int = 10000) -> DataFrame:
    return batching.shuffle_blocks(df, [shard], "idx", seed, size).drop("idx").withColumnRenamed("shuffled_idx", "idx")


@register("sort")
def sort(df: DataFrame, shard: str = "src", size: int = 500) -> DataFrame:
    rows = df.withColumn("__n", F.size("speech"))
    return batching.bounded_sort(rows, [shard], "__n", "idx", size).drop("__n", "idx").withColumnRenamed("sorted_idx", "idx")


@register("batch")
def batch(df: DataFrame, kind: str = "static", shard: str = "src", size: int = 16, cap: int = 12000) -> DataFrame:
    rows = df.withColumn("__n", F.size("speech"))
    return batching.batch(rows, kind, [shard], "idx", size=size, length="__n", cap=cap).drop("__n")


@register("padding")
def padding(df: DataFrame, shard: str = "src", optional: tuple[str, ...] = ()) -> DataFrame:
    return batching.padded_batch(df, [shard, "batch"], "speech", "utt", F.lit(0.0), [c for c in optional if c in df.columns])
