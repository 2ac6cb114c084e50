"""Views over the driver's tables that stand for segments, flags, utterances and frames: in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.session import table

#: 2024-01-01T00:00:00Z in microseconds.
EPOCH_US = 1_704_067_200_000_000


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, pos, seg_start, seg_end, text and who: one row per event, 10 x value seconds long."""
    e = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(1e6)
    return e.select(
        F.col("event_type").alias("source"),
        F.col("event_id").alias("pos"),
        start.alias("seg_start"),
        (start + F.lit(10.0) * F.col("value")).alias("seg_end"),
        F.col("event_type").alias("text"),
        F.when(F.col("user_id") % 2 == 0, "female").otherwise("male").alias("who"),
        "user_id",
        "value",
    )


SEGMENTS = f"""segment AS (
  SELECT event_type AS source, event_id AS pos, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS seg_start,
    (epoch_us(ts) - {EPOCH_US}) / 1e6 + 10.0::DOUBLE * value AS seg_end, event_type AS text,
    CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END AS who, user_id, value FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, idx, x, label: the embeddings in long form, as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


FRAMES = """frame AS (
  SELECT vec_id, label, i - 1 AS idx, embedding[i]::DOUBLE AS x
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, spk, text, n: the documents as utterances."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"), F.col("source").alias("spk"), "text", F.col("n_chars").alias("n"))


UTTERANCES = "utt AS (SELECT doc_id AS utt, source AS spk, text, n_chars AS n FROM documents)"
