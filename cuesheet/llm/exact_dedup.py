"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

All DataFrame functions. Hashes are grouped without their texts. Only rows whose hash another row has meet
with their texts, after map-side aggregation, so the copies that one task holds cross the network once; a
bitmap of fixed size picks them before the shuffle. The table that rows join back to has a row per content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.runtime import ascii_lower, bitmap, in_bitmap, without_ids, written


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256; its first 32 digits are the 128-bit grouping key."""
    return F.sha2(text, 256)


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = ascii_lower,
    key_digits: int = 32,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. `keep` is the id that stays, "min" or
    "max". Rows that repeat an id and a text are all reported, and all kept if that id stays. A null
    id is never chosen while its group has another; in a group of null ids only, keep_id is null and
    its rows are kept. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    best = F.min if keep == "min" else F.max
    text = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), text.alias("body"))
    key = F.substring("sha", 1, key_digits)
    # The costly hash is computed once for every row; mark is a cheap one that finds rows again by their text.
    hashed = written(rows.select("id", content_hash(F.col("body")).alias("sha"), F.xxhash64("body").alias("mark")).withColumn("key", key), "exact-hashes")
    parts = hashed.groupBy("key", "mark").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("sha").alias("sha"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("all"), best("keep_id").alias("keep_id"), F.min("sha").alias("sha"))
    sizes = written(sizes, "exact-sizes")
    several = sizes.filter("all > 1").select("key")
    marks = hashed.join(several, "key", "left_semi").select("mark")
    # Bytes are compared inside groups of several rows: the hash deals rows out, the bytes decide. No list of members is built.
    met = in_bitmap(rows.withColumn("mark", F.xxhash64("body")), F.col("mark"), bitmap(marks, F.col("mark"))).select("id", "body")
    met = met.withColumn("sha", content_hash(F.col("body"))).withColumn("key", key)
    by_bytes = met.groupBy("key", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("sha").alias("sha"))
    verified = by_bytes.select("key", "sha", "keep_id", "group_size").join(several, "key", "left_semi")
    single = sizes.filter("all = 1").select("key", "sha", "keep_id", F.col("all").alias("group_size"))
    groups = written(verified.unionByName(single), "exact-groups")
    # Different bytes under one key (none are known for 128 bits) are told apart by the whole SHA-256.
    joined = hashed.select("id", "key", "sha").join(groups, ["key", "sha"])
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """The rows of df that stay, with their columns as they were. Ids are taken to be unique."""
    found = exact_groups(df, id_col, text_col, keep, **options)
    gone = found.groupBy(F.col(id_col).alias("__id")).agg(F.bool_or("kept").alias("__kept")).filter("not __kept").select("__id")
    return without_ids(df, id_col, gone)
