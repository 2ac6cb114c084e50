"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.runtime import shuffle_partitions, written


def _small(df: DataFrame, name: str) -> DataFrame:
    """df written by a sixteenth of the session's tasks, 8 at least: labels are few where the width is set for texts."""
    return written(df.coalesce(max(8, shuffle_partitions(df.sparkSession) // 16)), name)


def _forward(edges: DataFrame) -> DataFrame:
    """Each link once, from the smaller to the larger end."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()


def _none(df: DataFrame) -> bool:
    return not df.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) can reach.

    Rounds of hooking (each label to the least label next to it), pointer jumping and contraction. A
    round at least halves the labels that still have links, and each writes its tables, so lineage stays
    short. Aggregates are partial before every shuffle; joins may be split by Spark when a hub is hot.
    Null ends and loops are ignored; an empty table gives no rows. Fewest rounds are needed if hubs have
    the smallest numbers.
    """
    links = _small(_forward(edges.filter("u is not null and v is not null")), "links")
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = ends.select("node", F.col("node").alias("component"))
    while True:
        # The least label next to each, itself included: of both directions of every link.
        sides = links.select(F.explode(F.array(F.struct(F.col("u").alias("label"), F.col("u").alias("to")), F.struct(F.col("v").alias("label"), F.col("u").alias("to")))).alias("s"))
        up = sides.groupBy("s.label").agg(F.min("s.to").alias("parent"))
        while True:
            over = up.select(F.col("label").alias("l2"), F.col("parent").alias("p2"))
            jump = F.coalesce("p2", "parent")
            up = _small(up.join(over, F.col("parent") == F.col("l2"), "left").select("label", jump.alias("parent"), (jump != F.col("parent")).alias("moved")), "parents")
            settled = _none(up.filter("moved"))
            up = up.select("label", "parent")
            if settled:
                break
        labels = labels.join(up, F.col("component") == F.col("label"), "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = _small(labels, "labels")
        ends = up.select(F.col("label").alias("l2"), F.col("parent").alias("p2"))
        moved = links.join(up, F.col("u") == F.col("label")).select(F.col("parent").alias("u"), "v")
        moved = moved.join(ends, F.col("v") == F.col("l2")).select("u", F.col("p2").alias("v"))
        links = _small(_forward(moved), "links")
        if _none(links):
            return labels
