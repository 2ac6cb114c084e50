"""Writers: Spark's committers do the writing, so a task that is run again leaves no second copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import scale
from cuesheet.operators.manifests import upsert


def write_shards(df: DataFrame, path: str, rows: int = 1000) -> None:
    """Parquet files of at most `rows` rows."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def shard_index(df: DataFrame, key: str) -> DataFrame:
    """(key, src) of a table that was read from shards: in which file each key is found."""
    return df.select(key, F.col("_metadata.file_path").alias("src")).distinct()


def write_list(df: DataFrame, column: str, path: str) -> None:
    """A line per distinct value."""
    df.select(F.col(column).cast("string").alias("value")).distinct().write.text(path)


def write_manifest(df: DataFrame, key: str, value: str, path: str) -> None:
    """Lines `key value`."""
    df.select(F.concat_ws(" ", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.text(path)


def grouped_manifest(df: DataFrame, key: str, value: str, order: str, bucket: Column, per_line: int = 10_000) -> DataFrame:
    """(key, part, values): values joined by blanks, in order, at most per_line to a row, so that no row grows with a key.

    `bucket` must not decrease in the order: the places of a key are counted bucket by bucket.
    """
    rows = scale.position(df.select(key, value, order), [key], [order], bucket, "__i")
    lists = rows.groupBy(key, F.floor(F.col("__i") / F.lit(per_line)).alias("part")).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("a"))
    return lists.select(key, "part", F.array_join(F.transform("a", lambda s: s[value].cast("string")), " ").alias("values"))


def pair_lines(df: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """`value`: two lines per row, reference and hypothesis, as `key:<tab>ref=...`."""
    def line(name: str, c: str):
        return F.concat(F.col(key).cast("string"), F.lit(f":\t{name}="), F.col(c))
    return df.select(F.explode(F.array(line("ref", ref), line("hyp", hyp))).alias("value"))


def write_pairs(df: DataFrame, key: str, ref: str, hyp: str, path: str) -> None:
    pair_lines(df, key, ref, hyp).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with all fields, characters kept as they are."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, copy_to: str | None = None) -> None:
    """Parquet, and a copy elsewhere if asked for."""
    df.write.parquet(path)
    if copy_to:
        df.sparkSession.read.parquet(path).write.parquet(copy_to)


def save_registry(registry: DataFrame, entries: DataFrame, key: str, path: str) -> None:
    """The registry with entries put in place of those of the same id, written anew.

    The registry may be read from that very path: all is written beside it before the old files go.
    """
    fresh = f"{path.rstrip('/')}.fresh"
    upsert(registry, entries, [key]).write.mode("overwrite").parquet(fresh)
    fs, old = _hadoop(registry.sparkSession, path)
    fs.delete(old, True)
    if not fs.rename(_hadoop(registry.sparkSession, fresh)[1], old):
        raise OSError(f"cannot put {fresh} in the place of {path}")


def write_report(metrics: DataFrame, name: str, value: str, path: str) -> None:
    """Metrics as JSON lines under path/json and as text lines `name: value` under path/text."""
    write_json(metrics, f"{path}/json")
    metrics.select(F.concat(F.col(name).cast("string"), F.lit(": "), F.col(value).cast("string")).alias("value")).write.text(f"{path}/text")


def cleared(inventory: DataFrame) -> DataFrame:
    """(n_files, bytes) that clearing an inventory would remove."""
    return inventory.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def clear_cache(spark: SparkSession, folder: str, inventory: DataFrame) -> DataFrame:
    """(n_files, bytes) of the inventory, whose folder is deleted."""
    counted = cleared(inventory).first()
    fs, path = _hadoop(spark, folder)
    fs.delete(path, True)
    return spark.createDataFrame([tuple(counted)], "n_files bigint, bytes bigint")


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found
