"""Joins and lookups over manifests: strict, left, keyed by position, and the latest of several versions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails if a left row has no partner: the missing key is named in the error."""
    found = left.join(right.withColumn("__found", F.lit(True)), on, "left")
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in on])
    checked = F.when(F.col("__found"), True).otherwise(F.raise_error(F.concat(F.lit("no entry for "), key)).cast("boolean"))
    return found.filter(checked).drop("__found")


def assemble(left: DataFrame, required: list[tuple[DataFrame, str]], optional: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """One row per left row: every required manifest by its key (strict), every optional one (left outer)."""
    out = left
    for df, on in required:
        out = strict_join(out, df, [on])
    for df, on in optional:
        out = out.join(df, on, "left")
    return out


def matched(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, left rows without a partner)."""
    return left.join(right, on), left.join(right, on, "left_anti")


def guaranteed(left: DataFrame, results: DataFrame, on: list[str], value: str, error: str, message: str) -> DataFrame:
    """Every left row, with its result or, without one, the default error."""
    out = results.withColumn("__hit", F.lit(True))
    both = left.join(out, on, "left")
    return both.withColumn(error, F.when(F.col("__hit"), F.col(error)).otherwise(F.lit(message))).drop("__hit")


def default_if_empty(df: DataFrame, default: DataFrame) -> DataFrame:
    """df, or the default's rows (same columns, by name) if it has none."""
    some = df.limit(1).select(F.lit(True).alias("__any"))
    return df.unionByName(default.join(some, F.col("__any"), "left_anti"))


def default_per_key(known: DataFrame, rows: DataFrame, on: list[str], defaults: dict[str, Column]) -> DataFrame:
    """rows, and one row of defaults (expressions on known's columns) for every key of `known` that has none."""
    lone = known.join(rows.select(*on), on, "left_anti").select(*on, *[c.alias(n) for n, c in defaults.items()])
    return rows.select(*on, *defaults).unionByName(lone)


def usable_audio(results: DataFrame, files: DataFrame, path: str, error: str, fallback: DataFrame) -> DataFrame:
    """Results without an error whose file exists (files: path); the fallback's rows if there are none."""
    good = results.filter(F.col(error).isNull() & F.col(path).isNotNull()).join(files.select(path).distinct(), path, "left_semi")
    return default_if_empty(good, fallback)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order (last wins), by a partial aggregate; ties go to the largest row."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__x")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*df.columns)


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order (first wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__x")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(registry: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """The registry with entries put in place of those of the same key."""
    both = registry.withColumn("__v", F.lit(0)).unionByName(entries.withColumn("__v", F.lit(1)))
    return latest(both, keys, ["__v"]).drop("__v")


def snapshot_diff(after: DataFrame, before: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """after with each counter less that of before; rows that before lacks stay as they are. Counters may be strings."""
    old = before.select(*keys, *[F.col(c).cast("bigint").alias(f"__{c}") for c in counters])
    out = after.join(old, keys, "left")
    return out.withColumns({c: F.col(c).cast("bigint") - F.coalesce(f"__{c}", F.lit(0)) for c in counters}).drop(*[f"__{c}" for c in counters])


def flatten_stats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stage rows, batch rows) of nested server statistics: name, key, ns, count and name, batch_size, key, ns, count."""
    model = df.select(F.explode("model_stats").alias("m"))
    stages = model.select("m.name", F.explode("m.inference_stats").alias("key", "v")).select("name", "key", F.col("v.ns").cast("bigint").alias("ns"), F.col("v.count").cast("bigint").alias("count"))
    batches = model.select("m.name", F.explode("m.batch_stats").alias("b")).select("name", F.col("b.batch_size").cast("bigint").alias("batch_size"), F.explode("b.stats").alias("key", "v"))
    return stages, batches.select("name", "batch_size", "key", F.col("v.ns").cast("bigint").alias("ns"), F.col("v.count").cast("bigint").alias("count"))


def scatter(positions: DataFrame, results: DataFrame, group: str) -> DataFrame:
    """Results of a batch back at their global index: positions (group, place, index), results (group, values)."""
    values = results.select(group, F.posexplode("values").alias("place", "value"))
    return positions.join(values, [group, "place"], "left")


def zip_shortest(a: Column, b: Column) -> Column:
    """Pairs of two arrays by place, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("left"), F.slice(b, 1, n).alias("right"))


def lockstep(first: DataFrame, second: DataFrame, on: list[str], flag: str, value: str) -> DataFrame:
    """Two streams by place: the second's value where the flag is set and present, else the first's."""
    both = first.join(second.select(*on, F.col(value).alias("__other")), on)
    return both.withColumn(value, F.when(F.col(flag) & F.col("__other").isNotNull(), F.col("__other")).otherwise(F.col(value))).drop("__other")


def mapped(key: Column, entries: dict[str, str], default: Column | None = None) -> Column:
    """A fixed dimension as a map literal, with a default for unknown keys (else the key itself)."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])
    return F.coalesce(F.try_element_at(table, key), key if default is None else default)


def preferred(available: DataFrame, name: str, prefer: str | None, priority: list[str], required: bool = False) -> DataFrame:
    """The preferred entry if available, else the first available of the priority list.

    If none is: no row, or an error if one is required.
    """
    ranks = {n: i + 1 for i, n in enumerate(priority)}
    order = F.when(F.col(name) == F.lit(prefer or ""), 0)
    for n, i in ranks.items():
        order = order.when(F.col(name) == n, i)
    ranked = available.withColumn("__rank", order).filter("__rank is not null")
    found = ranked.agg(F.min(F.struct("__rank", name)).alias("x")).select(F.col(f"x.{name}").alias(name))
    if required:
        return found.select(F.coalesce(name, F.raise_error(F.lit(f"none of {[prefer, *priority]} is available")).cast("string")).alias(name))
    return found.filter(F.col(name).isNotNull())
