"""Aggregations and metrics: vectors, votes, error rates, latencies, weighted means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each key, as an array of doubles. Elements are averaged map-side first."""
    long = df.select(*keys, F.posexplode(vector).alias("__p", "__x"))
    cells = long.groupBy(*keys, "__p").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    rows = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__p", "__m"))).alias("__a"))
    return rows.select(*keys, F.transform("__a", lambda s: s["__m"]).alias(vector))


def average_best(df: DataFrame, loss: str, vector: str, n: int, tie: str) -> DataFrame:
    """Element-wise mean of the vectors of the n rows with the least loss."""
    best = df.orderBy(loss, tie).limit(n)
    return mean_vector(best.withColumn("__all", F.lit(1)), ["__all"], vector).drop("__all")


def majority(df: DataFrame, keys: list[str], vote: str, value: str, other: str) -> DataFrame:
    """keys, n_votes, winner: `value` if half of the non-null votes or more are for it, else `other`."""
    seen = df.filter(F.col(vote).isNotNull())
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col(vote) == value).alias("n_for"))
    return counts.withColumn("winner", F.when(2 * F.col("n_for") >= F.col("n_votes"), value).otherwise(other))


def latency_summary(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Mean, population variance x 1000 and percentiles 50, 90, 95, 99 (linear interpolation), in milliseconds.

    The variance is of seconds, times 1000: kept as reported, and named so.
    """
    p = F.percentile(F.col(seconds), F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = df.groupBy(*keys).agg(F.count(seconds).alias("n"), (F.avg(seconds) * 1000).alias("avg_ms"), (F.var_pop(seconds) * 1000).alias("variance_x1000"), p.alias("__p"))
    return out.withColumns({f"p{q}_ms": F.col("__p")[i] * 1000 for i, q in enumerate((50, 90, 95, 99))}).drop("__p")


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    """elapsed / duration; a duration of 0 gives infinity."""
    return F.when(duration == 0, F.lit(float("inf"))).otherwise(F.try_divide(elapsed, duration))


def batch_averages(df: DataFrame) -> DataFrame:
    """Per-batch-size averages from batch_size, count, ns: milliseconds in total, per batch, per sample; counts of 0 are left out."""
    rows = df.filter(F.col("count") > 0)
    ms = F.col("ns") / F.lit(1e6)
    return rows.withColumns({"total_ms": ms, "batch_ms": ms / F.col("count"), "sample_ms": ms / F.col("count") / F.col("batch_size")})


def weighted_mean(df: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """keys and weighted_mean: sum(value x weight) / sum(weight); null if the weights sum to 0."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(value * weight), F.sum(weight)).alias("weighted_mean"))


def masked_accuracy(df: DataFrame, keys: list[str], predicted: Column, target: Column, ignore: Column) -> DataFrame:
    """keys, n_counted, accuracy: equal predictions among the rows that are not ignored."""
    use = ~F.coalesce(ignore, F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(use).alias("n_counted"), F.try_divide(F.count_if(use & (predicted == target)), F.count_if(use)).alias("accuracy"))


def preference_rate(df: DataFrame, keys: list[str], chosen: Column, rejected: Column) -> DataFrame:
    """keys and rate: the share of rows whose chosen score is the larger."""
    return df.groupBy(*keys).agg(F.avg((chosen > rejected).cast("double")).alias("rate"))


def error_rate(df: DataFrame, keys: list[str], ref: str, hyp: str) -> DataFrame:
    """keys, errors, ref_chars, rate: Levenshtein distance by character over the reference's length, summed first."""
    rows = df.select(*keys, F.levenshtein(ref, hyp).cast("bigint").alias("e"), F.char_length(ref).cast("bigint").alias("n"))
    return rows.groupBy(*keys).agg(F.sum("e").alias("errors"), F.sum("n").alias("ref_chars")).withColumn("rate", F.try_divide("errors", "ref_chars"))


def align_chars(ref: str, hyp: str) -> list[tuple[str, str, str]]:
    """(operation, ref, hyp) of a least-cost alignment: `cor`, `sub`, `ins` or `del`. Ties: match, substitution, deletion."""
    n, m = len(ref), len(hyp)
    letters = np.array([ord(c) for c in hyp], np.int32)
    at = np.arange(m + 1, dtype=np.int32)
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = at
    for i in range(1, n + 1):
        row = cost[i - 1] + 1
        row[1:] = np.minimum(row[1:], cost[i - 1, :-1] + (letters != ord(ref[i - 1])))
        # Insertions cost one a step: the least of row[k] + j - k over k up to j.
        cost[i] = np.minimum.accumulate(row - at) + at
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append(("cor" if ref[i] == hyp[j] else "sub", ref[i], hyp[j]))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(("del", ref[i], ""))
        else:
            j -= 1
            out.append(("ins", "", hyp[j]))
    return out[::-1]


def merge_errors(pairs: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Neighbouring errors as one: their sides joined, `sub` unless one side stays empty."""
    out: list[list[str]] = []
    for op, r, h in pairs:
        if op != "cor" and out and out[-1][0] != "cor":
            out[-1][1] += r
            out[-1][2] += h
        else:
            out.append([op, r, h])
    return [("cor" if o == "cor" else "sub" if r and h else "del" if r else "ins", r, h) for o, r, h in out]


def error_table(df: DataFrame, ref: str, hyp: str, combine: bool = False) -> DataFrame:
    """(op, ref_part, hyp_part, n) over all rows, most frequent first by order of the caller. Null sides count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[tuple, int] = {}
            for r, h in zip(pdf["r"], pdf["h"], strict=True):
                pairs = align_chars(r or "", h or "")
                for x in merge_errors(pairs) if combine else pairs:
                    rows[x] = rows.get(x, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["op", "ref_part", "hyp_part", "n"])

    parts = df.select(F.col(ref).alias("r"), F.col(hyp).alias("h")).mapInPandas(run, "op string, ref_part string, hyp_part string, n bigint")
    return parts.groupBy("op", "ref_part", "hyp_part").agg(F.sum("n").alias("n"))


def ordered_errors(errors: DataFrame) -> DataFrame:
    """An error table as it is reported: most frequent first, equals by their parts, descending."""
    return errors.orderBy(F.desc("n"), F.desc("ref_part"), F.desc("hyp_part"), F.desc("op"))


def completed(status: Column, state: str = "done") -> Column:
    """How many values of a map column equal the state."""
    return F.size(F.filter(F.map_values(status), lambda v: v == state))


def format_size(size: Column) -> Column:
    """Bytes as B, KB and MB with one decimal, GB with two, by powers of 1024; ties round to even."""
    b = size.cast("double")
    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("bigint")))
        .when(size < 1024**2, F.format_string("%.1f KB", F.bround(b / 1024, 1)))
        .when(size < 1024**3, F.format_string("%.1f MB", F.bround(b / 1024**2, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(b / 1024**3, 2)))
    )


def inventory(df: DataFrame, path: str, size: str, patterns: list[str]) -> DataFrame:
    """(path, size) of the files that match any glob, each once."""
    regexes = ["^" + p.replace(".", r"\.").replace("*", "[^/]*") + "$" for p in patterns]
    hit = F.lit(False)
    for r in regexes:
        hit = hit | F.col(path).rlike(r)
    return df.filter(hit).groupBy(path).agg(F.max(size).alias(size))
