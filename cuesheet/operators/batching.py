"""Sampling, sharding, bounded sorting, length-aware batching and padding.

A dataset is ordered inside shards (a key, as rank or file is in a training set); nothing here orders
all rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators import scale
from cuesheet.operators.manifests import earliest


def sequence_filter(
    df: DataFrame,
    frames: Column,
    tokens: Column,
    outputs: Column | None = None,
    max_length: int = 10240,
    min_length: int = 10,
    token_max: int = 200,
    token_min: int = 1,
    min_ratio: float = 0.0005,
    max_ratio: float = 1.0,
) -> DataFrame:
    """Rows whose frame and token counts, and their ratio (unless there are no frames), are inside the bounds; empty outputs go."""
    keep = frames.between(min_length, max_length) & tokens.between(token_min, token_max)
    ratio = F.try_divide(tokens.cast("double"), frames.cast("double"))
    keep = keep & F.when(frames != 0, ratio.between(min_ratio, max_ratio)).otherwise(True)
    if outputs is not None:
        keep = keep & (outputs.isNull() | (outputs > 0))
    return df.filter(keep)


def resample_filter(df: DataFrame, rate: Column, target: int = 22050, least: int = 16000) -> DataFrame:
    """Drop rows under the least rate, but only if they would have to be resampled."""
    return df.filter(~((rate != target) & (rate < least)))


def bounded_sort(df: DataFrame, shard: list[str], length: str, idx: str, size: int = 500) -> DataFrame:
    """df with `sorted_idx`: the place after a stable sort by length inside consecutive buffers of `size` rows of a shard."""
    block = F.floor(F.col(idx) / F.lit(size))
    place = F.row_number().over(Window.partitionBy(*shard, block).orderBy(length, idx)) - 1
    return df.withColumn("sorted_idx", block * size + place)


def static_batch(idx: Column, size: int) -> Column:
    """The batch of a row when batches have `size` rows and the last may have fewer."""
    return F.floor(idx / F.lit(size)).cast("bigint")


def batch(df: DataFrame, kind: str, shard: list[str], idx: str, **options) -> DataFrame:
    """df with `batch`, by static or dynamic batches; another kind is an error."""
    if kind == "static":
        return df.withColumn("batch", static_batch(F.col(idx), options.get("size", 16)))
    if kind == "dynamic":
        return dynamic_batch(df, shard, idx, options["length"], options.get("cap", 12000))
    raise ValueError(f"unsupported batch type {kind!r}")


def dynamic_batch(df: DataFrame, shard: list[str], idx: str, length: str, cap: int = 12000) -> DataFrame:
    """df with `batch`: a batch closes when longest x (rows + 1) would exceed the cap. Greedy, so a fold per shard.

    Rows stream through the fold in sorted Arrow batches: only the running count and longest are held, however
    long a shard is. An oversized row is a batch by itself; no batch is empty.
    """
    columns = df.columns
    schema = df.withColumn("batch", F.lit(0).cast("bigint")).schema
    ordered = df.repartition(*[F.col(c) for c in shard]).sortWithinPartitions(*shard, idx)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, longest, rows = None, 0, 0, 0
        for pdf in batches:
            lengths = pdf[length].to_numpy()
            out = np.empty(len(pdf), np.int64)
            codes = pdf.groupby(shard, sort=False, dropna=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[: len(pdf)]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
                key = tuple(None if pd.isna(v) else v for v in pdf[shard].iloc[a])
                if key != now:
                    now, number, longest, rows = key, 0, 0, 0
                while a < b:
                    # How far the batch goes: the longest so far times its rows does not fall, so the first place over the cap ends it.
                    part = np.maximum(np.maximum.accumulate(lengths[a : min(b, a + 512)]), longest)
                    over = np.flatnonzero(part * (rows + 1 + np.arange(len(part))) > cap)
                    over = over[over + rows > 0]
                    take = int(over[0]) if len(over) else len(part)
                    out[a : a + take] = number
                    if take:
                        rows, longest = rows + take, part[take - 1]
                    a += take
                    if len(over):
                        number, longest, rows = number + 1, 0, 0
            yield pdf[columns].assign(batch=out)

    return ordered.mapInPandas(run, schema)


def rank_shard(idx: Column, n: Column, rank: int, world: int, worker: int = 0, workers: int = 1) -> Column:
    """Whether row idx of n belongs to the worker of the rank: idx modulo world, then modulo workers among those."""
    return (idx % world == rank) & (F.floor(idx / F.lit(world)) % workers == worker)


def shard_rows(df: DataFrame, idx: str, n: int, world: int, workers: int = 1) -> DataFrame:
    """df with rank and worker, every row at least once: lists shorter than world (or workers) are repeated to that length."""
    padded = max(n, world)
    copies = df.withColumn("__i", F.explode(F.sequence(F.col(idx).cast("bigint"), F.lit(padded - 1).cast("bigint"), F.lit(max(n, 1)).cast("bigint")))) if n else df.withColumn("__i", F.lit(0))
    rows = copies.withColumns({"rank": F.col("__i") % world, "__j": F.floor(F.col("__i") / F.lit(world))})
    per = -(-padded // world)  # rows of the longest rank
    low = padded // world
    size = F.when(F.col("rank") < padded % world, per).otherwise(low) if padded % world else F.lit(low)
    rows = rows.withColumn("__n", F.greatest(size, F.lit(workers)))
    rows = rows.withColumn("__k", F.explode(F.sequence(F.col("__j").cast("bigint"), (F.col("__n") - 1).cast("bigint"), F.greatest(size, F.lit(1)).cast("bigint"))))
    return rows.withColumn("worker", F.col("__k") % workers).drop("__i", "__j", "__n", "__k")


def epoch_rows(df: DataFrame, ident: str, seed: int, epoch: int, world: int, workers: int = 1, shuffle: bool = True) -> DataFrame:
    """df with epoch_idx, rank and worker: one epoch of a distributed sampler, every row at least once.

    Rows are put in an order of the epoch (by id if not shuffled) without a sort of all rows in one task, and
    dealt as shard_rows does: lists shorter than the world, or than a rank's workers, are repeated. ident: a unique integer.
    """
    order = seeded_order(f"{seed}/{epoch}", F.col(ident)) if shuffle else F.col(ident).cast("bigint")
    rows = df.withColumn("__o", order)
    rows = scale.position(rows, [], ["__o", ident], F.shiftright("__o", 44) if shuffle else F.floor(F.col("__o") / 65536), "epoch_idx")
    return shard_rows(rows.drop("__o").withColumn("epoch_idx", F.col("epoch_idx").cast("bigint")), "epoch_idx", df.count(), world, workers)


def seeded_order(seed: int | str, *ids: Column) -> Column:
    """A reproducible shuffle key of 60 bits: rows sorted by it are in an order that depends on seed and ids only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded_share(seed: int | str, *ids: Column) -> Column:
    """A reproducible number from 0 to 1."""
    return seeded_order(seed, *ids) / F.lit(float(1 << 60))


def shuffle_blocks(df: DataFrame, shard: list[str], idx: str, seed: int, size: int = 10000) -> DataFrame:
    """df with `shuffled_idx`: a seeded permutation inside consecutive blocks of `size` rows of a shard."""
    block = F.floor(F.col(idx) / F.lit(size))
    place = F.row_number().over(Window.partitionBy(*shard, block).orderBy(seeded_order(seed, F.col(idx), *[F.col(c) for c in shard]), idx)) - 1
    return df.withColumn("shuffled_idx", block * size + place)


def split_balanced(idx: Column, n: Column, k: int) -> Column:
    """The contiguous part, from 1, of row idx of n when they are dealt to k (at most n) parts, the first n % k one longer."""
    parts = F.least(F.lit(k).cast("bigint"), n)
    low, more = F.floor(n / parts), n % parts
    edge = more * (low + 1)
    return F.when(idx < edge, F.floor(idx / (low + 1))).otherwise(more + F.floor((idx - edge) / F.greatest(low, F.lit(1)))) + 1


def with_split(df: DataFrame, keys: list[str], idx: str, k: int) -> DataFrame:
    """df with `part` by split_balanced inside each key; the sizes come from an aggregate, not a window."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(sizes, keys).withColumn("part", split_balanced(F.col(idx), F.col("__n"), k).cast("int")).drop("__n")


def crop_or_pad(values: Column, length: int, start: Column) -> Column:
    """`length` values from start if there are more, else all of them and zeros."""
    n = F.size(values)
    return F.when(n > length, F.slice(values, start + 1, length)).otherwise(F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - n, F.lit(0)))))


def random_start(values: Column, length: int, seed: int, *ids: Column) -> Column:
    """A start for crop_or_pad that depends on the seed and the row's ids."""
    return F.pmod(seeded_order(seed, *ids), F.greatest(F.size(values) - length + 1, F.lit(1)).cast("bigint")).cast("int")


def pick_one(df: DataFrame, seed: int, idx: str) -> DataFrame:
    """One row, uniformly by a seeded hash."""
    return df.orderBy(seeded_order(seed, F.col(idx)), idx).limit(1)


def coin(seed: int, share: float, *ids: Column) -> Column:
    """True for about the share of rows, by a seeded hash of their ids."""
    return F.pmod(seeded_order(seed, *ids), F.lit(1 << 30)) < int(share * (1 << 30))


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of an explicit order."""
    return df.orderBy(*order).limit(n)


def top_p(df: DataFrame, keys: list[str], weight: str, tie: str, p: float = 0.8, k: int = 25) -> DataFrame:
    """The rows, by weight descending, whose preceding share is under p and whose rank is at most k; with share and rank.

    Weights are exponentiated and normalised per key first (softmax).
    """
    top = df.groupBy(*keys).agg(F.max(weight).alias("__top"))
    rows = df.join(top, keys).withColumn("__e", F.exp(F.col(weight) - F.col("__top")))
    rows = rows.join(rows.groupBy(*keys).agg(F.sum("__e").alias("__sum")), keys).withColumn("share", F.col("__e") / F.col("__sum"))
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), F.asc(tie))
    rows = rows.withColumns({"rank": F.row_number().over(order), "__before": F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    return rows.filter((F.col("rank") <= k) & (F.col("__before") < p)).drop("__top", "__e", "__sum", "__before")


def draw(df: DataFrame, keys: list[str], share: str, order: str, seed: int | str) -> DataFrame:
    """One row of each key, by a seeded number: shares are laid end to end in the order, and it falls on one of them.

    Shares need not sum to 1. Keys are those of a distribution (a vocabulary at most), not of a corpus.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__end", F.sum(share).over(w))
    totals = df.groupBy(*keys).agg(F.sum(share).alias("__all"))
    at = seeded_share(seed, *[F.col(k) for k in keys]) * F.col("__all")
    past = rows.join(totals, keys).withColumn("__past", F.col("__end") > at).filter("__past")
    rest = [c for c in df.columns if c not in (*keys, order)]
    return past.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in (order, *rest)])


def sample_token(df: DataFrame, keys: list[str], weight: str, token: str, recent: Column, seed: int, p: float = 0.8, k: int = 25, window: int = 10, share: float = 0.1) -> DataFrame:
    """keys, token, redrawn: a token drawn from the top-p prefix; one that was repeated lately is banned and drawn again from all others.

    recent: the tokens of the key so far (an array).
    """
    first = draw(top_p(df, keys, weight, token, p, k), keys, "share", "rank", f"{seed}/1")
    history = df.select(*keys, recent.alias("__recent")).dropDuplicates(keys)
    first = first.join(history, keys).withColumn("redrawn", repeated_lately("__recent", F.col(token), window, share)).select(*keys, token, "redrawn")
    banned = first.filter("redrawn").select(*keys, F.col(token).alias("__banned"))
    others = df.join(banned, keys).filter(F.col(token) != F.col("__banned"))
    others = others.join(others.groupBy(*keys).agg(F.max(weight).alias("__top")), keys).withColumn("__share", F.exp(F.col(weight) - F.col("__top")))
    again = draw(others.select(*keys, token, "__share"), keys, "__share", token, f"{seed}/2").select(*keys, token, F.lit(True).alias("redrawn"))
    return first.filter("not redrawn").unionByName(again)


def doubled(df: DataFrame, chosen: str, rejected: str, out: str, flag: str = "is_rejected") -> DataFrame:
    """Every row twice: with the chosen value, then with the rejected one, told apart by a flag."""
    rest = [c for c in df.columns if c not in (chosen, rejected)]
    def half(column: str, which: bool) -> DataFrame:
        return df.select(*rest, F.col(column).alias(out), F.lit(which).alias(flag))
    return half(chosen, False).unionByName(half(rejected, True))


def capped_tokens(tokens: Column, duration: Column, most: float = 30.0) -> Column:
    """The tokens of a recording; none if it is longer than `most` seconds."""
    return F.when(duration > most, F.slice(tokens, 1, 0)).otherwise(tokens)


def below(df: DataFrame, duration: Column, most: float = 30.0) -> DataFrame:
    """Rows whose recording is shorter than `most` seconds."""
    return df.filter(duration < most)


def smallest(df: DataFrame, keys: list[str], size: str, tie: str) -> DataFrame:
    """The row of the least size of each key; ties by `tie`."""
    return earliest(df, keys, [size, tie])


def repeated_lately(tokens: str, candidate: Column, window: int = 10, share: float = 0.1) -> Column:
    """Whether the candidate makes up `share` of the last `window` tokens of an array or more."""
    last = F.slice(tokens, F.greatest(F.size(tokens) - window + 1, F.lit(1)), window)
    return F.size(F.filter(last, lambda t: t == candidate)) >= F.lit(share * window)


def padded_batch(df: DataFrame, batch_keys: list[str], values: str, tie: str, zero: Column, optional: list[str] = ()) -> DataFrame:
    """One row per batch: arrays in order of decreasing length, right-padded, their lengths, and ids.

    An optional column is an array in the same order if no row of the batch lacks it, else null.
    """
    item = F.struct((-F.size(values)).alias("order"), F.col(tie), F.col(values), *optional)
    present = [F.bool_and(F.col(c).isNotNull()).alias(f"__{c}") for c in optional]
    rows = df.groupBy(*batch_keys).agg(F.array_sort(F.collect_list(item)).alias("__i"), F.max(F.size(values)).alias("__n"), *present)
    pad = F.transform("__i", lambda x: F.concat(x[values], F.array_repeat(zero, F.col("__n") + x["order"])))
    out = [pad.alias(values), F.transform("__i", lambda x: -x["order"]).alias(f"{values}_len"), F.transform("__i", lambda x: x[tie]).alias(tie)]
    more = [F.when(F.col(f"__{c}"), _field("__i", c)).alias(c) for c in optional]
    return rows.select(*batch_keys, *out, *more)


def _field(column: str, name: str) -> Column:
    return F.transform(column, lambda x: x[name])


def indexed(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "idx") -> DataFrame:
    """df with the row's place, from 0, inside its key."""
    return scale.position(df, keys, order, bucket, name)
