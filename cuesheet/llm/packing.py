"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt by a hash of their id into groups of bounded size, and each group is packed by
itself: items in decreasing length go to the open bin that they fill best; when none has room, every
permitted length is tried by a look-ahead over the items still to come, and the one with the least
cost per token it would hold is opened. In the end each bin shrinks to the smallest permitted length
that has its contents. Only (id, length) pairs are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
GROUP_ITEMS = 20_000
#: Cost of a bin beside its length, in tokens.
BIN_COST = 8.0
#: Length at which the quadratic part of a sequence's cost equals the linear one.
QUADRATIC_AT = 16384.0


def bin_price(capacity: int, bin_cost: float = BIN_COST, quadratic_at: float = QUADRATIC_AT) -> float:
    """What a sequence of this length costs: a fixed part, its tokens, and attention over them."""
    return bin_cost + capacity + capacity * capacity / quadratic_at


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, quadratic_at: float = QUADRATIC_AT) -> tuple[list[int], list[int]]:
    """(bin of each item, capacity of each bin). lengths: non-increasing, none over the largest capacity."""
    caps = sorted(set(capacities))
    price = {c: bin_price(c, bin_cost, quadratic_at) for c in caps}
    left = [0] * (caps[-1] + 1)  # items still to come, by length
    for n in lengths:
        left[n] += 1
    todo = 0  # bit n: items of length n are to come
    for n, k in enumerate(left):
        if k:
            todo |= 1 << n
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]  # open bins by room left
    open_mask = 0
    bins: list[int] = []
    used: list[int] = []
    placed: list[int] = []

    def filled(space: int) -> int:
        """Tokens that a greedy fill with the items to come would add to an empty space."""
        start, taken = space, {}
        while space > 0:
            n = (todo & ((1 << (space + 1)) - 2)).bit_length() - 1
            while n > 0 and taken.get(n, 0) >= left[n]:
                n = (todo & ((1 << n) - 2)).bit_length() - 1
            if n <= 0:
                break
            fit = min(space // n, left[n] - taken.get(n, 0))
            taken[n] = taken.get(n, 0) + fit
            space -= fit * n
        return start - space

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            todo &= ~(1 << n)
        fitting = open_mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1  # least room that is enough
            b = room[r].pop()
            if not room[r]:
                open_mask &= ~(1 << r)
            r -= n
        else:
            cost, size = min((price[c] / max(1, n + filled(c - n)), c) for c in caps if c >= n)
            b = len(bins)
            bins.append(size)
            used.append(0)
            r = size - n
        used[b] += n
        placed.append(b)
        room[r].append(b)
        open_mask |= 1 << r
    return placed, [next(c for c in caps if c >= u) for u in used]


def pack_documents(
    df: DataFrame,
    length_col: str = "n_tokens",
    id_col: str = "doc_id",
    capacities: tuple[int, ...] = CAPACITIES,
    bin_cost: float = BIN_COST,
    quadratic_at: float = QUADRATIC_AT,
    group_items: int = GROUP_ITEMS,
    rows: int | None = None,
) -> DataFrame:
    """A row per piece: id, piece, token_start, n_tokens, bin_id, bin_offset, bin_capacity, bin_used.

    A document longer than the largest capacity is cut into pieces of that length and a rest; every
    other one is a single piece, also if it has no tokens (null or negative lengths count as 0). Ties
    in length go by id, then piece. Rows that repeat an id are packed each. Null ids are packed like
    others. Other columns are not read. `rows`: the row count, if known, else it is counted.
    """
    caps = tuple(sorted(set(capacities)))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    most = caps[-1]
    n_rows = df.count() if rows is None else rows
    groups = max(1, -(-n_rows // group_items))
    size = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    items = df.select(F.col(id_col).alias("id"), size.alias("n"))
    # The length is part of the hash, so that one id repeated in many rows is still dealt out.
    items = items.withColumn("grp", F.pmod(F.xxhash64("id", "n"), F.lit(groups)).cast("long"))
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "token_start", "n_tokens", "bin_id", "bin_offset", "bin_capacity", "bin_used"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-n // most))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * most
        length = np.minimum(n[row] - start, most)
        ids = pdf["id"].to_numpy()
        rank = pd.Series(ids).rank(method="dense", na_option="top").to_numpy()
        order = np.lexsort((piece, rank[row], -length))
        bins, sizes = pack(length[order].tolist(), caps, bin_cost, quadratic_at)
        bins = np.array(bins, np.int64)
        by_bin = np.argsort(bins, kind="stable")
        total = np.cumsum(length[order][by_bin]) - length[order][by_bin]
        head = np.flatnonzero(np.concatenate(([True], np.diff(bins[by_bin]) > 0)))
        offset = np.empty(len(order), np.int64)
        offset[by_bin] = total - np.repeat(total[head], np.diff(np.append(head, len(order))))
        held = np.bincount(bins, weights=length[order]).astype(np.int64)
        sizes = np.array(sizes, np.int64)
        group = int(pdf["grp"].iloc[0])
        return pd.DataFrame(dict(zip(names, [pdf["id"].iloc[row[order]].to_numpy(), piece[order], start[order], length[order], group * (1 << 32) + bins, offset, sizes[bins], held[bins]], strict=True)))

    schema = f"`{id_col}` {id_type}, piece bigint, token_start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_capacity bigint, bin_used bigint"
    return items.groupBy("grp").applyInPandas(run, schema)
