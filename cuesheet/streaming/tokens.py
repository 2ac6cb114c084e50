"""Stateful streaming by token count: growing windows, overlapping windows, run suppression, interleaving.

Progress comes from counts of arrived tokens and end marks, per request; there is no event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuesheet.functions import arrays
from cuesheet.functions.jsonio import let

CHUNK = "request string, chunk int, first int, last int, seen_to int, tokens array<int>, final boolean"
_STATE = "buffer array<int>, offset int, hop int, chunk int, silent int, base int"


@dataclass(frozen=True)
class Hops:
    """hop: tokens of the first window; grow: factor after each; most: largest window; lookahead: tokens that must
    follow a window before it is emitted; prompt: tokens of the prompt, which widen the first window to whole hops."""

    hop: int = 25
    grow: int = 2
    most: int = 100
    lookahead: int = 3
    prompt: int = 0

    @property
    def first(self) -> int:
        return self.hop + (-self.prompt) % self.hop


def windows(hops: Hops, n: int) -> list[tuple[int, int, int, bool]]:
    """(first, last, seen to, final) of the windows over n tokens that have all arrived; the final one takes the rest.

    The hop grows per request: one request does not change another's.
    """
    out, offset, hop = [], 0, hops.hop
    while True:
        width = hops.first if offset == 0 else hop
        if n - offset < width + hops.lookahead:
            break
        out.append((offset, offset + width, offset + width + hops.lookahead, False))
        offset += width
        hop = min(hops.most, hop * hops.grow)
    out.append((offset, n, n, True))
    return out


def chunk_stream(tokens: DataFrame, hops: Hops = Hops(), silent: frozenset[int] = frozenset(), most_silent: int = 5) -> DataFrame:
    """Chunks of a stream of (request, token, ended): emitted when enough tokens have arrived, the rest at the end mark.

    Rows of a request come in `seq` order within a micro-batch. Silent tokens beyond a run of most_silent are left
    out. State is the tokens from the current offset on, and is removed when the request ends.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, offset, hop, chunk, run, base = state.get if state.exists else ([], 0, hops.hop, 0, 0, 0)
        rows = []
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        ended = bool(pdf["ended"].fillna(False).astype(bool).any())
        fresh = pdf["token"].dropna().to_numpy(np.int64)
        quiet = np.isin(fresh, list(silent))
        # The place of each token in its silent run; the first run goes on from the last batch's.
        place = np.arange(len(fresh))
        spoken = np.maximum.accumulate(np.where(quiet, -1, place)) if len(fresh) else place
        runs = np.where(spoken < 0, run + place + 1, place - spoken)
        if len(fresh):
            run = int(runs[-1])
        buffer = [*buffer, *fresh[~quiet | (runs <= most_silent)].tolist()]
        while True:  # buffer[0] is token number `offset`
            width = hops.first if offset == 0 else hop
            if len(buffer) < width + hops.lookahead:
                break
            rows.append((key[0], chunk, offset, offset + width, offset + width + hops.lookahead, buffer[:width], False))
            buffer, offset, chunk = buffer[width:], offset + width, chunk + 1
            hop = min(hops.most, hop * hops.grow)
        if ended:
            rows.append((key[0], chunk, offset, offset + len(buffer), offset + len(buffer), buffer, True))
            state.remove()
        else:
            state.update((buffer, offset, hop, chunk, run, base))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return tokens.groupBy("request").applyInPandasWithState(step, CHUNK, _STATE, "append", GroupStateTimeout.NoTimeout)


def chunk_bounds(n: Column, hops: Hops = Hops(), longest: int = 1 << 16) -> Column:
    """array<struct<first,last,final>>: the windows over n tokens in batch form, by the closed form of their starts."""
    starts = [0, hops.first]
    hop = min(hops.most, hops.hop * hops.grow)
    while hop < hops.most and starts[-1] < longest:
        starts.append(starts[-1] + hop)
        hop = min(hops.most, hop * hops.grow)
    grown = F.array(*[F.lit(s) for s in starts])
    last = starts[-1]
    count = F.greatest(F.floor((n - hops.lookahead - last) / F.lit(hops.most)).cast("int"), F.lit(0))
    more = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.lit(last) + i * hops.most)).otherwise(F.array().cast("array<int>"))
    ends = F.filter(F.concat(F.slice(grown, 2, len(starts)), more), lambda e: e + hops.lookahead <= n)

    def bounds(edges: Column) -> Column:
        return F.transform(edges, lambda e, i: F.struct(e.alias("first"), F.coalesce(F.get(edges, i + 1), n).alias("last"), (i == F.size(edges) - 1).alias("final")))

    return let(F.concat(F.array(F.lit(0)), ends), bounds)


def exponential_hops(rate: int = 25, first: int = 15, n: int = 8) -> list[int]:
    """Window sizes that start small, then double from one second of tokens."""
    return [first, *[rate * 2**i for i in range(n - 1)]][:n]


def replay(tokens: Column, sizes: list[int]) -> Column:
    """An array of tokens as chunks of the given sizes; the last size goes on."""
    starts, at = [], 0
    for s in sizes:
        starts.append(at)
        at += s
    n = F.size(tokens)
    more = F.when(n > at, F.sequence(F.lit(at), n - 1, F.lit(sizes[-1]))).otherwise(F.array().cast("array<int>"))
    edges = F.filter(F.concat(F.array(*[F.lit(s) for s in starts]), more), lambda s: s < n)
    return let(edges, lambda edges: F.transform(edges, lambda e, i: F.slice(tokens, e + 1, F.coalesce(F.get(edges, i + 1), n) - e)))


def overlapping(tokens: Column, hop: int, overlap: int = 20) -> Column:
    """Windows of hop + overlap tokens that advance by hop, and a last one with what is left."""
    n = F.size(tokens)
    count = F.greatest(F.floor((n - overlap) / F.lit(hop)).cast("int"), F.lit(0))
    full = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, i * hop + 1, F.lit(hop + overlap)))).otherwise(F.array().cast("array<array<int>>"))
    rest = F.slice(tokens, count * hop + 1, F.greatest(n - count * hop, F.lit(0)))
    return F.concat(full, F.array(rest))


def cross_faded(values: Column, hop: int, overlap: int = 20) -> Column:
    """The values as they are heard when their overlapping windows are sent one after another, each faded into the next."""
    return arrays.overlap_add(overlapping(values, hop, overlap), overlap)


def interleaved(tokens: DataFrame, keys: list[str], kind: str = "kind", idx: str = "idx", n_text: int = 5, n_speech: int = 15) -> DataFrame:
    """tokens with `place`: where each stands when text and speech take turns of n_text and n_speech.

    tokens: keys, kind (text or speech), idx from 0. A turn of speech follows each whole turn of text; when the
    text has ended the speech goes on alone. Places come from the counts of a key, without a sort of its tokens.
    """
    is_text = F.col(kind) == "text"
    sizes = tokens.groupBy(*keys).agg(F.count_if(is_text).alias("__t"), F.count_if(~is_text).alias("__s"))
    turn = F.floor(F.col(idx) / F.when(is_text, n_text).otherwise(n_speech))
    text_at = F.col(idx) + F.least(F.col("__s"), turn * n_speech)
    speech_at = F.col(idx) + F.when(turn < F.floor(F.col("__t") / n_text), (turn + 1) * n_text).otherwise(F.col("__t"))
    return tokens.join(sizes, keys).withColumn("place", F.when(is_text, text_at).otherwise(speech_at).cast("bigint")).drop("__t", "__s")


def interleave(texts: list[int], speech: list[int], n_text: int = 5, n_speech: int = 15) -> list[tuple[str, int]]:
    """Text and speech tokens in turns of n_text and n_speech; when the text has ended the speech goes on alone."""
    out, i, j = [], 0, 0
    while i < len(texts):
        out += [("text", t) for t in texts[i : i + n_text]]
        i += n_text
        if i < len(texts) or len(texts) % n_text == 0:
            out += [("speech", t) for t in speech[j : j + n_speech]]
            j += n_speech
    return out + [("speech", t) for t in speech[j:]]
