"""Arithmetic on arrays and on long-form series: Column to Column unless rows are added or summed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def l2_normalize(a: Column) -> Column:
    """The vector over its Euclidean norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


def mean_center(a: Column) -> Column:
    mean = total(a) / F.size(a)
    return F.transform(a, lambda x: x.cast("double") - mean)


def peak_normalize(a: Column, limit: float = 1.0) -> Column:
    """Divided by the largest magnitude if that is over the limit."""
    peak = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(peak > limit, F.transform(a, lambda x: x.cast("double") / peak)).otherwise(F.transform(a, lambda x: x.cast("double")))


def downmix(channels: Column) -> Column:
    """The mean over channels (an array of arrays), as long as the shortest."""
    n = F.array_min(F.transform(channels, lambda c: F.size(c)))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: total(F.transform(channels, lambda c: F.element_at(c, i))) / F.size(channels))


def pad_to_multiple(a: Column, k: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.pmod(-F.size(a), F.lit(k))))


def pad_right(a: Column, n: Column, value: Column) -> Column:
    return F.concat(a, F.array_repeat(value, F.greatest(n - F.size(a), F.lit(0))))


def pad_left(a: Column, n: Column, value: Column) -> Column:
    return F.concat(F.array_repeat(value, F.greatest(n - F.size(a), F.lit(0))), a)


def unpad_concat(parts: list[tuple[Column, Column]], n: Column, value: Column) -> Column:
    """The first `length` items of each padded array, joined, and padded to n."""
    joined = F.concat(*[F.slice(a, F.lit(1), length) for a, length in parts])
    return pad_right(joined, n, value)


def pad_mask(length: Column, n: Column) -> Column:
    """Whether each of n positions is padding."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i >= length)).otherwise(F.array().cast("array<boolean>"))


def attention_mask(length: Column, n: Column) -> Column:
    """1 for each position below the length, else 0."""
    return F.transform(pad_mask(length, n), lambda p: F.when(p, 0).otherwise(1))


def causal_mask(n: Column) -> Column:
    """n x n: whether row i may see column j (j <= i)."""
    return chunk_mask(n, F.lit(1))


def chunk_mask(n: Column, chunk: Column, left: int = -1) -> Column:
    """n x n: a row sees its own chunk, and as many chunks before as `left` says (all if negative)."""
    at = F.sequence(F.lit(0), n - 1)

    def row(i: Column) -> Column:
        c = F.floor(i / chunk)
        low = F.lit(0) if left < 0 else F.greatest((c - left) * chunk, F.lit(0))
        return F.transform(at, lambda j: (j < (c + 1) * chunk) & (j >= low))

    return F.transform(at, row)


def cross_fade(head: Column, tail: Column, window: Column) -> Column:
    """`head` with its first half-window mixed with the end of `tail`, by the two halves of the window."""
    n = F.floor(F.size(window) / 2).cast("int")
    mixed = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.element_at(head, i) * F.element_at(window, i) + F.element_at(tail, F.size(tail) - n + i) * F.element_at(window, n + i),
    )
    return F.concat(mixed, F.slice(head, n + 1, F.greatest(F.size(head) - n, F.lit(0))))


def linear_fades(a: Column, fade_ms: float, rate: int) -> Column:
    """Faded in and out over min(fade_ms x rate / 1000, max(1, a quarter of the length)) values."""
    n = F.size(a)
    fade = F.least(F.lit(int(fade_ms * rate / 1000)), F.greatest(F.lit(1), F.floor(n / 4).cast("int")))

    def ramp(k: Column) -> Column:  # as linspace(0, 1, fade): a single value is 0
        return F.when(fade > 1, k / (fade - 1)).otherwise(F.lit(0.0))

    def ramp_out(k: Column) -> Column:  # as linspace(1, 0, fade): a single value is 1
        return F.when(fade > 1, 1 - k / (fade - 1)).otherwise(F.lit(1.0))

    def value(x: Column, i: Column) -> Column:
        up = F.when(i < fade, ramp(i)).otherwise(F.lit(1.0))
        down = F.when(i >= n - fade, ramp_out(i - (n - fade))).otherwise(F.lit(1.0))
        return x.cast("double") * up * down

    return F.transform(a, value)


def interpolate(a: Column, n: Column) -> Column:
    """n values by linear interpolation between centres, ends held."""
    size = F.size(a)
    scale = size / n

    def at(i: Column) -> Column:
        x = F.greatest((i + 0.5) * scale - 0.5, F.lit(0.0))
        low = F.least(F.floor(x).cast("int"), size - 1)
        high = F.least(low + 1, size - 1)
        t = x - low
        return F.get(a, low).cast("double") * (1 - t) + F.get(a, high).cast("double") * t

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def middle(a: Column, n: int) -> Column:
    """The middle n values, or all if there are fewer."""
    start = F.greatest(F.floor((F.size(a) - n) / 2).cast("int"), F.lit(0))
    return F.slice(a, start + 1, F.lit(n))


def head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def overlap_add(chunks: Column, overlap: int) -> Column:
    """Chunks joined; `overlap` values of each neighbouring pair are cross-faded linearly."""
    k = F.lit(overlap)

    def ramp(i: Column) -> Column:
        return (i - 1) / F.lit(max(overlap - 1, 1)) if overlap > 1 else F.lit(0.0)

    def step(acc: Column, chunk: Column) -> Column:
        n = F.size(acc)
        body = F.slice(acc, F.lit(1), F.greatest(n - k, F.lit(0)))
        mixed = F.transform(F.sequence(F.lit(1), k), lambda i: F.element_at(chunk, i) * ramp(i) + F.element_at(acc, n - k + i) * (1 - ramp(i)))
        return F.concat(body, mixed, F.slice(chunk, k + 1, F.greatest(F.size(chunk) - k, F.lit(0))))

    first = F.get(chunks, F.lit(0))
    return F.aggregate(F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))), first, step)


def overlay(pieces: DataFrame, background: DataFrame, keys: list[str], rate: int, gain: float = 0.85, under: float = 0.25, beside: float = 1.0) -> DataFrame:
    """(keys, pos, x): speech pieces mixed over a background, in long form.

    pieces: keys, start (seconds), wave; background: keys, pos, x. Pieces are added up at int(start x rate), scaled
    to `gain` at their peak, and put over the background, which is `under` where a piece is and `beside` elsewhere.
    A mix over 1 is divided by its peak.
    """
    at = F.greatest(F.lit(0), (F.col("start") * F.lit(rate)).cast("int"))
    long = pieces.select(*keys, at.alias("__at"), F.posexplode("wave").alias("__i", "__x"))
    speech = long.groupBy(*keys, (F.col("__at") + F.col("__i")).alias("pos")).agg(F.sum(F.col("__x").cast("double")).alias("s"))
    peaks = speech.groupBy(*keys).agg(F.max(F.abs("s")).alias("__p"))
    speech = speech.join(peaks, keys).withColumn("s", F.when(F.col("__p") > 1e-8, F.col("s") / F.col("__p") * gain).otherwise(F.col("s"))).drop("__p")
    both = background.select(*keys, "pos", F.col("x").cast("double").alias("b")).join(speech, [*keys, "pos"], "full")
    mixed = both.withColumn("x", F.coalesce("s", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)) * F.when(F.col("s").isNotNull(), under).otherwise(beside))
    top = mixed.groupBy(*keys).agg(F.max(F.abs("x")).alias("__m"))
    return mixed.join(top, keys).select(*keys, "pos", F.when(F.col("__m") > 1, F.col("x") / F.col("__m")).otherwise(F.col("x")).alias("x"))


def speech_track(pieces: DataFrame, keys: list[str], rate: int, gain: float = 0.85) -> DataFrame:
    """overlay without a background."""
    empty = pieces.select(*keys, F.lit(0).alias("pos"), F.lit(0.0).alias("x")).limit(0)
    return overlay(pieces, empty, keys, rate, gain)


def voice_label(f0: Column, probability: Column, seconds: Column, low: str = "male", high: str = "female", threshold: float = 165.0) -> Column:
    """The label of the median over confident frames; null under 1.5 seconds or two such frames."""
    sure = F.array_sort(F.transform(F.filter(F.arrays_zip(f0.alias("f"), probability.alias("p")), lambda z: (z["p"] > 0.7) & z["f"].isNotNull()), lambda z: z["f"].cast("double")))
    n = F.size(sure)
    median = (F.get(sure, F.floor((n - 1) / 2).cast("int")) + F.get(sure, F.floor(n / 2).cast("int"))) / 2
    return F.when((seconds >= 1.5) & (n >= 2), F.when(median >= threshold, high).otherwise(low))


def reward(error_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.tanh(3 * error_rate)))


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0, squared: bool = False) -> Column:
    """The loss of a preference pair from log-probabilities: logistic with label smoothing, or its squared variant."""
    gap = (chosen - rejected) - (ref_chosen - ref_rejected)
    if squared:
        return F.pow(gap - 1 / (2 * beta), F.lit(2))

    def log_sigmoid(x: Column) -> Column:
        return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))

    return -log_sigmoid(beta * gap) * (1 - smoothing) - log_sigmoid(-beta * gap) * smoothing


@F.pandas_udf(T.BinaryType())
def to_pcm16(a: pd.Series) -> pd.Series:
    """Values in [-1, 1) as little-endian 16-bit samples, cut at the ends of the range."""
    return a.map(lambda x: None if x is None else np.clip(np.asarray(x, float) * 32768.0, -32768, 32767).astype("<i2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_pcm16(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else (np.frombuffer(x, "<i2").astype(np.float32) / 32768.0))


def band_limited(x: np.ndarray, rate: int, target: int, zeros: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """x at another rate: a sinc below the lower of both Nyquist rates, under a Hann window of `zeros` crossings a side.

    There are ceil(len(x) * target / rate) values; outside of x there is silence.
    """
    x = np.asarray(x, float)
    if rate == target or not len(x):
        return x
    cut = min(1.0, target / rate) * rolloff
    half = zeros / cut
    n = -(-len(x) * target // rate)
    out = np.empty(n)
    reach = np.arange(-int(np.ceil(half)), int(np.ceil(half)) + 1)
    padded = np.concatenate([np.zeros(len(reach)), x, np.zeros(len(reach) + 1)])
    for first in range(0, n, 1 << 14):  # values at a time: the window of each is held
        at = np.arange(first, min(n, first + (1 << 14))) * rate / target
        near = np.floor(at).astype(np.int64)[:, None] + reach
        t = at[:, None] - near
        weight = np.where(np.abs(t) < half, cut * np.sinc(cut * t) * np.cos(np.pi * t / (2 * half)) ** 2, 0.0)
        out[first : first + len(at)] = (weight * padded[np.clip(near + len(reach), 0, len(padded) - 1)]).sum(axis=1)
    return out


def resample(rate: int, target: int):
    """A pandas UDF that resamples arrays, band-limited."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else band_limited(x, rate, target).astype(np.float32))

    return run


def resampled(values: Column, rate: Column, target: int) -> Column:
    """Values of a rate of their own at the target rate, band-limited, as doubles."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(a: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else band_limited(x, int(k), target) for x, k in zip(a, r, strict=True)])

    return run(values, rate)


def seconds_of(sample: Column, rate: int, offset: Column | None = None) -> Column:
    at = sample / F.lit(float(rate))
    return at if offset is None else at + offset


def decode_bounds(length: Column, low: float = 2.0, high: float = 20.0) -> tuple[Column, Column]:
    return (length * low).cast("int"), (length * high).cast("int")


def padded_samples(duration: Column, ref: Column, target: Column, rate: int, pad: int) -> Column:
    """Samples of a request padded to whole multiples of `pad` seconds, the target's length estimated from the reference's."""
    estimate = duration / F.char_length(ref) * F.char_length(target)
    return F.lit(pad * rate) * (F.floor((estimate + duration).cast("int") / F.lit(pad)) + 1)


def retime(target: Column, current: Column) -> Column:
    return F.when((current > 0) & (target > 0), target / current).otherwise(F.lit(1.0))


def even_size(width: Column, factor: int) -> Column:
    w = F.floor(width / F.lit(factor))
    return (w + w % 2).cast("int")


def progress(end: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.least((end / duration * 100).cast("int"), F.lit(99))).otherwise(0)


def square_crop(y1: Column, y2: Column, x1: Column, x2: Column, height: Column, width: Column, grow: float = 1.4) -> Column:
    """A square around the box's centre, `grow` times its longer side, cut to the frame: struct<y1,y2,x1,x2>."""
    half = F.greatest(y2 - y1, x2 - x1) * grow / 2
    cy, cx = (y1 + y2) / 2, (x1 + x2) / 2
    return F.struct(
        F.greatest(F.lit(0), (cy - half).cast("int")).alias("y1"),
        F.least(height, (cy + half).cast("int")).alias("y2"),
        F.greatest(F.lit(0), (cx - half).cast("int")).alias("x1"),
        F.least(width, (cx + half).cast("int")).alias("x2"),
    )


def rate_curve(kind: str, step: Column, base: float, steps: int, least: float = 0.0, warmup: int = 0, power: float = 1.0, hold: int = 0) -> Column:
    """A learning-rate curve over steps: warmup, square, squareroot, cosine, poly or hold."""
    left = (F.lit(steps) - step) / F.lit(float(steps))
    if kind == "warmup":
        grown = F.lit(base * warmup**0.5) * F.least(F.pow(step, F.lit(-0.5)), step * F.lit(float(warmup) ** -1.5)) if warmup else F.lit(base) * F.pow(step, F.lit(-0.5))
        return grown
    if kind == "square":
        return F.greatest(F.lit(base) * F.pow(left, F.lit(2.0)), F.lit(least))
    if kind == "squareroot":
        return F.greatest(F.lit(base) * F.sqrt(left), F.lit(least))
    if kind == "cosine":
        past = step - warmup
        shape = F.lit(least) + F.lit((base - least) * 0.5) * (F.cos(F.lit(np.pi) * past / F.lit(float(steps))) + 1)
        curve = F.when(step > warmup + steps, F.lit(least)).otherwise(shape)
        return F.when(step <= warmup, F.lit(base) * step / F.lit(float(warmup))).otherwise(curve) if warmup else curve
    if kind == "poly":
        return F.lit(base - least) * F.pow(1 - F.least(step, F.lit(steps)) / F.lit(float(steps)), F.lit(power)) + F.lit(least)
    if kind == "hold":
        decay = F.pow(F.greatest(F.lit(1.0), (step - hold).cast("double")), F.lit(power))
        return F.greatest(F.lit(base * max(1.0, warmup**power)) / decay, F.lit(least))
    raise ValueError(f"unknown curve {kind!r}")
