"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

One pass over the texts finds the pattern spans and every long token, with the token's inferred
encoding and the statistics of three tests: chi-squared uniformity over that encoding's alphabet, the
runs test and lag-one serial correlation. The same pass counts the pairs of neighbouring token
characters of the whole corpus; they say how a token made of ordinary text would do in each of the three
tests. A token is added if the battery takes it for random and its p-value against "ordinary text", the
three tests combined, survives the Benjamini-Hochberg step-up, applied within each class of lengths over
all tokens of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.runtime import separators, text_pieces, written

#: The base patterns. Upper and lower case count as equal in the first only, and only in ASCII.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

_HEX_BYTES = separators((0x30, 0x39), (0x61, 0x66))
_TOKEN_BYTES = separators((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x5F, 0x5F), (0x2D, 0x2D))
_MARKS = separators((0x3A, 0x3A), (0x3D, 0x3D))
#: '=' ends a token, as padding or between a name and its value: both sides are tested by themselves.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+")

_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by size; the first that has all characters of a token is its encoding.
ALPHABETS: dict[str, str] = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "hex-upper": _DIGITS + "ABCDEF",
    "lower": _LOW,
    "upper": _UP,
    "base32": _UP + "234567",
    "base36": _DIGITS + _LOW,
    "base36-upper": _DIGITS + _UP,
    "letters": _UP + _LOW,
    "base62": _DIGITS + _UP + _LOW,
    "base64": _UP + _LOW + _DIGITS + "+/",
    "base64url": _UP + _LOW + _DIGITS + "-_",
    "mixed": _UP + _LOW + _DIGITS + "+/-_",
}
_SETS = {name: frozenset(chars) for name, chars in ALPHABETS.items()}
_INDEX = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
#: Token characters by number; every other byte has the next one.
_CHARS = ALPHABETS["mixed"]
_NUMBER = np.full(256, len(_CHARS), np.int64)
_NUMBER[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))


@dataclass(frozen=True)
class Settings:
    """min_length: characters of the shortest token tested; the tests tell little of shorter ones, which only
    the patterns find. battery: level below which a token is not random. discovery: false-discovery rate. classes: lower ends of the classes of lengths."""

    min_length: int = 20
    battery: float = 1e-3
    discovery: float = 0.01
    classes: tuple[int, ...] = (20, 32, 64, 128)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Runs of [0-9a-f]+ are maximal, so those of 24 and more are the matches of the bounded pattern.
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that has every character of the token."""
    chars = set(token)
    return next((name for name, known in _SETS.items() if chars <= known), None)


def _upper_chi(x: float, df: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return _upper_normal(z)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, encoding: str) -> tuple[float, float, float, float]:
    """(chi-squared statistic, changes between the halves of the alphabet, lag-one correlation, p-value) of a token.

    The p-value is that of a random token: the least of the three tests', times three.
    """
    index = _INDEX[encoding]
    v = np.array([index[c] for c in token])
    n, size = len(v), len(index)
    counts = np.bincount(v, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    p_chi = _upper_chi(chi, size - 1)
    high = v >= size / 2
    up = int(high.sum())
    down = n - up
    changes = int((high[1:] != high[:-1]).sum())
    if up and down:
        mean = 2 * up * down / n
        var = max(1e-9, mean * (mean - 1) / (n - 1))
        p_runs = 2 * _upper_normal(abs(changes - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    d = v - v.mean()
    spread = float((d * d).sum())
    # Under independence the lag-one correlation is about normal with mean -1/n and variance 1/n.
    serial = float((d[1:] * d[:-1]).sum()) / spread if spread else 1.0
    p_serial = 2 * _upper_normal(abs(serial + 1 / n) * math.sqrt(n)) if spread else 0.0
    return chi, changes, serial, min(1.0, 3 * min(p_chi, p_runs, p_serial))


@dataclass(frozen=True)
class TextModel:
    """How ordinary text, written in an alphabet, does in the three tests.

    excess: what a character adds to chi-squared. changes, fair: share of neighbours in different halves of the
    alphabet, in text and under independence. serial: correlation of neighbours.
    """

    size: int
    excess: float
    changes: float
    fair: float
    serial: float

    @classmethod
    def of(cls, encoding: str, pairs: np.ndarray) -> TextModel:
        """From counts of the pairs of neighbouring token characters of a corpus (numbers of _CHARS)."""
        at = _NUMBER[[ord(c) for c in ALPHABETS[encoding]]]
        joint = pairs[np.ix_(at, at)] + 1e-9
        joint = joint / joint.sum()
        k = len(at)
        first, second = joint.sum(axis=1), joint.sum(axis=0)
        q = (first + second) / 2
        high = np.arange(k) >= k / 2
        v = np.arange(k)
        covariance = float(v @ joint @ v) - float(first @ v) * float(second @ v)
        spread = math.sqrt(max(1e-12, (first @ v**2 - (first @ v) ** 2) * (second @ v**2 - (second @ v) ** 2)))
        up = float(q[high].sum())
        return cls(k, max(0.0, k * float((q * q).sum()) - 1), float(joint[high[:, None] != high].sum()), 2 * up * (1 - up), covariance / spread)

    def p_value(self, n: int, chi: float, changes: float, serial: float) -> float:
        """How likely text of n characters is to be as near to random as this: the least of the three tests' p-values, times three.

        Each test looks to the side on which random tokens lie. Three times the least is valid however the tests depend on each other.
        """
        excess = n * self.excess
        mean, var = self.size - 1 + excess, 2 * (self.size - 1) + 4 * excess
        tests = [(mean - chi) / math.sqrt(var)]
        rate = min(max(self.changes, 1 / n), 1 - 1 / n)
        tests.append(math.copysign(1, self.fair - rate) * (changes - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate)))
        tests.append(math.copysign(1, self.serial) * (self.serial - 1 / n - serial) * math.sqrt(n))
        return min(1.0, max(1e-300, 3 * _upper_normal(max(tests))))


_SCAN = T.StructType(
    [
        T.StructField("row", T.StringType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("tokens", T.ArrayType(T.LongType())),
        T.StructField("stats", T.ArrayType(T.DoubleType())),
        T.StructField("pairs", T.ArrayType(T.LongType())),
    ]
)


def _runs_per_text(mask: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Whether each text has a run of `least` or more set bytes that does not leave the text."""
    # A byte starts a long run if the next `least` bytes are set: counted with running sums.
    if len(mask) < least:
        return np.zeros(len(offsets) - 1, bool)
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    hits = np.flatnonzero(total[least:] - total[:-least] == least)
    at = np.searchsorted(offsets, hits, "right") - 1
    inside = hits + least <= offsets[at + 1]
    out = np.zeros(len(offsets) - 1, bool)
    out[at[inside]] = True
    return out


def _any_per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets]) > 0


def scan(df: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """A row per document: id, counts, flat base spans, flat tested tokens; and rows with counts of pairs alone."""
    names = list(ALPHABETS)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *_SCAN.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(_CHARS) + 1
        seen = np.zeros(width * width, np.int64)
        arrow = None
        for batch in batches:
            texts = batch.column(1)
            for first, end, data, offsets in text_pieces(batch, "text"):
                if len(data) > 2:
                    # A run of one character counts as two, so that rules and fillers do not pass for letters.
                    keep = np.ones(len(data), bool)
                    keep[2:] = (data[2:] != data[1:-1]) | (data[1:-1] != data[:-2])
                    number = _NUMBER[data[keep]]
                    seen += np.bincount(number[:-1] * width + number[1:], minlength=width * width)
                size = end - first
                long_hex = _runs_per_text(_HEX_BYTES[data], offsets, 24)
                marked = _any_per_text(_MARKS[data], offsets)
                tokens_in = _runs_per_text(_TOKEN_BYTES[data], offsets, settings.min_length)
                out: list[list] = [[[]] * size, [[]] * size, [[]] * size]
                counts = np.zeros((3, size), np.int64)
                for i in np.flatnonzero(long_hex | marked | tokens_in):
                    text = texts[first + int(i)].as_py()
                    spans = base_spans(text)
                    for _, kind, _ in spans:
                        counts[kind, i] += 1
                    out[0][i] = [x for s in spans for x in s]
                    if tokens_in[i]:
                        rows, stats = [], []
                        begins, reach = [a for a, _, _ in spans], list(accumulate((b for _, _, b in spans), max))
                        for m in TOKEN.finditer(text):
                            token = m[0]
                            if len(token) < settings.min_length:
                                continue
                            before = bisect_left(begins, m.end())  # spans that begin before the token ends
                            if before and reach[before - 1] > m.start():
                                continue
                            encoding = encoding_of(token)
                            if encoding is None:
                                continue
                            *found, p = battery(token, encoding)
                            rows += [m.start(), m.end(), names.index(encoding), int(p >= settings.battery)]
                            stats += found
                        out[1][i], out[2][i] = rows, stats
                longs = pa.list_(pa.int64())
                made = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, size),
                        *(pa.array(c) for c in counts),
                        pa.array(out[0], longs),
                        pa.array(out[1], longs),
                        pa.array(out[2], pa.list_(pa.float64())),
                        pa.nulls(size, longs),
                    ],
                    names=schema.fieldNames(),
                )
                arrow = made.schema
                yield made
        if arrow is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(arrow)[:-1]), pa.array([seen.tolist()], pa.list_(pa.int64()))], names=schema.fieldNames())

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def thresholds(histogram: dict[tuple[int, int], int], rate: float, step: float = 0.1) -> dict[int, float]:
    """Benjamini-Hochberg per class from counts of -log10(p) in bins of `step`: the largest p that is accepted.

    A bin's upper edge stands for all of its p-values, which can only lower the number of findings.
    """
    out: dict[int, float] = {}
    for cls in {c for c, _ in histogram}:
        bins = sorted(((b, n) for (c, b), n in histogram.items() if c == cls), reverse=True)
        total = sum(n for _, n in bins)
        so_far, best = 0, 0.0
        for b, n in bins:
            so_far += n
            edge = 10.0 ** (-b * step)
            if edge * total / so_far <= rate:
                best = edge
        out[cls] = best
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null text counts as empty. spans: `kind:start:end` in code points, end exclusive, sorted by start and
    kind, comma-joined; base_sha256 is the hash of the base spans alone, so joined. A tested token that
    meets a base span is not added. Repeated rows and null ids give a row each; other columns are not
    read. Collected are the counts of pairs of 67 kinds of characters and one count per length class and bin of p-values.
    """
    found = written(scan(df, id_col, text_col, settings), "secrets-scan")
    width = len(_CHARS) + 1
    pairs = np.zeros(width * width)
    for r in found.filter("pairs is not null").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        pairs[r["at"]] = r["n"]
    models = [TextModel.of(name, pairs.reshape(width, width)) for name in ALPHABETS]
    edges = np.array(settings.classes)

    def tested(tokens: list[int], stats: list[float]) -> list[tuple[int, int, int, float]]:
        """(start, end, class, p) of the tested tokens; p is 1 for those that are not random."""
        out = []
        for i in range(len(stats) // 3):
            a, b, encoding, passed = tokens[4 * i : 4 * i + 4]
            p = models[encoding].p_value(b - a, *stats[3 * i : 3 * i + 3]) if passed else 1.0
            out.append((a, b, int(np.searchsorted(edges, b - a, "right")) - 1, p))
        return out

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t for tokens, stats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in tested(tokens, stats)]
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int32()), pa.array([int(-math.log10(r[3]) / 0.1) for r in rows], pa.int32())], names=["cls", "bin"])

    counted = found.filter("size(stats) > 0").select("tokens", "stats").mapInArrow(bins, "cls int, bin int").groupBy("cls", "bin").count()
    limit = thresholds({(r["cls"], r["bin"]): r["count"] for r in counted.collect()}, settings.discovery)
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            *_SCAN.fields[1:4],
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
            T.StructField("n_random", T.LongType()),
        ]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts, added = [], [], []
            for flat, tokens, stats in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
                spans = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
                base = joined(spans)
                more = [(a, 3, b) for a, b, cls, p in tested(tokens, stats) if 10.0 ** (-0.1 * int(-math.log10(p) / 0.1)) <= limit.get(cls, 0.0)]
                hashes.append(hashlib.sha256(base.encode()).hexdigest())
                texts.append(joined(sorted(spans + more)) if more else base)
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.string()), pa.array(texts, pa.string()), pa.array(added, pa.int64())], names=schema.fieldNames())

    return found.filter("pairs is null").drop("pairs").mapInArrow(finish, schema)


def redact(text: str, spans: str, mask: str = "*") -> str:
    """The text with every span's characters replaced by `mask`, one for one."""
    chars = list(text)
    for part in filter(None, spans.split(",")):
        _, a, b = part.split(":")
        chars[int(a) : int(b)] = mask * (int(b) - int(a))
    return "".join(chars)
