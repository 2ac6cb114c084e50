"""What the operators share: written intermediate tables, text folding, Arrow access to strings."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.session import fresh_path, shared_dir  # noqa: F401  the operators take them from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Rows go to Python workers in batches of at most `size` bytes, whole rows each: both sides hold one of them at a time."""
    before = spark.conf.get(_BATCH_BYTES)
    if not before.rstrip("b").isdigit() or int(before.rstrip("b")) <= size:
        yield
        return
    spark.conf.set(_BATCH_BYTES, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory that it has freed back to the system when a task ends: workers live on for other stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
            trim(0)

    return tidied


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there.

    A lost executor costs the tasks it ran, not the stages behind the written table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which operators scale their own shards by."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose shingles or seeds are one shard, which a task holds at a time.
SHARD_BYTES = 64 << 20


def shard_count(docs: DataFrame, text_col: str = "text") -> int:
    """Shards for the shingles of docs: one for each of the session's tasks, and more if texts are larger, as they are measured."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES))


def dealt_by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """rows dealt by their shard, from 0 on: shard i goes to task i modulo the session's tasks, so that none is empty or has two for another's none."""
    tasks = min(shards, shuffle_partitions(rows.sparkSession))
    return rows.repartitionById(tasks, F.col("shard") % tasks)


#: Bits of a bitmap that picks rows before a shuffle: 4 MB, whatever the number of rows.
BITMAP_BITS = 25


def bitmap(df: DataFrame, value: Column) -> DataFrame:
    """(word, bits): a bitmap that has the hash of every value, as at most 2^(BITMAP_BITS-6) rows."""
    at = F.pmod(F.xxhash64(value), F.lit(1 << BITMAP_BITS))
    rows = df.select(at.alias("__at")).select(F.shiftright("__at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(__at & 63 as int))").alias("bit"))
    return rows.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def in_bitmap(df: DataFrame, value: Column, bits: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of df, columns unchanged, whose value is (or is not) in the bitmap: all that were put in, and by chance some others.

    The bitmap's size is bounded, so it is broadcast; df is not shuffled.
    """
    row = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), F.pmod(F.xxhash64(value), F.lit(1 << BITMAP_BITS)).alias("__at"))
    found = row.join(F.broadcast(bits), F.shiftright("__at", 6).cast("int") == F.col("word"), "left")
    hit = F.coalesce(F.expr("(bits & shiftleft(1L, cast(__at & 63 as int))) <> 0"), F.lit(False))
    return found.filter(hit if inside else ~hit).select(*[F.col("__row")[c].alias(c) for c in df.columns])


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """df, columns unchanged, without the rows whose id is in gone (__id; null is an id too).

    Only rows that a bitmap of the ids lets through are joined with them; the others are not shuffled.
    """
    gone = written(gone.distinct(), "gone-ids")
    bits = written(bitmap(gone, F.col("__id")), "gone-bits")
    clean = in_bitmap(df, df[id_col], bits, inside=False)
    doubtful = in_bitmap(df, df[id_col], bits)
    return clean.unionByName(doubtful.join(gone, doubtful[id_col].eqNullSafe(gone["__id"]), "left_anti"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the JVM's byte loop, other text translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_pieces(batch: pa.RecordBatch, column: str, budget: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch's string column into runs of whole texts of about `budget` bytes.

    Yields (first row, end row, bytes, offsets from 0); the bytes are views of the Arrow buffer.
    Null texts have no bytes. A text over the budget comes alone, and whole.
    """
    array = batch.column(batch.schema.get_field_index(column))
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if not n:
        return
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of an odd base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[key] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACES = separators((0x20, 0x20), (0x09, 0x0D))


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) of the words between `gaps` bytes.

    UTF-8 bytes over 0x7F are never separators, so byte positions equal those of a regex on characters.
    """
    gap = gaps[data]
    inner = offsets[:-1]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        cuts = inner[inner < len(data)]
        before[cuts] = True
        ends_at = offsets[1:] - 1
        after[ends_at[(ends_at >= 0)]] = True
    inside = ~gap
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What is left of a chunk of 8 bytes that has 0 to 8 bytes of a span.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_CHUNKS = 4
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def _chunks(data: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, A-Z as a-z if asked for, and the 8 bytes from each of them on as one number."""
    body = np.zeros(len(data) + 8, np.uint8)
    body[: len(data)] = _LOWER[data] if fold_case else data
    return body, np.ndarray((len(data) + 1,), "<u8", body.data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; A-Z count as a-z if case is folded.

    Spans of up to 32 bytes are mixed in chunks of 8, each chunk by a bijection of the hash so far, so that no
    two spans of at most 8 bytes and equal length collide; longer ones take BLAKE2b. Other seeds give
    independent hashes.
    """
    body, chunk = _chunks(data, fold_case)
    size = ends - starts
    out = mix64(size.astype(np.uint64) * _LENGTH + np.uint64(seed * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    out = mix64(out ^ (chunk[starts] & _TAIL[np.minimum(size, 8)]))
    for k in range(1, _CHUNKS):
        rest = np.flatnonzero(size > 8 * k)
        if not len(rest):
            return out
        out[rest] = mix64(out[rest] ^ (chunk[starts[rest] + 8 * k] & _TAIL[np.minimum(size[rest] - 8 * k, 8)]))
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > 8 * _CHUNKS).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(body[starts[i] : ends[i]], digest_size=8, salt=salt).digest(), "little")
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the very bytes of the span with the number in `other`."""
    body, chunk = _chunks(data, fold_case=False)
    size, at = ends - starts, starts[other]
    out = size == size[other]
    for k in range(_CHUNKS):
        rest = np.flatnonzero(out & (size > 8 * k) & (at != starts))
        if not len(rest):
            return out
        out[rest] = (chunk[starts[rest] + 8 * k] ^ chunk[at[rest] + 8 * k]) & _TAIL[np.minimum(size[rest] - 8 * k, 8)] == 0
    for i in np.flatnonzero(out & (size > 8 * _CHUNKS) & (at != starts)).tolist():
        out[i] = np.array_equal(body[starts[i] : ends[i]], body[at[i] : at[i] + size[i]])
    return out


_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive word hashes; entry i covers words i to i+length-1."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, length):
        total *= _STEP
        total += words[k : k + n]
    return mix64(total)
