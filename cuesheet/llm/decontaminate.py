"""Benchmark decontamination: a broadcast hash set of test n-grams, token windows, verified hits.

All DataFrame functions, and one pass over the documents without a shuffle of text. The words of a document
are taken in blocks that overlap by a window less a word, so time grows with the length of a text, not its square:

1. A window of m words contains, at one of the document positions that are a multiple of s, a whole
   g-gram, where g = ceil(m / 2) and s = m - g + 1. So one probe in s positions finds every window.
2. Probes are looked up in the hash set of the benchmark's g-grams (broadcast if its measured size
   is below a bound, else joined by shuffle).
3. Only around a probe that hits are whole windows built and compared, as strings, with the test
   windows. Verified windows are gathered per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.runtime import LOWER, UPPER, without_ids

WINDOW = 13
#: Bytes of benchmark windows, and of their hash set, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Words of a document at which windows of one block begin.
BLOCK = 512

_GAPS = "".join(chr(c) for r in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)) for c in range(r[0], r[1] + 1))


def fold(text: Column) -> Column:
    """A-Z to a-z, every other ASCII character that is no digit or letter to a blank; length is kept."""
    return F.translate(text, UPPER + _GAPS, LOWER + " " * len(_GAPS))


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the folded text; null has none."""
    return F.array_remove(F.split(fold(F.coalesce(text.cast("string"), F.lit(""))), " "), "")


def _gram(words: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(m, win, items): distinct windows with the sorted ids, as strings, of the items that have them.

    An item of fewer than `window` words, but not none, is one window of its own length. Null ids are
    left out; items that repeat an id and text count once.
    """
    items = bench.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter("item is not null and size(w) > 0")
    m = F.least(F.size("w"), F.lit(window))
    each = items.select("item", m.alias("m"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice(F.col("w"), i, m), " "))).alias("win"))
    return each.groupBy("m", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _fits(df: DataFrame, limit: int) -> bool:
    """Whether the windows, and apart from them 16 bytes for each gram that they have, are within the limit."""
    grams = 16 * (F.col("m") - F.floor((F.col("m") + 1) / 2) + 1)
    sizes = df.agg(F.sum(F.octet_length("win") + 16 + 16 * F.size("items")), F.sum(grams)).first()
    return max(sizes[0] or 0, sizes[1] or 0) <= limit


def _probes(m: int) -> Column:
    """(m, position from 0 in the block, hash) of the g-gram at every s-th word of a block."""
    g = (m + 1) // 2
    s = m - g + 1
    at = F.sequence(F.lit(0), F.floor((F.size("w") - g) / s).cast("int"))
    return F.transform(at, lambda i: F.struct(F.lit(m).alias("m"), (i * s).alias("at"), F.xxhash64(F.lit(m), _gram(F.col("w"), i * s + 1, g)).alias("h")))


def _seeds(windows: DataFrame, m: int) -> DataFrame:
    """Hashes of the g-grams of the windows of m words."""
    g = (m + 1) // 2
    own = windows.filter(F.col("m") == m).select(F.split("win", " ").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.lit(m - g + 1)), lambda i: _gram(F.col("w"), i, g))
    return own.select(F.explode(grams).alias("gram")).select(F.xxhash64(F.lit(m), "gram").alias("seed"))


def find_windows(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per (id, text) met in docs: id, text_hash, copies, n_words, spans, items.

    spans: sorted distinct (start word from 0, length) of the benchmark windows that occur; items:
    sorted distinct ids, as strings. `copies` counts the rows that repeat this id and text.
    """
    windows = benchmark_windows(bench, item_col, bench_text_col, window)
    lengths = sorted(r[0] for r in windows.select("m").distinct().collect())  # at most `window` values
    small = _fits(windows, broadcast_bytes)
    spread = F.broadcast if small else (lambda df: df)

    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("text_hash"), words_of(text).alias("all"))
    # The first block of a document is there even if it has no words.
    begins = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = F.transform(begins, lambda i: F.struct(i.alias("from"), F.slice("all", i + 1, BLOCK + window - 1).alias("w")))
    base = base.select("id", "text_hash", F.size("all").cast("long").alias("n_words"), F.explode(blocks).alias("b")).select("id", "text_hash", "n_words", F.col("b.from").alias("from"), F.col("b.w").alias("w"))
    probe_type = "array<struct<m:int,at:int,h:bigint>>"
    probes = F.array().cast(probe_type)
    grams = None
    for m in lengths:
        probes = F.concat(probes, F.when(F.size("w") >= m, _probes(m)).otherwise(F.array().cast(probe_type)).cast(probe_type))
        own = _seeds(windows, m)
        grams = own if grams is None else grams.union(own)
    if grams is None:
        grams = docs.sparkSession.createDataFrame([], "seed bigint")
    marker = F.when(F.col("from") == 0, F.array(F.lit(None).cast("struct<m:int,at:int,h:bigint>"))).otherwise(F.array().cast(probe_type))
    cast = base.withColumn("p", F.explode(F.concat(marker, probes)))
    if not small:  # beyond the bound rows are shuffled: each carries only the words around its probe
        cast = cast.withColumn("w", F.when(F.col("p").isNotNull(), F.slice("w", F.greatest(F.col("p.at") - F.col("p.m") + 1, F.lit(1)), 3 * window)))
        shift = F.greatest(F.col("p.at") - F.col("p.m"), F.lit(0))
    else:
        shift = F.lit(0)
    cast = cast.withColumn("size", F.least(F.col("n_words") - F.col("from"), F.lit(BLOCK + window - 1)).cast("int"))
    met = cast.join(spread(grams.distinct()), F.col("p.h") == F.col("seed"), "left").filter("p is null or seed is not null")
    # A window of m words that holds the g-gram at `at` starts at at-(m-g) to at.
    low = F.greatest(F.col("p.at") - (F.col("p.m") - F.floor((F.col("p.m") + 1) / 2).cast("int")), F.lit(0))
    high = F.least(F.col("p.at"), F.col("size") - F.col("p.m"))
    starts = F.when(F.col("p").isNotNull() & (low <= high), F.sequence(low, high)).when(F.col("p").isNull(), F.array(F.lit(-1)))
    tried = met.withColumn("start", F.explode(starts))
    tried = tried.withColumn("try", F.when(F.col("start") >= 0, F.array_join(F.slice("w", F.col("start") - shift + 1, F.col("p.m")), " ")))
    seen = tried.join(spread(windows.select(F.col("win"), "items")), F.col("try") == F.col("win"), "left").filter("start < 0 or win is not null")
    return seen.groupBy("id", "text_hash").agg(
        F.sum(F.when(F.col("start") < 0, 1).otherwise(0)).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start") >= 0, F.struct((F.col("from") + F.col("start")).alias("start"), F.col("p.m").alias("m"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    """The distinct word positions, from 0, inside any of the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["m"] - 1))))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, **options) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. Null or word-less text has no words, no hits
    and the hash of the empty string. Repeated rows give repeated rows; rows with null id are kept.
    Other columns of docs or bench are not read. An empty benchmark marks nothing.
    """
    found = find_windows(docs, bench, id_col, text_col, **options)
    found = found.withColumn("n_hit", F.size(hit_words(F.col("spans"))).cast("long"))
    out = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without its contaminated documents, columns unchanged; ids are taken to be unique."""
    bad = contamination(docs, bench, id_col, text_col, **options).filter("contaminated").select(F.col(id_col).alias("__id"))
    return without_ids(docs, id_col, bad)


def remove_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs whose text has lost the benchmark words that any window hits; rows without hits stay as they are.

    A removed word takes the character after it along. Row order and other columns stay.
    """
    found = find_windows(docs, bench, id_col, text_col, **options).filter(F.size("spans") > 0)
    found = found.select(F.col("id").alias("found_id"), F.col("text_hash").alias("found_hash"), hit_words(F.col("spans")).alias("hit"))
    # The row goes along as one struct, so that names of its columns meet none of those used here.
    text = docs[text_col].cast("string")
    left = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_col].alias("row_id"),
        text.alias("body"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("row_hash"),
    )
    both = left.join(found, F.col("row_id").eqNullSafe(F.col("found_id")) & (F.col("row_hash") == F.col("found_hash")), "left")
    # Folding keeps lengths, so the pieces of the folded text give the places of words in the text itself.
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("word"), F.lit("").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        is_word = piece != ""
        gone = is_word & F.array_contains(F.col("hit"), acc["word"])
        size = F.char_length(piece)
        kept = F.substr(F.col("body"), acc["at"], size + 1)
        return F.struct(
            (acc["at"] + size + 1).alias("at"),
            (acc["word"] + is_word.cast("int")).alias("word"),
            F.concat(acc["out"], F.when(gone, F.lit("")).otherwise(kept)).alias("out"),
        )

    clean = F.aggregate(F.split(fold(F.col("body")), " "), start, step, lambda acc: acc["out"])
    new_text = F.when(F.col("hit").isNotNull(), clean).otherwise(F.col("body"))
    return both.select(*[(new_text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
