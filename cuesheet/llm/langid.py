"""Language ID by multilingual mixture inference.

A hashed byte trigram model per language is learned from a bounded sample of labelled documents. The
trigrams of each word give its likelihood under every language; expectation-maximisation over all
words of a document then estimates the document's language proportions. Which languages a document
has is chosen by penalised likelihood over the nested sets of its leading languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.runtime import separators, shuffle_partitions, span_hashes, text_pieces, tidy, word_spans, written

BUCKET_BITS = 16
UNDETERMINED = "und"
#: Letters are ASCII letters and every byte over 0x7F; all else separates words.
_GAPS = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: Words whose trigrams are looked up at once.
_WORDS = 1 << 16


@dataclass(frozen=True)
class Settings:
    """sample_docs: documents per language, about, that the model is learned from. smoothing: added to
    every trigram count. temper: weight of a trigram's log-likelihood, as overlapping trigrams are
    not independent. penalty: cost of one more language, in units of log(words + 1)."""

    sample_docs: int = 3000
    smoothing: float = 0.5
    temper: float = 0.5
    penalty: float = 3.0
    tolerance: float = 1e-3
    iterations: int = 30


def fold_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8; other bytes that are no letters become 0."""
    out = _FOLD[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    out[_GAPS[data]] = 0
    return out


def trigram_buckets(data: np.ndarray, begins: np.ndarray = np.zeros(0, np.int64)) -> np.ndarray:
    """The bucket of the trigram around each byte; neighbours outside the word count as 0. begins: where texts begin."""
    b = fold_bytes(data).astype(np.uint32)
    key = b << np.uint32(8)
    key[1:] |= b[:-1] << np.uint32(16)
    key[:-1] |= b[1:]
    begins = begins[(begins > 0) & (begins < len(b))]
    key[begins] &= np.uint32(0xFFFF)
    key[begins - 1] &= np.uint32(0xFFFF00)
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


class MixtureModel:
    """Log-likelihoods of trigrams by language, and the inference over a run of texts."""

    def __init__(self, languages: list[str], counts: np.ndarray, settings: Settings):
        smooth = counts.astype(np.float64) + settings.smoothing
        table = np.log(smooth / smooth.sum(axis=0, keepdims=True)) * settings.temper
        self.languages = languages
        self.table = np.ascontiguousarray((table - table.mean(axis=1, keepdims=True)).astype(np.float32))
        self.settings = settings

    def _em(self, like: np.ndarray, first: np.ndarray, allowed: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) of each text; like: words x languages, largest 1; allowed: texts x languages.

        weight: how often each word stands there; once, if not given. A text whose proportions have settled
        leaves the loop, so later steps touch only the others.
        """
        s = self.settings
        sizes = np.diff(np.append(first, len(like)))
        weight = np.ones(len(like)) if weight is None else weight
        total = np.add.reduceat(weight, first)
        out = allowed / allowed.sum(axis=1, keepdims=True)
        live = np.arange(len(first))
        for _ in range(s.iterations):
            if not len(live):
                break
            if len(live) == len(first):
                part, often, n = like, weight, sizes
            else:
                n = sizes[live]
                at = _spread(first[live], n)
                part, often = like[at], weight[at]
            share = part * np.repeat(out[live], n, axis=0)
            share *= (often / share.sum(axis=1))[:, None]
            fresh = np.add.reduceat(share, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / total[live][:, None]
            moved = np.abs(fresh - out[live]).max(axis=1)
            out[live] = fresh
            live = live[moved > s.tolerance]
        mixed = np.einsum("wl,wl->w", like, np.repeat(out, sizes, axis=0))
        return out, np.add.reduceat(weight * np.log(np.maximum(mixed, 1e-300)), first)

    def _likelihoods(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """The likelihoods of the words, words x languages, largest 1, for _WORDS words at a time."""
        for i in range(0, len(starts), _WORDS):
            low, high = starts[i], ends[min(i + _WORDS, len(ends)) - 1]
            piece = data[low:high]
            values = self.table[trigram_buckets(piece, starts[i : i + _WORDS] - low)]
            values[_GAPS[piece]] = 0
            words = np.add.reduceat(values, starts[i : i + _WORDS] - low, axis=0, dtype=np.float64)
            yield np.exp(words - words.max(axis=1, keepdims=True)) + 1e-12

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(likelihoods, numbers) of the distinct words: a very long text has far fewer of them than words."""
        keys, likes, counts = np.zeros(0, np.uint64), np.zeros((0, len(self.languages))), np.zeros(0)
        for i, like in enumerate(self._likelihoods(data, starts, ends)):
            part = slice(i * _WORDS, (i + 1) * _WORDS)
            both = np.concatenate([keys, span_hashes(data, starts[part], ends[part], fold_case=False)])
            often = np.concatenate([counts, np.ones(len(like))])
            keys, first, back = np.unique(both, return_index=True, return_inverse=True)
            likes, counts = np.concatenate([likes, like])[first], np.bincount(back, often)
        return likes, counts

    def infer(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Proportions of every language for each text (all zero for a text without a word)."""
        starts, ends, words_at = word_spans(data, offsets, _GAPS)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        sizes = np.diff(words_at)
        has = np.flatnonzero(sizes)
        if not len(has):
            return out
        # A text that comes alone may be very long; its words are held once each.
        alone = len(sizes) == 1 and sizes[0] > _WORDS
        if alone:
            like, weight = self._distinct(data, starts, ends)
            first, sizes_held = np.zeros(1, np.int64), np.array([len(like)])
        else:
            like, weight = np.concatenate(list(self._likelihoods(data, starts, ends))), None
            first, sizes_held = words_at[:-1][has], sizes[has]
        everything = np.ones((len(has), like.shape[1]))
        best, _ = self._em(like, first, everything, weight)
        order = np.argsort(-best, axis=1, kind="stable")
        # Nested sets: the leading language, the two leading ones, and so on.
        n = sizes[has]
        rank = np.argsort(order, axis=1, kind="stable")
        score = np.full(len(has), -np.inf)
        result = np.zeros_like(best)
        doubtful = np.arange(len(has))
        for k in range(1, like.shape[1] + 1):
            if not len(doubtful):
                break
            sub_n, held = n[doubtful], sizes_held[doubtful]
            part = like if len(doubtful) == len(has) else like[_spread(first[doubtful], held)]
            sub_first = np.concatenate(([0], np.cumsum(held)[:-1]))
            share, fit = self._em(part, sub_first, (rank[doubtful] < k).astype(np.float64), weight)
            penalised = fit - self.settings.penalty * (k - 1) * np.log(sub_n + 1.0)
            better = penalised > score[doubtful]
            score[doubtful[better]] = penalised[better]
            result[doubtful[better]] = share[better]
            # One more language must explain some words: a text that has none for it is settled.
            if k < like.shape[1]:
                following = np.take_along_axis(best[doubtful], order[doubtful, k : k + 1], axis=1)[:, 0]
                doubtful = doubtful[following * sub_n >= 1.0]
        out[has] = result
        return out


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs that start at `first` and have `sizes` entries."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)


def learn(df: DataFrame, lang_col: str, text_col: str, id_col: str, settings: Settings = Settings(), accept: Column | None = None) -> MixtureModel | None:
    """The model from rows with a language and text that `accept` takes; None if there is none.

    Of each language about settings.sample_docs documents are used, those whose hashed id is below
    the threshold that its count gives. Counted is a language at a time; collected is a row of counts, one
    per bucket, for each language.
    """
    rows = df if accept is None else df.filter(accept)
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return None
    spark = df.sparkSession
    share = spark.createDataFrame([(k, min(1.0, settings.sample_docs / n)) for k, n in sizes.items()], "lang string, share double")
    lot = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = written(rows.join(F.broadcast(share), "lang").filter(lot < F.col("share")).select("lang", "text"), "langid-sample")
    at = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by language: its counts."""
        now, counts = None, np.zeros(1 << BUCKET_BITS, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[now]], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["lang", "counts"])

        for batch in batches:
            tags = batch.column(0).to_pylist()
            for first, end, data, offsets in text_pieces(batch, "text"):
                bucket, keep = trigram_buckets(data, offsets[:-1]), ~_GAPS[data]
                cuts = [i for i in range(first, end) if i == first or tags[i] != tags[i - 1]] + [end]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if tags[a] != now:
                        if now is not None:
                            yield out()
                        now, counts = tags[a], np.zeros(1 << BUCKET_BITS, np.int64)
                    part = slice(offsets[a - first], offsets[b - first])
                    counts += np.bincount(bucket[part][keep[part]], minlength=len(counts))
        if now is not None:
            yield out()

    total = np.zeros((1 << BUCKET_BITS, len(languages)), np.int64)
    by_language = sample.repartition(min(len(languages), shuffle_partitions(spark)), "lang").sortWithinPartitions("lang")
    for row in by_language.mapInArrow(tidy(count), "lang int, counts binary").toLocalIterator():  # a row per language
        total[:, row["lang"]] += np.frombuffer(row["counts"], np.int64)
    return MixtureModel(languages, total, settings)


def _judge(known: MixtureModel | None, batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, whether a language was found, shares) for pieces of a batch."""
    texts = batch.column(batch.schema.get_field_index(column))
    for first, end, data, offsets in text_pieces(batch, column, 1 << 19):
        shares = known.infer(data, offsets) if known else np.zeros((end - first, 1))
        letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))[offsets]
        found = np.diff(letters) > 0
        for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
            found[i] = any(c.isalpha() for c in texts[first + int(i)].as_py())
        found &= shares.sum(axis=1) > 0
        shares[~found] = 0
        yield first, end, found, shares


def predict(df: DataFrame, model: MixtureModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, n_languages, proportions (language to share).

    lang_pred is the language of the largest share (ties: the first by name) in the selected set; score
    is that share. Null text, text without a letter, and any text if nothing was learned give `und`,
    score 0 and no proportions. Repeated rows and null ids give a row each; other columns are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    box = df.sparkSession.sparkContext.broadcast(model)  # a float per bucket and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: MixtureModel | None = box.value
        names = np.array([*(known.languages if known else []), UNDETERMINED], object)
        for batch in batches:
            for first, end, found, shares in _judge(known, batch, "text"):
                size = end - first
                top = shares.argmax(axis=1)
                picked = np.where(found, top, len(names) - 1)
                keep = shares > 0
                at = np.concatenate(([0], np.cumsum(keep.sum(axis=1)))).astype(np.int32)
                where = np.nonzero(keep)
                mixture = pa.MapArray.from_arrays(pa.array(at), pa.array(names[where[1]].tolist(), pa.string()), pa.array(shares[where]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, size),
                        pa.array(names[picked].tolist(), pa.string()),
                        pa.array(np.clip(shares[np.arange(size), top] * found, 0.0, 1.0)),
                        pa.array(keep.sum(axis=1).astype(np.int32)),
                        mixture,
                    ],
                    names=[id_col, "lang_pred", "score", "n_languages", "proportions"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {id_type}, lang_pred string, score double, n_languages int, proportions map<string,double>")


def keep_languages(df: DataFrame, model: MixtureModel | None, languages: list[str] | None = None, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, columns unchanged, whose leading language is one of `languages` (default: any learned
    one) with a share of min_share or more. Null text, text without a letter, and every row if nothing was
    learned are rejected. Rows are judged one by one, without a shuffle.
    """
    box = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: MixtureModel | None = box.value
        wanted = np.array([languages is None or k in languages for k in (known.languages if known else [UNDETERMINED])])
        for batch in batches:
            for first, end, found, shares in _judge(known, batch, text_col):
                top = shares.argmax(axis=1)
                stay = found & wanted[top] & (shares[np.arange(end - first), top] >= min_share)
                yield batch.slice(first, end - first).filter(pa.array(stay))

    return df.mapInArrow(tidy(run), df.schema)
