"""Compression classifier for text quality.

Two zstandard dictionaries are trained, from good and from bad labelled text. Every text is cut into
blocks that are compressed with either dictionary; the difference of the two sizes over their sum
says which kind of text it resembles. A logistic fit on labelled documents that took no part in the
dictionaries turns that difference into a probability, given the lesser size over the text's own: text that
repeats itself compresses so far with either dictionary that the difference alone says little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.runtime import text_pieces, written


@dataclass(frozen=True)
class Settings:
    """sample_docs: labelled documents of each class, at most, that are learned from; half of them train
    the dictionaries, with their whole texts. sample_bytes: bytes of the texts of a class, at most; a document
    that would exceed them is passed over."""

    sample_docs: int = 3000
    sample_bytes: int = 32 << 20
    block_bytes: int = 2048
    dict_bytes: int = 1 << 16
    level: int = 3
    ridge: float = 1e-3


class Scorer:
    """Dictionaries and calibration; picklable, as the compressors are made where they are used."""

    def __init__(self, good: bytes, bad: bytes, settings: Settings):
        self.good, self.bad, self.settings = good, bad, settings
        self.weights: np.ndarray | None = None
        self.centre = self.scale = None
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        if self._made is None:
            s = self.settings
            self._made = []
            for raw in (self.good, self.bad):
                words = zstandard.ZstdCompressionDict(raw)
                words.precompute_compress(level=s.level)
                self._made.append(zstandard.ZstdCompressor(level=s.level, dict_data=words, write_dict_id=False, write_checksum=False, write_content_size=False))
        return self._made

    def features(self, text: bytes) -> tuple[float, float]:
        """Normalised size difference (positive: like good text), and the lesser size over the text's."""
        good, bad = self._compressors()
        size = self.settings.block_bytes
        g = b = 0
        # Blocks of equal length, none longer than block_bytes, cover the whole text.
        n = max(1, -(-len(text) // size))
        step = -(-len(text) // n) if text else 1
        for i in range(0, len(text), step):
            piece = text[i : i + step]
            g, b = g + len(good.compress(piece)), b + len(bad.compress(piece))
        return ((b - g) / (b + g), min(g, b) / len(text)) if g else (0.0, 1.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps on standardised features and their squares."""
        z = self._expand(x, fresh=True)
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z / len(z) + self.settings.ridge * np.eye(len(w))
            step = np.linalg.solve(hess, z.T @ (y - p) / len(z) - self.settings.ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _expand(self, x: np.ndarray, fresh: bool = False) -> np.ndarray:
        if fresh:
            self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z, z[:, :1] * z[:, 1:]], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._expand(x) @ self.weights, -30, 30)))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, accept: Column | None, settings: Settings) -> DataFrame:
    """(label, half, text) of labelled documents of each class, chosen by a hash of the id, within the bounds of the settings."""
    known = labels if accept is None else labels.filter(accept)
    known = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).filter("__id is not null and label in (0, 1)").distinct()
    known = known.withColumn("lot", F.xxhash64(F.col("__id").cast("string"), F.lit("quality")))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy("lot", "__id").limit(settings.sample_docs)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 x sample_docs ids: a bounded broadcast, so the documents are not shuffled. Rows that repeat an id give one text.
    joined = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    texts = written(joined.groupBy("__id", "label", "lot").agg(F.min("text").alias("text")), "quality-texts")
    sizes = texts.select("__id", "label", "lot", F.octet_length("text").alias("n")).orderBy("lot", "__id").collect()  # at most 2 x sample_docs rows
    held, stay = {0: 0, 1: 0}, []
    for r in sizes:
        if held[r["label"]] + r["n"] <= settings.sample_bytes:
            held[r["label"]] += r["n"]
            stay.append((r["__id"], r["label"]))
    chosen = docs.sparkSession.createDataFrame(stay, T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType())]))
    half = F.pmod(F.xxhash64("lot"), F.lit(2)).alias("half")
    return written(texts.join(F.broadcast(chosen), ["__id", "label"]).select("label", half, "text"), "quality-sample")


def _dictionary(parts: list[bytes], settings: Settings) -> bytes:
    """A dictionary trained on the blocks; where they are too few to train on, the blocks themselves."""
    try:
        return zstandard.train_dictionary(settings.dict_bytes, parts, level=settings.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-settings.dict_bytes :]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", accept: Column | None = None, settings: Settings = Settings()) -> Scorer | None:
    """The scorer from labelled rows that `accept` (a condition on labels) takes; None without text of both classes.

    Half of the sample trains the dictionaries and the other half the calibration. Where a half lacks a class,
    as in very small samples, all of the sample serves for both.
    """
    sample = _sampled(docs, labels, id_col, text_col, label_col, accept, settings)
    size = settings.block_bytes

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All blocks of the whole texts."""
        for batch in batches:
            tags = batch.column(0).to_pylist()
            for first, _, data, offsets in text_pieces(batch, "text"):
                cut, label = [], []
                for i in range(len(offsets) - 1):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    mine = [raw[a : a + size] for a in range(0, len(raw), size)]
                    cut += mine
                    label += [tags[first + i]] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cut, pa.binary())], names=["label", "block"])

    both = {(r["label"], r["half"]) for r in sample.filter("text <> ''").select("label", "half").distinct().collect()}
    if {k for k, _ in both} != {0, 1}:
        return None
    split = len(both) == 4
    train: dict[int, list[bytes]] = {0: [], 1: []}
    # At most 2 x sample_bytes.
    for row in (sample.filter("half = 0") if split else sample).select("label", "text").mapInArrow(blocks, "label int, block binary").toLocalIterator():
        train[row["label"]].append(bytes(row["block"]))
    made = [_dictionary(sorted(train[value]), settings) for value in (1, 0)]
    scorer = Scorer(*made, settings)
    box = df_broadcast(docs, scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_pieces(batch, "text"):
                x = _features(box.value, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(c) for c in x.T)], names=["label", "a", "b"])

    held = (sample.filter("half = 1") if split else sample).select("label", "text").mapInArrow(measure, "label int, a double, b double")
    rows = np.array([tuple(r) for r in held.toLocalIterator()], float).reshape(-1, 3)  # at most 2 x sample_docs rows
    rows = rows[np.lexsort(rows.T)]
    scorer.fit(rows[:, 1:], rows[:, 0])
    return scorer


def df_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def _features(scorer: Scorer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([scorer.features(raw[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)], float).reshape(-1, 2)


def score(df: DataFrame, scorer: Scorer | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Null text counts as empty and gets the score of an empty text; without a scorer every score is 0.5.
    Whole texts are compressed, in blocks. Repeated rows and null ids give a row each; other columns
    are not read. The scorer (two dictionaries of dict_bytes) is broadcast.
    """
    box = df_broadcast(df, scorer)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_pieces(batch, "text"):
                p = box.value.score(_features(box.value, data, offsets)) if box.value else np.full(end - first, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")
