"""Slots for models: row functions that a user brings, run as iterator pandas UDFs, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def model_slot(load: Callable[[], Callable[[pd.Series], pd.Series]], result: T.DataType) -> Callable[[Column], Column]:
    """A Column function around a model: `load` makes it, once for each task; it maps a series to a series."""

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            yield model(values)

    return run


def routed(df: DataFrame, method: str, column: str, slots: dict[str, Callable[[Column], Column]], out: str) -> DataFrame:
    """df with out: the slot that the method column names, applied to the column; unknown methods are an error.

    Branches are filtered and united, so a model sees its own rows only.
    """
    parts = None
    for name, slot in slots.items():
        part = df.filter(F.col(method) == name).withColumn(out, slot(F.col(column)))
        parts = part if parts is None else parts.unionByName(part)
    known = F.coalesce(F.col(method).isin(list(slots)), F.lit(False))
    kind = parts.schema[out].dataType
    bad = df.filter(~known).withColumn(out, F.raise_error(F.concat(F.lit("no slot for method "), F.coalesce(F.col(method), F.lit("null")))).cast(kind))
    return parts.unionByName(bad)


#: The ways to ask for speech, with the columns that each needs.
METHODS: dict[str, tuple[str, ...]] = {
    "sft": ("tts_text", "spk_id"),
    "zero_shot": ("tts_text", "prompt_text", "prompt_speech"),
    "cross_lingual": ("tts_text", "prompt_speech"),
    "instruct": ("tts_text", "spk_id", "instruct_text"),
    "instruct2": ("tts_text", "instruct_text", "prompt_speech"),
    "vc": ("source_speech", "prompt_speech"),
}


def method_slot(name: str, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], result: T.DataType) -> Callable[[Column], Column]:
    """A Column function around a model of one method: it maps a frame of the method's columns to a series.

    A row that lacks one of them is an error.
    """
    needs = METHODS[name]

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for frame in batches:
            lacking = [c for c in needs if frame[c].isna().any()]
            if lacking:
                raise ValueError(f"{name} needs {', '.join(lacking)}")
            yield model(frame[list(needs)])

    return run


def inferred(df: DataFrame, method: str, slots: dict[str, Callable[[Column], Column]], out: str) -> DataFrame:
    """df with out: each row through the slot of its method, which gets the method's columns; unknown methods are an error.

    Columns that df has not are null.
    """
    inputs = sorted({c for needs in METHODS.values() for c in needs})
    frame = F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in inputs])
    return routed(df.withColumn("__inputs", frame), method, "__inputs", slots, out).drop("__inputs")


#: The slots that a dubbing job has, with what each takes and gives.
SLOTS: dict[str, tuple[str, str]] = {
    "voice_activity": ("speech array<float>", "array<struct<start:double,end:double>>"),
    "transcribe": ("speech array<float>", "array<struct<start:double,end:double,text:string>>"),
    "translate": ("text string", "string"),
    "chat": ("prompt string", "string"),
    "separate": ("speech array<float>", "struct<vocals:array<float>,rest:array<float>>"),
    "diarize": ("speech array<float>", "array<struct<start:double,end:double,label:int>>"),
    "detect_faces": ("frame binary", "array<struct<y1:int,y2:int,x1:int,x2:int,score:double>>"),
    "restore_faces": ("frame binary", "binary"),
    "lip_sync": ("frame binary", "binary"),
    "speaker_embedding": ("speech array<float>", "array<double>"),
    "speech_tokens": ("speech array<float>", "array<int>"),
    "features": ("speech array<float>", "array<array<float>>"),
    "pitch": ("speech array<float>", "array<float>"),
    "synthesize": ("text string", "array<float>"),
    "vocode": ("features array<array<float>>", "array<float>"),
}


def declared(name: str, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> Callable[[Column], Column]:
    """model_slot with the result type that SLOTS declares for a name."""
    return model_slot(load, T._parse_datatype_string(SLOTS[name][1]))
