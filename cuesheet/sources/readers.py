"""Readers: everything comes in as an explicitly typed DataFrame."""

from __future__ import annotations

import json
import re
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import jsonio, text
from cuesheet.operators.manifests import latest

#: A training shard; the columns after spk may be missing.
SHARD = "utt string, audio_data binary, wav string, text string, spk string, utt_embedding array<double>, spk_embedding array<double>, speech_token array<bigint>, instruct string, reject_speech_token array<bigint>"


def shards(spark: SparkSession, paths: list[str], skip_corrupt: bool = True) -> DataFrame:
    """Rows of Parquet shards with `src`, the file they come from; unreadable files are skipped if asked for."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("mergeSchema", "true")
    return reader.parquet(*paths).withColumn("src", F.col("_metadata.file_path"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the stripped lines of a list file, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def listed_shards(spark: SparkSession, list_path: str, limit: int = 100_000) -> DataFrame:
    """Rows of the shards that a list file names; the list itself (paths, not rows) is read on the driver, up to a limit."""
    paths = [r["value"] for r in lines(spark, list_path).limit(limit + 1).collect()]
    if len(paths) > limit:
        raise ValueError(f"{list_path} names more than {limit} shards")
    return shards(spark, paths)


def merged_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, value) of JSON objects of strings, file after file: later files (or folders of files) win.

    All are read by one scan; a file's rank is that of its path, or its folder's, in the list.
    """
    def plain(path: str) -> str:
        return re.sub("^file:/+", "/", path).rstrip("/")

    order = spark.createDataFrame([(plain(p), i) for i, p in enumerate(paths)], "listed string, ord int")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rows = spark.read.text(list(paths), wholetext=True).select("value", F.explode(F.array(path, F.regexp_replace(path, "/[^/]*$", ""))).alias("listed"))
    rows = rows.join(order, "listed").select("ord", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return latest(rows, ["key"], ["ord"]).select("key", "value")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(utt, value) of lines `key value...`: words joined by one blank; of a repeated key the last line stays.

    Files go by name. Inside a file, parts that tasks read go by their offset, and rows of a part by their order.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.text(path).select("value", place.alias("ord"))
    return latest(parse_manifest(raw), ["utt"], ["ord"]).select("utt", "value")


def parse_manifest(raw: DataFrame) -> DataFrame:
    words = F.split(text.strip(F.col("value")), r"\s+")
    rows = raw.withColumn("__w", words).filter(F.col("__w")[0] != "")
    return rows.select(F.col("__w")[0].alias("utt"), F.array_join(F.slice("__w", 2, 1 << 30), " ").alias("value"), *[c for c in raw.columns if c != "value"])


def _fields(value: Column, path: str, n: int, drop_empty: bool) -> Column:
    parts = F.split(value, r"\|")
    parts = F.filter(parts, lambda x: x != "") if drop_empty else parts
    return F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"{path}: not {n} fields: "), value)).cast("array<string>"))


def benchmark_manifest(spark: SparkSession, path: str) -> DataFrame:
    """utt, audio_path, reference_text, target_text of `audio|reference|target audio|target` lines; other lines are an error.

    utt is the stem of the target audio; relative paths are taken from the manifest's folder.
    """
    base = path.rsplit("/", 1)[0]
    p = lines(spark, path).select(_fields(F.col("value"), path, 4, False).alias("p"))
    audio = F.col("p")[0]
    return p.select(
        text.stem(F.col("p")[2]).alias("utt"),
        F.when(F.startswith(audio, F.lit("/")), audio).otherwise(F.concat(F.lit(base + "/"), audio)).alias("audio_path"),
        F.col("p")[1].alias("reference_text"),
        F.col("p")[3].alias("target_text"),
    )


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, target_text) of pipe-separated lines of which four fields are not empty; other lines are an error."""
    return lines(spark, path).select(_fields(F.col("value"), path, 4, True).alias("p")).select(F.col("p")[0].alias("id"), F.col("p")[3].alias("target_text"))


def transcripts_tsv(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """(utt, spk, text) of a tab-separated file with a header; rows without a file of that name in `existing` (name) go."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="utt string, spk string, text string", quote="")
    rows = rows.select(*[text.strip(F.col(c)).alias(c) for c in ("utt", "spk")], text.remove_tags(text.strip(F.col("text"))).alias("text"))
    return rows.join(existing.select(F.col("name").alias("utt")), "utt", "left_semi")


def audio_with_text(spark: SparkSession, folder: str, audio: str = ".wav", sidecar: str = ".normalized.txt") -> DataFrame:
    """(utt, wav, spk, text) of the audio files in the third level of a folder that have a text beside them."""
    def base(path: Column, ending: str) -> Column:
        # The two ways in which Spark names local files differ in their slashes.
        return F.regexp_replace(F.substr(path, F.lit(1), F.char_length(path) - len(ending)), "^file:/+", "file:/")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wav = files.filter(F.endswith("path", F.lit(audio))).select("path", base(F.col("path"), audio).alias("base"))
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{sidecar}").text(folder, wholetext=True)
    texts = texts.select(base(F.col("_metadata.file_path"), sidecar).alias("base"), text.strip(F.col("value")).alias("text"))
    found = wav.join(texts, "base")
    return found.select(text.basename(F.col("base")).alias("utt"), F.col("path").alias("wav"), text.speaker_of(text.basename(F.col("base"))).alias("spk"), "text")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; lines that are not JSON give a row of nulls, as Spark's permissive mode does."""
    return spark.read.schema(schema).json(path)


def project(spark: SparkSession, path: str) -> DataFrame:
    """The project document of a JSON file, with defaults."""
    return spark.read.text(path, wholetext=True).select(jsonio.decode_project(F.col("value")).alias("p")).select("p.*")


def message_log(spark: SparkSession, path: str) -> DataFrame:
    return jsonio.messages(spark.read.text(path))


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of all files below a folder that are not empty; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))


def checkpoint_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(path, loss, epoch, step, tag) of the YAML files in a folder but those named train* or init*."""
    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    name = text.basename(F.col("path"))
    def field(key: str, pattern: str) -> Column:
        return F.regexp_extract("value", rf"(?m)^\s*{key}:\s*({pattern})", 1)
    rows = files.filter(~name.rlike("^(train|init)"))
    return rows.select("path", field("loss", r"[-+0-9.eE]+").cast("double").alias("loss"), field("epoch", r"\d+").cast("int").alias("epoch"), field("step", r"\d+").cast("int").alias("step"), field("tag", r"\S+").alias("tag"))


def model_names(spark: SparkSession, base_url: str, timeout: float = 5.0) -> DataFrame:
    """(name) of the models that a server lists, sorted; no rows if it cannot be reached or understood."""
    try:
        with urllib.request.urlopen(f"{base_url.rstrip('/')}/api/tags", timeout=timeout) as reply:
            names = sorted(m["name"] for m in json.load(reply)["models"])
    except (OSError, ValueError, KeyError, TypeError):
        names = []
    return spark.createDataFrame([(n,) for n in names], "name string")


def waveforms(spark: SparkSession, path: str, least_rate: int = 0, target_rate: int | None = None):
    """(path, sample_rate, speech) of 16-bit PCM WAV files, channels averaged; a rate under the least is an error.

    With a target rate other files are resampled to it.
    """
    import io
    import wave

    import numpy as np
    import pandas as pd

    from cuesheet.functions.arrays import band_limited

    def run(batches):
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(bytes(raw))) as w:
                    if w.getframerate() < least_rate:
                        raise ValueError(f"{p}: {w.getframerate()} Hz, less than {least_rate}")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768.0
                    rate = target_rate or w.getframerate()
                    rows.append((p, rate, band_limited(x, w.getframerate(), rate).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "speech"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sample_rate int, speech array<float>")
