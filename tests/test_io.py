"""Readers, writers, streams and slots, on small files."""

import json
import os
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.functions import slots
from cuesheet.sources import readers, sinks
from cuesheet.streaming import events, tokens
from tests.conftest import rows_of


def test_manifests(spark, tmp_path):
    (tmp_path / "text").write_text("u1 a  b\n\nu2 c\nu1 d e\n")
    assert rows_of(readers.manifest(spark, str(tmp_path / "text"))) == [("u1", "d e"), ("u2", "c")]
    (tmp_path / "bench.lst").write_text("p.wav|ref|out/t1.wav|target\n/abs.wav||t2.wav|x\n")
    got = rows_of(readers.benchmark_manifest(spark, str(tmp_path / "bench.lst")))
    assert got == sorted([("t1", f"{tmp_path}/p.wav", "ref", "target"), ("t2", "/abs.wav", "", "x")], key=repr)
    (tmp_path / "bad.lst").write_text("a|b|c\n")
    with pytest.raises(Exception, match="not 4 fields"):
        readers.benchmark_manifest(spark, str(tmp_path / "bad.lst")).collect()
    (tmp_path / "labels").write_text("id|a||b|text\n")
    assert rows_of(readers.labels(spark, str(tmp_path / "labels"))) == [("id", "text")]


def test_tables_of_text(spark, tmp_path):
    (tmp_path / "TRANS.txt").write_text("UtteranceID\tSpeaker\tTrans\nu1\ts\t[FIL] hi [SPK]\nu2\ts\tgone\n")
    have = spark.createDataFrame([("u1",)], "name string")
    assert rows_of(readers.transcripts_tsv(spark, str(tmp_path / "TRANS.txt"), have)) == [("u1", "s", " hi ")]
    folder = tmp_path / "wavs" / "s1" / "c1"
    folder.mkdir(parents=True)
    for name in ("s1_a.wav", "s1_b.wav"):
        (folder / name).write_bytes(b"x")
    (folder / "s1_a.normalized.txt").write_text("hello \n")
    got = readers.audio_with_text(spark, str(tmp_path / "wavs")).collect()
    assert [(r.utt, r.spk, r.text) for r in got] == [("s1_a", "s1", "hello")]
    assert sorted(r.size for r in readers.file_inventory(spark, str(tmp_path / "wavs")).collect()) == [1, 1, 7]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": "1", "y": "2"}')
    (tmp_path / "b.json").write_text('{"y": "3"}')
    assert rows_of(readers.merged_json(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])) == [("x", "1"), ("y", "3")]
    (tmp_path / "p.json").write_text(json.dumps({"name": "n", "steps": {"s": "done"}}))
    assert readers.project(spark, str(tmp_path / "p.json")).first().steps == {"s": "done"}
    (tmp_path / "log").write_text('{"type":"segment","source":"f"}\noops\n{"ev":"done","done":2}\n')
    assert rows_of(readers.message_log(spark, str(tmp_path / "log")), "type", "ev", "done") == sorted([("segment", None, None), (None, "done", 2)], key=repr)
    (tmp_path / "y").mkdir()
    for name, body in (("e1.yaml", "loss: 0.5\nepoch: 1\nstep: 10\ntag: CV\n"), ("train.yaml", "loss: 1\n"), ("init.yaml", "loss: 2\n")):
        (tmp_path / "y" / name).write_text(body)
    assert rows_of(readers.checkpoint_scores(spark, str(tmp_path / "y")), "loss", "epoch", "step", "tag") == [("0.5", 1, 10, "CV")]
    assert readers.model_names(spark, "http://127.0.0.1:9", 0.2).count() == 0


def test_shards_round_trip(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").cast("string").alias("utt"), F.lit("s").alias("spk"))
    sinks.write_shards(rows.coalesce(1), str(tmp_path / "shards"), 10)
    files = sorted(p.name for p in (tmp_path / "shards").glob("*.parquet"))
    assert len(files) == 3
    (tmp_path / "data.list").write_text("".join(f"{tmp_path}/shards/{f}\n" for f in files))
    read = readers.listed_shards(spark, str(tmp_path / "data.list"))
    assert read.count() == 25 and read.select("src").distinct().count() == 3
    (tmp_path / "shards" / files[0]).write_bytes(b"broken")
    assert readers.shards(spark, [f"{tmp_path}/shards/{f}" for f in files]).count() == 15
    sinks.write_list(read.select(F.lit("x").alias("c")).limit(0), "c", str(tmp_path / "none"))


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "u2", 2), ("s", "u1", 1), ("t", "u3", 3)], "spk string, utt string, i int")
    lists = sinks.grouped_manifest(df, "spk", "utt", "i", F.col("i"), 1)
    assert rows_of(lists) == [("s", 0, "u1"), ("s", 1, "u2"), ("t", 0, "u3")]
    sinks.write_manifest(df, "utt", "spk", str(tmp_path / "utt2spk"))
    assert rows_of(readers.manifest(spark, str(tmp_path / "utt2spk"))) == [("u1", "s"), ("u2", "s"), ("u3", "t")]
    sinks.write_pairs(spark.createDataFrame([("k", "a", "b")], "k string, r string, h string"), "k", "r", "h", str(tmp_path / "pairs"))
    assert rows_of(spark.read.text(str(tmp_path / "pairs"))) == [("k:\thyp=b",), ("k:\tref=a",)]
    sinks.save_registry(spark.createDataFrame([("a", 1)], "id string, v int"), spark.createDataFrame([("a", 2)], "id string, v int"), "id", str(tmp_path / "reg"))
    assert rows_of(spark.read.parquet(str(tmp_path / "reg"))) == [("a", 2)]
    sinks.write_json(spark.createDataFrame([("中", None)], "a string, b string"), str(tmp_path / "j"))
    assert "中" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    sinks.write_table(df, str(tmp_path / "t1"), str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 3
    assert rows_of(sinks.cleared(readers.file_inventory(spark, str(tmp_path / "reg"))), "n_files")[0][0] >= 1


def test_waveforms(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, 0], [0, 0]], "<i2").tobytes())
    r = readers.waveforms(spark, str(tmp_path / "a.wav")).first()
    assert r.sample_rate == 8000 and r.speech == [0.25, 0.0]
    with pytest.raises(Exception, match="less than"):
        readers.waveforms(spark, str(tmp_path / "a.wav"), 16000).collect()


def test_windows_closed_form(spark):
    hops = tokens.Hops(25, 2, 100, 3, 10)
    df = spark.range(700).select(F.col("id").cast("int").alias("n"))
    for r in df.select("n", tokens.chunk_bounds(F.col("n"), hops).alias("w")).collect():
        assert [(w.first, w.last, w.final) for w in r.w] == [(a, b, end) for a, b, _, end in tokens.windows(hops, r.n)], r.n


def test_token_stream(spark, tmp_path):
    hops = tokens.Hops(5, 2, 20, 2)
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"request": q, "seq": i, "token": (7 if 10 <= i < 20 else i), "ended": i == 59} for q in ("a", "b") for i in range(60)]
    for part in range(3):
        (src / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows if r["seq"] // 20 == part))
        os.utime(src / f"{part}.json", (1000 + part, 1000 + part))  # files are taken in this order
    stream = spark.readStream.schema("request string, seq int, token int, ended boolean").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(src))
    chunks = tokens.chunk_stream(stream, hops, frozenset({7}), 5)
    events.drain(chunks, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("request = 'a'").orderBy("chunk").collect()
    # Token 7 itself is silent as well: a run of one, then one of ten of which five stay.
    assert [t for r in got for t in r.tokens] == [*range(10), *[7] * 5, *range(20, 60)]
    assert [(r.first, r.last, r.final) for r in got] == [(a, b, end) for a, b, _, end in tokens.windows(hops, 55)]


def test_message_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a").write_text('{"type":"segment","source":"f"}\n{"type":"segment","source":"f"}\nbad\n')
    told = []
    events.progress_stream(events.message_stream(spark, str(src)), told.append, str(tmp_path / "cp")).awaitTermination()
    assert told == [{"batch": 0, "segments": {"f": 2}}]


def test_replay_and_overlap(spark):
    t = F.sequence(F.lit(0), F.lit(99))
    sizes = tokens.exponential_hops(25, 15, 3)
    assert sizes == [15, 25, 50]
    assert [len(x) for x in spark.range(1).select(tokens.replay(t, sizes).alias("x")).first().x] == [15, 25, 50, 10]
    over = spark.range(1).select(tokens.overlapping(t, 40, 20).alias("x")).first().x
    assert [(x[0], x[-1]) for x in over] == [(0, 59), (40, 99), (80, 99)]
    mixed = tokens.interleave(list(range(7)), list(range(40)), 5, 15)
    assert [k for k, _ in mixed[:20]] == ["text"] * 5 + ["speech"] * 15 and len(mixed) == 47


def test_retries_and_slots(spark):
    def call(value, hint):
        if value == "bad" or (value == "once" and hint is None):
            raise ValueError(f"no {value}")
        return value.upper()

    df = spark.createDataFrame([("a",), ("once",), ("bad",)], "t string")
    got = {r.t: (r.result, r.result_error) for r in events.with_retries(df, call, "t", attempts=3).collect()}
    assert got == {"a": ("A", None), "once": ("ONCE", None), "bad": (None, "no bad")}
    take = events.longest_take(lambda v, seed: [0] * seed, lambda v: 2.0)
    assert len(take("x")) == 2
    double = slots.model_slot(lambda: lambda s: pd.Series([2 * x for x in s]), T.LongType())
    nums = spark.createDataFrame([("x", 1), ("y", 2)], "m string, v long")
    assert rows_of(slots.routed(nums, "m", "v", {"x": double, "y": lambda c: c}, "o"), "m", "o") == [("x", 2), ("y", 2)]
    with pytest.raises(Exception, match="no slot"):
        slots.routed(nums, "m", "v", {"x": double}, "o").collect()
