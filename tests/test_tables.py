"""Literal cases of joins, aggregates, sampling and batching."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import aggregates, batching, dag, dataset, manifests  # noqa: F401
from cuesheet.pipeline import compose, known
from tests.conftest import rows_of


def test_strict_join_names_the_missing_key(spark):
    left = spark.createDataFrame([("a",), ("b",)], "utt string")
    right = spark.createDataFrame([("a", 1)], "utt string, v int")
    with pytest.raises(Exception, match="no entry for b"):
        manifests.strict_join(left, right, ["utt"]).collect()
    assert rows_of(manifests.strict_join(left.limit(0), right, ["utt"])) == []


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert rows_of(manifests.latest(log, ["k"], ["t"])) == [("a", 2, "y"), ("b", 1, None)]
    assert rows_of(manifests.earliest(log, ["k"], ["t"])) == [("a", 1, "x"), ("b", 1, None)]
    new = spark.createDataFrame([("a", 9, "z")], "k string, t int, v string")
    assert rows_of(manifests.upsert(manifests.latest(log, ["k"], ["t"]), new, ["k"])) == [("a", 9, "z"), ("b", 1, None)]


def test_choices(spark):
    a = spark.createDataFrame([("small",), ("large",)], "name string")
    assert [r.name for r in manifests.preferred(a, "name", "large", ["medium", "small"]).collect()] == ["large"]
    assert [r.name for r in manifests.preferred(a, "name", "huge", ["medium", "small"]).collect()] == ["small"]
    assert manifests.preferred(a, "name", None, ["medium"]).count() == 0
    z = spark.range(1).select(manifests.zip_shortest(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("z")).first().z
    assert [tuple(x) for x in z] == [(1, 3)]


def test_nested_stats(spark):
    row = {"model_stats": [{"name": "m", "inference_stats": {"queue": {"ns": "5", "count": "2"}}, "batch_stats": [{"batch_size": 4, "stats": {"compute_infer": {"ns": "8", "count": "2"}}}]}]}
    stat = "struct<ns:string,count:string>"
    df = spark.createDataFrame([row], f"model_stats array<struct<name:string,inference_stats:map<string,{stat}>,batch_stats:array<struct<batch_size:int,stats:map<string,{stat}>>>>>")
    stages, batches = manifests.flatten_stats(df)
    assert rows_of(stages) == [("m", "queue", 5, 2)] and rows_of(batches) == [("m", 4, "compute_infer", 8, 2)]


def test_votes_rates_and_errors(spark):
    v = spark.createDataFrame([(1, "f"), (1, "m"), (2, "m"), (2, None)], "k int, v string")
    assert rows_of(aggregates.majority(v, ["k"], "v", "f", "m"), "k", "winner") == [(1, "f"), (2, "m")]
    r = spark.range(1).select(aggregates.real_time_factor(F.lit(1.0), F.lit(0.0)).alias("r")).first().r
    assert math.isinf(r)
    assert [x[0] for x in aggregates.align_chars("abc", "axcd")] == ["cor", "sub", "cor", "ins"]
    assert aggregates.merge_errors([("sub", "a", "b"), ("ins", "", "c"), ("cor", "d", "d"), ("del", "e", "")]) == [("sub", "a", "bc"), ("cor", "d", "d"), ("del", "e", "")]
    pairs = spark.createDataFrame([("abc", "axc"), (None, "y")], "r string, h string")
    assert rows_of(aggregates.error_table(pairs, "r", "h")) == sorted([("cor", "a", "a", 1), ("cor", "c", "c", 1), ("sub", "b", "x", 1), ("ins", "", "y", 1)], key=repr)
    one = spark.createDataFrame([(1, 0.5)], "k int, s double")
    assert aggregates.latency_summary(one, ["k"], "s").first().p99_ms == 500.0


def fold(lengths, cap):
    out, longest, k, b = [], 0, 0, 0
    for n in lengths:
        if k and max(longest, n) * (k + 1) > cap:
            b, longest, k = b + 1, 0, 0
        longest, k = max(longest, n), k + 1
        out.append(b)
    return out


@pytest.mark.parametrize("lengths", [[5, 5, 20], [50, 3, 3], [], [random.Random(1).randint(1, 30) for _ in range(200)]])
def test_dynamic_batches(spark, lengths):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(lengths)], "shard string, idx long, n int")
    got = [r.batch for r in batching.dynamic_batch(df, ["shard"], "idx", "n", 12 if len(lengths) < 4 else 100).orderBy("idx").collect()]
    assert got == fold(lengths, 12 if len(lengths) < 4 else 100)


def test_splits(spark):
    def parts(n, k):
        df = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("idx"))
        return [r.part for r in batching.with_split(df, ["s"], "idx", k).orderBy("idx").collect()]

    assert [parts(11, 4).count(i) for i in (1, 2, 3, 4)] == [3, 3, 3, 2]
    assert parts(2, 4) == [1, 2]


def deal(n, world, workers):
    out = []
    for rank in range(world):
        data = list(range(n))
        if len(data) < world:
            data = (data * math.ceil(world / len(data)))[:world]
        data = data[rank::world]
        if len(data) < workers:
            data = (data * math.ceil(workers / len(data)))[:workers]
        for w in range(workers):
            out += [(rank, w, x) for x in data[w::workers]]
    return sorted(out)


@pytest.mark.parametrize("n, world, workers", [(10, 3, 2), (2, 5, 2), (3, 2, 4), (1, 1, 1), (7, 7, 1)])
def test_shards_are_even(spark, n, world, workers):
    df = batching.shard_rows(spark.range(n).withColumnRenamed("id", "idx"), "idx", n, world, workers)
    assert sorted((r.rank, r.worker, r.idx) for r in df.collect()) == deal(n, world, workers)


def test_shuffle_is_a_permutation_and_seeded(spark):
    df = spark.range(100).select(F.lit("s").alias("s"), F.col("id").alias("idx"))
    def places(seed):
        return [r.shuffled_idx for r in batching.shuffle_blocks(df, ["s"], "idx", seed, 30).orderBy("idx").collect()]

    assert sorted(places(1)) == list(range(100)) and places(1) == places(1) != places(2)
    assert all(p // 30 == i // 30 for i, p in enumerate(places(1)))


def test_top_p(spark):
    shares = [0.5, 0.3, 0.15, 0.05]
    df = spark.createDataFrame([("k", i, math.log(p)) for i, p in enumerate(shares)], "k string, i int, w double")
    assert sorted(r.i for r in batching.top_p(df, ["k"], "w", "i", 0.8).collect()) in ([0, 1], [0, 1, 2])  # 0.5 + 0.3 is 0.8 up to rounding
    assert sorted(r.i for r in batching.top_p(df, ["k"], "w", "i", 0.79).collect()) == [0, 1]
    assert sorted(r.i for r in batching.top_p(df, ["k"], "w", "i", 2.0, 3).collect()) == [0, 1, 2]


def test_crop_and_filter(spark):
    v = F.array(*[F.lit(float(i)) for i in range(5)])
    assert spark.range(1).select(batching.crop_or_pad(v, 3, F.lit(1)).alias("x")).first().x == [1, 2, 3]
    assert spark.range(1).select(batching.crop_or_pad(v, 7, F.lit(0)).alias("x")).first().x == [0, 1, 2, 3, 4, 0, 0]
    df = spark.createDataFrame([(0, 1, 2), (10, 1, 2), (100, 300, 2), (100, 5, 0)], "frames int, tokens int, out int")
    assert rows_of(batching.sequence_filter(df, F.col("frames"), F.col("tokens"), F.col("out"))) == [(10, 1, 2)]
    rates = spark.createDataFrame([(8000,), (22050,), (44100,)], "r int")
    assert rows_of(batching.resample_filter(rates, F.col("r"))) == [(22050,), (44100,)]
    assert rows_of(batching.resample_filter(rates, F.col("r"), 8000)) == [(22050,), (44100,), (8000,)]
    with pytest.raises(ValueError, match="unsupported"):
        batching.batch(df, "other", [], "frames")


def test_padding_needs_all_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0], 5), (0, 2, [1.0, 2.0], None), (1, 3, [], 7)], "b int, id int, v array<double>, e int")
    got = {r.b: r for r in batching.padded_batch(df, ["b"], "v", "id", F.lit(0.0), ["e"]).collect()}
    assert got[0].v == [[1, 2], [1, 0]] and got[0].v_len == [2, 1] and got[0].e is None
    assert got[1].v == [[]] and got[1].e == [7]


def test_steps(spark):
    states = spark.createDataFrame([("u", "拆分音轨", "done"), ("u", "转换文字", "running"), ("u", "other", "done")], "k string, step string, state string")
    got = {r.step: r.status for r in dag.status(states, dag.steps(spark), dag.edges(spark), ["k"]).collect()}
    assert got["切割视频"] == "ready" and got["转换文字"] == "running" and got["文本翻译"] == "locked" and got["人声分离"] == "ready" and got["other"] == "locked"
    assert rows_of(dag.first_ready(dag.status(states, dag.steps(spark), dag.edges(spark), ["k"]), ["k"])) == [("u", "切割视频")]
    with pytest.raises(Exception, match="unknown step"):
        dag.marked(states, states.filter("step = 'other'")).collect()
    out, told = dag.run_plan(spark.range(4), dag.plan([("a", lambda d: d.filter("id > 0")), ("b", lambda d: None), ("c", lambda d: d)], {"c": False}))
    assert out.count() == 3 and told == [("a", "done"), ("b", "skipped")]


def test_pipelines_by_name(spark):
    assert {"tokenize", "filter", "resample", "truncate", "parse_embedding", "shuffle", "sort", "batch", "padding"} <= set(known())
    with pytest.raises(KeyError):
        compose(["no such"])
    df = spark.createDataFrame([("u", "s", 0, [0.5, 4.0, 0.5], 100, "a b"), ("v", "s", 1, [1.0], 10, "a")], "utt string, src string, idx long, speech array<double>, sample_rate int, text string")
    run = compose(["tokenize", ("resample", {"rate": 200, "least": 50}), ("truncate", {"length": 4}), ("shuffle", {"seed": 3}), "sort"], shard="src")
    got = run(df).collect()
    assert len(got) == 1 and len(got[0].speech) == 4 and max(got[0].speech) <= 1.0 and len(got[0].text_token) == 2
    emb = df.select("utt").withColumn("utt_embedding", F.array(F.lit(3.0), F.lit(4.0)))
    assert compose(["parse_embedding"])(emb).first().spk_embedding == [0.6, 0.8]
