import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cuesheet.llm import decontaminate, exact_dedup
from tests.conftest import SMALL, assert_matches, rows_of
from tests.llm.common import LOW, contamination, documents, item_words, query


@pytest.mark.parametrize("name", ["op3", "op6", "op8", "op10"])
def test_queries_match_their_sql(spark, name):
    key, f = query(name)
    assert_matches(f(spark, SMALL), entry.oracle_sql()[key])


AWKWARD = [(5, "A b"), (7, "a B"), (1, None), (2, ""), (None, "a b"), (9, "É"), (8, "é"), (3, "x" * 300_000), (4, "X" * 300_000), (6, "lone"), (6, "lone")]


def test_groups(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(documents(spark, AWKWARD), keep="max").collect()}
    def sha(t):
        return hashlib.sha256(t.translate(LOW).encode()).hexdigest()

    expected = {(i, k, n, i == k, sha(t)) for i, t, k, n in [(5, "a b", 7, 3), (7, "a b", 7, 3), (None, "a b", 7, 3), (1, "", 2, 2), (2, "", 2, 2), (9, "É", 9, 1), (8, "é", 8, 1), (3, "x" * 300_000, 4, 2), (4, "x" * 300_000, 4, 2), (6, "lone", 6, 2)]}
    assert got == expected
    kept = exact_dedup.drop_exact_copies(documents(spark, AWKWARD))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 6, 8, 9]


def test_collisions_are_told_apart_by_bytes(spark):
    docs = documents(spark, [f"text {i % 40}" for i in range(120)])
    weak = exact_dedup.exact_groups(docs, key_digits=1)
    assert rows_of(weak) == rows_of(exact_dedup.exact_groups(docs))
    assert {r.group_size for r in weak.collect()} == {3}


def test_empty_and_null_ids(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    got = exact_dedup.exact_groups(documents(spark, [(None, "a"), (None, "a")])).collect()
    assert [(r.keep_id, r.kept) for r in got] == [(None, True)] * 2


def cases(seed):
    rnd = random.Random(seed)
    vocab = ["un", "deux", "trois", "É", "x1", "the", "of"]
    items = {i: " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(8)}
    texts = []
    for _ in range(25):
        t = " ".join(rnd.choices(vocab + ["other", "words"], k=rnd.randint(0, 40)))
        if rnd.random() < 0.6:
            t = t[: len(t) // 2] + ". " + rnd.choice(list(items.values())).upper() + "!" + t[len(t) // 2 :]
        texts.append(t)
    return items, texts + ["", None, "...", "un" * 100_000]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_contamination_equals_brute_force(spark, seed, limit):
    items, texts = cases(seed)
    items = {i: t for i, t in items.items() if len(item_words(t)) != 1 or seed}  # one-word items hit nearly everything
    bench = spark.createDataFrame([(i, t, "x") for i, t in items.items()] + [(None, "un deux", "x"), (99, None, "x")], "item_id long, text string, w string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(documents(spark, texts), bench, broadcast_bytes=limit).collect()}
    for i, t in enumerate(texts):
        n, hit, seen = contamination(t, items)
        assert got[i] == (n, hit, len(seen), hashlib.sha256(",".join(seen).encode()).hexdigest(), hit > 0 and 20 * hit >= n), (i, t)


def test_benchmark_edges(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = bench.limit(0)
    docs = documents(spark, [(1, "x a b c"), (1, "x a b c"), (None, "a b c"), (2, None)])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_hit) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(False, 1, 3), (False, 1, 3), (False, 2, 0), (True, 0, 3)]
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_spans_are_removed(spark):
    bench = spark.createDataFrame([(1, "bad words here")], "item_id long, text string")
    docs = documents(spark, ["Good, BAD  words-here; then good.", "none", None, "bad words here"])
    out = [r.text for r in decontaminate.remove_spans(docs, bench).orderBy("doc_id").collect()]
    assert out[1:] == ["none", None, ""]
    assert item_words(out[0]) == ["good", "then", "good"] and out[0].startswith("Good,") and out[0].endswith("good.")


def test_main_paths_are_native(spark):
    for name in ("op8", "op10"):
        plan = query(name)[1](spark, SMALL)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_shared_window_of_a_hot_item(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = documents(spark, [f"start {text} end {i}" for i in range(300)])
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = decontaminate.contamination(docs, bench).select("n_hit", F.col("n_items")).distinct().collect()
    assert [tuple(r) for r in rows] == [(20, 1)]
