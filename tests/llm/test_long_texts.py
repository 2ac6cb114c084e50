"""One very long text: time in proportion to its length, and results as by brute force over block edges."""

import random
import time

import pytest

from cuesheet.llm import decontaminate, langid, secrets
from tests.llm.common import contamination, documents


def seconds(run):
    """The better of two runs."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took)


def grows_in_proportion(run_of, small, times=8):
    """A run on `times` as much input may take twice as many times as long, and some seconds: a square would take times^2."""
    run_of(small)()
    one, more = seconds(run_of(small)), seconds(run_of(small * times))
    assert more < 2 * times * one + 3, (one, more)


def test_benchmark_windows_in_a_long_text(spark):
    rnd = random.Random(0)
    vocabulary = [f"w{i}" for i in range(5000)]
    bench = spark.createDataFrame([(i, " ".join(rnd.choices(vocabulary, k=40))) for i in range(40)], "item_id long, text string")

    def run_of(n):
        docs = documents(spark, [" ".join(rnd.choices(vocabulary, k=n))], clash=False)
        return lambda: decontaminate.contamination(docs, bench).collect()

    grows_in_proportion(run_of, 200_000)


def test_windows_over_the_edges_of_blocks(spark):
    rnd = random.Random(1)
    step = decontaminate.BLOCK
    items = {1: " ".join(f"a{i}" for i in range(13)), 2: " ".join(f"b{i}" for i in range(30)), 3: "c0 c1", 4: "d"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = ["d", "", None]
    for shift in range(-16, 3):
        words = [f"x{rnd.randrange(10**6)}" for _ in range(2 * step + 40)]
        for k, t in enumerate(items.values(), 1):
            at = (1 + k % 2) * step + shift - (40 if k > 2 else 0)
            words[at : at + len(t.split())] = t.split()
        texts.append(" ".join(words[: rnd.choice([step, step + 1, step + 12, 2 * step, 2 * step + 40])]))
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(documents(spark, texts), bench, broadcast_bytes=limit).collect()}
        assert got == {i: (n, h, len(s)) for i, (n, h, s) in ((i, contamination(t, items)) for i, t in enumerate(texts))}


@pytest.mark.parametrize("kinds", [("0123456789abcdef", "ABCDEFGHabcdefghijk0123456789")])
def test_secrets_in_a_long_text(spark, kinds):
    rnd = random.Random(2)

    def run_of(n):
        docs = documents(spark, [" ".join("".join(rnd.choices(kinds[i % 2], k=32)) for i in range(n))], clash=False)
        return lambda: secrets.find_secrets(docs).collect()

    grows_in_proportion(run_of, 3_000)


def test_language_of_a_long_text(spark):
    rnd = random.Random(3)
    docs = documents(spark, [(i, " ".join(rnd.choices(["the", "of", "and", "house"] if i % 2 else ["le", "la", "et", "maison"], k=30)), "ab"[i % 2]) for i in range(40)])
    model = langid.learn(docs, "lang", "text", "doc_id")

    def run_of(n):
        text = documents(spark, [" ".join(rnd.choices(["the", "le", "house", "maison"], k=n))], clash=False)
        return lambda: langid.predict(text, model).collect()

    grows_in_proportion(run_of, 100_000)
