import random

import numpy as np
import pytest

from cuesheet.llm import graph, jaccard, passages
from cuesheet.llm.runtime import run_hashes, span_hashes, text_pieces, word_spans
from tests.conftest import rows_of
from tests.llm.common import components, documents, similar, words

VOCAB = [f"{a}{b}" for a in "bcdfgl" for b in ("a", "e", "i", "o", "ou", "É")]


def corpus(seed, families=8, members=6):
    """Texts of families whose members differ from their base by some words, with copies and odd ones."""
    rnd = random.Random(seed)
    out = []
    for _ in range(families):
        base = [rnd.choice(VOCAB) for _ in range(rnd.choice([3, 8, 30, 120]))]
        for _ in range(members):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, max(1, len(w) // 15)])):
                w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
            out.append(" ".join(w) + rnd.choice(["", "\n", " "]))
    rnd.shuffle(out)
    return out + ["", None, " \n ", "one", "ONE", "two words", "É é"]


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(documents(spark, texts)).collect()}
    expected = similar(dict(enumerate(texts)))
    from tests.llm.common import shingles

    assert got == {i: (len(shingles(t)), expected[i]) for i, t in enumerate(texts)}


def test_star_that_only_its_centre_links(spark):
    # Copies that differ from the base at places of their own: near the base, far from one another.
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        w = list(base)
        for at in rnd.sample(range(120), 3):
            w[at] = f"z{i}x{at}"
        texts.append(" ".join(w))
    texts.insert(25, " ".join(base))
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(documents(spark, texts)).collect()}
    assert got == similar(dict(enumerate(texts)))


def test_awkward_rows(spark):
    long = " ".join(f"a{i}" for i in range(60_000))
    rows = [(3, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (1, "A B C D E F"), (8, long), (9, long + " end"), (4, None)]
    got = jaccard.similar_components(documents(spark, rows)).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=repr) == sorted([(3, 1), (None, None), (3, 1), (1, 1), (8, 8), (9, 8), (4, 4)], key=repr)
    assert jaccard.similar_components(documents(spark, [])).count() == 0
    docs = documents(spark, rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=repr) == [1, 4, 8, None]
    with pytest.raises(ValueError, match="integer"):
        jaccard.similar_components(docs.withColumn("doc_id", docs.text))


@pytest.mark.parametrize("seed", range(6))
def test_similar_sets_share_a_signature(seed):
    rnd = np.random.default_rng(seed)
    for _ in range(150):
        n = int(rnd.integers(4, 400))
        a = np.unique(rnd.integers(0, 1 << 48, n, dtype=np.uint64))
        b = a
        while True:  # one more change, as long as the sets are still linked
            c = b.copy()
            at = int(rnd.integers(len(c)))
            kind = rnd.integers(3)
            if kind == 0 and len(c) > 1:
                c = np.delete(c, at)
            else:
                c = np.append(c if kind == 1 else np.delete(c, at), rnd.integers(0, 1 << 48, 1, dtype=np.uint64))
            c = np.unique(c)
            same = len(np.intersect1d(a, c))
            if 100 * same < 75 * (len(a) + len(c) - same):
                break
            b = c
        if np.array_equal(a, b):
            continue
        assert len(np.intersect1d(jaccard.partenum(a), jaccard.partenum(b))), (len(a), len(b))


def test_bands():
    ends = jaccard.band_ends(75, 10_000)
    for n in range(1, 3000):
        most = n * 100 // 75
        assert np.searchsorted(ends, most) - np.searchsorted(ends, n) <= 1


@pytest.mark.parametrize("seed", range(3))
def test_graph(spark, seed):
    rnd = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 60) if rnd.random() < 0.8] + [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(30)]
    got = dict((r.node, r.component) for r in graph.components(spark.createDataFrame(links + [(None, 1)], "u long, v long")).collect())
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, [(a, b) for a, b in links if a != b])
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["The  cat\n", "", None, "É\tx", " ", "a" * 5000, " b c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]).slice(1)
    seen = {}
    for budget in (1, 7, 1 << 20):
        for first, end, data, offsets in text_pieces(batch, "text", budget):
            s, e, at = word_spans(data, offsets)
            h = span_hashes(data, s, e)
            for i in range(end - first):
                got = [data[a:b].tobytes().decode() for a, b in zip(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]])]
                assert [g.lower() if g.isascii() else g for g in got] == words(texts[1:][first + i])
                seen.setdefault(first + i, set()).add(tuple(h[at[i] : at[i + 1]].tolist()))
    assert all(len(v) == 1 for v in seen.values())  # hashes do not depend on the place
    assert len(run_hashes(np.arange(3, dtype=np.uint64), 5)) == 0


# -- passages ----------------------------------------------------------------------------------


def test_minimizers_equal_the_definition():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 5, 12, 13, 40, 200):
        h = rnd.integers(0, 50, n, dtype=np.uint64)
        expected = {i + int(np.argmin(h[i : i + 12])) for i in range(max(1, n - 11))} if n else set()
        assert set(passages.minimizers(h, 12).tolist()) == expected


def chain_by_pairs(x, y, weight, gap):
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    best = {}
    for j in order:
        best[j] = weight + max([0.0, *(best[i] - gap * (x[j] - x[i] + y[j] - y[i]) for i in best if x[i] < x[j] and y[i] < y[j])])
    return max(best.values())


@pytest.mark.parametrize("seed", range(20))
def test_chains_are_optimal(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(2, 40))
    x, y = rnd.integers(0, 60, n), rnd.integers(0, 60, n)
    if seed % 2:
        x, y = np.unique(x), np.unique(y)
        x, y = x[: min(len(x), len(y))], y[: min(len(x), len(y))]
    found = passages.chains(x, y, 5, 0.2, least=1)
    for c in found:
        assert np.all(np.diff(x[c]) > 0) and np.all(np.diff(y[c]) > 0)
    best = max(5.0 * len(c) - 0.2 * float((x[c][-1] - x[c][0]) + (y[c][-1] - y[c][0])) for c in found)
    assert best == pytest.approx(chain_by_pairs(x.tolist(), y.tolist(), 5.0, 0.2))


def test_common_words():
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for u in a:
            last = row[:]
            for j, v in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if u == v else max(row[j - 1], last[j])
        assert passages.common_words(np.array(a, "<u4"), np.array(b, "<u4")) == row[-1]


def text_of(rnd, n):
    return [rnd.choice(VOCAB) + rnd.choice(VOCAB) + rnd.choice(VOCAB) for _ in range(n)]


def test_planted_passages(spark):
    rnd = random.Random(7)
    texts = [text_of(rnd, rnd.randint(80, 200)) for _ in range(60)]
    shared, edited, short = text_of(rnd, 60), text_of(rnd, 90), text_of(rnd, 30)
    for i in range(10, 30):  # a passage that a third of the documents have
        texts[i][40:40] = shared
    for i in range(30, 34):  # a passage with changed, added and lost words
        e = list(edited)
        for _ in range(3):
            e[rnd.randrange(len(e))] = "changed"
        del e[rnd.randrange(len(e))]
        e.insert(rnd.randrange(len(e)), "added")
        texts[i][20:20] = e
    for i in range(40, 50):  # too short to count
        texts[i][10:10] = short
    texts[50] = text_of(rnd, 120) * 2  # repeats itself only
    rows = [" ".join(t) for t in texts] + [None, "", " ".join(texts[0]), (None, " ".join(texts[0]))]
    got = passages.repeated_passages(documents(spark, rows)).collect()
    flagged = {r.doc_id for r in got}
    assert flagged == {*range(10, 34), 0, 62}
    assert {(r.other_doc_id, r.doc_id) for r in got} == {(r.doc_id, r.other_doc_id) for r in got}
    for r in got:
        a, b = words(rows[r.doc_id])[r.start_word : r.end_word], words(rows[r.other_doc_id])[r.other_start : r.other_end]
        assert r.n_words == max(len(a), len(b)) >= 50 and r.equal_words >= 0.75 * r.n_words
        if 10 <= r.doc_id < 30:
            assert a[a.index(shared[0]) :][:60] == shared
    first = min(r.doc_id for r in got if 10 <= r.doc_id < 30)
    later = {r.doc_id: r.spans for r in passages.later_spans(passages.repeated_passages(documents(spark, rows))).collect()}
    assert first not in later and 62 in later and [tuple(s) for s in later[62]] == [(0, len(texts[0]))]


def test_no_passages(spark):
    assert passages.repeated_passages(documents(spark, [])).count() == 0
    assert passages.repeated_passages(documents(spark, ["a b", None, "a b"])).count() == 0
    long = " ".join(f"q{i}" for i in range(30_000))
    assert rows_of(passages.repeated_passages(documents(spark, [long, long])), "doc_id", "start_word", "end_word") == [(0, 0, 30_000), (1, 0, 30_000)]
