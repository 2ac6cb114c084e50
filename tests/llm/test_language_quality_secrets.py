import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import langid, quality, secrets
from tests.conftest import SMALL
from tests.llm.common import documents, query

FR = "le chat de la maison est sur une table avec des pommes et du lait"
DE = "die katze ist auf dem tisch und der hund steht unter einem haus mit garten"


def sentence(rnd, base, n):
    return " ".join(rnd.choices(base.split(), k=n))


def labelled(spark, n=40):
    rnd = random.Random(0)
    return documents(spark, [(i, sentence(rnd, FR if i % 2 else DE, 30), "fr" if i % 2 else "de") for i in range(n)] + [(900, None, "fr"), (901, "x", None)])


def test_held_out_accuracy(spark):
    f = query("op1")[1]
    got = f(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    rows = f(spark, SMALL).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_edges(spark):
    rnd = random.Random(1)
    model = langid.learn(labelled(spark), "lang", "text", "doc_id")
    assert model.languages == ["de", "fr"]
    texts = [sentence(rnd, FR, 50), sentence(rnd, DE, 25) + ". " + sentence(rnd, FR, 75), None, "", "12 !!", "😀 ，", "猫", "É", "katze " * 50_000, "katze", "katze"]
    rows = {r.doc_id: r for r in langid.predict(documents(spark, [(i, t) for i, t in enumerate(texts)] + [(None, DE)]), model).collect()}
    assert rows[0].lang_pred == "fr" and rows[0].n_languages == 1 and rows[0].score == 1.0
    assert rows[1].lang_pred == "fr" and rows[1].n_languages == 2 and rows[1].proportions["fr"] == pytest.approx(0.75, abs=0.06)
    assert [rows[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4 and rows[2].score == 0.0 and rows[2].proportions == {}
    assert rows[6].lang_pred in ("de", "fr") and rows[7].lang_pred in ("de", "fr") and rows[8].lang_pred == "de" == rows[None].lang_pred
    docs = documents(spark, texts)
    kept = langid.keep_languages(docs, model, ["fr"], 0.6)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id < 6) == [0, 1]


def test_more_languages_than_three(spark):
    rnd = random.Random(6)
    bases = {f"l{i}": " ".join("".join(rnd.choices(letters, k=6)) for _ in range(25)) for i, letters in enumerate(("abcde", "fghij", "klmno", "pqrst", "uvwxyz"))}
    docs = documents(spark, [(i, sentence(rnd, bases[f"l{i % 5}"], 30), f"l{i % 5}") for i in range(60)])
    model = langid.learn(docs, "lang", "text", "doc_id")
    texts = [" ".join(sentence(rnd, bases[f"l{j}"], 30) for j in range(k)) for k in range(1, 6)]
    for r in langid.predict(documents(spark, texts), model).collect():
        k = r.doc_id + 1
        assert r.n_languages == k and r.score == pytest.approx(1 / k, abs=0.02)
        assert {g: p for g, p in r.proportions.items() if p > 0} == {f"l{j}": pytest.approx(1 / k, abs=0.02) for j in range(k)}


def test_nothing_to_learn_from(spark):
    none = langid.learn(labelled(spark).filter("lang is null"), "lang", "text", "doc_id")
    assert none is None
    assert {r.lang_pred for r in langid.predict(labelled(spark), None).collect()} == {"und"}
    assert langid.keep_languages(labelled(spark), None).count() == 0
    assert langid.predict(documents(spark, []), None).count() == 0


def test_em_equals_a_plain_loop(spark):
    model = langid.learn(labelled(spark), "lang", "text", "doc_id", langid.Settings(iterations=200, tolerance=1e-9))
    rnd = np.random.default_rng(3)
    like = rnd.random((60, 2)) + 0.01
    first = np.array([0, 20, 45])
    shares, fit = model._em(like, first, np.ones((3, 2)))
    for k, (a, b) in enumerate([(0, 20), (20, 45), (45, 60)]):
        p = np.array([0.5, 0.5])
        for _ in range(2000):
            r = like[a:b] * p
            p = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert shares[k] == pytest.approx(p, abs=1e-3) and fit[k] == pytest.approx(np.log(like[a:b] @ p).sum(), abs=1e-3)


# -- quality -----------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = query("op5")[1](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.96
    rank = got.score.rank()
    good = got.quality == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.97
    assert abs(got.score.mean() - good.mean()) < 0.03  # calibrated


def test_quality_edges(spark):
    rnd = random.Random(2)
    texts = [sentence(rnd, FR, 40) if i % 2 else "!!! " + sentence(rnd, FR.upper(), 20) for i in range(60)]
    docs = documents(spark, texts + [None, "", "x" * 300_000])
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(60)] + [(None, 1, "t"), (3, None, "t"), (500, 1, "t"), (4, 7, "t")], "doc_id long, quality int, text string")
    scorer = quality.learn(docs, labels)
    out = {r.doc_id: r for r in quality.score(docs, scorer).collect()}
    assert all(out[i].predicted == i % 2 for i in range(60)) and len(out) == 63 and all(0 <= r.score <= 1 for r in out.values())
    assert out[60].score == out[61].score
    assert quality.learn(docs, labels.filter("quality = 1")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(documents(spark, []), scorer).count() == 0


# -- secrets -----------------------------------------------------------------------------------


def base_by_scan(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(4)
    bits = ["token=token:abcdefgh", 'PassWord" : "hunter22', "api_key= x", "apikey=é", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 20, "0" * 23, "0" * 24, "f" * 60, "É ", " ", "secret==abcdef", "\n", "toKen:1234567", "ſecret=abcdefg"]
    texts = ["".join(rnd.choices(bits, k=6)) for _ in range(200)] + [None, "", "a" * 400_000 + " token=abcdef", "".join(bits)]
    docs = documents(spark, texts + ["dup token=abcdef"]).unionAll(documents(spark, [(len(texts), "dup token=abcdef")]))
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = (texts + ["dup token=abcdef"])[r.doc_id] or ""
        base = base_by_scan(t)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_random_tokens_are_found_and_text_is_not(spark):
    rnd = random.Random(1)
    ordinary = ["the", "there", "of", "andthehouseofthefreeandbrave", "internationalization-of-things/and/more", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1111111111111111111111", "2024-01-01/2024-02-02/2024"]
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.digits + "ABCDEF"]
    texts, planted = [], {}
    for i in range(400):
        t = " ".join(rnd.choices(ordinary, k=50))
        if i % 8 == 0:
            key = "".join(rnd.choices(alphabets[i // 8 % 4], k=rnd.choice([40, 64, 100])))
            planted[i] = key
            t += f" {key}== end"
        texts.append(t)
    rows = secrets.find_secrets(documents(spark, texts)).collect()
    found = {r.doc_id for r in rows if r.n_random}
    assert len(found - set(planted)) <= 1 and len(found) >= 0.9 * len(planted)
    for r in rows:
        if r.doc_id in found & set(planted):
            kind, a, b = r.spans.split(",")[-1].split(":")
            assert kind == "random" and texts[r.doc_id][int(a) : int(b)] == planted[r.doc_id]
            assert planted[r.doc_id] not in secrets.redact(texts[r.doc_id], r.spans)


def test_thresholds_are_the_step_up():
    rnd = random.Random(3)
    p = [10 ** -rnd.uniform(0, 2) for _ in range(500)] + [10 ** -rnd.uniform(3, 8) for _ in range(40)]
    bins = {}
    for x in p:
        b = int(-np.log10(x) / 0.1)
        bins[(0, b)] = bins.get((0, b), 0) + 1
    edge = secrets.thresholds(bins, 0.05)[0]
    ranked = sorted(p)
    exact = max((x for i, x in enumerate(ranked, 1) if x * len(p) / i <= 0.05), default=0)
    assert sum(x <= edge for x in p) <= sum(x <= exact for x in p)
    assert sum(10 ** (-0.1 * int(-np.log10(x) / 0.1)) <= edge for x in p) >= 0.8 * sum(x <= exact for x in p)
    assert secrets.thresholds({}, 0.05) == {}


def test_random_values_of_names_are_found(spark):
    rnd = random.Random(2)
    names = ["AWS_KEY=", "sig=", "private_key=", "a=b=", "x==", ""]
    texts, planted = [], {}
    for i in range(400):
        t = " ".join(rnd.choices(["the", "there", "of", "andthehouseofthefreeandbrave", "x=internationalization-of-things/and/more"], k=50))
        if i % 8 == 0:
            planted[i] = "".join(rnd.choices(string.ascii_letters + string.digits, k=rnd.choice([40, 64, 100])))
            t += f" {names[i // 8 % 6]}{planted[i]}{rnd.choice(['', '=', '=='])} end"
        texts.append(t)
    rows = {r.doc_id: r for r in secrets.find_secrets(documents(spark, texts)).collect()}
    named = {i for i in planted if i // 8 % 6 < 5}
    assert sum(rows[i].n_random for i in named) >= 0.9 * len(named) and sum(r.n_random for i, r in rows.items() if i not in planted) <= 1
    for i in planted:
        for part in filter(None, rows[i].spans.split(",")):
            kind, a, b = part.split(":")
            assert kind == "random" and texts[i][int(a) : int(b)] == planted[i]


# -- whole queries against plain Python ----------------------------------------------------------


def test_language_query_equals_a_plain_loop(spark, tmp_path):
    """op1 over a small table against a loop over words: likelihoods, EM for each nested set, penalised choice."""
    import math
    import zlib

    from cuesheet.llm.queries import op1_language_id

    rnd = random.Random(8)
    es = "el gato de la casa esta en una mesa con manzanas y leche"
    texts = [(i, sentence(rnd, (FR, DE, es)[i % 3], rnd.randint(5, 40)), ("fr", "de", "es")[i % 3]) for i in range(90)]
    texts += [(90, sentence(rnd, FR, 30) + " " + sentence(rnd, DE, 20), "fr"), (91, None, "fr"), (92, "12 ,", None), (93, sentence(rnd, es, 12), None)]
    documents(spark, texts, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_language_id(spark, str(tmp_path)).collect()}
    s, gram_bits = langid.Settings(), langid.BUCKET_BITS

    def words_of(text):
        return [w.encode() for w in re.findall(r"[a-zA-Z\x80-\U0010ffff]+", (text or "").lower())]

    def grams(word):
        padded = b"\x00" + word + b"\x00"
        return [(((padded[i - 1] << 16) + (padded[i] << 8) + padded[i + 1]) * 2654435761 % (1 << 32)) >> (32 - gram_bits) for i in range(1, len(padded) - 1)]

    learned = ["de", "es", "fr"]
    counts = {g: [s.smoothing] * (1 << gram_bits) for g in learned}
    for i, t, g in texts:
        if g and t and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in words_of(t):
                for x in grams(w):
                    counts[g][x] += 1
    totals = {g: sum(counts[g]) for g in learned}
    for i, t, _ in texts:
        words = words_of(t)
        if not words:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        logs = [[s.temper * sum(math.log(counts[g][x] / totals[g]) for x in grams(w)) for g in learned] for w in words]
        like = [[math.exp(v - max(row)) + 1e-12 for v in row] for row in logs]

        def em(allowed):
            p = [a / sum(allowed) for a in allowed]
            for _ in range(s.iterations):
                parts = [[a * b for a, b in zip(p, row, strict=True)] for row in like]
                fresh = [sum(q[k] / sum(q) for q in parts) / len(like) for k in range(3)]
                moved = max(abs(a - b) for a, b in zip(p, fresh, strict=True))
                p = fresh
                if moved <= s.tolerance:
                    break
            return p, sum(math.log(sum(a * b for a, b in zip(p, row, strict=True))) for row in like)

        whole, _ = em([1, 1, 1])
        order = sorted(range(3), key=lambda k: -whole[k])
        best = max((em([k in order[:n] for k in range(3)]) + (n,) for n in (1, 2, 3) if n == 1 or all(whole[order[m]] * len(words) >= 1 for m in range(1, n))), key=lambda e: e[1] - s.penalty * (e[2] - 1) * math.log(len(words) + 1))
        assert got[i].lang_pred == learned[best[0].index(max(best[0]))] and got[i].n_languages == best[2]
        assert got[i].score == pytest.approx(max(best[0]), abs=1e-3)
    assert got[90].n_languages == 2


def test_words_held_once_give_the_same(spark, monkeypatch):
    model = langid.learn(labelled(spark), "lang", "text", "doc_id")
    rnd = random.Random(4)
    raw = np.frombuffer((sentence(rnd, FR, 700) + ". " + sentence(rnd, DE, 300)).encode(), np.uint8)
    one = model.infer(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(langid, "_WORDS", 128)
    assert model.infer(raw, np.array([0, len(raw)])) == pytest.approx(one, abs=1e-9)
    assert model.infer(np.concatenate([raw, raw]), np.array([0, len(raw), 2 * len(raw)])) == pytest.approx(np.concatenate([one, one]), abs=1e-9)


def test_quality_query_equals_plain_compression(spark, tmp_path):
    """op5 over a small table: its scorer's dictionaries applied by hand, block by block, through the logistic formula."""
    import math
    import zlib

    import zstandard

    from cuesheet.llm.queries import op5_quality

    rnd = random.Random(7)
    texts = [(i, sentence(rnd, FR, rnd.randint(5, 900)) if i % 2 else sentence(rnd, "!!! BUY NOW click 999", rnd.randint(2, 500))) for i in range(120)] + [(120, None), (121, "")]
    documents(spark, texts, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, i % 2, 0) for i in range(100)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op5_quality(spark, str(tmp_path)).collect()}
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scorer = quality.learn(docs, labels, accept=fold != 0)
    size = scorer.settings.block_bytes
    for i, t in texts:
        raw, sizes = (t or "").encode(), []
        for words in (scorer.good, scorer.bad):
            n = max(1, -(-len(raw) // size))
            step = max(1, -(-len(raw) // n))
            c = zstandard.ZstdCompressor(level=scorer.settings.level, dict_data=zstandard.ZstdCompressionDict(words), write_dict_id=False, write_checksum=False, write_content_size=False)
            sizes.append(sum(len(c.compress(raw[a : a + step])) for a in range(0, len(raw), step)))
        g, b = sizes
        x = [(b - g) / (b + g), min(g, b) / len(raw)] if raw else [0.0, 1.0]
        z = [max(-6, min(6, (v - m) / d)) for v, m, d in zip(x, scorer.centre, scorer.scale, strict=True)]
        total = sum(w * v for w, v in zip(scorer.weights, [1, *z, z[0] ** 2, z[1] ** 2, z[0] * z[1]], strict=True))
        score = 1 / (1 + math.exp(-max(-30, min(30, total))))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert sum(got[i].predicted == i % 2 for i in range(120)) >= 108


def test_quality_learns_from_few_and_repeated_rows(spark):
    docs = documents(spark, [(1, "le chat de la maison"), (1, "le chat de la maison"), (2, "!!! BUY"), (3, "x" * 5000), (2, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 0)], "doc_id long, quality int")
    scorer = quality.learn(docs, labels)
    assert scorer is not None and len({r.score for r in quality.score(docs, scorer).collect()}) > 1
    bounded = quality._sampled(docs, labels, "doc_id", "text", "quality", None, quality.Settings(sample_bytes=1000)).collect()
    assert sorted((r.label, r.text) for r in bounded) == [(0, ""), (1, "le chat de la maison")]
