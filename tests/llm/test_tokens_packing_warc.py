import itertools
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import packing, token_counts, warc
from tests.conftest import SMALL, rows_of
from tests.llm.common import documents, query

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark):
    got = {r.doc_id: r for r in query("op7")[1](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = library().encode_batch([d.text or "" for d in docs], add_special_tokens=False)
    for d, e in zip(docs, expected):
        r = got[d.doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(e.ids), len((d.text or "").encode()), len(e.ids) > 1024)


def test_counts_of_odd_texts():
    rnd = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\t", "\xa0", " ", "　", "a", "b's", "don't", "DON'T", "12", "é", "日本", "½", "!!", "...", "<|endoftext|>", "<|endof", " x", "\x1c", "\x85", "😀", "​", "É"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(4000)] + ["", "a" * 3000, "ab" * 5000, "0123456789" * 300, " ", "\n", "<|endoftext|>" * 3, " a", "a "]
    counter = token_counts.ArrayBpe(token_counts.read_tokenizer(PATH))
    expected = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert counter.counts_of(texts) == expected
    assert [counter.counts_of([t])[0] for t in texts[:300]] == expected[:300]  # now from the cache, one by one
    small = token_counts.ArrayBpe(token_counts.read_tokenizer(PATH), cache_entries=50)
    assert [n for i in range(0, len(texts), 97) for n in small.counts_of(texts[i : i + 97])] == expected


def test_counts_edges(spark):
    rows = token_counts.count_tokens(documents(spark, [(1, None), (1, None), (None, "é"), (2, "x " * 200_000)]), PATH, limit=1).collect()
    assert sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens > 1, r.over_limit) for r in rows)) == [(0, 2, False, False), (1, 0, False, False), (1, 0, False, False), (2, 400_000, True, True)]
    assert token_counts.count_tokens(documents(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.ArrayBpe(token_counts.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


# -- packing -----------------------------------------------------------------------------------


def cost_of(bins, caps):
    return sum(packing.bin_price(next(c for c in caps if c >= sum(b))) for b in bins)


def best_cost(lengths, caps):
    """The least price over all ways to put the items into bins."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], cost_of(bins, caps))
            return
        for b in bins:
            if sum(b) + lengths[i] <= caps[-1]:
                b.append(lengths[i])
                go(i + 1, bins)
                b.pop()
        bins.append([lengths[i]])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_near_the_best_packing(seed):
    rnd = random.Random(seed)
    caps = (512, 1024, 2048)
    lengths = sorted((rnd.choice([rnd.randint(1, 300), rnd.randint(1, 2048), 512, 256]) for _ in range(7)), reverse=True)
    placed, sizes = packing.pack(lengths, caps)
    bins = [[n for n, b in zip(lengths, placed) if b == i] for i in range(len(sizes))]
    assert all(sum(b) <= c and c == next(x for x in caps if x >= sum(b)) for b, c in zip(bins, sizes))
    assert cost_of(bins, caps) <= 1.25 * best_cost(lengths, caps)


def test_pieces_cover_every_document(spark):
    rnd = random.Random(9)
    lengths = [rnd.choice([0, 1, 100, 512, 4096, 4097, 30_000, rnd.randint(1, 5000)]) for _ in range(500)]
    rows = [(i, n, "x") for i, n in enumerate(lengths)] + [(None, 5, "x"), (3, 7, "x"), (3, 7, "x"), (900, None, "x"), (901, -4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, grp string")
    out = packing.pack_documents(df, group_items=100).toPandas()
    got = sorted((-1 if d != d else int(d), int(n)) for d, n in out.groupby(["doc_id", "bin_id", "bin_offset", "piece"], dropna=False)["n_tokens"].sum().reset_index().groupby("doc_id", dropna=False)["n_tokens"].sum().items())
    expected = {}
    for i, n, _ in rows:
        expected[-1 if i is None else i] = expected.get(-1 if i is None else i, 0) + max(0, n or 0)
    assert got == sorted(expected.items())
    for _, b in out.groupby("bin_id"):
        b = b.sort_values(["bin_offset", "n_tokens"])
        assert b.n_tokens.sum() == b.bin_used.iloc[0] <= b.bin_capacity.iloc[0] and b.bin_capacity.iloc[0] == next(c for c in packing.CAPACITIES if c >= b.bin_used.iloc[0])
        assert b.bin_offset.tolist() == [0, *itertools.accumulate(b.n_tokens.tolist()[:-1])]
    assert out.bin_used.sum() and out.drop_duplicates("bin_id").bin_used.sum() > 0.9 * out.drop_duplicates("bin_id").bin_capacity.sum()
    assert packing.pack_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, capacities=())


def test_packing_query(spark):
    out = query("op9")[1](spark, SMALL)
    counts = query("op7")[1](spark, SMALL)
    assert rows_of(out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))) == rows_of(counts.select("doc_id", F.col("n_tokens").alias("n")))


# -- archives ----------------------------------------------------------------------------------


def pages(spark):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 30
    rows = [(1, "http://a", long), (5, "http://b\r\nX: y", long), (3, None, long), (2, "u", "small"), (4, "u", "small"), (6, None, None), (7, "", ""), (None, "n", long), (8, "z", "x" * 999), (9, "z", "x" * 999), (10, "z", "y" * 1000), (11, "z", "y" * 1000), (12, "big", "é" * 200_000), (13, "q", "\x00\x01 binary \x85")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), rows


def expected_records(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None] if len(raw) >= 1000 else [i]
        to = max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    out = warc.round_trip(df, path=f"file://{tmp_path}/w")
    assert rows_of(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected_records(rows)
    for f in (tmp_path / "w").glob("*.gz"):
        for headers, block in warc.parse(f.read_bytes()):
            assert headers["warc-type"] in ("response", "revisit") and int(headers["content-length"]) == len(block)
            assert ("warc-refers-to" in headers) == (headers["warc-type"] == "revisit")
    back = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, f"file://{tmp_path}/w", True).filter("type = 'response'").collect()}
    assert all(back[str(i)] == (h or "").encode() for i, _, h in rows if str(i) in back)
    assert warc.round_trip(df.limit(0), path=f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize(
    "rows",
    [
        [(5, "A"), (5, "A"), (3, "A"), (1, "x")],
        [(5, "A"), (5, "B"), (3, "A")],
        [(5, "A"), (5, "B"), (3, "A"), (3, "B"), (3, "B"), (None, "A"), (None, "A"), (None, None), (None, "B"), (2, "x"), (2, "x")],
    ],
)
def test_repeated_ids(spark, tmp_path, rows):
    """As in plain Python: a row each, whatever ids and payloads repeat, and no two records of one name."""
    rows = [(i, f"http://{n}", p and (p * (2500 if p == "B" else 1500) if p < "a" else p)) for n, (i, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = warc.round_trip(df, path=f"file://{tmp_path}/w")
    assert rows_of(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected_records(rows)
    heads = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse(f.read_bytes())]
    names = {h["warc-record-id"]: h for h in heads}
    assert len(names) == len(heads) == len(rows) == len({h["warc-target-uri"] for h in heads})
    for h in heads:
        if "warc-refers-to" in h:
            to = names[h["warc-refers-to"]]
            assert to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"]
    warc.dedupe_archives(spark, f"file://{tmp_path}/w", f"file://{tmp_path}/x")
    again = warc.joined_revisits(warc.read_archives(spark, f"file://{tmp_path}/x"))
    assert rows_of(again.withColumn("page_id", F.col("record_id").cast("long")), "page_id", "payload_bytes", "digest") == sorted([r[:3] for r in expected_records(rows)], key=repr)


def test_files_hold_fewer_large_records(spark, tmp_path):
    rows = [(i, "u", ("abcd" * n)[:n] + str(i)) for i, n in enumerate([10, 20, 30, 70_000, 80_000, 2_000_000, 2_000_000, 17_000_000])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    out = warc.round_trip(df, path=f"file://{tmp_path}/w")
    assert rows_of(out, "page_id", "payload_bytes") == sorted((i, len(h)) for i, _, h in rows)
    held = sorted([h["warc-record-id"].split(":")[3] for h, _ in warc.parse(f.read_bytes())] for f in (tmp_path / "w").glob("*.gz"))
    assert held == [["0", "1", "2"], ["3", "4"], ["5", "6"], ["7"]]


def test_archives_are_deduplicated_anew(spark, tmp_path):
    def record(kind, name, payload, to=None):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{warc.URN}{name}>\r\nWARC-Target-URI: http://{name}\r\nContent-Type: application/http; msgtype=response\r\n" + (f"WARC-Refers-To: <{warc.URN}{to}>\r\n" if to else "") + f"Content-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")  # a member for each record

    body = b"z" * 3000
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(record("warcinfo", "i", b"") + record("response", "a", body) + record("response", "b", body))
    (tmp_path / "in" / "b.warc.gz").write_bytes(record("revisit", "c", b"", "a") + record("response", "d", b"other"))
    warc.dedupe_archives(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = warc.joined_revisits(warc.read_archives(spark, f"file://{tmp_path}/out"))
    assert rows_of(got, "record_id", "type", "refers_to", "payload_bytes") == [("a", "revisit", "c", 3000), ("b", "revisit", "c", 3000), ("c", "response", None, 3000), ("d", "response", None, 5)]


def test_broken_archives_are_errors():
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.parse(b"HTTP/1.1 200\r\n\r\n"))
    assert list(warc.parse(b"")) == []
