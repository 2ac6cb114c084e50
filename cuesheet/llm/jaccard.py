"""N-gram Jaccard join by PartEnum signatures.

Sets are the distinct word shingles of whole documents; two link when their Jaccard similarity
reaches a threshold, and the result is the component of every document. In steps:

1. Count filter. A set that links shares at least threshold x its size with one other set. Shingles are
   counted in each map batch, then dealt to shards by hash, as packed arrays, and counted there; sets of
   which too few shingles occur elsewhere are done. Hash collisions can only let more sets through.
2. Equal sets are one node. The nodes' sets are read again from the text, picked by a bitmap of fixed
   size before the shuffle and by a join after it.
3. PartEnum. Sizes fall into bands so that linked sets are in one band or in neighbours; for a band
   with largest size r, linked sets differ in at most k = 2r(1-t)/(1+t) shingles. The domain of hashes
   is cut into n1 partitions of n2 cells; more than n1 - k/(k2+1) - 1 partitions hold at most k2
   differences, and in such a partition some n2 - k2 cells agree. Every choice of n2 - k2 cells of
   every partition is a signature. A set whose own partitions with an empty choice are fewer than the
   partitions that must agree leaves its empty choices out: another signature is shared then.
4. Of the nodes that share a signature the one whose shingles are the most common is the hub. Every node is
   compared, exactly, with the foremost of its hubs, then with the hubs of those signatures whose nodes are
   not of one component yet. Nodes that still miss a hub's component are compared with the hub's other
   nodes, under the last hub that both have, unless a component, the sizes, the triangle inequality of the
   Jaccard distance or the counts of elements by cell of the domain rule it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.graph import components
from cuesheet.llm.runtime import dealt_by_shard, mix64, run_hashes, shard_count, shuffle_partitions, span_hashes, text_pieces, tidy, without_ids, word_spans, written

SHINGLE = 5
#: The similarity threshold, in hundredths.
PERCENT = 75
#: Differences allowed in a partition, and cells of a partition.
K2, N2 = 1, 4
#: Share of partitions beyond those that differences can spoil.
SPARE = 0.2
BITMAP_BITS = 25
#: Cells by which elements are counted; differing counts bound the difference of two sets from below.
PROFILE = 256
_FLUSH = 400_000

#: shared and weight: what the batch knows by itself.
_HEAD = np.dtype([("id", "<i8"), ("null", "?"), ("n", "<u4"), ("hi", "<i8"), ("lo", "<i8"), ("shared", "<u4"), ("weight", "<f4")])
_SEEN = np.dtype([("doc", "<u2"), ("shared", "<u4"), ("weight", "<f4")])
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    starts, ends, at = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    runs = run_hashes(words, length)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(np.unique(runs[a : b - length + 1]))
        else:
            out.append(run_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the elements only."""
    a = np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else np.uint64(0)
    b = np.bitwise_xor.reduce(mix64(s + np.uint64(0x632BE59BD9B4E019))) if len(s) else np.uint64(0)
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by shard, shards met, where each begins, and the end) of hashes."""
    shard = ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.uint32)
    order = np.argsort(shard.astype(np.uint16) if shards < 65536 else shard, kind="stable")
    ranked = shard[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    return order, ranked[first], np.append(first, len(ranked))


def _dealt(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """Packed rows (shard, batch, kind, body, docs, more): for each batch one head, and the shingles of each shard.

    A shingle that several documents of the batch have is counted for them here; only one entry of it, in `more`,
    goes to its shard, so a shingle that a third of all documents have gives an entry a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        heads: list[tuple] = []
        sets: list[np.ndarray] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            nonlocal heads, sets, held, number
            key = (part << 32) | number
            all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            order = np.argsort(all_)
            ranked = all_[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(ranked)))
            common = first[count > 1]
            often = np.ones(len(ranked), np.int64)
            often[order] = np.repeat(count, count)
            head = np.array(heads, _HEAD)
            head["shared"] = np.bincount(doc[often > 1], minlength=len(sets))
            head["weight"] = np.bincount(doc, np.log2(often), minlength=len(sets))
            rows = [((part + number) % shards, key, 0, head.tobytes(), b"", b"")]
            alone = often == 1
            single, doc, more = all_[alone], doc[alone], ranked[common]
            bodies: dict[int, tuple] = {}
            order, met, cuts = _by_shard(single, shards)
            low, doc = (single[order] & _LOW).astype("<u4"), doc[order]
            for i, a, b in zip(met.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                bodies[i] = (low[a:b].tobytes(), _runs(doc[a:b]), b"")
            order, met, cuts = _by_shard(more, shards)
            low = (more[order] & _LOW).astype("<u4")
            for i, a, b in zip(met.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                bodies[i] = (*bodies.get(i, (b"", b""))[:2], low[a:b].tobytes())
            rows += [(i, key, 1, *body) for i, body in bodies.items()]
            number, heads, sets, held = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "batch", "kind", "body", "docs", "more"])

        for batch in batches:
            ids, null = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for first, _, data, offsets in text_pieces(batch, "text"):
                for i, s in enumerate(shingle_sets(data, offsets, length), first):
                    heads.append((ids[i], null[i], len(s), *_set_key(s), 0, 0.0))
                    sets.append(s)
                    held += len(s)
                    if held >= _FLUSH or len(sets) >= 60_000:
                        yield flushed()
        if heads:
            yield flushed()

    return docs.mapInArrow(tidy(run), "shard int, batch bigint, kind int, body binary, docs binary, more binary")


def _runs(doc: np.ndarray) -> bytes:
    """Sorted document numbers as (number, count) pairs of 16 bits; long runs take several pairs."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    count = np.diff(np.append(first, len(doc)))
    pieces = np.maximum(1, -(-count // 65535))
    value = np.repeat(doc[first], pieces)
    size = np.full(len(value), 65535)
    last = np.cumsum(pieces) - 1
    size[last] = count - (pieces - 1) * 65535
    return np.stack([value, size.astype(np.uint16)], axis=1).astype("<u2").tobytes()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shard: heads as they are, and per batch which documents share how many shingles."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["batch", "kind", "body"])

    def counted(keys: list[int], bodies: list[bytes], runs: list[bytes], mores: list[bytes]) -> list[tuple]:
        values = np.frombuffer(b"".join(bodies), "<u4")
        # An entry of `more` stands for two documents, at least.
        everything = np.concatenate([values, np.repeat(np.frombuffer(b"".join(mores), "<u4"), 2)])
        order = np.argsort(everything, kind="stable")
        ranked = everything[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        count = np.diff(np.append(first, len(ranked))).astype(np.int32)
        df = np.empty(len(everything), np.int32)
        df[order] = np.repeat(count, count)
        rows, at = [], 0
        for key, body, run in zip(keys, bodies, runs, strict=True):
            mine = df[at : at + len(body) // 4]
            at += len(mine)
            if not len(mine):
                continue
            pair = np.frombuffer(run, "<u2").reshape(-1, 2)
            start = np.concatenate(([0], np.cumsum(pair[:, 1].astype(np.int64))[:-1]))
            more = mine > 1
            shared = np.add.reduceat(more.astype(np.int64), start)
            weight = np.add.reduceat(np.where(more, np.log2(mine), 0.0), start)
            keep = shared > 0
            if keep.any():
                seen = np.zeros(int(keep.sum()), _SEEN)
                seen["doc"], seen["shared"], seen["weight"] = pair[keep, 0], shared[keep], weight[keep]
                rows.append((key, 1, seen.tobytes()))
        return rows

    now, held = None, []
    for batch in batches:
        for shard, key, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                yield out([(key, 0, row[0])])
                continue
            if shard != now and held:
                if rows := counted(*zip(*held, strict=True)):
                    yield out(rows)
                held = []
            now = shard
            held.append((key, *row))
    if held and (rows := counted(*zip(*held, strict=True))):
        yield out(rows)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by batch and kind: a row per document with its size, key and shared count."""
    head = shared = weight = now = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(head["id"], mask=head["null"]), pa.array(head["n"].astype(np.int64)), pa.array(head["hi"]), pa.array(head["lo"]), pa.array(shared), pa.array(weight)],
            names=["id", "n", "hi", "lo", "shared", "weight"],
        )

    for batch in batches:
        for key, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if head is not None:
                    yield out()
                now, head = key, None
            if kind == 0:
                head = np.frombuffer(body, _HEAD)
                shared, weight = head["shared"].astype(np.int64), head["weight"].astype(np.float64)
            else:
                seen = np.frombuffer(body, _SEEN)
                np.add.at(shared, seen["doc"], seen["shared"].astype(np.int64))
                np.add.at(weight, seen["doc"], seen["weight"].astype(np.float64))
    if head is not None:
        yield out()


def document_sets(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """(id, n, hi, lo, shared, weight) per row of docs (id bigint, text string): the count filter's figures."""
    tasks = shuffle_partitions(docs.sparkSession)
    shards = shard_count(docs)
    seen = dealt_by_shard(_dealt(docs, shards, length), shards).sortWithinPartitions("shard").mapInArrow(tidy(_counted), "batch bigint, kind int, body binary")
    out = seen.repartition(tasks, "batch").sortWithinPartitions("batch", "kind").mapInArrow(tidy(_combined), "id bigint, n bigint, hi bigint, lo bigint, shared bigint, weight double")
    return written(out, "jaccard-documents")


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """2^BITMAP_BITS bits, set where a node's hashed id falls: 4 MB, whatever the number of nodes."""
    at = F.pmod(F.xxhash64("node"), F.lit(1 << BITMAP_BITS))
    words = nodes.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {1 << BITMAP_BITS}) & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2^(BITMAP_BITS-6) rows
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits


def _packed(s: np.ndarray) -> bytes:
    """The hashes, sorted, eight bytes each."""
    return s.astype("<u8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _profile(s: np.ndarray) -> list[int]:
    """Elements in each of PROFILE cells of the domain, as far as 16 bits count."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PROFILE), 32767).tolist()


def _node_sets(docs: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """(node, n, hk, body, profile) of every node, written."""
    box = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes))
    rows = docs.filter("id is not null").withColumn("pos", F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((box.value[pos >> 6] >> (pos & 63)) & 1 == 1))
            for first, end, data, offsets in text_pieces(batch, "text"):
                sets = shingle_sets(data, offsets, length)
                keys = [_set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([_packed(s) for s in sets], pa.binary()), pa.array([_profile(s) for s in sets], pa.list_(pa.int16()))],
                    names=["id", "hi", "lo", "body", "profile"],
                )

    found = rows.mapInArrow(tidy(run), "id bigint, hi bigint, lo bigint, body binary, profile array<smallint>")
    own = nodes.select("node", "n", F.col("hi").alias("h2"), F.col("lo").alias("l2"), "hk")
    joined = found.join(own, (F.col("id") == F.col("node")) & (F.col("hi") == F.col("h2")) & (F.col("lo") == F.col("l2")))
    return written(joined.select("node", "n", "hk", "body", "profile").dropDuplicates(["node", "hk"]), "jaccard-sets")


def band_ends(percent: int, most: int) -> list[int]:
    """Largest sizes of the bands up to one that has `most`, and one more. Linked sizes are in one band or in neighbours."""
    ends, low = [], 1
    while len(ends) < 2 or ends[-2] < most:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return ends


def differences(a: int, b: int, percent: int) -> int:
    """The most elements that differ between linked sets of sizes a and b together."""
    return (a + b) * (100 - percent) // (100 + percent)


def partenum(s: np.ndarray, percent: int = PERCENT, k2: int = K2, n2: int = N2, spare: float = SPARE) -> np.ndarray:
    """The signatures of a set of 64-bit hashes, sorted: those of its own band and of the next."""
    n = len(s)
    ends = band_ends(percent, n)
    band = int(np.searchsorted(ends, n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(s + np.uint64(1)), out=total[1:])
    high = s >> np.uint64(32)
    out = []
    for j in (band, band + 1):
        r = ends[j]
        k = differences(r, r, percent)
        if not k:
            continue  # linked sets are equal here, and equal sets are one node
        spoiled = k // (k2 + 1)
        n1 = spoiled + 1 + int(np.ceil(spare * k / (k2 + 1)))
        cells = n1 * n2
        at = (high * np.uint64(cells)) >> np.uint64(32)
        cut = np.searchsorted(at, np.arange(cells + 1, dtype=np.uint64))
        sums, sizes = (total[cut[1:]] - total[cut[:-1]]).reshape(n1, n2), np.diff(cut).reshape(n1, n2)
        whole, count = np.add.reduce(sums, axis=1), sizes.sum(axis=1)
        sigs, empty = [], []
        for choice, out_cells in enumerate(combinations(range(n2), k2)):
            left = list(out_cells)
            part = whole - np.add.reduce(sums[:, left], axis=1)
            salt = mix64(np.arange(n1, dtype=np.uint64) + np.uint64((j << 40) + (choice << 32) + 1))
            sigs.append(mix64(part ^ salt))
            empty.append(count - sizes[:, left].sum(axis=1) == 0)
        empty = np.stack(empty)
        agree = n1 - differences(n, min(n * 100 // percent, r), percent) // (k2 + 1)
        sigs = np.stack(sigs)
        out.append(sigs.ravel() if int(empty.any(axis=0).sum()) >= agree else sigs[~empty])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signatures(sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hk, bodies = batch.column(0).to_numpy(), batch.column(1)
            sigs, owner, held = [], [], 0
            for i in range(batch.num_rows):
                sigs.append(partenum(_unpacked(bodies[i].as_py()), percent))
                owner.append(i)
                held += len(sigs[-1])
                if held > 500_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(hk[owner], [len(x) for x in sigs]))], names=["sig", "hk"])
                    sigs, owner, held = [], [], 0

    return sets.select("hk", "body").mapInArrow(tidy(run), "sig bigint, hk bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """(a, b, gap, linked) for pairs of hk: the Jaccard distance, and whether they link."""
    right = pairs.join(sets.select(F.col("hk").alias("b"), F.col("body").alias("sb")), "b")
    both = right.join(sets.select(F.col("hk").alias("a"), F.col("body").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            gap, linked = np.empty(batch.num_rows), np.empty(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = _unpacked(sa[i].as_py()), _unpacked(sb[i].as_py())
                ranked = np.sort(np.concatenate([x, y]))
                same = int((ranked[1:] == ranked[:-1]).sum())
                union = len(x) + len(y) - same
                gap[i], linked[i] = 1 - same / union, 100 * same >= percent * union
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gap), pa.array(linked)], names=["a", "b", "gap", "linked"])

    return written(both.mapInArrow(tidy(run), "a bigint, b bigint, gap double, linked boolean"), name)


def _open_pairs(members: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """(a, b, ca, cb): hub and member of the groups that have more than one component yet, with those components."""
    tagged = members.join(label.select(F.col("node").alias("hk"), F.col("component").alias("c")), "hk", "left").select("sig", "hk", "hub", F.coalesce("c", "hk").alias("c"))
    mixed = tagged.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.when(F.col("hk") == F.col("hub"), F.col("c"))).alias("ca")).filter("low <> high")
    return written(tagged.filter("hk <> hub").join(mixed, "sig").select(F.col("hub").alias("a"), F.col("hk").alias("b"), "ca", F.col("c").alias("cb")).distinct(), name)


def _as_links(pairs: DataFrame) -> DataFrame:
    return pairs.filter("linked").select("a", "b")


def _labels(links: DataFrame) -> DataFrame:
    """(node, component) as hk; a component is named by its foremost node, as hubs have the largest hk."""
    found = components(links.select((-F.col("a")).alias("u"), (-F.col("b")).alias("v")))
    return found.select((-F.col("node")).alias("node"), (-F.col("component")).alias("component"))


def _node_components(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component), as hk, of the nodes that link with any other."""
    sigs = _signatures(sets, percent)
    hubs = sigs.groupBy("sig").agg(F.max("hk").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    # Nodes that share a signature meet at its hub: a row for each member, never all pairs of a group.
    members = written(sigs.join(hubs, "sig"), "jaccard-members")
    # First every node with the foremost of its hubs: mostly that settles its component.
    foremost = members.filter("hk <> hub").groupBy(F.col("hk").alias("b")).agg(F.max("hub").alias("a"))
    first = _verified(foremost, sets, percent, "jaccard-first")
    label = _labels(_as_links(first))
    # Then with the hubs of those groups that are not of one component.
    open_ = _open_pairs(members, label, "jaccard-open").filter("ca <> cb").select("a", "b")
    second = _verified(open_.join(first.select("a", "b"), ["a", "b"], "left_anti"), sets, percent, "jaccard-second")
    links = _as_links(first).unionByName(_as_links(second))
    label = _labels(links)
    # What is left: members of still open groups, outside their hub's component, against the hub's other members.
    spokes = _open_pairs(members, label, "jaccard-spokes")
    gaps = first.select("a", "b", "gap").unionByName(second.select("a", "b", "gap"))
    hubs_of = spokes.groupBy("b").agg(F.collect_set("a").alias("hubs"))
    about = hubs_of.join(sets.select(F.col("hk").alias("b"), "n", "profile"), "b")
    spokes = written(spokes.join(gaps, ["a", "b"], "left").join(about, "b"), "jaccard-about")
    fields = ("b", "gap", "cb", "hubs", "n", "profile")
    apart = spokes.filter("ca <> cb").select("a", *[F.col(c).alias(f"{c}_y") for c in fields])
    near = spokes.select("a", *[F.col(c).alias(f"{c}_x") for c in fields], (F.col("ca") != F.col("cb")).alias("out"))
    most = (100 - percent) / 100 + 1e-9
    apart_by = F.aggregate(F.zip_with("profile_x", "profile_y", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda acc, d: acc + d)
    condition = (
        (near["a"] == apart["a"])
        & (F.col("cb_x") != F.col("cb_y"))
        & (~F.col("out") | (F.col("b_x") < F.col("b_y")))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & (F.col("gap_x").isNull() | F.col("gap_y").isNull() | (F.abs(F.col("gap_x") - F.col("gap_y")) <= most))
        # compared before: one is a hub of the other
        & ~F.array_contains("hubs_x", F.col("b_y"))
        & ~F.array_contains("hubs_y", F.col("b_x"))
        # a pair is met under each hub that both have, and taken under the last
        & (F.array_max(F.array_intersect("hubs_x", "hubs_y")) == near["a"])
        & ((100 + percent) * apart_by <= (100 - percent) * (F.col("n_x") + F.col("n_y")))
    )
    rest = near.join(apart, condition).select(F.greatest("b_x", "b_y").alias("a"), F.least("b_x", "b_y").alias("b")).distinct()
    third = _verified(rest, sets, percent, "jaccard-third")
    more = _as_links(third)
    return _labels(links.unionByName(more)) if more.limit(1).count() else label


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id (an integer), n_shingles, component_id.

    component_id is the smallest id that the document reaches by links, itself included. Null or
    word-less text has an empty set, links with nothing and is its own component; so is every document
    without a similar one. Rows with a null id are reported with a null component and link with nothing.
    Ids are taken to be unique; rows that repeat an id and text have equal sets and thus one component.
    Sets are of 64-bit hashes of the bytes of shingles, and overlaps are counted on all of those bits.
    Other columns are not read.
    """
    if not isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError(f"{id_col} must be an integer")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = document_sets(docs, length)
    candidate = table.filter(f"id is not null and n > 0 and 100 * shared >= {percent} * n")
    # hk orders nodes by how common their shingles are, then by a hash of the node: 20 + 43 bits.
    rank = F.least(F.floor(F.max("weight") / F.max("n") * 32768), F.lit((1 << 20) - 1)).cast("long")
    nodes = candidate.groupBy("hi", "lo", "n").agg(F.min("id").alias("node"), rank.alias("rank"))
    nodes = written(nodes.select("hi", "lo", "n", "node", (F.shiftleft("rank", 43) + F.shiftrightunsigned(F.xxhash64("node", "hi", "lo"), 21)).alias("hk")), "jaccard-nodes")
    sets = _node_sets(docs, nodes, length)
    label = _node_components(sets, percent)
    of = nodes.join(label.select(F.col("node").alias("k"), F.col("component").alias("ck")), F.col("hk") == F.col("k"), "left")
    of = of.withColumn("ck", F.coalesce("ck", "hk"))
    least = of.groupBy("ck").agg(F.min("node").alias("component_id"))
    of = written(of.join(least, "ck").select("hi", "lo", "n", "component_id"), "jaccard-components")
    out = table.join(of, ["hi", "lo", "n"], "left")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))).cast(df.schema[id_col].dataType).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one document, that of the smallest id, of each component; columns unchanged. Rows with a null id stay."""
    gone = similar_components(df, id_col, text_col, **options).filter(f"`{id_col}` <> component_id").select(F.col(id_col).alias("__id"))
    return without_ids(df, id_col, gone)
