"""Queries of manifest joins, aggregations, sampling and batching, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import aggregates, batching, manifests
from cuesheet.plans.views import FRAMES, SEGMENTS, UTTERANCES, frames, segments, utterances
from cuesheet.session import table


def _u(col: Column) -> Column:
    """A double as whole millionths: comparisons need no tolerance."""
    return F.floor(col * 1e6 + 0.5).cast("bigint")


_U = "CAST(floor(({0}) * 1e6 + 0.5) AS BIGINT)"


# -- manifests ---------------------------------------------------------------------------------


def manifest_strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    utt = customer.select(F.col("c_custkey").alias("utt"), F.col("c_nationkey").alias("spk"))
    spk = nation.select(F.col("n_nationkey").alias("spk"), F.col("n_name").alias("spk_name"), F.col("n_regionkey").alias("grp"))
    grp = region.select(F.col("r_regionkey").alias("grp"), F.col("r_name").alias("grp_name"))
    return manifests.assemble(utt, [(spk, "spk"), (grp, "grp")]).select("utt", "spk_name", "grp_name")


MANIFEST_STRICT_JOIN = "SELECT c_custkey AS utt, n_name AS spk_name, r_name AS grp_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def manifest_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("utt"), "quality", "toxic")
    return manifests.assemble(utterances(spark, sf_dir).select("utt", "spk", "n"), [], [(labels, "utt")]).select("utt", "spk", "n", "quality", "toxic")


MANIFEST_LEFT_JOIN = f"WITH {UTTERANCES} SELECT utt, spk, n, quality, toxic FROM utt LEFT JOIN labels ON doc_id = utt"


def missing_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("utt"))
    return manifests.matched(utterances(spark, sf_dir).select("utt", "spk"), labels, ["utt"])[1]


MISSING_LABEL_ROWS = f"WITH {UTTERANCES} SELECT utt, spk FROM utt WHERE utt NOT IN (SELECT doc_id FROM labels)"


def spk2utt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of at most 100 utterances, so that one speaker of a third of all rows is many rows."""
    rows = batching.indexed(utterances(spark, sf_dir).select("utt", "spk"), ["spk"], ["utt"], F.floor(F.col("utt") / 4096))
    rows = rows.withColumn("part", F.floor(F.col("idx") / 100).cast("bigint"))
    lists = rows.groupBy("spk", "part").agg(F.array_sort(F.collect_list("utt")).alias("u"))
    return lists.select("spk", "part", F.array_join(F.transform("u", lambda x: x.cast("string")), " ").alias("utts"))


SPK2UTT = f"""WITH {UTTERANCES},
i AS (SELECT spk, utt, (row_number() OVER (PARTITION BY spk ORDER BY utt) - 1) // 100 AS part FROM utt)
SELECT spk, part, string_agg(CAST(utt AS VARCHAR), ' ' ORDER BY utt) AS utts FROM i GROUP BY spk, part"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    def stats(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("l_suppkey").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).cast("string").alias("ns"))
    before = stats(li.filter("l_returnflag = 'A'"))
    return manifests.snapshot_diff(stats(li), before, ["name"], ["n", "ns"])


SNAPSHOT_DIFF = """WITH a AS (SELECT l_suppkey AS name, count(*) AS n, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS ns FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey AS name, count(*) AS n, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS ns FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT name, a.n - coalesce(b.n, 0) AS n, a.ns - coalesce(b.ns, 0) AS ns FROM a LEFT JOIN b USING (name)"""


def guaranteed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("utt"), F.col("quality").alias("audio"), F.lit(None).cast("string").alias("error"))
    return manifests.guaranteed(utterances(spark, sf_dir).select("utt"), labels, ["utt"], "audio", "error", "no result")


GUARANTEED_ROWS = f"WITH {UTTERANCES} SELECT utt, quality AS audio, CASE WHEN doc_id IS NULL THEN 'no result' END AS error FROM utt LEFT JOIN labels ON doc_id = utt"


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return manifests.latest(e, ["user_id", "event_type"], ["us", "event_id"])


LATEST_STATE = "SELECT user_id, event_type, event_id, us FROM (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("info"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("info"))
    return manifests.upsert(c, s, ["id"])


REGISTRY_UPSERT = "SELECT s_suppkey AS id, s_name AS info FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"


def dedupe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), "page_id")
    return manifests.earliest(p, ["host"], ["page_id"])


DEDUPE_PATHS = "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1"


def lockstep_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("vec_id", "idx", "x", (F.col("x") > 0).alias("restore"))
    other = frames(spark, sf_dir).filter("idx % 2 = 0").select("vec_id", "idx", (-F.col("x")).alias("x"))
    return manifests.lockstep(f, f.select("vec_id", "idx").join(other, ["vec_id", "idx"], "left"), ["vec_id", "idx"], "restore", "x").select("vec_id", "idx", "x")


LOCKSTEP_CHOICE = f"WITH {FRAMES} SELECT vec_id, idx, CASE WHEN x > 0 AND idx % 2 = 0 THEN -x ELSE x END AS x FROM frame"


def static_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"en": "English", "fr": "French", "de": "German"}
    return table(spark, sf_dir, "documents").select("doc_id", manifests.mapped(F.col("lang"), names).alias("language"))


STATIC_DIMENSION = "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS language FROM documents"


def batch_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a batch and its results, joined back at the global index."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "n_chars")
    positions = d.select("index", F.floor(F.col("index") / 15).alias("grp"), (F.col("index") % 15).cast("int").alias("place"))
    results = d.groupBy(F.floor(F.col("index") / 15).alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "n_chars"))), lambda s: s["n_chars"]).alias("values"))
    return manifests.scatter(positions, results, "grp").select("index", F.col("value").alias("n_chars"))


BATCH_SCATTER = "SELECT doc_id AS index, n_chars FROM documents"


# -- aggregates --------------------------------------------------------------------------------


def group_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("embedding").alias("idx", "m")).select("label", "idx", _u(F.col("m")).alias("mean_u"))


GROUP_MEAN_VECTOR = f"WITH {FRAMES} SELECT label, CAST(idx AS INT) AS idx, {_U.format('avg(x)')} AS mean_u FROM frame GROUP BY label, idx"


def average_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("loss", F.col("embedding")[0].cast("double"))
    m = aggregates.average_best(e, "loss", "embedding", 5, "vec_id")
    return m.select(F.posexplode("embedding").alias("idx", "m")).select("idx", _u(F.col("m")).alias("mean_u"))


AVERAGE_BEST = f"WITH {FRAMES}, best AS (SELECT vec_id FROM embeddings ORDER BY embedding[1], vec_id LIMIT 5) SELECT CAST(idx AS INT) AS idx, {_U.format('avg(x)')} AS mean_u FROM frame JOIN best USING (vec_id) GROUP BY idx"


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    votes = d.withColumn("vote", F.when(F.col("quality") == 1, "female").when(F.col("quality") == 0, "male"))
    return aggregates.majority(votes, ["source", "lang"], "vote", "female", "male")


MAJORITY_VOTE = """SELECT source, lang, count(*) AS n_votes, count(*) FILTER (WHERE quality = 1) AS n_for,
  CASE WHEN 2 * count(*) FILTER (WHERE quality = 1) >= count(*) THEN 'female' ELSE 'male' END AS winner
FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY source, lang"""


def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("audio", F.col("value") > 20)
    return s.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("audio").alias("ok"),
        F.count_if(F.col("audio") & (F.col("who") == "male")).alias("male"),
        F.count_if(F.col("audio") & (F.col("who") == "female")).alias("female"),
        F.min("pos").alias("first_pos"),
    )


CONDITIONAL_COUNTS = f"""WITH {SEGMENTS} SELECT source, count(*) AS total, count(*) FILTER (WHERE value > 20) AS ok, count(*) FILTER (WHERE value > 20 AND who = 'male') AS male,
  count(*) FILTER (WHERE value > 20 AND who = 'female') AS female, min(pos) AS first_pos FROM segment GROUP BY source"""


def nested_length_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    files = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("segments"), F.when(F.max("turn") > 6, "too long").alias("error"))
    good = files.filter("error is null")
    return good.agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("segments").cast("bigint")).alias("segments"))


NESTED_LENGTH_SUM = "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS segments FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING max(turn) <= 6)"


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 1000).alias("s"))
    out = aggregates.latency_summary(e, ["event_type"], "s")
    return out.select("event_type", "n", *[_u(F.col(c)).alias(c.removesuffix("_ms") + "_u") for c in ("avg_ms", "variance_x1000", "p50_ms", "p90_ms", "p95_ms", "p99_ms")])


LATENCY_SUMMARY = "SELECT event_type, count(*) AS n, " + ", ".join(f"{_U.format(x)} AS {n}_u" for x, n in [("avg(value / 1000) * 1000", "avg"), ("var_pop(value / 1000) * 1000", "variance_x1000"), *[(f"quantile_cont(value / 1000, {q}) * 1000", f"p{int(q * 100 + 0.5)}") for q in (0.5, 0.9, 0.95, 0.99)]]) + " FROM events GROUP BY event_type"


def rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = segments(spark, sf_dir).groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).alias("c"), F.count(F.lit(1)).alias("n"))
    duration = F.when(F.col("user_id") % 10 == 0, F.lit(0.0)).otherwise(F.col("c") / 10.0)
    return g.select("user_id", aggregates.real_time_factor(F.col("n") / 4.0, duration).alias("rtf"))


RTF = f"""WITH {SEGMENTS}, g AS (SELECT user_id, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM segment GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'inf'::DOUBLE ELSE (n / 4.0::DOUBLE) / (c / 10.0::DOUBLE) END AS rtf FROM g"""


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint")
    return aggregates.weighted_mean(li, ["l_returnflag", "l_linestatus"], cents, F.col("l_quantity").cast("bigint"))


WEIGHTED_MEAN = """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * CAST(trunc(l_quantity) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS DOUBLE) AS weighted_mean
FROM lineitem GROUP BY ALL"""


def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("ref"))
    hyp = b.select((F.col("item_id") - 1).alias("item_id"), F.col("ref").alias("hyp"))
    return aggregates.error_rate(b.join(hyp, "item_id"), ["item_id"], "ref", "hyp")


#: The oracle's distance counts bytes, so other than ASCII characters are replaced on both sides.
CHAR_ERROR_RATE = r"""WITH b AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM benchmark)
SELECT a.item_id, CAST(levenshtein(a.t, b.t) AS BIGINT) AS errors, length(a.t) AS ref_chars, levenshtein(a.t, b.t) / length(a.t) AS rate FROM b a JOIN b ON b.item_id = a.item_id + 1"""


def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    return aggregates.error_table(b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("ref").alias("hyp")), "item_id"), "ref", "hyp", combine=True)


def masked_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.masked_accuracy(d, ["lang"], (F.col("n_chars") % 2).cast("int"), F.col("quality"), F.col("quality").isNull())


MASKED_ACCURACY = """SELECT lang, count(quality) AS n_counted, CAST(count(*) FILTER (WHERE quality IS NOT NULL AND n_chars % 2 = quality) AS DOUBLE) / nullif(count(quality), 0) AS accuracy
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""


def preference_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return aggregates.preference_rate(e, ["label"], F.col("embedding")[0], F.col("embedding")[1])


PREFERENCE_RATE = "SELECT label, avg(CASE WHEN embedding[1] > embedding[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM embeddings GROUP BY label"


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("batch_size")).agg(F.count_if(F.col("l_quantity") > 10).alias("count"), F.sum(F.col("l_partkey").cast("bigint") * 1000).alias("ns"))
    out = aggregates.batch_averages(o)
    return out.select("batch_size", "count", *[_u(F.col(c)).alias(c.replace("_ms", "_u")) for c in ("total_ms", "batch_ms", "sample_ms")])


BATCH_STATS = f"""WITH o AS (SELECT CAST(l_linenumber AS BIGINT) AS batch_size, count(*) FILTER (WHERE l_quantity > 10) AS count, CAST(sum(CAST(l_partkey AS BIGINT) * 1000) AS BIGINT) AS ns FROM lineitem GROUP BY 1)
SELECT batch_size, count, {_U.format('ns / 1e6')} AS total_u, {_U.format('ns / 1e6 / count')} AS batch_u, {_U.format('ns / 1e6 / count / batch_size')} AS sample_u FROM o WHERE count > 0"""


def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).alias("total_c"), F.coalesce(F.max(F.abs("value")), F.lit(0.0)).alias("peak"))


STAGE_TOTALS = "SELECT event_type, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total_c, coalesce(max(abs(value)), 0) AS peak FROM events GROUP BY event_type"


def cache_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest page `files` below the cached hosts, with readable sizes."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"), F.octet_length("html").cast("bigint").alias("size"))
    found = aggregates.inventory(p, "path", "size", ["http://*/en/*", "https://*/en/*", "https://*/fr/*"])
    return batching.top_n(found, 5, F.desc("size"), "path").select("path", "size", aggregates.format_size(F.col("size")).alias("label"))


CACHE_INVENTORY = r"""SELECT path, size, CASE WHEN size < 1024 THEN size || ' B' ELSE printf('%.1f KB', size / 1024.0::DOUBLE) END AS label
FROM (SELECT regexp_replace(url, '[?#].*$', '') AS path, max(strlen(html)) AS size FROM pages GROUP BY 1)
WHERE regexp_matches(path, '^http://[^/]*/en/[^/]*$') OR regexp_matches(path, '^https://[^/]*/(en|fr)/[^/]*$') ORDER BY size DESC, path LIMIT 5"""


# -- sampling and batching ---------------------------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.indexed(utterances(spark, sf_dir).select("utt", "spk", "n"), ["spk"], ["utt"], F.floor(F.col("utt") / 4096)).withColumn("idx", F.col("idx").cast("bigint"))


_INDEXED = f"{UTTERANCES}, ix AS (SELECT utt, spk, n, row_number() OVER (PARTITION BY spk ORDER BY utt) - 1 AS idx FROM utt)"


def seq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).cast("bigint").alias("tokens"))
    return batching.sequence_filter(d, F.floor(F.col("n_chars") / 2), F.col("tokens"), F.col("n_chars") % 7, max_length=2000, token_max=600, min_ratio=0.3, max_ratio=0.5)


SEQ_FILTER = """SELECT * FROM (SELECT doc_id, n_chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS tokens FROM documents)
WHERE n_chars // 2 BETWEEN 10 AND 2000 AND tokens BETWEEN 1 AND 600 AND n_chars % 7 > 0
  AND (n_chars // 2 = 0 OR tokens::DOUBLE / (n_chars // 2)::DOUBLE BETWEEN 0.3::DOUBLE AND 0.5::DOUBLE)"""


def bounded_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.bounded_sort(_indexed(spark, sf_dir), ["spk"], "n", "idx", 20).select("utt", "spk", F.col("sorted_idx").cast("bigint").alias("sorted_idx"))


BOUNDED_SORT = f"WITH {_INDEXED} SELECT utt, spk, idx // 20 * 20 + row_number() OVER (PARTITION BY spk, idx // 20 ORDER BY n, idx) - 1 AS sorted_idx FROM ix"


def static_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch(_indexed(spark, sf_dir), "static", ["spk"], "idx", size=16).groupBy("spk", "batch").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest"))


STATIC_BATCH = f"WITH {_INDEXED} SELECT spk, idx // 16 AS batch, count(*) AS rows, max(n) AS longest FROM ix GROUP BY 1, 2"


def dynamic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch(_indexed(spark, sf_dir), "dynamic", ["spk"], "idx", length="n", cap=12000).select("utt", "spk", "batch")


DYNAMIC_BATCH = f"""WITH RECURSIVE {_INDEXED},
f AS (
  SELECT spk, utt, idx, CAST(0 AS BIGINT) AS batch, n AS longest, CAST(1 AS BIGINT) AS k FROM ix WHERE idx = 0
  UNION ALL
  SELECT ix.spk, ix.utt, ix.idx, CASE WHEN greatest(f.longest, ix.n) * (f.k + 1) > 12000 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN greatest(f.longest, ix.n) * (f.k + 1) > 12000 THEN ix.n ELSE greatest(f.longest, ix.n) END,
    CASE WHEN greatest(f.longest, ix.n) * (f.k + 1) > 12000 THEN 1 ELSE f.k + 1 END
  FROM f JOIN ix ON ix.spk = f.spk AND ix.idx = f.idx + 1)
SELECT utt, spk, batch FROM f"""


def ntile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.with_split(_indexed(spark, sf_dir), ["spk"], "idx", 7).select("utt", "spk", "part")


NTILE_SPLIT = f"WITH {_INDEXED} SELECT utt, spk, CAST(ntile(7) OVER (PARTITION BY spk ORDER BY idx) AS INT) AS part FROM ix"


def rank_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _indexed(spark, sf_dir)
    return rows.filter(batching.rank_shard(F.col("idx"), F.lit(0), 1, 3, 0, 2)).select("utt", "spk")


RANK_SHARD = f"WITH {_INDEXED} SELECT utt, spk FROM ix WHERE idx % 3 = 1 AND (idx // 3) % 2 = 0"


def padded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, (F.col("vec_id") % 9 + 1).cast("int")).alias("v"), F.when(F.col("vec_id") % 50 > 0, F.col("label")).alias("extra"))
    out = batching.padded_batch(e.withColumn("batch", F.floor(F.col("vec_id") / 16)), ["batch"], "v", "vec_id", F.lit(0.0).cast("float"), ["extra"])
    return out.select("batch", F.array_join(F.transform("vec_id", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(F.transform("v_len", lambda x: x.cast("string")), ",").alias("lens"), F.size(F.flatten("v")).alias("cells"), F.size("extra").alias("n_extra"), F.md5(F.array_join(F.transform(F.flatten("v"), lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string")), ",")).alias("cells_md5"))


PADDED_BATCH = """WITH e AS (SELECT vec_id // 16 AS batch, vec_id, vec_id % 9 + 1 AS n, CASE WHEN vec_id % 50 > 0 THEN label END AS extra FROM embeddings),
x AS (SELECT e.batch, e.vec_id, e.n, i, CASE WHEN i < e.n THEN embedding[i + 1]::DOUBLE ELSE 0 END AS x FROM e JOIN embeddings USING (vec_id) JOIN (SELECT batch, max(n) AS m FROM e GROUP BY batch) USING (batch), (SELECT unnest(range(0, 9)) AS i) WHERE i < m),
c AS (SELECT batch, md5(string_agg(CAST(CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY n DESC, vec_id, i)) AS cells_md5 FROM x GROUP BY batch)
SELECT batch, any_value(cells_md5) AS cells_md5, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY n DESC, vec_id) AS ids, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC, vec_id) AS lens,
  CAST(count(*) * max(n) AS INT) AS cells, CASE WHEN count(extra) = count(*) THEN CAST(count(*) AS INT) END AS n_extra FROM e JOIN c USING (batch) GROUP BY batch"""


def topn_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.top_n(table(spark, sf_dir, "events").select("event_id", "value"), 10, "value", "event_id")


TOPN_LOSS = "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10"


def top_p_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("w", F.col("x") * 20)
    out = batching.top_p(f, ["vec_id"], "w", "idx")
    return out.select("vec_id", "idx", F.col("rank").cast("int").alias("rank"))


TOP_P_PREFIX = f"""WITH {FRAMES}, e AS (SELECT vec_id, idx, x * 20 AS w, exp(x * 20 - max(x * 20) OVER (PARTITION BY vec_id)) AS e FROM frame),
s AS (SELECT vec_id, idx, w, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM e),
r AS (SELECT vec_id, idx, row_number() OVER o AS rank, coalesce(sum(share) OVER (PARTITION BY vec_id ORDER BY w DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY w DESC, idx))
SELECT vec_id, CAST(idx AS INT) AS idx, CAST(rank AS INT) AS rank FROM r WHERE rank <= 25 AND b < 0.8"""


def repetition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 20).cast("int")).alias("t"))
    return e.select("vec_id", batching.repeated_lately("t", F.element_at("t", 1), 10, 0.2).alias("banned"))


REPETITION_COUNT = "SELECT vec_id, len(list_filter(embedding[55:64], lambda x: floor(x::DOUBLE * 20) = floor(embedding[1]::DOUBLE * 20))) >= 2 AS banned FROM embeddings"


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.shuffle_blocks(_indexed(spark, sf_dir), ["spk"], "idx", 7, 64).select("utt", "spk", F.col("shuffled_idx").cast("bigint").alias("shuffled_idx"))


SEEDED_SHUFFLE = f"WITH {_INDEXED} SELECT utt, spk, idx // 64 * 64 + row_number() OVER (PARTITION BY spk, idx // 64 ORDER BY CAST('0x' || left(md5('7:' || idx || ':' || spk), 15) AS BIGINT), idx) - 1 AS shuffled_idx FROM ix"


def crop_or_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform(F.slice("embedding", 1, (F.col("vec_id") % 60 + 1).cast("int")), lambda x: x.cast("double")))
    out = e.withColumn("c", batching.crop_or_pad(F.col("v"), 24, F.lit(3)))
    return out.select("vec_id", F.size("c").alias("n"), _u(F.aggregate("c", F.lit(0.0), lambda a, x: a + x)).alias("sum_u"))


CROP_OR_PAD = f"""WITH {FRAMES}, k AS (SELECT vec_id, x, idx FROM frame WHERE CASE WHEN vec_id % 60 + 1 > 24 THEN idx >= 3 AND idx < least(27, vec_id % 60 + 1) ELSE idx < vec_id % 60 + 1 END)
SELECT vec_id, CAST(CASE WHEN vec_id % 60 + 1 > 24 THEN count(*) ELSE 24 END AS INT) AS n, {_U.format('sum(x ORDER BY idx)')} AS sum_u FROM k GROUP BY vec_id"""


def routed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches worked on apart and put together by index again."""
    s = segments(spark, sf_dir).select("pos", "who")
    a = s.filter("who = 'female'").withColumn("voice", F.lit("f1"))
    b = s.filter("who <> 'female'").withColumn("voice", F.lit("m1"))
    return a.unionByName(b)


ROUTED_UNION = f"WITH {SEGMENTS} SELECT pos, who, CASE WHEN who = 'female' THEN 'f1' ELSE 'm1' END AS voice FROM segment"

_NAMES = [
    manifest_strict_join, manifest_left_join, missing_label_rows, spk2utt, snapshot_diff, guaranteed_rows, latest_state, registry_upsert, dedupe_paths, lockstep_choice, static_dimension, batch_scatter,
    group_mean_vector, average_best, majority_vote, conditional_counts, nested_length_sum, latency_summary, rtf, weighted_mean, char_error_rate, error_table, masked_accuracy, preference_rate, batch_stats, stage_totals, cache_inventory,
    seq_filter, bounded_sort, static_batch, dynamic_batch, ntile_split, rank_shard, padded_batch, topn_loss, top_p_prefix, repetition_count, seeded_shuffle, crop_or_pad, routed_union,
]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
