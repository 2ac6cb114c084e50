"""Queries of the small functions, a group of them at a time, and of choices, defaults and samples. With their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import arrays, jsonio, text
from cuesheet.operators import aggregates, batching, manifests, timeline
from cuesheet.plans.texts import _U, _u, _vectors
from cuesheet.plans.views import FRAMES, frames
from cuesheet.session import table

# -- texts -------------------------------------------------------------------------------------


def path_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    windows = F.concat(F.lit("C:"), F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "/", r"\\"))
    return p.select("page_id", text.unix_path(windows).alias("mounted"), text.unix_path(F.regexp_replace(F.substring("url", 9, 1000), "/", r"\\")).alias("turned"), text.stem(F.concat("url", F.lit(".tar.gz"))).alias("stem"), text.speaker_of(F.concat(F.lit("spk"), F.col("page_id").cast("string"), F.lit("_12_3"))).alias("speaker"), text.remove_tags(F.concat(F.lit("[SPK]a[FIL][fil]"), F.col("page_id").cast("string"), F.lit("[SPK]"))).alias("untagged"))


PATH_HELPERS = r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)
SELECT page_id, '/mnt/c' || regexp_replace(url, '^https?:/', '') AS mounted, substr(url, 9) AS turned, regexp_extract(url || '.tar.gz', '([^/]*)\.gz$', 1) AS stem, 'spk' || page_id AS speaker, 'a[fil]' || page_id AS untagged FROM p"""


def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    tqdm = F.concat(F.floor("value").cast("string"), F.lit("%|## | 3/9 [00:01, 2.5"), F.when(F.col("event_id") % 2 == 0, "it/s]").otherwise("s/it]"))
    out = F.concat(F.lit("out_time_ms="), F.floor(F.col("value") * 1e6).cast("bigint").cast("string"))
    total = F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.lit(250.0))
    return e.select(
        "event_id",
        text.percent_done(tqdm).alias("percent"),
        _u(text.out_time_share(out, total)).alias("share_u"),
        arrays.progress(F.col("value"), total).alias("progress"),
        _u(arrays.retime(F.col("value"), total)).alias("retime_u"),
        arrays.even_size(F.col("user_id"), 3).alias("even"),
    )


PROGRESS_LINES = f"""WITH e AS (SELECT event_id, value, user_id, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE 250.0::DOUBLE END AS t FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS INT) END AS percent, CASE WHEN t > 0 THEN {_U.format('least(CAST(floor(value * 1e6) AS BIGINT) / 1e6::DOUBLE / t, 1.0::DOUBLE)')} END AS share_u,
  CASE WHEN t > 0 THEN CAST(least(trunc(value / t * 100), 99) AS INT) ELSE 0 END AS progress, {_U.format('CASE WHEN t > 0 AND value > 0 THEN value / t ELSE 1.0::DOUBLE END')} AS retime_u,
  CAST(user_id // 3 + (user_id // 3) % 2 AS INT) AS even FROM e"""


def han_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Han characters put before them: how many there are, and how long they take to say."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("好ab"), (F.col("doc_id") % 9).cast("int")), F.coalesce("text", F.lit(""))).alias("t"), "n_chars")
    return d.select("doc_id", text.count_han(F.col("t")).alias("han"), _u(text.least_duration(F.col("t"))).alias("least_u"), text.much_shorter(F.substring("t", 1, 40), F.col("t")).alias("short"), text.all_parts(F.concat(F.lit("Sakura-"), F.col("t")), ["sakura", "好"]).alias("sakura"))


HAN_COUNTS = f"""WITH d AS (SELECT doc_id, repeat('好ab', CAST(doc_id % 9 AS INT)) || coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(doc_id % 9 AS INT) AS han, {_U.format('(doc_id % 9) * 0.1::DOUBLE + 0.3::DOUBLE')} AS least_u, least(40, length(t)) < 0.5 * length(t) AS short, doc_id % 9 > 0 AS sakura FROM d"""


def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    whole = F.concat(F.lit(" <|im_start|> "), F.md5("text"), F.lit("<|im_end|>\n</im_end>"))
    quoted = F.concat(F.lit("“("), F.md5("text"), F.lit(")” '（x）'"))
    return c.select("conv_id", "turn", text.strip_chat_tokens(whole).alias("bare"), text.strip_quotes(F.concat("role", quoted)).alias("full_text"), text.answer_or_blank(F.when(F.col("turn") % 2 == 0, F.lit(" \n")).otherwise("x"), F.col("role")).alias("answer"))


CHAT_TOKENS = "SELECT conv_id, turn, md5(text) AS bare, role || md5(text) || ' x' AS full_text, CASE WHEN turn % 2 = 0 THEN '' ELSE role END AS answer FROM conversations"


def escaped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with the delimiter in them, escaped, joined and split again; and a template filled with them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.substring("c_name", 1, 4), F.lit(","), F.col("c_custkey").cast("string")).alias("a"), F.col("c_mktsegment").alias("b"))
    joined = F.concat_ws(",", F.regexp_replace("a", ",", r"\\,"), F.lit(""), "b")
    template = F.concat(F.lit("$name-${name}-$names-$other: "), F.col("c_custkey").cast("string"), F.lit(" $port"))
    return c.select("c_custkey", F.array_join(text.split_escaped(joined, ","), "|").alias("parts"), text.fill_template(template, {"name": "a$b", "port": "80"}).alias("filled"))


ESCAPED_PARTS = "SELECT c_custkey, left(c_name, 4) || ',' || c_custkey || '||' || c_mktsegment AS parts, 'a$b-a$b-$names-$other: ' || c_custkey || ' 80' AS filled FROM customer"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per token of the benchmark's texts."""
    return text.token_rows(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text").select("item_id", "place", "token")


TOKEN_ROWS = r"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, CAST(i - 1 AS INT) AS place, w[i] AS token FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)"""


def odd_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists with pieces among them that are none: the ids, and what is reported."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.lit("<|s_7|>"), F.lit("<|x|>"), F.concat(F.lit("<|s_"), F.col("vec_id").cast("string"), F.lit("|>")), F.lit("s_3")).alias("t"))
    return e.select("vec_id", F.array_join(F.transform(text.ids_of_tokens(F.col("t")), lambda x: x.cast("string")), ",").alias("ids"), F.array_join(text.unexpected_tokens(F.col("t")), " ").alias("odd"))


ODD_TOKENS = "SELECT vec_id, '7,' || vec_id AS ids, '<|x|> s_3' AS odd FROM embeddings"


def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters rounded half to even, and to tens; stripped text beside them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") / 4).alias("q"), "o_orderstatus")
    return o.select("o_orderkey", text.half_even(F.col("q")).alias("whole"), text.half_even(F.col("q") * 10, -1).alias("tens"), text.strip(F.concat(F.lit("　 \t"), "o_orderstatus", F.lit("\n"))).alias("status"))


ROUNDED_VALUES = "SELECT o_orderkey, CAST(round_even(o_orderkey / 4.0::DOUBLE, 0) AS DOUBLE) AS whole, CAST(round_even(o_orderkey / 4.0::DOUBLE, 0) * 10 AS DOUBLE) AS tens, o_orderstatus AS status FROM orders"


def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    first = F.create_map(F.lit("name"), F.col("c_name"), F.lit("key"), F.col("c_custkey").cast("string"))
    second = F.create_map(F.lit("key"), F.lit("new"), F.lit("segment"), F.col("c_mktsegment"))
    m = c.select("c_custkey", jsonio.merge_objects(first, F.when(F.col("c_custkey") % 2 == 0, second).otherwise(F.create_map().cast("map<string,string>"))).alias("m"))
    return m.select("c_custkey", F.size("m").alias("n"), F.col("m")["name"].alias("name"), F.col("m")["key"].alias("key"), F.try_element_at("m", F.lit("segment")).alias("segment"))


MAP_MERGE = """SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS INT) AS n, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE CAST(c_custkey AS VARCHAR) END AS key,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer"""


# -- choices and defaults ----------------------------------------------------------------------


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first available of a priority list where the preferred is not there, and the preferred where it is."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    first = n.agg(F.max("name")).first()[0]
    return manifests.preferred(n, "name", "nowhere", ["nobody", "FRANCE", "CHINA", first], required=True).withColumn("asked", F.lit("nowhere")).unionByName(manifests.preferred(n, "name", first, ["FRANCE"]).withColumn("asked", F.lit("last"))).unionByName(manifests.preferred(n, "name", None, ["nobody"]).withColumn("asked", F.lit("nothing")))


MODEL_CHOICE = """SELECT coalesce(max(n_name) FILTER (WHERE n_name = 'FRANCE'), max(n_name) FILTER (WHERE n_name = 'CHINA'), max(n_name)) AS name, 'nowhere' AS asked FROM nation
UNION ALL SELECT max(n_name), 'last' FROM nation"""


def default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents, one default row for each without; and one row for a table that is empty."""
    d = table(spark, sf_dir, "documents")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    per = manifests.default_per_key(d.select("doc_id", "n_chars"), rows, ["doc_id"], {"quality": F.when(F.col("n_chars") > 100, -1).otherwise(-2)})
    whole = d.select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit(0).alias("quality")).limit(1)
    none = manifests.default_if_empty(rows.filter("quality > 5"), whole)
    return per.unionByName(none).unionByName(manifests.default_if_empty(rows.limit(0), whole.limit(0)))


DEFAULT_ROWS = """SELECT doc_id, CAST(coalesce(quality, CASE WHEN n_chars > 100 THEN -1 ELSE -2 END) AS INT) AS quality FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT -1, 0"""


def usable_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without an error whose file is there; a fallback row where none is."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("path"), F.when(F.col("o_orderkey") % 3 == 0, "failed").alias("error"))
    files = o.filter("o_orderkey % 7 = 1").select("path")
    fallback = o.limit(1).select(F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("whole").alias("path"), F.lit(None).cast("string").alias("error"))
    return manifests.usable_audio(o, files, "path", "error", fallback).unionByName(manifests.usable_audio(o.filter("error is not null"), files, "path", "error", fallback)).select("o_orderkey", "path")


USABLE_AUDIO = """SELECT o_orderkey, 'f' || (o_custkey % 50) AS path FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 50 IN (SELECT o_custkey % 50 FROM orders WHERE o_orderkey % 7 = 1)
UNION ALL SELECT -1, 'whole'"""


def recording_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings of up to 49 seconds: those below 45, and no tokens of any over 30."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("s"), F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int")).alias("t"))
    return batching.below(e, F.col("s"), 45.0).select("event_id", F.size(batching.capped_tokens(F.col("t"), F.col("s"))).alias("tokens"))


RECORDING_CAPS = "SELECT event_id, CAST(CASE WHEN value / 10 > 30 THEN 0 ELSE event_id % 4 + 1 END AS INT) AS tokens FROM events WHERE value / 10 < 45"


def rate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that would have to be resampled from under 16 kHz go; their request sizes for the others."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.element_at(F.array(F.lit(8000), F.lit(16000), F.lit(22050), F.lit(12000)), (F.col("event_id") % 4 + 1).cast("int")).alias("rate"), "event_type")
    kept = batching.resample_filter(e, F.col("rate"), 12000)
    low, high = arrays.decode_bounds(F.col("value"))
    samples = arrays.padded_samples(F.col("value"), F.lit("ten chars."), F.col("event_type"), 16000, 10)
    return kept.select("event_id", "rate", low.alias("low"), high.alias("high"), samples.cast("bigint").alias("samples"))


RATE_FILTER = """WITH e AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 8000 WHEN 1 THEN 16000 WHEN 2 THEN 22050 ELSE 12000 END AS rate FROM events)
SELECT event_id, CAST(rate AS INT) AS rate, CAST(trunc(value * 2.0::DOUBLE) AS INT) AS low, CAST(trunc(value * 20.0::DOUBLE) AS INT) AS high,
  CAST(160000 * (CAST(trunc(value / 10 * length(event_type) + value) AS BIGINT) // 10 + 1) AS BIGINT) AS samples FROM e WHERE NOT (rate <> 12000 AND rate < 16000)"""


def smallest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.octet_length("html").alias("size"), "page_id")
    return batching.smallest(p, ["host"], "size", "page_id").select("host", "page_id")


SMALLEST_FILES = "SELECT host, page_id FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]*)', 1) ORDER BY strlen(html), page_id) AS k FROM pages) WHERE k = 1"


def completed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*[x for k in range(5) for x in (F.lit(f"s{k}"), F.when(F.col("c_custkey") % (k + 2) == 0, "done").otherwise("ready"))])
    return table(spark, sf_dir, "customer").select("c_custkey", aggregates.completed(state).alias("done"))


COMPLETED_STEPS = "SELECT c_custkey, CAST(len(list_filter([2, 3, 4, 5, 6], lambda k: c_custkey % k = 0)) AS INT) AS done FROM customer"


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent errors between neighbouring market segments, in the report's order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 1).alias("r"))
    pairs = c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("r").alias("h")), "c_custkey")
    top = aggregates.ordered_errors(aggregates.error_table(pairs, "r", "h")).limit(10)
    return top.select("op", "ref_part", "hyp_part", "n")


ERROR_REPORT = """WITH c AS (SELECT c_custkey AS k, left(c_mktsegment, 1) AS r FROM customer)
SELECT CASE WHEN a.r = b.r THEN 'cor' ELSE 'sub' END AS op, a.r AS ref_part, b.r AS hyp_part, count(*) AS n FROM c a JOIN c b ON b.k = a.k + 1 GROUP BY ALL ORDER BY n DESC, ref_part DESC, hyp_part DESC LIMIT 10"""


def merged_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring errors as one: a letter against two of the next customer's, between equal marks."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("1"), F.substring("c_mktsegment", 1, 1), F.lit("2")).alias("r"), F.concat(F.lit("1"), F.substring("c_mktsegment", 1, 2), F.lit("2")).alias("h"))
    pairs = c.select("c_custkey", "r").join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), "h"), "c_custkey")
    return aggregates.error_table(pairs, "r", "h", combine=True)


MERGED_ERRORS = """WITH p AS (SELECT left(a.c_mktsegment, 1) AS r, left(b.c_mktsegment, 1) AS x, substr(b.c_mktsegment, 2, 1) AS y FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1),
e AS (SELECT unnest(CASE WHEN r = x THEN [('cor', '1', '1'), ('cor', r, x), ('ins', '', y), ('cor', '2', '2')] WHEN r = y THEN [('cor', '1', '1'), ('ins', '', x), ('cor', r, y), ('cor', '2', '2')]
  ELSE [('cor', '1', '1'), ('sub', r, x || y), ('cor', '2', '2')] END) AS e FROM p)
SELECT e[1] AS op, e[2] AS ref_part, e[3] AS hyp_part, count(*) AS n FROM e GROUP BY ALL"""


# -- samples -----------------------------------------------------------------------------------

_ORDER = "CAST('0x' || left(md5('{0}:' || {1}), 15) AS BIGINT)"


def epoch_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of one epoch dealt to three ranks of two workers; and the nations to more workers than there are."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"))
    n = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("utt"))
    return batching.epoch_rows(d, "utt", 3, 1, 3, 2).unionByName(batching.epoch_rows(n, "utt", 0, 0, 4, 3, shuffle=False)).select("utt", "epoch_idx", F.col("rank").cast("bigint").alias("rank"), F.col("worker").cast("bigint").alias("worker"))


EPOCH_SHARDS = f"""WITH d AS (SELECT doc_id AS utt, row_number() OVER (ORDER BY {_ORDER.format('3/1', 'doc_id')}, doc_id) - 1 AS i FROM documents)
SELECT utt, i AS epoch_idx, i % 3 AS rank, i // 3 % 2 AS worker FROM d
UNION ALL SELECT * FROM (VALUES (0, 0, 0, 0), (4, 4, 0, 1), (0, 0, 0, 2), (1, 1, 1, 0), (1, 1, 1, 1), (1, 1, 1, 2), (2, 2, 2, 0), (2, 2, 2, 1), (2, 2, 2, 2), (3, 3, 3, 0), (3, 3, 3, 1), (3, 3, 3, 2)) v(utt, epoch_idx, rank, worker)"""


def seeded_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coin for every document, a random crop of its length, and whether it is the one picked."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sequence(F.lit(1), (F.col("n_chars") % 50 + 1).cast("int")).alias("v"))
    one = batching.pick_one(d, 5, "doc_id").select("doc_id", F.lit(True).alias("picked"))
    return d.join(one, "doc_id", "left").select("doc_id", batching.coin(7, 0.5, F.col("doc_id")).alias("coin"), batching.random_start(F.col("v"), 20, 9, F.col("doc_id")).alias("start"), F.coalesce("picked", F.lit(False)).alias("picked"))


SEEDED_PICKS = f"""SELECT doc_id, {_ORDER.format(7, 'doc_id')} % 1073741824 < 536870912 AS coin, CAST({_ORDER.format(9, 'doc_id')} % greatest(n_chars % 50 + 1 - 20 + 1, 1) AS INT) AS start,
  doc_id = (SELECT doc_id FROM documents ORDER BY {_ORDER.format(5, 'doc_id')}, doc_id LIMIT 1) AS picked FROM documents"""


def sampled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token drawn from the top-p prefix of each embedding's values; one that the history repeats is drawn again."""
    f = frames(spark, sf_dir).withColumns({"w": F.col("x") * 20, "recent": F.when(F.col("vec_id") % 2 == 0, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array().cast("array<int>"))})
    return batching.sample_token(f.select("vec_id", "idx", "w", "recent"), ["vec_id"], "w", "idx", F.col("recent"), 11, window=64, share=1 / 64)


SAMPLED_TOKENS = f"""WITH {FRAMES}, e AS (SELECT vec_id, idx, x * 20 AS w, exp(x * 20 - max(x * 20) OVER (PARTITION BY vec_id)) AS e FROM frame),
s AS (SELECT vec_id, idx, w, e, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, idx) AS rank, coalesce(sum(share) OVER (PARTITION BY vec_id ORDER BY w DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s),
p AS (SELECT *, sum(share) OVER (PARTITION BY vec_id ORDER BY rank) AS c, sum(share) OVER (PARTITION BY vec_id) AS a FROM r WHERE rank <= 25 AND b < 0.8),
one AS (SELECT vec_id, arg_min(idx, rank) AS idx FROM p WHERE c > {_ORDER.format('11/1', 'vec_id')} / 1152921504606846976.0::DOUBLE * a GROUP BY vec_id),
o AS (SELECT e.vec_id, e.idx, exp(w - max(w) OVER (PARTITION BY e.vec_id)) AS share FROM e JOIN one ON e.vec_id = one.vec_id AND e.idx <> one.idx WHERE e.vec_id % 2 = 0),
q AS (SELECT *, sum(share) OVER (PARTITION BY vec_id ORDER BY idx) AS c, sum(share) OVER (PARTITION BY vec_id) AS a FROM o),
two AS (SELECT vec_id, min(idx) AS idx FROM q WHERE c > {_ORDER.format('11/2', 'vec_id')} / 1152921504606846976.0::DOUBLE * a GROUP BY vec_id)
SELECT vec_id, CAST(idx AS INT) AS idx, false AS redrawn FROM one WHERE vec_id % 2 = 1 UNION ALL SELECT vec_id, CAST(idx AS INT), true FROM two"""


def doubled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("chosen"), (-F.col("o_custkey")).alias("rejected"))
    return batching.doubled(o, "chosen", "rejected", "speech")


DOUBLED_ROWS = "SELECT o_orderkey, o_custkey AS speech, false AS is_rejected FROM orders UNION ALL SELECT o_orderkey, -o_custkey, true FROM orders"


def overlapping_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 30 seconds that overlap by half a second, of documents that take a quarter second a character."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return timeline.overlapping_cuts(d, F.col("n_chars") / 4.0, 30.0, 0.5).select("doc_id", F.col("index").cast("bigint").alias("cut_index"), "cut_start", "cut_length")


OVERLAPPING_CUTS = """WITH RECURSIVE c AS (SELECT doc_id, n_chars / 4.0::DOUBLE AS t, CAST(1 AS BIGINT) AS cut_index, 0.0::DOUBLE AS cut_start FROM documents WHERE n_chars > 0
  UNION ALL SELECT doc_id, t, cut_index + 1, cut_index * 29.5::DOUBLE FROM c WHERE cut_start + 30 < t)
SELECT doc_id, cut_index, cut_start, least(30.0::DOUBLE, t - cut_start) AS cut_length FROM c"""


# -- arrays ------------------------------------------------------------------------------------


def mono_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of unequal length as one, padded to whole blocks; its middle and its head."""
    v = _vectors(spark, sf_dir)
    mono = arrays.downmix(F.array("v", F.slice("v", 1, (F.col("vec_id") % 30 + 20).cast("int"))))
    out = v.withColumn("m", F.transform(mono, lambda x: x * 2))
    return out.select("vec_id", F.size("m").alias("n"), F.size(arrays.pad_to_multiple(F.col("m"), 16)).alias("n_padded"), _u(arrays.total(arrays.middle(F.col("m"), 25))).alias("middle_u"), _u(arrays.total(arrays.head(F.col("m"), 10))).alias("head_u"), _u(arrays.seconds_of(F.size("m"), 16, F.lit(1.5))).alias("seconds_u"))


MONO_PARTS = f"""WITH {FRAMES}, m AS (SELECT vec_id, idx, x * 2 AS x, vec_id % 30 + 20 AS n FROM frame WHERE idx < vec_id % 30 + 20)
SELECT vec_id, CAST(n AS INT) AS n, CAST((n + 15) // 16 * 16 AS INT) AS n_padded, {_U.format('sum(x ORDER BY idx) FILTER (WHERE n <= 25 OR (idx >= (n - 25) // 2 AND idx < (n - 25) // 2 + 25))')} AS middle_u,
  {_U.format('sum(x ORDER BY idx) FILTER (WHERE idx < 10)')} AS head_u, {_U.format('n / 16.0::DOUBLE + 1.5::DOUBLE')} AS seconds_u FROM m GROUP BY vec_id, n"""


def joined_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and speech parts without their padding, one after the other, padded again."""
    n = (F.col("vec_id") % 7).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", n.alias("n"), arrays.pad_right(F.sequence(F.lit(1), F.col("vec_id").cast("int") % 7 + 1), F.lit(10), F.lit(0)).alias("a"), F.array_repeat(F.lit(9), 5).alias("b"))
    joined = arrays.unpad_concat([(F.col("a"), F.col("n")), (F.col("b"), F.col("n") % 3)], F.lit(12), F.lit(-1))
    return e.select("vec_id", F.array_join(F.transform(joined, lambda x: x.cast("string")), ",").alias("joined"))


JOINED_SEQUENCES = """SELECT vec_id, array_to_string(list_concat(list_concat(range(1, vec_id % 7 + 1), list_transform(range(0, vec_id % 7 % 3), lambda i: 9)), list_transform(range(0, 12 - vec_id % 7 - vec_id % 7 % 3), lambda i: -1)), ',') AS joined FROM embeddings"""


def speech_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label laid on silence, each at its own time."""
    e = table(spark, sf_dir, "embeddings").select("label", ((F.col("vec_id") % 30) * 2.5).alias("start"), F.col("embedding").alias("wave"))
    return arrays.speech_track(e, ["label"], 10).select("label", F.col("pos").cast("int").alias("pos"), _u(F.col("x")).alias("x_u"))


SPEECH_TRACK = f"""WITH {FRAMES}, s AS (SELECT label, CAST((vec_id % 30) * 2.5::DOUBLE * 10 AS INT) + idx AS pos, sum(x) AS s FROM frame GROUP BY 1, 2)
SELECT label, CAST(pos AS INT) AS pos, {_U.format('s / max(abs(s)) OVER (PARTITION BY label) * 0.85::DOUBLE')} AS x_u FROM s"""


def pcm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as 16-bit samples and back; those out of range are cut."""
    v = _vectors(spark, sf_dir).withColumn("o", arrays.from_pcm16(arrays.to_pcm16(F.transform("v", lambda x: x * 4))))
    return v.select("vec_id", F.posexplode("o").alias("idx", "y")).select("vec_id", "idx", F.floor(F.col("y").cast("double") * 32768 + 0.5).cast("bigint").alias("sample"))


PCM_SAMPLES = f"WITH {FRAMES} SELECT vec_id, CAST(idx AS INT) AS idx, CAST(trunc(least(greatest(x * 4 * 32768, -32768), 32767)) AS BIGINT) AS sample FROM frame"


def face_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", *[(F.col("o_custkey") * k % 400).cast("int").alias(n) for n, k in (("y", 7), ("x", 11), ("h", 3), ("w", 5))])
    box = arrays.square_crop(F.col("y"), F.col("y") + F.col("h"), F.col("x"), F.col("x") + F.col("w"), F.lit(480), F.lit(640))
    return s.select("o_orderkey", box.alias("b")).select("o_orderkey", "b.*")


FACE_CROPS = """WITH s AS (SELECT o_orderkey, o_custkey * 7 % 400 AS y, o_custkey * 11 % 400 AS x, o_custkey * 3 % 400 AS h, o_custkey * 5 % 400 AS w FROM orders),
c AS (SELECT o_orderkey, greatest(h, w) * 1.4::DOUBLE / 2 AS r, (y + y + h) / 2.0::DOUBLE AS cy, (x + x + w) / 2.0::DOUBLE AS cx FROM s)
SELECT o_orderkey, CAST(greatest(0, trunc(cy - r)) AS INT) AS y1, CAST(least(480, trunc(cy + r)) AS INT) AS y2, CAST(greatest(0, trunc(cx - r)) AS INT) AS x1, CAST(least(640, trunc(cx + r)) AS INT) AS x2 FROM c"""


def zipped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(0), (F.col("vec_id") % 9).cast("int")).alias("f"), F.sequence(F.lit(10), (F.col("vec_id") % 5 + 10).cast("int")).alias("c"))
    z = e.select("vec_id", F.posexplode(manifests.zip_shortest(F.col("f"), F.col("c"))).alias("pos", "z"))
    return z.select("vec_id", "pos", F.col("z.left").alias("frame"), F.col("z.right").alias("chunk"))


ZIPPED_FRAMES = "SELECT vec_id, CAST(i AS INT) AS pos, CAST(i AS INT) AS frame, CAST(i + 10 AS INT) AS chunk FROM (SELECT vec_id, unnest(range(0, least(vec_id % 9, vec_id % 5) + 1)) AS i FROM embeddings)"


def resampled_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at three halves of their rate, band-limited."""
    v = _vectors(spark, sf_dir).withColumn("o", arrays.resample(16000, 24000)(F.col("v")))
    return v.select("vec_id", F.posexplode("o").alias("idx", "y")).select("vec_id", "idx", (F.round(F.col("y").cast("double"), 4) + 0.0).alias("y"))


RESAMPLED_ARRAYS = f"""WITH {FRAMES}, w AS (SELECT vec_id, i, x, i * 2.0::DOUBLE / 3 - idx AS t FROM frame, (SELECT unnest(range(0, 96)) AS i))
SELECT vec_id, CAST(i AS INT) AS idx, round(CAST(CAST(sum(CASE WHEN abs(t) >= 6 / 0.99::DOUBLE THEN 0 ELSE x * 0.99::DOUBLE * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 0.99::DOUBLE * t) / (pi() * 0.99::DOUBLE * t) END * pow(cos(pi() * t * 0.99::DOUBLE / 12), 2) END) AS FLOAT) AS DOUBLE), 4) + 0.0 AS y
FROM w GROUP BY vec_id, i"""


def held_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate curve that holds before it decays, and the causal mask's rows."""
    s = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("step"))
    row = F.element_at(arrays.causal_mask(F.lit(25)), F.col("step").cast("int"))
    return s.select("step", _u(arrays.rate_curve("hold", F.col("step"), 1.0, 30, 0.05, 4, 0.5, 10)).alias("hold_u"), F.size(F.filter(row, lambda x: x)).alias("seen"))


HELD_RATE = f"SELECT n_nationkey + 1 AS step, {_U.format('greatest(2.0::DOUBLE / pow(greatest(1.0::DOUBLE, n_nationkey + 1 - 10), 0.5), 0.05::DOUBLE)')} AS hold_u, CAST(n_nationkey + 1 AS INT) AS seen FROM nation"

_NAMES = [
    path_helpers, progress_lines, han_counts, chat_tokens, escaped_parts, token_rows, odd_tokens, rounded_values, map_merge,
    model_choice, default_rows, usable_audio, recording_caps, rate_filter, smallest_files, completed_steps, error_report, merged_errors,
    epoch_shards, seeded_picks, sampled_tokens, doubled_rows, overlapping_cuts,
    mono_parts, joined_sequences, speech_track, pcm_samples, face_crops, zipped_frames, resampled_arrays, held_rate,
]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {name: globals()[name.upper()] for name in QUERIES}
