"""Queries of streams that are drained, of work per row on the way, and of planned runs. With their oracle SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.functions import slots
from cuesheet.operators import dag
from cuesheet.plans.files import _MESSAGES, _per_source, _put, message_lines
from cuesheet.plans.views import FRAMES, frames
from cuesheet.session import fresh_path, table
from cuesheet.streaming import events, tokens

_HOPS = tokens.Hops(8, 2, 32, 3, 4)


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each embedding as tokens of a request, which arrive in three files: the chunks that a stream sends."""
    f = frames(spark, sf_dir).select(F.col("vec_id").cast("string").alias("request"), F.col("idx").cast("long").alias("seq"), (F.floor(F.abs("x") * 1000) % 7).cast("int").alias("token"), (F.col("idx") == 63).alias("ended"))
    path, out = fresh_path(spark, "tokens"), fresh_path(spark, "chunks")
    for part in range(3):
        f.filter(F.floor(F.col("seq") / 25) == part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(path)
    events.drain(tokens.chunk_stream(stream, _HOPS, frozenset({0, 1, 2}), 2), out, fresh_path(spark, "tokens-state"))
    return spark.read.parquet(out).select("request", "chunk", "first", "last", "seen_to", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"), "final")


TOKEN_STREAM = f"""WITH RECURSIVE {FRAMES},
t AS (SELECT vec_id, idx, CAST(floor(abs(x) * 1000) AS INT) % 7 AS token FROM frame),
f AS (SELECT *, sum(CASE WHEN token > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY idx) AS run FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, run, token > 2 ORDER BY idx) AS k FROM f),
kept AS (SELECT vec_id, token, row_number() OVER (PARTITION BY vec_id ORDER BY idx) - 1 AS p FROM r WHERE token > 2 OR k <= 2),
n AS (SELECT vec_id, count(*) AS n FROM kept GROUP BY vec_id),
w AS (SELECT vec_id, n, 0 AS chunk, 0 AS a, 12 AS width, 16 AS hop FROM n
  UNION ALL SELECT vec_id, n, chunk + 1, a + width, hop, least(32, hop * 2) FROM w WHERE n - a >= width + 3),
c AS (SELECT *, n - a < width + 3 AS final, CASE WHEN n - a < width + 3 THEN n ELSE a + width END AS b FROM w)
SELECT CAST(vec_id AS VARCHAR) AS request, CAST(chunk AS INT) AS chunk, CAST(a AS INT) AS first, CAST(b AS INT) AS last, CAST(CASE WHEN final THEN b ELSE b + 3 END AS INT) AS seen_to,
  coalesce((SELECT string_agg(CAST(token AS VARCHAR), ',' ORDER BY p) FROM kept WHERE kept.vec_id = c.vec_id AND p >= a AND p < b), '') AS tokens, final FROM c"""


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of files that arrive in a folder, drained in two goes."""
    path, out, state = fresh_path(spark, "lines"), fresh_path(spark, "messages"), fresh_path(spark, "messages-state")
    lines = message_lines(spark, sf_dir)
    for part in (0, 1):
        lines.filter(F.crc32("value") % 2 == part).write.mode("append").text(path)
        events.drain(events.message_stream(spark, path), out, state, "messages")
    return _per_source(spark.read.parquet(out))


MESSAGE_STREAM = _MESSAGES


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback is told of a stream: segments by source."""
    path, told = fresh_path(spark, "lines"), []
    message_lines(spark, sf_dir).write.text(path)
    events.progress_stream(events.message_stream(spark, path), told.append, fresh_path(spark, "progress-state")).awaitTermination()
    rows = [(s, n) for t in told for s, n in t["segments"].items()]
    return spark.createDataFrame(rows, "source string, segments bigint").groupBy("source").agg(F.sum("segments").alias("segments"))


STREAM_PROGRESS = "SELECT event_type AS source, count(*) AS segments FROM events WHERE event_id % 3 = 0 GROUP BY event_type"


def active_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of running streams, and that none is left after a shutdown."""
    path = fresh_path(spark, "lines")
    message_lines(spark, sf_dir).limit(1).write.text(path)
    stream = events.message_stream(spark, path).writeStream.format("noop").queryName("messages-watch").option("checkpointLocation", fresh_path(spark, "watch-state")).start()
    names = [n for n in dag.active(spark) if n == "messages-watch"]
    stream.stop()
    return spark.createDataFrame([(n, stream.isActive) for n in names], "name string, left_running boolean")


ACTIVE_STREAMS = "SELECT 'messages-watch' AS name, false AS left_running"


def interleaved_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of five text and fifteen speech tokens; a request has as many text tokens as its key says."""
    f = frames(spark, sf_dir).withColumn("n_text", F.col("vec_id") % 41)
    kind = F.when(F.col("idx") < F.col("n_text"), "text").otherwise("speech")
    rows = f.select("vec_id", kind.alias("kind"), F.when(F.col("idx") < F.col("n_text"), F.col("idx")).otherwise(F.col("idx") - F.col("n_text")).cast("int").alias("idx"))
    return tokens.interleaved(rows, ["vec_id"])


INTERLEAVED_TOKENS = f"""WITH {FRAMES}, k AS (SELECT vec_id, vec_id % 41 AS t, CASE WHEN idx < vec_id % 41 THEN 'text' ELSE 'speech' END AS kind, CASE WHEN idx < vec_id % 41 THEN idx ELSE idx - vec_id % 41 END AS idx FROM frame),
r AS (SELECT *, CASE WHEN kind = 'text' THEN idx // 5 WHEN idx // 15 < t // 5 THEN idx // 15 ELSE t // 5 END AS turn FROM k)
SELECT vec_id, kind, CAST(idx AS INT) AS idx, row_number() OVER (PARTITION BY vec_id ORDER BY turn, kind DESC, idx) - 1 AS place FROM r"""


def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 + 8 values that advance by 16, and what is heard of them, faded into each other."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, (F.col("vec_id") % 60 + 5).cast("int")), lambda x: x.cast("double")).alias("v"))
    out = e.withColumns({"w": tokens.overlapping(F.col("v"), 16, 8), "heard": tokens.cross_faded(F.col("v"), 16, 8)})
    same = F.forall(F.zip_with("heard", "v", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    return out.select("vec_id", F.array_join(F.transform("w", lambda x: F.size(x).cast("string")), ",").alias("sizes"), F.size("heard").alias("n_heard"), same.alias("same"))


OVERLAP_WINDOWS = """WITH n AS (SELECT vec_id, vec_id % 60 + 5 AS n FROM embeddings),
w AS (SELECT vec_id, n, i, least(24, n - i * 16) AS size FROM n, (SELECT unnest(range(0, 5)) AS i) WHERE i * 16 + 24 <= n OR i = greatest((n - 8) // 16, 0))
SELECT vec_id, string_agg(CAST(size AS VARCHAR), ',' ORDER BY i) AS sizes, CAST(any_value(n) AS INT) AS n_heard, true AS same FROM w GROUP BY vec_id"""


def replay_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of documents as tokens, replayed in chunks that grow and in equal ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sequence(F.lit(1), F.least(F.col("n_chars"), F.lit(2000)).cast("int")).alias("t"))
    def sizes(column: str, chunks: Column) -> Column:
        return F.array_join(F.transform(chunks, lambda c: F.size(c).cast("string")), ",").alias(column)
    return d.select("doc_id", sizes("growing", tokens.replay(F.col("t"), tokens.exponential_hops(25, 15, 5))), sizes("equal", tokens.replay(F.col("t"), [300])))


REPLAY_CHUNKS = """WITH n AS (SELECT doc_id, least(n_chars, 2000) AS n FROM documents),
g(a) AS (SELECT unnest([0, 15, 40, 90, 190]) UNION ALL SELECT unnest(range(390, 2001, 200))),
c AS (SELECT doc_id, n, a, lead(a, 1, 1000000) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM n, g),
x AS (SELECT doc_id, string_agg(CAST(least(b, n) - a AS VARCHAR), ',' ORDER BY a) AS growing FROM c WHERE a < n GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(CAST(least(300, n - a) AS VARCHAR), ',' ORDER BY a) AS equal FROM n, (SELECT unnest(range(0, 2001, 300)) AS a) WHERE a < n GROUP BY doc_id)
SELECT doc_id, growing, equal FROM x JOIN y USING (doc_id)"""


# -- work per row ------------------------------------------------------------------------------


def retry_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service that fails without a hint for some rows, and always for others."""

    def call(value: str, hint: str | None) -> str:
        n = int(value)
        if n % 5 == 0:
            raise ValueError(f"bad {n}")
        if n % 3 == 0 and hint is None:
            raise ValueError("again")
        return f"{n * 2}{'' if hint is None else ' after ' + hint}"

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return events.with_retries(c, call, "key", attempts=3)


RETRY_ANSWERS = """SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey * 2 || CASE WHEN c_custkey % 3 = 0 THEN ' after again' ELSE '' END END AS result,
  CASE WHEN c_custkey % 5 = 0 THEN 'bad ' || c_custkey END AS result_error FROM customer"""


def cancelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the nations: one before the marker that cancels is there, one after."""
    folder = fresh_path(spark, "cancel")
    n = table(spark, sf_dir, "nation").select("n_name")
    before = events.until_cancelled(n, str.lower, "n_name", f"{folder}/not-there")
    after = events.until_cancelled(n, str.lower, "n_name", f"{_put(spark, folder, {'stop': b''})}/stop")
    return before.unionByName(after)


CANCELLED_ROWS = "SELECT n_name, lower(n_name) AS result, 'done' AS result_status FROM nation UNION ALL SELECT n_name, NULL, 'cancelled' FROM nation"


def longest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first four events as attempts: the first of a plausible value, else the largest."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("attempt"), F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("length"))
    best = e.groupBy("user_id", "attempt").agg(F.min("length").alias("length")).withColumn("plausible", F.col("user_id") * 12 % 100 * 10)
    return events.longest_attempt(best, ["user_id"], "attempt", "length", "plausible")


LONGEST_ATTEMPT = """WITH a AS (SELECT user_id, event_id % 4 AS attempt, min(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS length, user_id * 12 % 100 * 10 AS plausible FROM events GROUP BY ALL),
r AS (SELECT *, max(length) OVER (PARTITION BY user_id ORDER BY attempt) AS best, coalesce(max(length) OVER (PARTITION BY user_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM a)
SELECT user_id, arg_max(attempt, length) AS attempt, max(length) AS length FROM (SELECT user_id, attempt, length FROM r WHERE before < plausible AND length > before) GROUP BY user_id"""


def slot_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts answered by the slot that their method names; models are loaded once a task."""
    def upper() -> object:
        return lambda values: values.str.upper()

    def backwards() -> object:
        return lambda values: pd.Series([v[::-1] for v in values])

    n = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "chat").otherwise("translate").alias("method"))
    return slots.routed(n, "method", "c_mktsegment", {"chat": slots.model_slot(upper, T.StringType()), "translate": slots.declared("translate", backwards)}, "answer")


SLOT_ROUTING = "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'chat' ELSE 'translate' END AS method, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE reverse(c_mktsegment) END AS answer FROM customer"


def inference_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by three methods, each answered from the columns that its method has."""
    def joined() -> object:
        return lambda frame: frame.astype(str).agg("+".join, axis=1)

    c = table(spark, sf_dir, "customer")
    asked = F.element_at(F.array(*[F.lit(m) for m in ("sft", "cross_lingual", "instruct")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = c.select("c_custkey", asked.alias("method"), F.col("c_name").alias("tts_text"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("spk_id"), F.lower("c_mktsegment").alias("instruct_text"), F.when(F.col("c_custkey") % 3 == 1, "wave").alias("prompt_speech"))
    out = slots.inferred(rows, "method", {m: slots.method_slot(m, joined, T.StringType()) for m in ("sft", "cross_lingual", "instruct")}, "answer")
    return out.select("c_custkey", "method", "answer")


INFERENCE_METHODS = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'sft' WHEN 1 THEN 'cross_lingual' ELSE 'instruct' END AS method,
  c_name || CASE c_custkey % 3 WHEN 0 THEN '+s' || c_nationkey WHEN 1 THEN '+wave' ELSE '+s' || c_nationkey || '+' || lower(c_mktsegment) END AS answer FROM customer"""


def planned_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enabled steps of a plan run one after another; one of them finds nothing to do."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    named = [("even", lambda df: df.filter("o_orderkey % 2 = 0")), ("never", lambda df: df.limit(0)), ("nothing", lambda df: None), ("double", lambda df: df.withColumn("o_custkey", F.col("o_custkey") * 2))]
    out, log = dag.run_plan(o, dag.plan(named, {"never": False}))
    return out.withColumn("run", F.lit(" ".join(f"{n}:{s}" for n, s in log)))


PLANNED_RUN = "SELECT o_orderkey, o_custkey * 2 AS o_custkey, 'even:done nothing:skipped double:done' AS run FROM orders WHERE o_orderkey % 2 = 0"


def marked_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state log with an entry put at its end, and the latest state of each step."""
    log = table(spark, sf_dir, "customer").select((F.col("c_nationkey")).alias("project"), F.element_at(F.array(*[F.lit(s) for s in dag.STEPS[:3]]), (F.col("c_custkey") % 3 + 1).cast("int")).alias("step"), F.col("c_custkey").alias("at"), F.lit("running").alias("state"))
    entry = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), F.lit(dag.STEPS[0]).alias("step"), F.lit(1 << 40).alias("at"), F.lit("done").alias("state"))
    return dag.state_of(dag.marked(log, entry), ["project"], "at", "state").groupBy("step", "state").agg(F.count(F.lit(1)).alias("n"))


_STEP = "['" + "', '".join(dag.STEPS[:3]) + "']"
MARKED_LOG = f"""WITH l AS (SELECT c_nationkey AS project, {_STEP}[c_custkey % 3 + 1] AS step FROM customer)
SELECT step, 'running' AS state, count(DISTINCT project) AS n FROM l WHERE step <> {_STEP}[1] GROUP BY step UNION ALL SELECT {_STEP}[1], 'done', count(*) FROM nation"""

_NAMES = [
    token_stream, message_stream, stream_progress, active_streams, interleaved_tokens, overlap_windows, replay_chunks,
    retry_answers, cancelled_rows, longest_attempt, slot_routing, inference_methods, planned_run, marked_log,
]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {name: globals()[name.upper()] for name in QUERIES}
