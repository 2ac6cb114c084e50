"""Queries of the step graph, the dataset pipeline and the token windows, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import dag, dataset  # noqa: F401  dataset registers its transforms
from cuesheet.pipeline import compose
from cuesheet.session import table
from cuesheet.streaming import tokens


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state per user and step, from the user's latest event of each type: done if its value is over 40."""
    e = table(spark, sf_dir, "events")
    kinds = dag.steps(spark).select("step", "ord")
    steps = e.withColumn("ord", (F.ascii("event_type") % 12).cast("int")).join(F.broadcast(kinds), "ord")
    log = steps.select("user_id", "step", F.col("ts"), "event_id", F.when(F.col("value") > 40, "done").when(F.col("value") > 20, "failed").otherwise("running").alias("state"))
    return dag.state_of(log, ["user_id"], "ts", "event_id").select("user_id", "step", "state")


def _literal(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_STATES = f"""steps(step, ord) AS (VALUES {_literal([(s, i) for i, s in enumerate(dag.STEPS)])}),
edges(step, needs) AS (VALUES {_literal([(s, n) for s, ns in dag.NEEDS.items() for n in ns])}),
log AS (SELECT user_id, step, CASE WHEN value > 40 THEN 'done' WHEN value > 20 THEN 'failed' ELSE 'running' END AS state,
  row_number() OVER (PARTITION BY user_id, step ORDER BY ts DESC, event_id DESC) AS k FROM events JOIN steps ON ord = ascii(event_type) % 12),
states AS (SELECT user_id, step, state FROM log WHERE k = 1),
users AS (SELECT DISTINCT user_id FROM states),
locks AS (SELECT u.user_id, e.step, bool_or(coalesce(s.state, '') <> 'done') AS locked FROM users u, edges e LEFT JOIN states s ON s.user_id = u.user_id AND s.step = e.needs GROUP BY 1, 2),
status AS (SELECT u.user_id, t.step, t.ord, CASE WHEN l.locked THEN 'locked' ELSE coalesce(s.state, 'ready') END AS status
  FROM users u CROSS JOIN steps t LEFT JOIN locks l ON l.user_id = u.user_id AND l.step = t.step LEFT JOIN states s ON s.user_id = u.user_id AND s.step = t.step)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.status(_states(spark, sf_dir), dag.steps(spark), dag.edges(spark), ["user_id"])


def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("user_id", "step", "status")


STEP_STATUS = f"WITH {_STATES} SELECT user_id, step, status FROM status"


def first_ready_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.first_ready(_status(spark, sf_dir), ["user_id"])


FIRST_READY_STEP = f"WITH {_STATES} SELECT user_id, arg_min(step, ord) AS step FROM status WHERE status = 'ready' GROUP BY user_id"


def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("action"))
    return dag.history_tail(e, ["user_id"], "ts", "event_id", 3).select("user_id", "place", "event_id", "action")


HISTORY_TAIL = "SELECT user_id, CAST(k - 1 AS INT) AS place, event_id, event_type AS action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3"


def token_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows in which each document's characters, taken as tokens, would be sent."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    hops = tokens.Hops(25, 2, 100, 3, 10)
    return d.select("doc_id", F.posexplode(tokens.chunk_bounds(F.col("n"), hops)).alias("chunk", "w")).select("doc_id", "chunk", "w.first", "w.last", "w.final")


TOKEN_HOP = """WITH RECURSIVE w AS (
  SELECT doc_id, n_chars AS n, 0 AS chunk, 0 AS first, 40 AS width, 50 AS hop FROM documents
  UNION ALL SELECT doc_id, n, chunk + 1, first + width, hop, least(100, hop * 2) FROM w WHERE n - first >= width + 3)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(first AS INT) AS first, CAST(CASE WHEN n - first >= width + 3 THEN first + width ELSE n END AS INT) AS last, n - first < width + 3 AS final FROM w"""


def dataset_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as speech through the configured pipeline: filter, bounded sort, batches, padding."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("utt"),
        F.col("label").cast("string").alias("src"),
        F.slice("embedding", 1, (F.col("vec_id") % 60 + 4).cast("int")).alias("speech"),
        F.lit(100).alias("sample_rate"),
        F.concat(F.lit("a b "), F.col("vec_id").cast("string")).alias("text"),
    )
    from cuesheet.operators.batching import indexed

    rows = indexed(rows, ["src"], ["utt"], F.floor(F.col("utt") / 512))
    plan = compose(["tokenize", ("filter", {"min_length": 10, "max_length": 60}), ("sort", {"size": 16}), ("batch", {"kind": "static", "size": 8}), "padding"], shard="src")
    return plan(rows).select("src", "batch", F.array_join(F.transform("utt", lambda u: u.cast("string")), ",").alias("utts"), F.size(F.col("speech")[0]).alias("width"))


DATASET_PIPELINE = """WITH r AS (SELECT vec_id AS utt, CAST(label AS VARCHAR) AS src, vec_id % 60 + 4 AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings),
f AS (SELECT * FROM r WHERE n BETWEEN 10 AND 60 AND 3 / n::DOUBLE BETWEEN 0.0005 AND 1),
s AS (SELECT *, idx // 16 * 16 + row_number() OVER (PARTITION BY src, idx // 16 ORDER BY n, idx) - 1 AS place FROM f)
SELECT src, place // 8 AS batch, string_agg(CAST(utt AS VARCHAR), ',' ORDER BY n DESC, utt) AS utts, CAST(max(n) AS INT) AS width FROM s GROUP BY 1, 2"""

_NAMES = [step_status, first_ready_step, history_tail, token_hop, dataset_pipeline]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
