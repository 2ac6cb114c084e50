"""Queries of the sources and sinks: what is written comes back. With their oracle SQL."""

from __future__ import annotations

import io
import json
import threading
import wave
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import jsonio, text
from cuesheet.plans.views import utterances
from cuesheet.session import fresh_path, table
from cuesheet.sources import readers, sinks


def _put(spark: SparkSession, folder: str, files: dict[str, bytes]) -> str:
    """A few small files with names of their own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, body in files.items():
        out = fs.create(path(f"{folder}/{name}"))
        out.write(bytearray(body))
        out.close()
    return folder


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    return [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]


# -- shards, lists and manifests ---------------------------------------------------------------


def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as Parquet shards of 50 rows at most, each found in one file by the index."""
    path = fresh_path(spark, "shards")
    sinks.write_shards(utterances(spark, sf_dir), path, 50)
    back = readers.shards(spark, [path])
    index = sinks.shard_index(spark.read.parquet(path), "utt").groupBy("utt").agg(F.count(F.lit(1)).alias("files"))
    sizes = back.groupBy("src").agg(F.count(F.lit(1)).alias("rows"))
    return back.join(index, "utt").join(sizes, "src").select("utt", "spk", F.md5("text").alias("text_md5"), "files", (F.col("rows") <= 50).alias("small"))


SHARD_ROUND_TRIP = "SELECT doc_id AS utt, source AS spk, md5(text) AS text_md5, CAST(1 AS BIGINT) AS files, true AS small FROM documents"


def listed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards read by a written list of their paths."""
    path, names = fresh_path(spark, "shards"), fresh_path(spark, "list")
    sinks.write_shards(utterances(spark, sf_dir), path, 300)
    sinks.write_list(readers.shards(spark, [path]), "src", names)
    return readers.listed_shards(spark, names).groupBy("spk").agg(F.count(F.lit(1)).alias("utts"), F.sum("n").alias("chars"))


LISTED_SHARDS = "SELECT source AS spk, count(*) AS utts, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source"


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "list")
    sinks.write_list(utterances(spark, sf_dir).withColumn("line", F.when(F.col("utt") % 9 > 0, F.concat(F.lit("  "), F.col("spk"), F.lit(" "))).otherwise("")), "line", path)
    return readers.lines(spark, path)


LIST_LINES = "SELECT DISTINCT source AS value FROM documents WHERE doc_id % 9 > 0"


def merged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two JSON objects of nations; the second names the even ones anew."""
    nation = table(spark, sf_dir, "nation")
    paths = []
    for rows in (nation.select("n_nationkey", "n_name"), nation.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lower("n_name").alias("n_name"))):
        paths.append(fresh_path(spark, "object"))
        rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value")).write.text(paths[-1])
    return readers.merged_json(spark, paths)


MERGED_JSON = "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS value FROM nation"


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "manifest")
    sinks.write_manifest(utterances(spark, sf_dir).withColumn("value", F.concat("spk", F.lit("  x\t"), F.col("n").cast("string"))), "utt", "value", path)
    return readers.manifest(spark, path)


MANIFEST_ROUND_TRIP = "SELECT CAST(doc_id AS VARCHAR) AS utt, source || ' x ' || n_chars AS value FROM documents"


def manifest_last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that names every third key again, further down in the same file."""
    path = fresh_path(spark, "manifest")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    again = c.filter("k % 3 = 0").withColumn("v", F.lower("v"))
    sinks.write_manifest(c.coalesce(1).unionByName(again.coalesce(1)).coalesce(1), "k", "v", path)
    return readers.manifest(spark, path)


MANIFEST_LAST_LINE = "SELECT CAST(c_custkey AS VARCHAR) AS utt, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS value FROM customer"


def benchmark_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "benchmark")
    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id").cast("string")
    b.select(F.concat_ws("|", F.concat(F.when(F.col("item_id") % 2 == 0, "/abs").otherwise("wav"), F.lit("/"), k, F.lit(".wav")), F.md5("text"), F.concat(F.lit("out/t_"), k, F.lit(".wav")), F.sha1("text")).alias("value")).write.text(path)
    out = readers.benchmark_manifest(spark, path)
    return out.select("utt", F.regexp_extract("audio_path", "(wav|abs)/[^/]*$", 0).alias("audio"), F.startswith("audio_path", F.lit("/abs")).alias("absolute"), "reference_text", "target_text")


BENCHMARK_MANIFEST = "SELECT 't_' || item_id AS utt, CASE WHEN item_id % 2 = 0 THEN 'abs' ELSE 'wav' END || '/' || item_id || '.wav' AS audio, item_id % 2 = 0 AS absolute, md5(text) AS reference_text, sha1(text) AS target_text FROM benchmark"


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "labels")
    c = table(spark, sf_dir, "customer")
    c.select(F.concat_ws("|", F.lit(""), F.col("c_custkey").cast("string"), F.lit("a"), F.lit(""), F.col("c_mktsegment"), F.upper("c_name"), F.lit("")).alias("value")).write.text(path)
    return readers.labels(spark, path)


LABEL_LINES = "SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS target_text FROM customer"


def transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "transcripts")
    c = table(spark, sf_dir, "conversations")
    utt = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    c.select(utt.alias("UtteranceID"), F.concat(F.lit(" "), "role").alias("SpeakerID"), F.concat(F.lit("[FIL]a "), F.md5("text"), F.lit(" [SPK]z ")).alias("Transcription")).write.csv(path, sep="\t", header=True, quote="")
    return readers.transcripts_tsv(spark, path, c.filter("turn % 2 = 0").select(utt.alias("name")))


TRANSCRIPT_ROWS = "SELECT conv_id || '_' || turn AS utt, role AS spk, 'a ' || md5(text) || ' z' AS text FROM conversations WHERE turn % 2 = 0"


def audio_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {}
    for key, name, region in _nations(spark, sf_dir):
        files[f"r{region}/c1/r{region}_{key}.wav"] = b"x" * key
        if key % 4:
            files[f"r{region}/c1/r{region}_{key}.normalized.txt"] = f" {name} \n".encode()
    out = readers.audio_with_text(spark, _put(spark, fresh_path(spark, "corpus"), files))
    return out.select("utt", text.basename(F.col("wav")).alias("wav"), "spk", "text")


AUDIO_WITH_TEXT = "SELECT 'r' || n_regionkey || '_' || n_nationkey AS utt, 'r' || n_regionkey || '_' || n_nationkey || '.wav' AS wav, 'r' || n_regionkey AS spk, n_name AS text FROM nation WHERE n_nationkey % 4 > 0"


def _wav(channels: list[list[int]], rate: int) -> bytes:
    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.array(channels, "<i2").T.tobytes())
    return out.getvalue()


def wave_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo files of steps of a nation's key, as the mean of their channels."""
    files = {f"{key}.wav": _wav([[key * 100 + 10 * i for i in range(20)], [key * 100 + 30 * i for i in range(20)]], 8000) for key, _, _ in _nations(spark, sf_dir)}
    out = readers.waveforms(spark, _put(spark, fresh_path(spark, "waves"), files), 8000)
    rows = out.select(text.stem(F.col("path")).alias("name"), "sample_rate", F.posexplode("speech").alias("idx", "x"))
    return rows.select("name", "sample_rate", "idx", F.floor(F.col("x").cast("double") * 32768 + 0.5).cast("bigint").alias("sample"))


WAVE_FILES = "SELECT CAST(n_nationkey AS VARCHAR) AS name, CAST(8000 AS INT) AS sample_rate, CAST(i AS INT) AS idx, CAST(n_nationkey * 100 + 20 * i AS BIGINT) AS sample FROM nation, (SELECT unnest(range(0, 20)) AS i)"


def resampled_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono files read at half of their rate, band-limited."""
    files = {f"{key}.wav": _wav([[(key * 37 + i * i * 11) % 2000 - 1000 for i in range(40)]], 16000) for key, _, _ in _nations(spark, sf_dir)}
    out = readers.waveforms(spark, _put(spark, fresh_path(spark, "waves"), files), 8000, 8000)
    rows = out.select(text.stem(F.col("path")).alias("name"), "sample_rate", F.posexplode("speech").alias("idx", "x"))
    return rows.select("name", "sample_rate", "idx", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


RESAMPLED_WAVES = """WITH s AS (SELECT n_nationkey AS k, j, ((n_nationkey * 37 + j * j * 11) % 2000 - 1000) / 32768.0::DOUBLE AS x FROM nation, (SELECT unnest(range(0, 40)) AS j)),
w AS (SELECT k, i, x, 2.0::DOUBLE * i - j AS t, 0.5::DOUBLE * 0.99 AS c FROM s, (SELECT unnest(range(0, 20)) AS i))
SELECT CAST(k AS VARCHAR) AS name, CAST(8000 AS INT) AS sample_rate, CAST(i AS INT) AS idx,
  round(CAST(CAST(sum(CASE WHEN abs(t) >= 6 / c THEN 0 ELSE x * c * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * c * t) / (pi() * c * t) END * pow(cos(pi() * t * c / 12), 2) END) AS FLOAT) AS DOUBLE), 5) + 0.0 AS x FROM w GROUP BY k, i"""


# -- JSON, projects, logs ----------------------------------------------------------------------


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    c = table(spark, sf_dir, "conversations").withColumn("note", F.when(F.col("turn") % 2 == 0, F.lit("é\n\"x\"")))
    sinks.write_json(c.coalesce(2), path)
    # Null fields are written too: every line has the same keys.
    keys = spark.read.text(path).agg(F.min(F.size(F.json_object_keys("value"))).alias("keys"))
    back = readers.jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string, note string")
    return back.crossJoin(keys).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "note", "keys")


JSONL_ROUND_TRIP = "SELECT conv_id, turn, role, md5(text) AS text_md5, CASE WHEN turn % 2 = 0 THEN 'é' || chr(10) || '\"x\"' END AS note, CAST(5 AS INT) AS keys FROM conversations"


def _project(key, name) -> Column:
    steps = F.create_map(F.lit("a"), F.when(key % 2 == 0, "done").otherwise("ready"), F.lit("b"), F.lit("done"))
    entry = F.struct(F.lit("t").alias("timestamp"), F.lit("a").alias("step"), F.lit("mark").alias("action"), name.alias("detail"))
    full = F.struct(name.alias("name"), F.lit("c").alias("created_at"), F.lit("u").alias("updated_at"), F.lit(None).cast("string").alias("video_path"), F.lit("w").alias("workspace_dir"), steps.alias("steps"), F.create_map(F.lit("a"), F.lit('{"k": 1}')).alias("step_data"), F.array(entry).alias("history"))
    # Every third document lacks all but its creation.
    return F.when(key % 3 == 0, F.lit('{"created_at": "c"}')).otherwise(jsonio.encode_project(full))


def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project documents as JSON and back, with the defaults of what they lack."""
    c = table(spark, sf_dir, "customer").select("c_custkey", jsonio.decode_project(_project(F.col("c_custkey"), F.col("c_name"))).alias("p"))
    return c.select("c_custkey", F.col("p.name").alias("name"), F.col("p.created_at").alias("created"), F.try_element_at("p.steps", F.lit("a")).alias("a"), F.size("p.steps").alias("steps"), F.size("p.history").alias("entries"), F.get("p.history", F.lit(0))["detail"].alias("detail"))


PROJECT_DOCUMENTS = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, 'c' AS created, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'done' ELSE 'ready' END END AS a,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END AS INT) AS steps, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INT) AS entries, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS detail FROM customer"""


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project files of the nations, one document a file."""
    docs = {f"{k}.json": (json.dumps({"name": n, "steps": {"x": "done"}}, indent=2) if k % 2 else "{}").encode() for k, n, _ in _nations(spark, sf_dir)}
    out = readers.project(spark, _put(spark, fresh_path(spark, "projects"), docs))
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("steps")).alias("steps"))


PROJECT_FILES = "SELECT CASE WHEN n_nationkey % 2 = 1 THEN n_name ELSE '' END AS name, count(*) AS files, CAST(sum(n_nationkey % 2) AS BIGINT) AS steps FROM nation GROUP BY 1"


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of two kinds with other lines between them, as written by a worker."""
    e = table(spark, sf_dir, "events")
    segment = F.to_json(F.struct(F.lit("segment").alias("type"), F.col("event_type").alias("source"), F.col("value").alias("start")))
    tick = F.to_json(F.struct(F.lit("tick").alias("ev"), F.col("user_id").cast("int").alias("done")))
    return e.select(F.when(F.col("event_id") % 3 == 0, segment).when(F.col("event_id") % 3 == 1, tick).otherwise(F.lit('{"other": 1} not json')).alias("value"))


def _per_source(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type", "ev", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("start") * 100 + 0.5).cast("bigint")).alias("start_c"), F.sum("done").alias("done"))


_MESSAGES = """SELECT CASE WHEN event_id % 3 = 0 THEN 'segment' END AS type, CASE WHEN event_id % 3 = 1 THEN 'tick' END AS ev, CASE WHEN event_id % 3 = 0 THEN event_type END AS source, count(*) AS n,
  CAST(sum(CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END) AS BIGINT) AS start_c, CAST(sum(CASE WHEN event_id % 3 = 1 THEN user_id END) AS BIGINT) AS done
FROM events WHERE event_id % 3 < 2 GROUP BY 1, 2, 3"""


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "log")
    message_lines(spark, sf_dir).write.text(path)
    return _per_source(readers.message_log(spark, path))


MESSAGE_LOG = _MESSAGES


def checkpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {f"{'train' if k % 5 == 0 else 'epoch'}_{k}.yaml": f"tag: {n.split()[0]}\n  epoch: {k}\nstep: {k * 10}\nloss_dict:\n  loss: {k / 4}\n  acc: 1\n".encode() for k, n, _ in _nations(spark, sf_dir)}
    files["other.txt"] = b"loss: 9"
    out = readers.checkpoint_scores(spark, _put(spark, fresh_path(spark, "checkpoints"), files))
    return out.select(text.basename(F.col("path")).alias("name"), "loss", "epoch", "step", "tag")


CHECKPOINT_SCORES = "SELECT 'epoch_' || n_nationkey || '.yaml' AS name, n_nationkey / 4.0::DOUBLE AS loss, CAST(n_nationkey AS INT) AS epoch, CAST(n_nationkey * 10 AS INT) AS step, string_split(n_name, ' ')[1] AS tag FROM nation WHERE n_nationkey % 5 > 0"


def served_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a server on this machine lists, and none from one that does not answer in JSON."""
    names = [n for _, n, _ in _nations(spark, sf_dir)]

    class Reply(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"no" if self.path.startswith("/bad") else json.dumps({"models": [{"name": n} for n in names]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        return readers.model_names(spark, f"{base}/").unionByName(readers.model_names(spark, f"{base}/bad"))
    finally:
        server.shutdown()
        server.server_close()


SERVED_MODELS = "SELECT n_name AS name FROM nation"


# -- inventories and other sinks ---------------------------------------------------------------


def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a written folder with their sizes; contents are not read."""
    path = fresh_path(spark, "cache")
    table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value")).coalesce(1).write.partitionBy("n_regionkey").text(path)
    return readers.file_inventory(spark, path).select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region"), "size")


FOLDER_INVENTORY = "SELECT CAST(n_regionkey AS INT) AS region, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS size FROM nation GROUP BY n_regionkey"


def cleared_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clearing a folder removed, and what is left of it."""
    path = fresh_path(spark, "cache")
    table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("part"), F.col("c_name").alias("value")).coalesce(1).write.partitionBy("part").text(path)
    done = sinks.clear_cache(spark, path, readers.file_inventory(spark, path))
    fs, folder = sinks._hadoop(spark, path)
    return done.withColumn("folder_left", F.lit(fs.exists(folder)))


CLEARED_CACHE = "SELECT count(DISTINCT c_custkey % 7) AS n_files, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, false AS folder_left FROM customer"


def table_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = fresh_path(spark, "table"), fresh_path(spark, "copy")
    sinks.write_table(table(spark, sf_dir, "orders"), one, two)
    return spark.read.parquet(one).intersectAll(spark.read.parquet(two)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


TABLE_COPIES = "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderstatus"


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "pairs")
    sinks.write_pairs(table(spark, sf_dir, "benchmark").select("item_id", F.md5("text").alias("ref"), F.sha1("text").alias("hyp")), "item_id", "ref", "hyp", path)
    return spark.read.text(path)


PAIR_LINES = "SELECT unnest([item_id || ':' || chr(9) || 'ref=' || md5(text), item_id || ':' || chr(9) || 'hyp=' || sha1(text)]) AS value FROM benchmark"


def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events as a report in JSON and in text."""
    path = fresh_path(spark, "report")
    sinks.write_report(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("value")), "metric", "value", path)
    lines = spark.read.text(f"{path}/text").withColumnRenamed("value", "line")
    back = readers.jsonl(spark, f"{path}/json", "metric string, value bigint")
    return back.join(lines, F.startswith("line", F.concat("metric", F.lit(": "))))


METRIC_REPORT = "SELECT event_type AS metric, count(*) AS value, event_type || ': ' || count(*) AS line FROM events GROUP BY event_type"


def registry_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry saved to the path that it is read from."""
    path = fresh_path(spark, "registry")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    s.write.parquet(path)
    sinks.save_registry(spark.read.parquet(path), s.filter("s_suppkey % 4 = 0").withColumn("s_name", F.upper("s_name")).unionByName(s.limit(1).select(F.lit(-1).cast("bigint").alias("s_suppkey"), F.lit("new").alias("s_name"))), "s_suppkey", path)
    return spark.read.parquet(path)


REGISTRY_REWRITE = "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier UNION ALL SELECT -1, 'new'"

_NAMES = [
    shard_round_trip, listed_shards, list_lines, merged_json, manifest_round_trip, manifest_last_line, benchmark_manifest, label_lines, transcript_rows, audio_with_text, wave_files, resampled_waves,
    jsonl_round_trip, project_documents, project_files, message_log, checkpoint_scores, served_models,
    folder_inventory, cleared_cache, table_copies, pair_lines, metric_report, registry_rewrite,
]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {name: globals()[name.upper()] for name in QUERIES}
