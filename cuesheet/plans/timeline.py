"""Queries of the interval and sequence operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import scale, timeline
from cuesheet.plans.views import FRAMES, SEGMENTS, frames, segments
from cuesheet.session import table

#: Length of the common timeline, in seconds.
DURATION = 2_600_000.0


def _micros(col: str):
    return F.floor(F.col(col) * 1e6 + 0.5).cast("bigint")


def seg_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = timeline.merge_segments(segments(spark, sf_dir), ["source"])
    return merged.select("source", "island", _micros("seg_start").alias("start_us"), _micros("seg_end").alias("end_us"), "n_segments", F.sha2("text", 256).alias("text_sha"))


_ISLANDS = f"""{SEGMENTS},
reach AS (
  SELECT *, max(seg_end) OVER (PARTITION BY source ORDER BY seg_start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM segment WHERE text <> ''),
numbered AS (
  SELECT *, sum(CASE WHEN r IS NULL OR seg_start > r + 0.05::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seg_start, pos) AS island FROM reach),
island AS (
  SELECT source, CAST(island AS BIGINT) AS island, min(seg_start) AS seg_start, max(seg_end) AS seg_end, count(*) AS n_segments,
    string_agg(text, '' ORDER BY seg_start, pos) AS text FROM numbered GROUP BY 1, 2)"""

SEG_ISLANDS = f"""WITH {_ISLANDS}
SELECT source, island, CAST(floor(seg_start * 1e6 + 0.5) AS BIGINT) AS start_us, CAST(floor(seg_end * 1e6 + 0.5) AS BIGINT) AS end_us, n_segments, sha256(text) AS text_sha FROM island"""


def seg_islands_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = seg_islands(spark, sf_dir)
    return i.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_islands"),
        F.sum("n_segments").alias("n_segments"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"),
        F.max(F.col("end_us") - F.col("start_us")).alias("longest_us"),
    )


SEG_ISLANDS_SUMMARY = f"""SELECT source, count(*) AS n_islands, CAST(sum(n_segments) AS BIGINT) AS n_segments,
  CAST(sum(end_us - start_us) AS BIGINT) AS speech_us, max(end_us - start_us) AS longest_us FROM ({SEG_ISLANDS}) GROUP BY source"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    accept = (F.col("value") > 1.0) & (F.col("who") == "female")
    return timeline.speech_ranges(segments(spark, sf_dir), ["source"], F.lit(DURATION), accept=accept)


def speech_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("source", "island", "part", _micros("seg_start").alias("start_us"), _micros("seg_end").alias("end_us"))


_RANGES = f"""{SEGMENTS},
pad AS (
  SELECT source, pos, greatest(0.0::DOUBLE, seg_start - 0.5::DOUBLE) AS s, least({DURATION}::DOUBLE, seg_end + 0.3::DOUBLE) AS e
  FROM segment WHERE value > 1.0 AND who = 'female'),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pad WHERE e >= s),
numbered AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1.0::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY s, pos) AS island FROM reach),
merged AS (SELECT source, CAST(island AS BIGINT) AS island, min(s) AS s, max(e) AS e FROM numbered GROUP BY 1, 2 HAVING max(e) - min(s) > 0.1::DOUBLE),
parts AS (
  SELECT source, island, s, e, n, unnest(range(0, n)) AS part
  FROM (SELECT *, CAST(greatest(ceil((e - s) / 12.0::DOUBLE), 1) AS INT) AS n FROM merged)),
cut AS (
  SELECT source, island, CAST(part AS INT) AS part,
    CASE WHEN n > 1 THEN s + part * ((e - s) / n) ELSE s END AS seg_start,
    CASE WHEN n > 1 THEN least(e, s + (part + 1) * ((e - s) / n)) ELSE e END AS seg_end FROM parts),
ranges AS (SELECT * FROM cut WHERE seg_end - seg_start > 0.1::DOUBLE)"""

SPEECH_RANGES = f"""WITH {_RANGES}
SELECT source, island, part, CAST(floor(seg_start * 1e6 + 0.5) AS BIGINT) AS start_us, CAST(floor(seg_end * 1e6 + 0.5) AS BIGINT) AS end_us FROM ranges"""


def gap_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.complement(_ranges(spark, sf_dir), ["source"], F.lit(DURATION))
    return out.select("source", "kind", _micros("seg_start").alias("start_us"), _micros("seg_end").alias("end_us"))


GAP_COMPLEMENT = f"""WITH {_RANGES},
gaps AS (
  SELECT source, coalesce(lag(seg_end) OVER (PARTITION BY source ORDER BY seg_start), 0.0) AS a, seg_start AS b FROM ranges
  UNION ALL SELECT source, max(seg_end), {DURATION}::DOUBLE FROM ranges GROUP BY source),
both_kinds AS (
  SELECT source, 'speech' AS kind, seg_start AS a, seg_end AS b FROM ranges
  UNION ALL SELECT source, 'gap', a, b FROM gaps WHERE b - a > 0.05::DOUBLE)
SELECT source, kind, CAST(floor(a * 1e6 + 0.5) AS BIGINT) AS start_us, CAST(floor(b * 1e6 + 0.5) AS BIGINT) AS end_us FROM both_kinds"""


def timeline_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).withColumn("source", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    # Transcripts as they come: a list of segments per file, flattened again here.
    nested = seg.groupBy("source", "user_id").agg(F.collect_list(F.struct("pos", "seg_start", "seg_end")).alias("segments"))
    flat = nested.select("source", F.explode("segments").alias("s")).select("source", "s.*")
    files = nested.select("source", F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("part_"), F.col("user_id").cast("string"))).otherwise(F.lit("whole")).alias("label"))
    cuts = nested.filter("user_id % 3 = 0").select(F.col("user_id").cast("int").alias("index"), (F.col("user_id") * 200.5).alias("cut_start"))
    out = timeline.rebase(flat, files, cuts)
    return out.select("source", "pos", _micros("seg_start").alias("start_us"), _micros("seg_end").alias("end_us"))


TIMELINE_REBASE = f"""WITH {SEGMENTS},
u AS (SELECT DISTINCT user_id FROM segment),
o AS (
  SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 0.0 WHEN user_id % 3 = 0 THEN user_id * 200.5::DOUBLE ELSE (user_id - 1) * 180.0::DOUBLE END AS shift FROM u)
SELECT 'u' || user_id AS source, pos, CAST(floor((seg_start + shift) * 1e6 + 0.5) AS BIGINT) AS start_us, CAST(floor((seg_end + shift) * 1e6 + 0.5) AS BIGINT) AS end_us
FROM segment JOIN o USING (user_id)"""


def tumbling_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return timeline.tumbling_cuts(docs, F.col("n_chars") / F.lit(4.0)).select("doc_id", F.col("index").cast("bigint").alias("cut_index"), "cut_start", "cut_length")


TUMBLING_CUTS = """SELECT doc_id, i + 1 AS cut_index, i * 180.0::DOUBLE AS cut_start, least(180.0::DOUBLE, n_chars / 4.0::DOUBLE - i * 180.0::DOUBLE) AS cut_length
FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(ceil(n_chars / 4.0::DOUBLE / 180.0::DOUBLE) AS BIGINT))) AS i FROM documents)"""


def overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    right = seg.select("source", "pos", "seg_start", "seg_end", "who")
    out = timeline.overlap_argmax(seg.select("source", "pos", "seg_start", "seg_end"), right, ["source"], "who", "female")
    return out.select("pos", F.floor(F.col("overlap") * 1e6 + 0.5).cast("bigint").alias("overlap_us"), "who")


OVERLAP_ARGMAX = f"""WITH {SEGMENTS},
pairs AS (
  SELECT l.pos, r.who, r.seg_start AS rs, r.pos AS rp, least(l.seg_end, r.seg_end) - greatest(l.seg_start, r.seg_start) AS overlap
  FROM segment l JOIN segment r ON l.source = r.source AND l.pos <> r.pos AND r.seg_start < l.seg_end AND l.seg_start < r.seg_end),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY overlap DESC, rs, rp) AS k FROM pairs WHERE overlap > 0) WHERE k = 1),
lonely AS (SELECT * FROM segment WHERE pos NOT IN (SELECT pos FROM best)),
near AS (
  SELECT l.pos, r.who, row_number() OVER (PARTITION BY l.pos ORDER BY abs((r.seg_start + r.seg_end) / 2 - (l.seg_start + l.seg_end) / 2), r.seg_start, r.pos) AS k
  FROM lonely l JOIN segment r ON l.source = r.source AND l.pos <> r.pos)
SELECT s.pos, CAST(floor(b.overlap * 1e6 + 0.5) AS BIGINT) AS overlap_us, coalesce(b.who, n.who, 'female') AS who
FROM segment s LEFT JOIN best b ON s.pos = b.pos LEFT JOIN near n ON n.pos = s.pos AND n.k = 1"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).withColumn("flag", F.col("value") > 30)
    return scale.position(seg, ["source"], ["seg_start", "pos"], timeline.bucket_of())


_FLAGS = f"""{SEGMENTS},
flags AS (SELECT *, value > 30 AS flag, row_number() OVER (PARTITION BY source ORDER BY seg_start, pos) - 1 AS idx FROM segment)"""


def run_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.run_gate(_flags(spark, sf_dir), ["source"]).select("source", "pos", F.col("idx").cast("bigint").alias("idx"), "gated")


RUN_LENGTH_GATE = f"""WITH {_FLAGS},
r AS (SELECT *, idx // 600 AS c, idx - row_number() OVER (PARTITION BY source, idx // 600, flag ORDER BY idx) AS run FROM flags)
SELECT source, pos, idx, flag AND count(*) OVER (PARTITION BY source, c, flag, run) >= 6 AS gated FROM r"""


def ffill_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).withColumn("detected", F.when(F.col("value") > 60, F.col("who")))
    return scale.forward_fill(seg, ["source"], ["seg_start", "pos"], timeline.bucket_of(), "detected", F.lit("female"), "resolved").select("pos", "detected", "resolved")


FFILL_DEFAULT = f"""WITH {SEGMENTS}
SELECT pos, CASE WHEN value > 60 THEN who END AS detected,
  coalesce(last_value(CASE WHEN value > 60 THEN who END IGNORE NULLS) OVER (PARTITION BY source ORDER BY seg_start, pos), 'female') AS resolved FROM segment"""


def run_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).withColumn("silent", F.col("value") < 120)
    return timeline.suppress_runs(seg, ["source"], ["seg_start", "pos"], timeline.bucket_of(), "silent").select("source", "pos", "silent")


RUN_SUPPRESSION = f"""WITH {SEGMENTS},
f AS (SELECT source, pos, seg_start, value < 120 AS silent, lag(value < 120) OVER (PARTITION BY source ORDER BY seg_start, pos) AS before FROM segment),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> silent THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seg_start, pos) AS run FROM f)
SELECT source, pos, silent FROM (SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY seg_start, pos) AS k FROM r) WHERE NOT silent OR k <= 5"""


def keyframe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.keyframes(_flags(spark, sf_dir), ["source"], 25).select("source", "pos", F.col("idx").cast("bigint").alias("idx"))


KEYFRAME_SAMPLE = f"""WITH {_FLAGS}
SELECT source, pos, idx FROM (SELECT *, max(idx) OVER (PARTITION BY source) AS m FROM flags) WHERE idx % 25 = 0 OR idx = m"""


def range_lookup_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("valid", F.abs("x") > 0.05)
    seg = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    seg = seg.withColumns({"seg_start": F.col("pos") * 1.75, "seg_end": F.col("pos") * 1.75 + (F.col("vec_id") % 5) * 0.5})
    out = timeline.range_lookup_median(seg, f, ["vec_id"], 4096.0, 512, 0.0, "unknown", "high", "low")
    return out.select("vec_id", "pos", "n_valid", F.floor(F.col("median") * 1e6 + 0.5).cast("bigint").alias("median_u"), "label")


RANGE_LOOKUP_MEDIAN = f"""WITH {FRAMES},
seg AS (SELECT vec_id, p AS pos, p * 1.75::DOUBLE AS s, p * 1.75::DOUBLE + (vec_id % 5) * 0.5::DOUBLE AS e FROM embeddings, (VALUES (0), (1), (2), (3)) t(p)),
j AS (
  SELECT seg.vec_id, pos, count(x) AS n_valid, median(x) AS m FROM seg LEFT JOIN frame f
  ON f.vec_id = seg.vec_id AND abs(x) > 0.05::DOUBLE AND idx >= CAST(trunc(s * 4096.0::DOUBLE / 512) AS INT) AND idx < CAST(trunc(e * 4096.0::DOUBLE / 512) AS INT) GROUP BY 1, 2)
SELECT vec_id, pos, n_valid, CAST(floor(m * 1e6 + 0.5) AS BIGINT) AS median_u, CASE WHEN n_valid < 2 THEN 'unknown' WHEN m >= 0 THEN 'high' ELSE 'low' END AS label FROM j"""


def sliding_rms_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sliding_argmax(table(spark, sf_dir, "embeddings"), "embedding", 8, 4).select("vec_id", "best_start", F.round("best_rms", 6).alias("best_rms"))


SLIDING_RMS_ARGMAX = f"""WITH {FRAMES},
w AS (SELECT vec_id, s FROM embeddings, (SELECT unnest(range(0, 56, 4)) AS s)),
r AS (SELECT w.vec_id, s, sqrt(sum(x * x ORDER BY idx) / 8) AS rms FROM w JOIN frame f ON f.vec_id = w.vec_id AND idx >= s AND idx < s + 8 GROUP BY 1, 2)
SELECT vec_id, CAST(s AS INT) AS best_start, round(rms, 6) AS best_rms FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY rms DESC, s) AS k FROM r) WHERE k = 1"""


def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"))
    return timeline.hop_windows(e, F.col("n"), 80.0 / 25.0, 16).select("vec_id", F.col("window").alias("win"), F.col("first").alias("win_start"))


HOP_WINDOWS = """WITH s AS (SELECT vec_id, i, CAST(floor(i * (80.0::DOUBLE / 25.0::DOUBLE)) AS INT) AS a FROM embeddings, (SELECT unnest(range(0, 40)) AS i)),
k AS (SELECT vec_id, i, a FROM s WHERE a <= 48)
SELECT vec_id, CAST(i AS INT) AS win, a AS win_start FROM k UNION ALL SELECT vec_id, CAST(max(i) + 1 AS INT), 48 FROM k GROUP BY vec_id"""


def smooth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("v", F.floor(F.col("x") * 1000).cast("bigint"))
    return timeline.smooth_forward(f.select("vec_id", "idx", "v"), ["vec_id"], "v").select("vec_id", "idx", "smooth")


SMOOTH_BOXES = f"""WITH {FRAMES}, v AS (SELECT vec_id, idx, CAST(floor(x * 1000) AS BIGINT) AS v FROM frame),
b AS (SELECT *, CAST(trunc(avg(v) OVER (PARTITION BY vec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS BIGINT) AS body FROM v),
t AS (SELECT vec_id, max(body) FILTER (WHERE idx = 59) AS s59, max(v) FILTER (WHERE idx = 60) AS v60, max(v) FILTER (WHERE idx = 61) AS v61, max(v) FILTER (WHERE idx = 62) AS v62, max(v) FILTER (WHERE idx = 63) AS v63 FROM b GROUP BY vec_id),
t0 AS (SELECT *, CAST(trunc((s59 + v60 + v61 + v62 + v63) / 5.0::DOUBLE) AS BIGINT) AS s60 FROM t),
t1 AS (SELECT *, CAST(trunc((s59 + s60 + v61 + v62 + v63) / 5.0::DOUBLE) AS BIGINT) AS s61 FROM t0),
t2 AS (SELECT *, CAST(trunc((s59 + s60 + s61 + v62 + v63) / 5.0::DOUBLE) AS BIGINT) AS s62 FROM t1),
t3 AS (SELECT *, CAST(trunc((s59 + s60 + s61 + s62 + v63) / 5.0::DOUBLE) AS BIGINT) AS s63 FROM t2)
SELECT vec_id, CAST(idx AS INT) AS idx, CASE idx WHEN 60 THEN s60 WHEN 61 THEN s61 WHEN 62 THEN s62 WHEN 63 THEN s63 ELSE body END AS smooth FROM b JOIN t3 USING (vec_id)"""


def interpolate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames every 8 positions of an embedding; the box follows the value there."""
    f = frames(spark, sf_dir).filter("idx % 8 = 0")
    x = (F.col("x") * 100).cast("double")
    k = f.select("vec_id", "idx", (F.abs("x") > 0.03).alias("valid"), F.array(x, x + 80, x + 10, x + 70).alias("box"))
    out = timeline.resolve_boxes(k, ["vec_id"], F.lit(64), 8)
    return out.select("vec_id", "frame", F.col("box")[0].alias("y1"), F.col("box")[1].alias("y2"), F.col("box")[2].alias("x1"), F.col("box")[3].alias("x2"))


INTERPOLATE_BOXES = f"""WITH {FRAMES}, k AS (SELECT vec_id, idx, x * 100 AS x, abs(x) > 0.03::DOUBLE AS valid, lead(x * 100) OVER w AS x1, coalesce(lead(abs(x) > 0.03::DOUBLE) OVER w, false) AS v1 FROM frame WHERE idx % 8 = 0 WINDOW w AS (PARTITION BY vec_id ORDER BY idx)),
s AS (SELECT *, v1 AND NOT sqrt(2 * pow(x - x1, 2)) > 48 AS smooth FROM k WHERE valid),
a AS (
  SELECT vec_id, idx + d AS frame, 1 AS kind, idx, x + (x1 - x) * d / 8 AS y1, x + 80 + (x1 - x) * d / 8 AS y2, x + 10 + (x1 - x) * d / 8 AS x1, x + 70 + (x1 - x) * d / 8 AS x2 FROM s, (SELECT unnest(range(0, 8)) AS d) WHERE smooth
  UNION ALL SELECT vec_id, idx + d, 0, idx, x, x + 80, x + 10, x + 70 FROM s, (SELECT unnest(range(-7, 8)) AS d) WHERE NOT smooth AND idx + d BETWEEN 0 AND 63)
SELECT vec_id, CAST(frame AS INT) AS frame, CAST(round_even(y1, 0) AS INT) AS y1, CAST(round_even(y2, 0) AS INT) AS y2, CAST(round_even(x1, 0) AS INT) AS x1, CAST(round_even(x2, 0) AS INT) AS x2
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, frame ORDER BY kind DESC, idx) AS r FROM a) WHERE r = 1"""

QUERIES = {f.__name__: f for f in (seg_islands, seg_islands_summary, speech_ranges, gap_complement, timeline_rebase, tumbling_cuts, overlap_argmax, run_length_gate, ffill_default, run_suppression, keyframe_sample, range_lookup_median, sliding_rms_argmax, hop_windows, smooth_boxes, interpolate_boxes)}
ORACLE = {
    "seg_islands": SEG_ISLANDS,
    "seg_islands_summary": SEG_ISLANDS_SUMMARY,
    "speech_ranges": SPEECH_RANGES,
    "gap_complement": GAP_COMPLEMENT,
    "timeline_rebase": TIMELINE_REBASE,
    "tumbling_cuts": TUMBLING_CUTS,
    "overlap_argmax": OVERLAP_ARGMAX,
    "run_length_gate": RUN_LENGTH_GATE,
    "ffill_default": FFILL_DEFAULT,
    "run_suppression": RUN_SUPPRESSION,
    "keyframe_sample": KEYFRAME_SAMPLE,
    "range_lookup_median": RANGE_LOOKUP_MEDIAN,
    "sliding_rms_argmax": SLIDING_RMS_ARGMAX,
    "hop_windows": HOP_WINDOWS,
    "smooth_boxes": SMOOTH_BOXES,
    "interpolate_boxes": INTERPOLATE_BOXES,
}
