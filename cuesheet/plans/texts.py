"""Queries of the text, JSON and array functions, with their oracle SQL."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.functions import arrays, jsonio, text
from cuesheet.plans.views import FRAMES
from cuesheet.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars", "source")


def _u(col: Column) -> Column:
    return F.floor(col * 1e6 + 0.5).cast("bigint")


_U = "CAST(floor(({0}) * 1e6 + 0.5) AS BIGINT)"


def clean_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("  "), F.col("text"), F.lit("<br/><|im_end|>\n<|im_start|>assistant"))
    raw = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("原文："), raw)).otherwise(raw)
    return c.select("conv_id", "turn", text.extract_translation(raw, F.col("role")).alias("cleaned"))


CLEAN_TRANSLATION = r"""WITH c AS (SELECT conv_id, turn, role AS original, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 OR (length(t) > 60 AND length(original) > 0 AND length(t) > 6 * length(original)) THEN '' ELSE t END AS cleaned FROM c"""


def clean_commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    raw = F.concat(F.lit("<|im_start|>\n1. "), F.col("text"), F.lit(" (a note)\n说明：x"))
    return d.select("doc_id", text.clean_commentary(raw).alias("line"))


def _clean_commentary_sql() -> str:
    """The rules one after another, each a table of its own: a marker cuts what follows it."""
    parts = [r"c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('<|im_start|>' || chr(10) || '1. ' || text || ' (a note)' || chr(10) || '说明：x', '^\s+|\s+$', '', 'g'), '" + text.CHAT_TOKENS + r"', '', 'g'), '[（(][^)）]*[)）]', '', 'g') AS t FROM documents)"]
    last = "c"
    for i, m in enumerate(text.MARKERS):
        q = f"'{m}'"
        after = f"substr(t, instr(t, {q}) + {len(m)})"
        rules = [f"instr(t, {q}) = 0 THEN t"]
        if m in text.LABEL_MARKERS:
            rules.append(f"instr(t, {q}) = 1 THEN regexp_replace({after}, '^[：: ]+', '')")
        if m in text.HEADER_MARKERS:
            tail = f"regexp_replace({after}, '^[：: \t]+', '')"
            rules.append(f"instr(t, {q}) > 1 AND substr(t, instr(t, {q}) - 1, 1) = chr(10) AND {tail} <> '' THEN {tail}")
        rules.append(f"instr(t, {q}) > 1 THEN left(t, instr(t, {q}) - 1)")
        parts.append(f"m{i} AS (SELECT doc_id, CASE {' '.join('WHEN ' + r for r in rules)} ELSE t END AS t FROM {last})")
        last = f"m{i}"
    parts.append(f"h AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{text.HEADER_LINE}', '', 'g'), '{text.INSTRUCTION_LINE}', '', 'g') AS t FROM {last})")
    # A run of five or more of one mark at the end is one mark.
    runs = "".join(f"WHEN regexp_matches(t, '{re.escape(c)}{{5,}}$') THEN regexp_replace(t, '{re.escape(c)}{{5,}}$', '{c}') " for c in "。！？….!?")
    parts.append(f"e AS (SELECT doc_id, CASE {runs}ELSE t END AS t FROM h)")
    parts.append(r"l AS (SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\r\n|\n|\r'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '" + text.NUMBERING + r"', ''), '^\s+|\s+$', '', 'g')) AS l FROM e)")
    return f"WITH {', '.join(parts)} SELECT doc_id, coalesce(list_filter(l, lambda x: x <> '')[1], '') AS line FROM l"


CLEAN_COMMENTARY = _clean_commentary_sql()


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(text.has_words(F.col("text"), ["Password", "license", "the and"])).select("doc_id")


KEYWORD_ROWS = "SELECT doc_id FROM documents WHERE contains(lower(text), 'password') OR contains(lower(text), 'license') OR contains(lower(text), 'the and')"


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    marked = F.concat(F.when(F.col("item_id") % 3 == 0, F.lit("「Ａ」，")).otherwise(F.lit("")), "text", F.lit("<sil> ｂ。don't、`<%>`？"))
    return b.select("item_id", text.normalize_transcript(marked).alias("norm"))


_MARKS = "".join(dict.fromkeys(c for c in text.CJK_PUNCTUATION + string.punctuation if c != "'")).replace("'", "''")
NORMALIZE_TEXT = f"""WITH t AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '「Ａ」，' ELSE '' END || text || '<sil> ｂ。don''t、`<%>`？' AS t FROM benchmark),
u AS (SELECT item_id, upper(replace(replace(replace(translate(t, '　 ', ''), '<sil>', ''), '<%>', ''), 'ß', 'SS')) AS t FROM t)
SELECT item_id, translate(translate(translate(t, 'Ａａｂｃｋｔ', 'AABCKT'), '，丶。、？', ''), '{_MARKS}', '') AS norm FROM u"""


def punct_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", r"\s+")).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(text.only_punctuation(F.col("w"))).alias("n_punct"), F.count(F.lit(1)).alias("n_words"))


PUNCT_ONLY = r"""SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(w, '[\p{P}\p{S}]*')) AS n_punct, count(*) AS n_words
FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) GROUP BY doc_id"""


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int")).alias("ids"))
    back = e.withColumn("s", text.token_text(F.col("ids"))).withColumns({"again": text.token_ids(F.col("s")), "parts": text.ids_of_tokens(text.split_tokens(F.col("s")))})
    return back.select("vec_id", F.size("again").alias("n"), (F.col("again") == F.col("ids")).alias("same"), (F.col("parts") == F.col("ids")).alias("same_parts"), F.aggregate("again", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


TOKEN_IDS = f"WITH {FRAMES} SELECT vec_id, 64::INT AS n, true AS same, true AS same_parts, CAST(sum(CAST(floor(abs(x) * 1000) AS BIGINT)) AS BIGINT) AS id_sum FROM frame GROUP BY vec_id"


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(text.split_paragraph(_quoted(F.col("text")), zh=False, length=F.char_length)).alias("pos", "sentence"))


def sentence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(text.cut_sentences(_quoted(F.col("text")), zh=False)).alias("pos", "sentence"))


def _quoted(t: Column) -> Column:
    """The text with a sentence of several marks and a closing quote put before it."""
    return F.concat(F.lit("“Hi!!” “No?”; "), t)


_SENTENCES = r"""d AS (SELECT doc_id, '“Hi!!” “No?”; ' || text AS t FROM documents),
e AS (SELECT doc_id, regexp_extract_all(regexp_replace(CASE WHEN regexp_matches(t, '[.?!;:]$') THEN t ELSE t || '.' END, '([.?!;:])[.?!;:]+', '\1', 'g'), '[^.?!;:]+[.?!;:]["”]?(?:[.?!;:]["”]?)*') AS s FROM d),
p AS (SELECT doc_id, i - 1 AS pos, s[i] AS s, regexp_extract(s[i], '^[^.?!;:]+[.?!;:]') AS h FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM e)),
sentence AS (SELECT doc_id, pos, h || regexp_replace(substr(s, length(h) + 1), '[.?!;:]', '', 'g') AS sentence FROM p)"""
SENTENCE_CUT = f"WITH {_SENTENCES} SELECT doc_id, CAST(pos AS INT) AS pos, sentence FROM sentence"
SENTENCE_SPLIT = f"""WITH RECURSIVE {_SENTENCES},
f AS (SELECT doc_id, pos, 0 AS piece, length(sentence) AS now FROM sentence WHERE pos = 0
  UNION ALL SELECT s.doc_id, s.pos, CASE WHEN now + length(sentence) > 80 AND now > 60 THEN piece + 1 ELSE piece END, CASE WHEN now + length(sentence) > 80 AND now > 60 THEN length(sentence) ELSE now + length(sentence) END
  FROM f JOIN sentence s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1),
z AS (SELECT doc_id, max(piece) AS last, arg_max(now, pos) AS size FROM f GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN piece = last AND last > 0 AND size < 20 THEN piece - 1 ELSE piece END AS INT) AS pos, string_agg(sentence, '' ORDER BY s.pos) AS sentence
FROM f JOIN sentence s USING (doc_id, pos) JOIN z USING (doc_id) GROUP BY ALL"""


def speech_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.normalize_for_speech(F.concat("text", F.lit(" 1234 items")))).alias("pos", "piece"))


def _words(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"


#: The benchmark's texts have no digits of their own and no Han characters.
SPEECH_PIECES = f"""WITH RECURSIVE {_SENTENCES.replace("'“Hi!!” “No?”; ' || text AS t FROM documents", "trim(text, ' ' || chr(10) || chr(9)) || ' one thousand, two hundred and thirty-four items' AS t FROM (SELECT item_id AS doc_id, text FROM benchmark)")},
f AS (SELECT doc_id, pos, 0 AS piece, sentence AS now FROM sentence WHERE pos = 0
  UNION ALL SELECT s.doc_id, s.pos, CASE WHEN {_words('now || sentence')} > 80 AND {_words('now')} > 60 THEN piece + 1 ELSE piece END, CASE WHEN {_words('now || sentence')} > 80 AND {_words('now')} > 60 THEN sentence ELSE now || sentence END
  FROM f JOIN sentence s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1),
z AS (SELECT doc_id, max(piece) AS last, {_words('arg_max(now, pos)')} AS size FROM f GROUP BY doc_id),
g AS (SELECT doc_id, CASE WHEN piece = last AND last > 0 AND size < 20 THEN piece - 1 ELSE piece END AS piece, string_agg(sentence, '' ORDER BY s.pos) AS s FROM f JOIN sentence s USING (doc_id, pos) JOIN z USING (doc_id) GROUP BY ALL)
SELECT doc_id AS item_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS INT) AS pos, s AS piece FROM g WHERE NOT regexp_full_match(s, '[\\p{{P}}\\p{{S}}]*')"""


def hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.hash_prefix(F.col("url")).alias("h"), text.basename(F.regexp_replace("url", "[?#].*$", "")).alias("name"), text.suffix_index(F.concat(F.lit("part_"), F.col("page_id").cast("string"))).alias("n"))


HASH_PREFIX = r"""SELECT page_id, left(md5(url), 8) AS h, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS name, CAST(page_id AS INT) AS n FROM pages"""


def clock_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.col("value") * 7.0).alias("label"), text.segment_name(F.col("event_id")).alias("name"))


CLOCK_LABEL = """WITH t AS (SELECT event_id, CAST(round_even(value * 7.0::DOUBLE * 10, 0) AS BIGINT) AS t FROM events)
SELECT event_id, printf('%d:%02d.%d', t // 600, (t // 10) % 60, t % 10) AS label, printf('seg_%04d', event_id + 1) AS name FROM t"""


def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rendered = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))), "")
    return c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.md5(rendered).alias("prompt_md5"))


CHAT_TEMPLATE = "SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS prompt_md5 FROM conversations GROUP BY conv_id"


def prev_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    translated = F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.lit(""))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("prev", F.lag(text.first_given(translated, F.col("text"))).over(w))
    return rows.select("conv_id", "turn", F.md5(text.chat_prompt(F.col("text"), "Japanese", "Chinese", F.col("prev"))).alias("prompt_md5"))


PREV_CONTEXT = """WITH p AS (SELECT conv_id, turn, text, lag(CASE WHEN turn % 2 = 0 THEN upper(role) ELSE text END) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, md5('<|im_start|>user' || chr(10) || CASE WHEN coalesce(prev, '') <> '' THEN 'Context: ' || prev || chr(10) || chr(10) ELSE '' END
  || 'Translate Japanese to Chinese:' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5 FROM p"""


def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three pairs from batches before the row's own, with batches of two turns."""
    c = table(spark, sf_dir, "conversations").withColumn("batch", F.floor(F.col("turn") / 2))
    # Three turns before the batch: a bounded frame, however long a conversation is.
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-4, -1)
    pairs = F.filter(F.array_sort(F.collect_list(F.struct("turn", "role", "batch")).over(w)), lambda x: (x["batch"] < F.col("batch")) & (x["turn"] >= F.col("batch") * 2 - 3))
    return c.withColumn("p", pairs).select("conv_id", "turn", F.array_join(F.transform("p", lambda x: F.concat(x["turn"].cast("string"), x["role"])), ",").alias("context"))


ROLLING_CONTEXT = """SELECT a.conv_id, a.turn, coalesce((SELECT string_agg(turn || role, ',' ORDER BY turn) FROM conversations b
  WHERE b.conv_id = a.conv_id AND b.turn // 2 < a.turn // 2 AND b.turn >= (a.turn // 2) * 2 - 3), '') AS context FROM conversations a"""


def size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuesheet.operators.aggregates import format_size

    return _docs(spark, sf_dir).select("doc_id", format_size(F.col("n_chars") * F.col("n_chars") * 4).alias("label"))


SIZE_LABEL = """WITH s AS (SELECT doc_id, n_chars * n_chars * 4 AS s FROM documents)
SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0::DOUBLE)
  ELSE printf('%.2f GB', s / 1073741824.0::DOUBLE) END AS label FROM s"""


# -- JSON --------------------------------------------------------------------------------------


def json_array_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.when(k % 4 == 0, F.concat(F.lit('```json\n["'), F.col("event_type"), F.lit('", "x"]\n```'))).when(k % 4 == 1, F.lit('["a", 1]')).when(k % 4 == 2, F.lit('so: ["a"] ok')).otherwise(F.lit("none"))
    out = e.withColumn("r", jsonio.json_array(raw, F.lit(2)))
    return out.select("event_id", F.array_join("r.ok", "+").alias("ok"), F.col("r.err").alias("err"))


JSON_ARRAY_VALIDATE = """WITH k AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) % 4 AS k FROM events)
SELECT event_id, CASE WHEN k = 0 THEN event_type || '+x' END AS ok, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'not a string' WHEN 2 THEN 'wrong length' ELSE 'no array' END AS err FROM k"""


def jsonl_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.lit("segment").alias("type"), F.col("event_type").alias("source"), F.col("value").alias("start")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.lit("tick").alias("ev"), F.col("user_id").cast("int").alias("done")))).otherwise(F.lit("not json"))
    return jsonio.messages(e.select("event_id", line.alias("value"))).select("event_id", "type", "ev", "source", "start", "done")


JSONL_UNION = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'segment' END AS type, CASE WHEN event_id % 3 = 1 THEN 'tick' END AS ev, CASE WHEN event_id % 3 = 0 THEN event_type END AS source,
  CASE WHEN event_id % 3 = 0 THEN value END AS start, CASE WHEN event_id % 3 = 1 THEN CAST(user_id AS INT) END AS done FROM events WHERE event_id % 3 < 2"""


def json_encode_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return jsonio.encode_batch(c, ["conv_id"], F.struct("turn", "role"), "turn")


JSON_ENCODE_BATCH = """SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS payload FROM conversations GROUP BY conv_id"""


def rl_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    r = jsonio.training_record(d, "train", "corpus", "text", "lang", "doc_id")
    return r.select("data_source", F.size("prompt").alias("n_prompt"), F.md5(F.col("prompt")[0]["content"]).alias("prompt_md5"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("idx"))


RL_RECORD = "SELECT 'corpus' AS data_source, CAST(2 AS INT) AS n_prompt, md5(text) AS prompt_md5, lang AS truth, doc_id AS idx FROM documents"


# -- arrays ------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _long(df: DataFrame, column: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("idx", "y")).select("vec_id", "idx", _u(F.col("y")).alias("y_u"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir).withColumn("o", arrays.l2_normalize(F.transform("v", lambda x: x * 3))), "o")


L2_NORMALIZE = f"WITH {FRAMES} SELECT vec_id, CAST(idx AS INT) AS idx, {_U.format('x * 3 / sqrt(sum(x * 3 * x * 3) OVER (PARTITION BY vec_id))')} AS y_u FROM frame"


def mean_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir).withColumn("o", arrays.mean_center(F.col("v"))), "o")


MEAN_CENTER = f"WITH {FRAMES} SELECT vec_id, CAST(idx AS INT) AS idx, {_U.format('x - avg(x) OVER (PARTITION BY vec_id)')} AS y_u FROM frame"


def peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir).withColumn("o", arrays.peak_normalize(F.transform("v", lambda x: x * 4))), "o")


PEAK_NORMALIZE = f"WITH {FRAMES} SELECT vec_id, CAST(idx AS INT) AS idx, {_U.format('x * 4 / greatest(1.0, max(abs(x * 4)) OVER (PARTITION BY vec_id))')} AS y_u FROM frame"


def pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", (F.col("n_chars") % 12).cast("int").alias("n"))
    m = d.withColumns({"mask": arrays.pad_mask(F.col("n"), F.lit(12)), "att": arrays.attention_mask(F.col("n"), F.lit(12)), "pad": arrays.pad_left(F.sequence(F.lit(0), F.col("n")), F.lit(14), F.lit(-1))})
    bits = F.array_join(F.transform("mask", lambda b: b.cast("int").cast("string")), "")
    return m.select("doc_id", bits.alias("mask"), F.aggregate("att", F.lit(0), lambda a, x: a + x).alias("n_seen"), F.size(F.filter("pad", lambda x: x == -1)).alias("n_pad"))


PAD_MASK = "SELECT doc_id, repeat('0', CAST(n_chars % 12 AS INT)) || repeat('1', CAST(12 - n_chars % 12 AS INT)) AS mask, CAST(n_chars % 12 AS INT) AS n_seen, CAST(13 - n_chars % 12 AS INT) AS n_pad FROM documents"


def chunk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    m = r.withColumn("m", arrays.chunk_mask((F.col("k") + 6).cast("int"), F.lit(3), 1)).select("k", F.posexplode("m").alias("i", "row"))
    return m.select("k", "i", F.array_join(F.transform("row", lambda b: b.cast("int").cast("string")), "").alias("bits"))


CHUNK_MASK = """WITH g AS (SELECT r_regionkey AS k, i, unnest(range(0, r_regionkey + 6)) AS j FROM (SELECT r_regionkey, unnest(range(0, r_regionkey + 6)) AS i FROM region))
SELECT k, CAST(i AS INT) AS i, string_agg(CASE WHEN j < (i // 3 + 1) * 3 AND j >= greatest((i // 3 - 1) * 3, 0) THEN '1' ELSE '0' END, '' ORDER BY j) AS bits FROM g GROUP BY k, i"""


def fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir).withColumn("o", arrays.linear_fades(F.col("v"), 20, 500)), "o")


FADES = f"WITH {FRAMES} SELECT vec_id, CAST(idx AS INT) AS idx, {_U.format('x * CASE WHEN idx < 10 THEN idx / 9.0::DOUBLE ELSE 1.0 END * CASE WHEN idx >= 54 THEN 1 - (idx - 54) / 9.0::DOUBLE ELSE 1.0 END')} AS y_u FROM frame"


def overlay_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label laid over a flat background, each at its own time."""
    e = table(spark, sf_dir, "embeddings")
    pieces = e.select("label", ((F.col("vec_id") % 40) * 1.5).alias("start"), F.col("embedding").alias("wave"))
    base = e.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(700))).alias("pos")).withColumn("x", F.lit(0.5))
    out = arrays.overlay(pieces, base, ["label"], 10)
    return out.select("label", F.col("pos").cast("int").alias("pos"), _u(F.col("x")).alias("x_u"))


OVERLAY_MIX = f"""WITH {FRAMES},
s AS (SELECT label, CAST((vec_id % 40) * 1.5::DOUBLE * 10 AS INT) + idx AS pos, sum(x) AS s FROM frame GROUP BY 1, 2),
n AS (SELECT label, pos, s / max(abs(s)) OVER (PARTITION BY label) * 0.85::DOUBLE AS s FROM s),
b AS (SELECT label, p AS pos FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(range(0, 701)) AS p)),
m AS (SELECT label, pos, coalesce(s, 0) + CASE WHEN b.pos IS NULL THEN 0 ELSE 0.5::DOUBLE END * CASE WHEN s IS NULL THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS x FROM b FULL JOIN n USING (label, pos)),
t AS (SELECT *, max(abs(x)) OVER (PARTITION BY label) AS m FROM m)
SELECT label, CAST(pos AS INT) AS pos, {_U.format('CASE WHEN m > 1 THEN x / m ELSE x END')} AS x_u FROM t"""


def interpolate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir).withColumn("o", arrays.interpolate(F.col("v"), F.lit(100))), "o")


INTERPOLATE_SERIES = """WITH g AS (SELECT vec_id, embedding, i, greatest((i + 0.5::DOUBLE) * (64 / 100.0::DOUBLE) - 0.5::DOUBLE, 0.0) AS x FROM (SELECT vec_id, embedding, unnest(range(0, 100)) AS i FROM embeddings)),
h AS (SELECT *, CAST(least(floor(x), 63) AS INT) AS lo FROM g)
SELECT vec_id, CAST(i AS INT) AS idx, CAST(floor((embedding[lo + 1]::DOUBLE * (1 - (x - lo)) + embedding[least(lo + 2, 64)]::DOUBLE * (x - lo)) * 1e6 + 0.5) AS BIGINT) AS y_u FROM h"""


def preference_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Four values are the log-probabilities of a pair: sixteen pairs a vector.
    e = _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("v", i * 4 + 1, 4))).alias("pair", "v"))
    v = F.col("v")
    return e.select("vec_id", "pair", _u(arrays.preference_loss(v[0], v[1], v[2], v[3], 0.1, 0.05)).alias("loss_u"), _u(arrays.preference_loss(v[0], v[1], v[2], v[3], 0.1, squared=True)).alias("ipo_u"), _u(arrays.reward(F.abs(v[0]))).alias("reward_u"))


_GAP = "((embedding[i * 4 + 1]::DOUBLE - embedding[i * 4 + 2]::DOUBLE) - (embedding[i * 4 + 3]::DOUBLE - embedding[i * 4 + 4]::DOUBLE))"
PREFERENCE_LOSS = f"""SELECT vec_id, CAST(i AS INT) AS pair, {_U.format(f'ln(1 + exp(-0.1::DOUBLE * {_GAP})) * 0.95::DOUBLE + ln(1 + exp(0.1::DOUBLE * {_GAP})) * 0.05::DOUBLE')} AS loss_u,
  {_U.format(f'pow({_GAP} - 5.0::DOUBLE, 2)')} AS ipo_u, {_U.format('greatest(0.0, least(1.0, 1 - tanh(3 * abs(embedding[i * 4 + 1]::DOUBLE))))')} AS reward_u FROM embeddings, (SELECT unnest(range(0, 16)) AS i)"""


def cross_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    w = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i + 1) / F.lit(8.0))
    return _long(v.withColumn("o", arrays.cross_fade(F.slice("v", 1, 32), F.slice("v", 33, 32), w)), "o")


CROSS_FADE = f"""SELECT vec_id, CAST(i AS INT) AS idx, {_U.format('CASE WHEN i < 4 THEN embedding[i + 1]::DOUBLE * ((i + 1) / 8.0::DOUBLE) + embedding[61 + i]::DOUBLE * ((i + 5) / 8.0::DOUBLE) ELSE embedding[i + 1]::DOUBLE END')} AS y_u
FROM (SELECT vec_id, embedding, unnest(range(0, 32)) AS i FROM embeddings)"""


def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _long(v.withColumn("o", arrays.overlap_add(F.array(*[F.slice("v", 16 * k + 1, 16) for k in range(4)]), 4)), "o")


OVERLAP_ADD = f"""WITH {FRAMES}, c AS (SELECT vec_id, idx // 16 * 12 + idx % 16 AS p, x * CASE WHEN idx >= 16 AND idx % 16 < 4 THEN idx % 16 / 3.0::DOUBLE ELSE 1 END * CASE WHEN idx < 48 AND idx % 16 >= 12 THEN 1 - (idx % 16 - 12) / 3.0::DOUBLE ELSE 1 END AS x FROM frame)
SELECT vec_id, CAST(p AS INT) AS idx, {_U.format('sum(x)')} AS y_u FROM c GROUP BY vec_id, p"""


def rate_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("step"))
    return s.select("step", *[_u(arrays.rate_curve(k, F.col("step"), 1.0, 30, 0.05, 5, 2.0)).alias(k) for k in ("warmup", "square", "squareroot", "cosine", "poly")])


RATE_CURVES = f"""WITH s AS (SELECT n_nationkey + 1 AS step FROM nation)
SELECT step, {_U.format('sqrt(5.0::DOUBLE) * least(pow(step, -0.5::DOUBLE), step * pow(5.0::DOUBLE, -1.5::DOUBLE))')} AS warmup, {_U.format('greatest(pow((30 - step) / 30.0::DOUBLE, 2), 0.05::DOUBLE)')} AS square,
  {_U.format('greatest(sqrt((30 - step) / 30.0::DOUBLE), 0.05::DOUBLE)')} AS squareroot,
  {_U.format('CASE WHEN step <= 5 THEN step / 5.0::DOUBLE ELSE 0.05::DOUBLE + 0.95::DOUBLE * 0.5::DOUBLE * (cos(pi() * (step - 5) / 30.0::DOUBLE) + 1) END')} AS cosine,
  {_U.format('0.95::DOUBLE * pow(1 - step / 30.0::DOUBLE, 2) + 0.05::DOUBLE')} AS poly FROM s"""


def voiced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    f0 = F.transform("v", lambda x: 160 + x * 100)
    p = F.transform("v", lambda x: F.abs(x) * 8)
    return v.select("vec_id", arrays.voice_label(f0, p, F.lit(2.0)).alias("who"))


VOICED_FRAMES = f"""WITH {FRAMES} SELECT vec_id, CASE WHEN count(x) FILTER (WHERE abs(x) * 8 > 0.7::DOUBLE) >= 2 THEN CASE WHEN median(160 + x * 100) FILTER (WHERE abs(x) * 8 > 0.7::DOUBLE) >= 165 THEN 'female' ELSE 'male' END END AS who FROM frame GROUP BY vec_id"""

_NAMES = [
    clean_translation, clean_commentary, keyword_rows, normalize_text, punct_only, token_ids, sentence_split, sentence_cut, speech_pieces, hash_prefix, clock_label, chat_template, prev_context, rolling_context, size_label,
    json_array_validate, jsonl_union, json_encode_batch, rl_record,
    l2_normalize, mean_center, peak_normalize, pad_mask, chunk_mask, fades, overlay_mix, interpolate_series, preference_loss, cross_fade, overlap_add, rate_curves, voiced_frames,
]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
