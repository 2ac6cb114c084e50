"""Literal cases of the text, JSON and array functions."""

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import arrays, jsonio, text


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, v if not isinstance(v, (str, int, float)) else F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("<|im_start|>你好<|im_end|>", "你好"),
        ("你好（粗俗语）", "你好"),
        ("翻译：你好", "你好"),
        ("原文\n翻译：你好", "你好"),
        ("你好 解释：这是", "你好"),
        ("Note: x", ""),
        ("你好。。。。。。", "你好。"),
        ("\n\n1. 你好\n再见", "你好"),
        ("②你好", "你好"),
        ("参考：上文\n你好", "你好"),
        ("将以下日文翻译为中文：你好", "你好"),
        ("", ""),
    ],
)
def test_commentary(spark, raw, expected):
    assert one(spark, text.clean_commentary(F.col("t")), t=raw) == expected


@pytest.mark.parametrize(
    "raw, original, expected",
    [("  你好<br/> ", "", "你好"), ("你好<|im_end|>", "", "你好"), ("原文：x", "", ""), ("这个词语的意思是", "", ""), ("x" * 61, "y" * 10, ""), ("x" * 61, "y" * 11, "x" * 61), ("你好<|im_start|>more", "", "你好")],
)
def test_translation(spark, raw, original, expected):
    assert one(spark, text.extract_translation(F.col("t"), F.col("o")), t=raw, o=original) == expected


def test_small_rules(spark):
    assert one(spark, text.only_punctuation(F.col("t")), t="") is True
    assert one(spark, text.only_punctuation(F.col("t")), t="。！") is True
    assert one(spark, text.only_punctuation(F.col("t")), t="a!") is False
    assert one(spark, text.replace_blank(F.col("t")), t="你 好 a b 你 a") == "你好a b你a"
    assert one(spark, text.remove_bracket(text.replace_corner_mark(F.col("t"))), t="10²（注）——`x") == "10平方注 x"
    assert one(spark, text.contains_han(F.col("t")), t="a中") is True
    assert one(spark, text.count_han(F.col("t")), t="a中文b") == 2
    assert one(spark, text.normalize_transcript(F.col("t")), t="he llo<sil>，Ａ!") == "HELLOA"
    assert one(spark, text.spell_out_numbers(F.col("t")), t="a 1234 and 100, 0") == "a one thousand, two hundred and thirty-four and one hundred, zero"
    assert one(spark, text.token_ids(F.col("t")), t="<|s_12|><|s_7|>x") == [12, 7]
    assert one(spark, text.ids_of_tokens(text.split_tokens(F.col("t"))), t="<|s_1|><|x|><|s_2|>") == [1, 2]
    assert one(spark, text.unix_path(F.col("t")), t="C:\\foo\\bar") == "/mnt/c/foo/bar"
    assert one(spark, text.stem(F.col("t")), t="/a/b.c.wav") == "b.c"
    assert one(spark, text.clock(F.col("t")), t=125.25) == "2:05.2"
    assert one(spark, text.first_given(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, text.percent_done(F.col("t")), t=" 40%|## | 4/10 [3it/s]") == 40
    assert one(spark, text.out_time_share(F.col("t"), F.lit(2.0)), t="out_time_ms=1000000") == 0.5
    assert one(spark, text.split_escaped(F.col("t"), ","), t="a\\,b,c") == ["a,b", "c"]
    assert one(spark, text.fill_template(F.col("t"), {"n": "5"}), t="x $n ${n} $nn $m") == "x 5 5 $nn $m"
    assert one(spark, text.all_parts(F.col("t"), ["sakura", "qwen"]), t="Sakura-Qwen2") is True
    assert one(spark, text.half_even(F.col("t"), 2), t=0.125) == 0.12


def split_by_loop(t, zh, most=80, least=60, merge=20):
    marks = "。？！；：、.?!;" if zh else ".?!;:"
    if t[-1] not in marks:
        t += "。" if zh else "."
    out, start = [], 0
    for i, c in enumerate(t):
        if c in marks:
            if t[start:i]:
                out.append(t[start:i] + c)
                if i + 1 < len(t) and t[i + 1] in '"”':
                    out[-1] += t[i + 1]
                    i += 1
            start = i + 1
    done, now = [], ""
    for u in out:
        if len(now + u) > most and len(now) > least:
            done.append(now)
            now = ""
        now += u
    if now:
        if len(now) < merge and done:
            done[-1] += now
        else:
            done.append(now)
    return done


@pytest.mark.parametrize("t", ["你好。再见！", "一" * 70 + "。" + "二" * 30 + "。三。", "无标点", "“你好。”他说。", "一" * 100 + "。" + "二" * 10])
def test_paragraphs(spark, t):
    assert one(spark, text.split_paragraph(F.col("t")), t=t) == split_by_loop(t, True)


def test_speech_text(spark):
    assert one(spark, text.normalize_for_speech(F.col("t")), t="有 10 个\n苹果.") == ["有10个苹果。"]
    assert one(spark, text.normalize_for_speech(F.col("t")), t="I have 2 cats") == ["I have two cats."]
    assert one(spark, text.normalize_for_speech(F.col("t")), t="<|en|> 2") == ["<|en|> 2"]
    assert one(spark, text.normalize_for_speech(F.col("t")), t="") == [""]


@pytest.mark.parametrize(
    "raw, n, ok, err",
    [
        ('```json\n["a", "b"]\n```', 2, ["a", "b"], None),
        ('["a", 1]', 2, None, "not a string"),
        ('["a"]', 2, None, "wrong length"),
        ('here: ["a", "b"] done', 2, ["a", "b"], None),
        ("nothing", 2, None, "no array"),
        ('["a", ]', 1, None, "not json"),
        ('["a", ""]', 2, None, "empty item"),
        ("[]", 0, [], None),
        ("] [", 1, None, "no array"),
    ],
)
def test_json_array(spark, raw, n, ok, err):
    got = one(spark, jsonio.json_array(F.col("t"), F.lit(n)), t=raw)
    assert (got.ok, got.err) == (ok, err)


def test_project_round_trip(spark):
    doc = one(spark, jsonio.decode_project(F.col("t")), t='{"name":"中","steps":{"a":"done"}}')
    assert doc.name == "中" and doc.steps == {"a": "done"} and doc.history == [] and doc.step_data == {}
    again = one(spark, jsonio.decode_project(jsonio.encode_project(jsonio.decode_project(F.col("t")))), t='{"name":"中"}')
    assert again.name == "中"
    assert one(spark, jsonio.merge_objects(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}


def vector(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_arrays(spark):
    assert one(spark, arrays.l2_normalize(vector(3, 4))) == [0.6, 0.8]
    assert one(spark, arrays.l2_normalize(vector(0, 0))) == [0.0, 0.0]
    assert one(spark, arrays.peak_normalize(vector(2, -4))) == [0.5, -1.0]
    assert one(spark, arrays.pad_to_multiple(vector(1, 2, 3), 2)) == [1, 2, 3, 0]
    assert one(spark, arrays.pad_mask(F.lit(2), F.lit(4))) == [False, False, True, True]
    assert one(spark, arrays.pad_mask(F.lit(0), F.lit(0))) == []
    assert one(spark, arrays.causal_mask(F.lit(2))) == [[True, False], [True, True]]
    assert one(spark, arrays.downmix(F.array(vector(1, 3), vector(3, 5)))) == [2, 4]
    assert one(spark, arrays.interpolate(vector(0, 1), F.lit(4))) == [0.0, 0.25, 0.75, 1.0]
    assert one(spark, arrays.overlap_add(F.array(vector(1, 1, 1), vector(0, 0, 0)), 2)) == [1, 1, 0, 0]
    assert one(spark, arrays.unpad_concat([(vector(1, 0), F.lit(1)), (vector(2, 3), F.lit(2))], F.lit(4), F.lit(-1.0))) == [1, 2, 3, -1]
    assert one(spark, arrays.from_pcm16(arrays.to_pcm16(vector(0.5, -1, 2)))) == [0.5, -1.0, 32767 / 32768]
    assert one(spark, arrays.voice_label(vector(100, 200, 300), vector(0.9, 0.9, 0.1), F.lit(2.0))) == "male"
    assert one(spark, arrays.voice_label(vector(100, 200), vector(0.9, 0.9), F.lit(1.0))) is None
    assert one(spark, arrays.progress(F.lit(5.0), F.lit(10.0))) == 50
    assert one(spark, arrays.padded_samples(F.lit(2.0), F.lit("abcd"), F.lit("ab"), 10, 2)) == 40
    assert one(spark, arrays.even_size(F.lit(15), 2)) == 8
    assert tuple(one(spark, arrays.square_crop(F.lit(10), F.lit(20), F.lit(10), F.lit(30), F.lit(100), F.lit(30)))) == (1, 29, 6, 30)
