"""Text cleaning, normalising, splitting and formatting: Column to Column, JVM-side wherever that can be said.

Null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The chat markup of the models whose output is cleaned.
CHAT_USER = "<|im_start|>user"
CHAT_ASSISTANT = "<|im_start|>assistant"
CHAT_END = "<|im_end|>"
CHAT_TOKENS = r"<\|im_start[\|>]*|<\|im_end[\|>]*|</?im_start>|</?im_end>"

# Words that show an explanation in place of a translation.
EXPLANATIONS = (
    "文法", "这个表达", "这个词语", "这个单词", "这个句子", "这个词", "この表現", "この言葉", "この単語",
    "意思是", "语义不明", "意味不明", "语意不明", "可以翻译成", "翻译成", "通常使用", "通常、この",
    "注意してください", "以下の点", "テンプレート",
)

# Markers of commentary, in the order in which they are looked for.
LABEL_MARKERS = ("解释：", "说明：", "备注：", "注意：", "注：", "翻译：", "翻译结果", "译文：")
MARKERS = (*LABEL_MARKERS, "Explanation:", "Note:", "Translation:", "（", "(", "【")
HEADER_MARKERS = ("翻译：", "译文：", "翻译结果")
HEADER_LINE = r"(?im)^\s*(Translation|翻译|解释|说明|备注|注意|Note|Explanation|参考前文|参考|示例)[：:]\s*.*$"
INSTRUCTION_LINE = r"(?m)^\s*将以下(日文|日语|文本).*?(翻译|润色).*?[：:]\s*"
NUMBERING = r"^\s*(?:\d+[\.\)、．]\s*|[①②③④⑤⑥⑦⑧⑨⑩]|[一二三四五六七八九十]+[\.\)、．]\s*)"

# Marks that a normalised transcript does not have.
TRANSCRIPT_TAGS = ("<sil>", "<%>", "<->", "<$>", "<#>", "<_>", "<space>", "`", "&", ",")
FULL_WIDTH = {"Ａ": "A", "ａ": "A", "ｂ": "B", "ｃ": "C", "ｋ": "K", "ｔ": "T"}
CJK_PUNCTUATION = (
    "＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､　、〃〈〉《》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏﹑﹔·！？｡。"
)
CLOSING_QUOTES = ('"', "”")
ENDS_ZH = "。？！；：、.?!;"
ENDS_EN = ".?!;:"
QUOTES_AND_BRACKETS = "\"()“”‘（）'"


def strip(text: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_chat_tokens(text: Column) -> Column:
    return strip(F.regexp_replace(text, CHAT_TOKENS, ""))


def extract_translation(raw: Column, original: Column | None = None) -> Column:
    """The translation in a model's answer; empty if it echoes the source or explains instead.

    Markup goes first, then what follows a chat marker. An answer over 60 characters and over 6 times as
    long as the original counts as an explanation.
    """
    t = F.regexp_replace(strip(raw), r"<br\s*/?>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"</?im_start>", ""), r"<\|im_end[\|>]*", "")
    for suffix in (CHAT_ASSISTANT, CHAT_USER):
        t = strip(F.regexp_replace(t, r"\Q" + suffix + r"\E$", ""))
    t = strip(F.substring_index(t, "<|im_start|>", 1))
    explained = F.lit(False)
    for mark in EXPLANATIONS:
        explained = explained | F.contains(t, F.lit(mark))
    bad = F.startswith(t, F.lit("原文：")) | F.startswith(t, F.lit("原文:")) | explained
    if original is not None:
        bad = bad | ((F.char_length(original) > 0) & (F.char_length(t) > 60) & (F.char_length(t) > 6 * F.char_length(original)))
    return F.when(bad, F.lit("")).otherwise(t)


def clean_commentary(raw: Column) -> Column:
    """The first line of a model's answer that says something, without commentary, markers or numbering."""
    t = F.regexp_replace(strip(raw), CHAT_TOKENS, "")
    t = F.regexp_replace(t, "[（(][^)）]*[)）]", "")
    marks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(m in LABEL_MARKERS).alias("label"), F.lit(m in HEADER_MARKERS).alias("header")) for m in MARKERS])

    def cut(acc: Column, mark: Column) -> Column:
        at = F.call_function("instr", acc, mark["m"])
        after = F.substr(acc, at + F.char_length(mark["m"]))
        tail = F.regexp_replace(after, "^[：: \t]+", "")
        head = F.substr(acc, F.lit(1), at - 1)
        return (
            F.when(at == 0, acc)
            .when((at == 1) & mark["label"], F.regexp_replace(after, "^[：: ]+", ""))
            .when((at > 1) & mark["header"] & (F.substr(acc, at - 1, F.lit(1)) == "\n") & (tail != ""), tail)
            .when(at > 1, head)
            .otherwise(acc)
        )

    t = F.aggregate(marks, t, cut)
    t = F.regexp_replace(F.regexp_replace(t, HEADER_LINE, ""), INSTRUCTION_LINE, "")
    t = F.regexp_replace(t, r"([。！？….!?])\1{4,}$", "$1")
    t = strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    lines = F.transform(F.split(t, r"\R"), lambda x: strip(F.regexp_replace(strip(x), NUMBERING, "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.when(raw.isNotNull(), F.lit("")))


def contains_han(text: Column) -> Column:
    return F.rlike(text, F.lit("[一-鿿]"))


def much_shorter(text: Column, prompt: Column, share: float = 0.5) -> Column:
    """Whether a text has less than `share` of its prompt's characters, so that speech from it may be poor."""
    return F.char_length(text) < share * F.char_length(prompt)


def answer_or_blank(text: Column, answer: Column) -> Column:
    """The answer to a text; blank text has an empty one and asks nothing."""
    return F.when(strip(text) == "", F.lit("")).otherwise(answer)


def token_rows(df, column: str, token: str = "token", place: str = "place"):
    """df with a row per token, the pieces between white space, and its place; texts without one give none."""
    return df.select("*", F.posexplode(F.filter(F.split(strip(F.col(column)), r"\s+"), lambda t: t != "")).alias(place, token))


def count_han(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^一-鿿]", ""))


def least_duration(text: Column) -> Column:
    """The shortest plausible spoken length of a text, in seconds."""
    return count_han(text) * 0.10 + 0.3


def replace_corner_mark(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("²"), F.lit("平方")), F.lit("³"), F.lit("立方"))


def remove_bracket(text: Column) -> Column:
    return F.replace(F.translate(text, "（）【】`", ""), F.lit("——"), F.lit(" "))


def replace_blank(text: Column) -> Column:
    """Keep a space only between two ASCII characters that are no spaces."""
    return F.regexp_replace(text, r"(?<![\x00-\x1F\x21-\x7F]) | (?![\x00-\x1F\x21-\x7F])", "")


def only_punctuation(text: Column) -> Column:
    """Whether all characters are punctuation or symbols; true for the empty text."""
    return F.rlike(text, F.lit(r"^[\p{P}\p{S}]*\z"))


def remove_punctuation(text: Column) -> Column:
    """Without ASCII and CJK punctuation, apostrophes aside."""
    return F.translate(text, "".join(dict.fromkeys(c for c in CJK_PUNCTUATION + string.punctuation if c != "'")), "")


def normalize_transcript(text: Column) -> Column:
    """For error rates: no spaces, tags or punctuation; upper case if any Latin letter; full-width letters folded."""
    t = F.translate(text, "  ", "")
    for tag in TRANSCRIPT_TAGS:
        t = F.replace(t, F.lit(tag), F.lit(""))
    t = F.when(F.rlike(t, F.lit("[a-zA-Z]")), F.upper(t)).otherwise(t)
    t = F.translate(t, "".join(FULL_WIDTH) + "，丶。、？", "".join(FULL_WIDTH.values()))
    return remove_punctuation(t)


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
_GROUPS = ["", " thousand", " million", " billion", " trillion", " quadrillion"]


def number_words(n: int) -> str:
    """English words of a number below 10^18: `one thousand, two hundred and thirty-four`."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_ONES[n // 100]} hundred" + (f" and {number_words(n % 100)}" if n % 100 else "")
    parts, rest, i = [], n, 0
    while rest:
        rest, part = divmod(rest, 1000)
        if part:
            parts.append((part, i))
        i += 1
    words = [number_words(p) + _GROUPS[i] for p, i in reversed(parts)]
    low, place = parts[0]
    if place == 0 and low < 100:
        return ", ".join(words[:-1]) + " and " + words[-1]
    return ", ".join(words)


@F.pandas_udf(T.StringType())
def spell_out_numbers(text: pd.Series) -> pd.Series:
    """Runs of digits as English words; runs over 18 digits are spelled digit by digit."""
    import re

    def words(m) -> str:
        return number_words(int(m[0])) if len(m[0]) <= 18 else " ".join(_ONES[int(c)] for c in m[0])

    return text.map(lambda t: None if t is None else re.sub("[0-9]+", words, t))


def cut_sentences(text: Column, zh: bool = True, commas: bool = False) -> Column:
    """Sentences with their end mark, and a closing quote that follows it; a missing last mark is added.

    An empty text has none. A mark with nothing before it is no sentence: it goes, and a quote after it closes
    the sentence before.
    """
    ends = (ENDS_ZH if zh else ENDS_EN) + ("，," if commas else "")
    klass = "[" + "".join("\\" + c if c in ".?" else c for c in ends) + "]"
    rest = "[^" + klass[1:]
    done = F.when(F.rlike(text, F.lit(klass + r"\z")), text).otherwise(F.concat(text, F.lit("。" if zh else ".")))
    # Of a run of marks the first counts.
    single = F.regexp_replace(done, f"({klass}){klass}+", "$1")
    found = F.regexp_extract_all(single, F.lit(f"(?s)({rest}+{klass}[\"”]?(?:{klass}[\"”]?)*)"), F.lit(1))
    whole = F.transform(found, lambda s: F.regexp_replace(s, f"(?<={klass}[\"”])([\"”]*){klass}", "$1"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def pack_sentences(sentences: Column, length=F.char_length, most: int = 80, least: int = 60, merge: int = 20) -> Column:
    """Sentences packed greedily: a piece ends when the next would make it over `most` and it is over `least` already.

    A last piece under `merge` joins the one before. `length` measures a piece.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        flush = (length(F.concat(acc["now"], s)) > most) & (length(acc["now"]) > least)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(flush, s).otherwise(F.concat(acc["now"], s)).alias("now"),
        )

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["done"], -1), acc["now"])))
        return F.when(acc["now"] == "", acc["done"]).when((length(acc["now"]) < merge) & (n > 0), joined).otherwise(F.concat(acc["done"], F.array(acc["now"])))

    return F.aggregate(sentences, start, step, finish)


def word_count(text: Column) -> Column:
    """Words between blanks: the token count of a text when no tokenizer is given."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def split_paragraph(text: Column, zh: bool = True, length=None, most: int = 80, least: int = 60, merge: int = 20, commas: bool = False) -> Column:
    """Sentences cut and packed; Chinese text is measured in characters, other text in words unless `length` is given."""
    return pack_sentences(cut_sentences(text, zh, commas), length or (F.char_length if zh else word_count), most, least, merge)


def normalize_for_speech(text: Column, split: bool = True, frontend: bool = True) -> Column:
    """Pieces of a text as a speech model reads them, without those of punctuation only.

    Without `split` the whole normalised text is one piece; without `frontend` the text is left as it is.
    Text with markup (`<|` and `|>`) is left alone. Chinese text loses line ends, needless blanks, brackets and
    corner marks; other text gets its numbers spelled out.
    """
    if not frontend:
        return F.array(text)
    t = strip(text)
    zh = remove_bracket(F.replace(F.replace(replace_corner_mark(replace_blank(F.replace(t, F.lit("\n"), F.lit("")))), F.lit("."), F.lit("。")), F.lit(" - "), F.lit("，")))
    zh = F.regexp_replace(zh, "[，,、]+$", "。")
    marked = F.contains(text, F.lit("<|")) & F.contains(text, F.lit("|>"))
    if not split:
        return F.array(F.when(marked | (text == ""), text).when(contains_han(t), zh).otherwise(spell_out_numbers(t)))
    pieces = F.when(contains_han(t), split_paragraph(zh, True)).otherwise(split_paragraph(spell_out_numbers(t), False))
    kept = F.filter(pieces, lambda p: ~only_punctuation(p))
    return F.when(marked | (text == ""), F.array(text)).otherwise(kept)


def token_ids(text: Column) -> Column:
    """The numbers of all <|s_N|> in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<\|s_(\d+)\|>"), F.lit(1)), lambda x: x.cast("int"))


def token_text(ids: Column) -> Column:
    """The inverse of token_ids."""
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<|s_"), x.cast("string"), F.lit("|>"))), "")


def ids_of_tokens(tokens: Column) -> Column:
    """The numbers of an array of tokens; any that is not <|s_N|> is left out."""
    good = F.filter(tokens, lambda t: F.rlike(t, F.lit(r"^<\|s_\d+\|>$")))
    return F.transform(good, lambda t: F.regexp_extract(t, r"(\d+)", 1).cast("int"))


def unexpected_tokens(tokens: Column) -> Column:
    """What ids_of_tokens leaves out."""
    return F.filter(tokens, lambda t: ~F.rlike(t, F.lit(r"^<\|s_\d+\|>$")))


def split_tokens(text: Column) -> Column:
    """The <...> pieces of a text of tokens that stand side by side."""
    return F.regexp_extract_all(text, F.lit("(<[^<>]*>)"), F.lit(1))


def remove_tags(text: Column, tags: tuple[str, ...] = ("[FIL]", "[SPK]")) -> Column:
    for tag in tags:
        text = F.replace(text, F.lit(tag), F.lit(""))
    return text


def strip_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES_AND_BRACKETS, "")


def unix_path(path: Column) -> Column:
    """A Windows path as it is mounted under /mnt; others with their slashes turned."""
    drive = F.concat(F.lit("/mnt/"), F.lower(F.substring(path, 1, 1)), F.replace(F.substr(path, F.lit(3)), F.lit("\\"), F.lit("/")))
    return F.when(F.substring(path, 2, 1) == ":", drive).otherwise(F.replace(path, F.lit("\\"), F.lit("/")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix_index(label: Column) -> Column:
    """The number after the last underscore; null without one."""
    found = F.regexp_extract(label, r"_(\d+)$", 1)
    return F.when(found != "", found.cast("int"))


def speaker_of(utt: Column) -> Column:
    return F.substring_index(utt, "_", 1)


def hash_prefix(text: Column, n: int = 8) -> Column:
    return F.substring(F.md5(text), 1, n)


def has_words(text: Column, words: list[str]) -> Column:
    """Whether any word is a part of the text, both in lower case."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w.lower()))
    return F.coalesce(found, F.lit(False))


def all_parts(text: Column, parts: list[str]) -> Column:
    """Whether all parts occur in the text in lower case; null counts as no."""
    found = F.lit(True)
    for p in parts:
        found = found & F.contains(F.lower(text), F.lit(p))
    return F.coalesce(found, F.lit(False))


def percent_done(line: Column) -> Column:
    """The number before the first % of a progress line that also names a rate; else null."""
    found = F.regexp_extract(line, r"([0-9.]+)\s*%", 1)
    return F.when(F.contains(line, F.lit("it/s")) & (found != ""), F.try_to_number(found, F.lit("999999.9999")).cast("int"))


def out_time_share(line: Column, total_s: Column) -> Column:
    """The share done that an out_time_ms line (microseconds, by name) reports, at most 1; else null."""
    found = F.regexp_extract(line, r"^out_time_ms=(\d+)", 1)
    return F.when((found != "") & (total_s > 0), F.least(found.cast("double") / 1e6 / total_s, F.lit(1.0)))


def clock(seconds: Column) -> Column:
    """m:ss.s, rounded half to even; minutes do not wrap."""
    tenths = F.rint(seconds * 10).cast("bigint")
    return F.format_string("%d:%02d.%d", F.floor(tenths / 600).cast("bigint"), F.floor(tenths / 10).cast("bigint") % 60, tenths % 10)


def segment_name(idx: Column) -> Column:
    return F.format_string("seg_%04d", (idx + 1).cast("bigint"))


def chat_prompt(text: Column, source: str, target: str, context: Column | None = None) -> Column:
    """The prompt that asks for a translation, with the context before it if there is one."""
    ask = F.lit(f"Translate {source} to {target}:")
    if context is not None:
        ask = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context, F.lit("\n\n"), ask)).otherwise(ask)
    return F.concat(F.lit(f"{CHAT_USER}\n"), ask, F.lit("\n"), text, F.lit(f"{CHAT_END}\n{CHAT_ASSISTANT}\n"))


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def split_escaped(text: Column, delimiter: str) -> Column:
    """Parts between delimiters that no backslash escapes, unescaped."""
    d = "\\" + delimiter
    parts = F.regexp_extract_all(F.concat(text, F.lit(delimiter)), F.lit(rf"(?s)((?:\\.|[^\\{d}])*){d}"), F.lit(1))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1"))


def fill_template(template: Column, values: dict[str, str]) -> Column:
    """The template with each $name or ${name} replaced; names that it lacks are an error, others stay."""
    for name in values:
        template = F.when(F.contains(template, F.lit(name)), template).otherwise(F.raise_error(F.lit(f"no {name} in the template")))
    for name, value in values.items():
        safe = value.replace("\\", "\\\\").replace("$", "\\$")
        template = F.regexp_replace(template, rf"\$(?:{name}(?![A-Za-z0-9_])|\{{{name}\}})", safe)
    return template


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded half to even on the decimal expansion: the closest built-in to what Python's round does."""
    return F.rint(x) if digits == 0 else F.bround(x, digits)
